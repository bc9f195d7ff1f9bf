"""Helpers that several corpus operators share: shared-folder tables and connected components."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILTER_BITS = 1 << 27
RELEASE_SECONDS = 0.5
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
_OWN_ROOTS: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where none is configured and all runs in this process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = _OWN_ROOTS.get(spark.sparkContext.applicationId) or "file://" + tempfile.mkdtemp(prefix="ridgeline-")
        _OWN_ROOTS[spark.sparkContext.applicationId] = root
    return root.rstrip("/")


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of at most BATCH_ROWS rows and BATCH_BYTES bytes for what is run inside; settings that are smaller stay."""
    before = {}
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            before[name] = now
            spark.conf.set(name, str(most))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Intermediate tables in the shared folder.

    A written table cuts lineage: a lost executor costs its running tasks, not
    the stages before. `drop` deletes tables that no later plan reads;
    the rest goes when the driver ends.
    """

    released = 0.0

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name = spark, name

    def path(self) -> str:
        """A new folder, which goes when the driver ends."""
        path = f"{checkpoint_root(self.spark)}/ridgeline/{self.name}-{uuid.uuid4().hex}"
        atexit.register(_forget, self.spark, path)
        return path

    def table(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = self.path()
        with small_batches(self.spark):
            df.write.parquet(path)
        self.release()
        return self.spark.read.schema(df.schema).parquet(path), path

    def keep(self, df: DataFrame) -> DataFrame:
        return self.table(df)[0]

    def drop(self, *paths: str) -> None:
        for path in paths:
            _delete(self.spark, path)

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of plans that are done, from time to time."""
        if time.monotonic() - Scratch.released >= RELEASE_SECONDS:
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            Scratch.released = time.monotonic()


def text_digest(text: Column) -> Column:
    """Tells the texts of rows that share an id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _forget(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # noqa: BLE001  the session is gone; the folder's owner cleans up
        return


def _bit(rows: DataFrame, key: Column, ids: DataFrame) -> tuple[DataFrame, Column]:
    """`rows` with the bits, and whether the key's bit is set: false for keys that aren't in the one column of `ids`, nearly always."""
    place = lambda x: F.pmod(F.xxhash64(x.cast("long")), F.lit(FILTER_BITS))
    held = ids.select(place(F.col(ids.columns[0])).alias("place"))
    bits = held.groupBy(F.shiftright("place", 15).alias("__bucket")).agg(F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit(32767))).alias("__bits"))
    at = place(key)
    within = at.bitwiseAND(F.lit(32767))
    byte = F.ascii(F.decode(F.substring(F.col("__bits"), (F.shiftright(within, 3) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
    may = F.coalesce(F.getbit(byte, within.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    return rows.join(F.broadcast(bits), F.shiftright(at, 15) == F.col("__bucket"), "left"), may


def split_by_ids(docs: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(some, rest): rows of `docs` whose key may be in the one column of `ids`, and rows whose key is not.

    A bit for each of FILTER_BITS hashes says whether any id has it. The bits are
    4 KB rows, at most 16 MB together however many ids there are, so they are sent to
    all tasks, and only `some` has to meet the ids in a shuffle. Beyond tens of
    millions of ids the bits fill up and `some` nears all of `docs`; results
    stay the same. Rows with a null key may be in either part.
    """
    known, may = _bit(docs, docs[key], ids)
    return known.where(may).select(docs.columns), known.where(~may).select(docs.columns)


def perhaps_in(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key may be in the one column of `ids`: few others are left to meet the ids in a shuffle."""
    return split_by_ids(rows, key, ids)[0]


def connected_components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (a long, b long); component is the smallest node reachable.

    Alternating large-star and small-star rounds: each links nodes to the
    smallest neighbour through a map-side combined minimum and a join that AQE may
    split at hot nodes, so no task holds the neighbours of a node. Rounds grow
    with the logarithm of the diameter. Self loops and null ends are ignored;
    no edges give an empty result.
    """
    spark = edges.sparkSession
    links, path = scratch.table(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    for _ in range(most_rounds):
        if _are_stars(links):
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that the join reads it from its own exchange and AQE can split a hot node.
        lowest, lowest_path = scratch.table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        small = small.select(F.col("m").alias("a"), F.col("u").alias("b")).unionByName(
            small.where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
        )
        links, new_path = scratch.table(small.distinct())
        scratch.drop(path, lowest_path)
        path = new_path
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    # Settled links are stars around each component's smallest node.
    found = links.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return found.unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _are_stars(links: DataFrame) -> bool:
    """Whether each larger end has one link, and none of them is a smaller end: nothing is left to contract."""
    ends = links.select(F.col("a").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(links.select(F.col("b").alias("x"), F.lit(0).alias("low"), F.lit(1).alias("high")))
    roles = ends.groupBy("x").agg(F.max("low").alias("low"), F.sum("high").alias("high"))
    return roles.where((F.col("high") > 1) | ((F.col("high") == 1) & (F.col("low") == 1))).isEmpty()
