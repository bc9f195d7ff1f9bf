"""Prepared areas, jobs, logs and reports as files.

An entry is a folder `areas/<key>` with Parquet tables and a manifest that is
written last: a folder without one isn't an entry. All paths go through Spark
or Hadoop's file system, so any store will do.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgeline.operators.areas import stale_siblings

SCHEMA_VERSION = 1
MANIFEST = "key string, schema_version int, generation string, area string, policy string, dem_version string, created_at string"
JOB = "job_id string, status string, updated string, kind string, params string"


class CorruptEntry(ValueError):
    """An entry that can't be read: prepare it again."""


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside the target and renames over it: readers see the old text or the new one."""
    fs, target = _path(spark, path)
    _, beside = _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(target), options)


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    write_text(spark, path, json.dumps(value, sort_keys=True))


def write_entry(spark: SparkSession, root: str, key: str, tables: dict[str, DataFrame], manifest: dict) -> None:
    """Tables go to a folder of their own, and the manifest that names it makes them the entry's: readers see the old tables or
    the new ones, never some of both. Then older folders of the entry go."""
    generation = uuid.uuid4().hex
    for name, table in tables.items():
        table.write.mode("error").parquet(f"{root}/areas/{key}/{generation}/{name}")
    write_json(spark, f"{root}/areas/{key}/manifest.json", manifest | {"key": key, "schema_version": SCHEMA_VERSION, "generation": generation})
    fs, folder = _path(spark, f"{root}/areas/{key}")
    for status in fs.listStatus(folder):
        if status.isDirectory() and status.getPath().getName() != generation:
            fs.delete(status.getPath(), True)


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """Manifests of all entries by key; those that can't be read are left out."""
    fs, folder = _path(spark, f"{root}/areas")
    if not fs.exists(folder) or not fs.listStatus(folder):
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{root}/areas/*/manifest.json")
    return rows.where(F.col("key").isNotNull() & (F.col("schema_version") == SCHEMA_VERSION)).orderBy("key")


def rebuild_index(spark: SparkSession, root: str) -> int:
    """Writes the index file, one manifest a line by key, and returns their number. A catalogue of entries is small."""
    rows = [json.dumps(r.asDict(), sort_keys=True) for r in read_index(spark, root).collect()]
    write_text(spark, f"{root}/index.jsonl", "".join(f"{r}\n" for r in rows))
    return len(rows)


def read_entry(spark: SparkSession, root: str, key: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    found = read_index(spark, root).where(F.col("key") == key).first()
    if found is None:
        raise CorruptEntry(f"{key}: no manifest of this schema version")
    return {name: spark.read.parquet(f"{root}/areas/{key}/{found['generation']}/{name}") for name in names}


def drop_entries(spark: SparkSession, root: str, keys: list[str]) -> None:
    for key in keys:
        fs, target = _path(spark, f"{root}/areas/{key}")
        fs.delete(target, True)


def collect_superseded(spark: SparkSession, root: str, key: str) -> list[str]:
    """Removes the entries that `key` replaces: the same area, policy and elevation version under another key."""
    index = read_index(spark, root)
    entries = index.select("key", F.col("area").alias("area_id"), "policy", "dem_version")
    gone = [r["key"] for r in stale_siblings(entries, entries.where(F.col("key") == key)).collect()]
    drop_entries(spark, root, gone)
    return gone


def canonical_hash(value: object) -> str:
    """SHA-256 of a value's canonical JSON: sorted keys, no spaces."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


GOLDEN = "route int, n_edges long, length_m double, d_plus_m double, objective double, edge_hash string"


def write_golden(spark: SparkSession, routes: DataFrame, path: str, params: dict) -> None:
    """Routes (GOLDEN) of a reference run and the hash of its parameters, as one JSON file."""
    rows = [r.asDict() for r in routes.select(*[c.split()[0] for c in GOLDEN.split(", ")]).orderBy("route").collect()]  # n routes
    write_json(spark, path, {"params_hash": canonical_hash(params), "routes": rows})


def read_golden(spark: SparkSession, path: str, params: dict) -> DataFrame:
    row = spark.read.schema(f"params_hash string, routes array<struct<{GOLDEN.replace(' ', ':').replace(',:', ',')}>>").json(path).first()
    if row is None or row["params_hash"] != canonical_hash(params):
        raise CorruptEntry(f"{path}: made with other parameters")
    return spark.createDataFrame([tuple(r) for r in row["routes"]], GOLDEN)


def read_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(JOB).option("mode", "DROPMALFORMED").json(folder)


def latest_jobs(records: DataFrame, recover: bool = False) -> DataFrame:
    """(job_id, status): each job's last record; after a restart (recover), running ones have failed."""
    out = records.groupBy("job_id").agg(F.max_by("status", "updated").alias("status"))
    return out.withColumn("status", F.when(F.col("status") == "running", "failed").otherwise(F.col("status"))) if recover else out


#: What a job's status may turn into (fixed values).
NEXT_STATUS = {"queued": ("running", "cancelled"), "running": ("done", "failed", "stopped"), "done": (), "failed": (), "cancelled": (), "stopped": ()}


def bad_transitions(records: DataFrame) -> DataFrame:
    """(job_id, updated, before, status): records whose status doesn't follow from the one before; a job begins queued."""
    before = F.lag("status").over(Window.partitionBy("job_id").orderBy("updated"))
    allowed = F.col("before").isNull() & (F.col("status") == "queued")
    for name, after in NEXT_STATUS.items():
        allowed |= (F.col("before") == name) & F.col("status").isin(*after) if after else F.lit(False)
    return records.withColumn("before", before).where(~F.coalesce(allowed, F.lit(False))).select("job_id", "updated", "before", "status")


def write_routes(routes: DataFrame, folder: str) -> None:
    """One JSON line for each route, with its edges in order."""
    edges = F.array_sort(F.collect_list(F.struct("seq", "node_u", "node_v", "key")))
    routes.groupBy("route").agg(edges.alias("edges")).write.mode("error").json(folder)


def age_days(text: Column, now: Column) -> Column:
    """Whole days, rounded up, since an ISO time (UTC unless it says otherwise); null if it isn't one."""
    micros = lambda c: F.unix_micros(F.try_to_timestamp(c))
    return F.ceil((micros(now) - micros(text)) / F.lit(86_400_000_000.0))


def place_label(address: Column, fields: tuple[str, ...], name: Column, display_name: Column) -> Column:
    """The first address field that isn't blank, else the name, else the head of the display name."""
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(*[full(F.try_element_at(address, F.lit(f))) for f in fields], full(name), full(F.split_part(display_name, F.lit(","), F.lit(1))))


def parse_lat_lon(text: Column) -> Column:
    """(lat, lon) of 'LAT,LON'; null if it isn't a place on the globe."""
    lat, lon = F.trim(F.split_part(text, F.lit(","), F.lit(1))).try_cast("double"), F.trim(F.split_part(text, F.lit(","), F.lit(2))).try_cast("double")
    return F.when(F.abs(lat) <= 90, F.when(F.abs(lon) <= 180, F.struct(lat.alias("lat"), lon.alias("lon"))))
