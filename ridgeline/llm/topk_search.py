"""Exact top-k inner-product search by columnar branch and bound.

Vectors become integers, floor(256 * x), and are gathered in blocks. A block is
stored vertically: one row of numbers for each dimension, dimensions with the
largest mass in the block first, and beside them what mass each vector has left
after every few dimensions. For a query, scores grow dimension block by
dimension block, over the survivors only; after each, the Cauchy-Schwarz bound
of the mass that is left on both sides is added, and candidates that can't
reach the query's floor are compacted away. The floor is the k-th best score
that is certain in the block, or the k-th best found in the blocks that the
task has seen before.

Scale: queries and candidates are packed in blocks, which meet in a grid of
cells (a stated query set against all rows, in blocks): candidates are sent to
each column and queries to each row of the grid, and the grid's shape makes what
is sent least. A cell's meetings are one task, which keeps the floors. Each
meeting returns k rows a query at most; the best k of all blocks follow from a
windowed rank over those. Nothing is broadcast, only two counts of blocks come
to the driver, and a vector that many rows hold costs what any other does.

Defined results: vectors that are null or hold a null or non-finite component
take no part; an empty vector has score 0 with every other; shorter vectors
count as padded with zeros; ties go to the smaller id; the query's own row (its
id) is no candidate for it; rows that share an id are separate candidates; rows
with a null id take no part; fewer candidates than k are all returned; an empty
table gives an empty result; extra columns aren't used. Products that a double
can't hold exactly are computed in Python integers, and ranks follow from
these; a score beyond 64 bits, which its column can't hold, is shown as the bound.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import ceil, floor, isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 5
SCALE = 256
CANDIDATES = 4096
QUERIES = 512
DIMS = 8

PACKED = "block long, ids binary, values binary, dims int, places binary, masses binary"
FOUND = "query_id long, vec_id long, score long, beyond int, exact string"
_LEAST, _MOST = -(2**63), 2**63 - 1


def takes_part(embedding: Column) -> Column:
    inf = F.lit(float("inf"))
    return F.coalesce(F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < inf)), F.lit(False))


def _cuts(dims: int) -> list[slice]:
    return [slice(a, min(a + DIMS, dims)) for a in range(0, dims, DIMS)] or [slice(0, 0)]


def _left(values: np.ndarray) -> np.ndarray:
    """For each dimension block, the norm of what comes after it (rounded up)."""
    mass = np.stack([np.einsum("ij,ij->j", values[c], values[c]) for c in _cuts(len(values))])
    return np.sqrt(np.maximum(np.cumsum(mass[::-1], axis=0)[::-1] - mass, 0)) * (1 + 1e-9) + 1e-6


def _packer(size: int, masses: bool):
    """Rows of a task to blocks of at most `size` vectors, by dimension, with what mass is left."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        first, number = TaskContext.get().partitionId() << 24, 0
        held: list[tuple[int, np.ndarray]] = []

        def packed() -> pd.DataFrame:
            raw = np.zeros((max(len(v) for _, v in held), len(held)))
            for k, (_, v) in enumerate(held):
                raw[: len(v), k] = v
            whole = np.floor(np.clip(raw, -(2.0**900), 2.0**900) * SCALE)
            places = np.argsort(-np.einsum("ij,ij->i", whole, whole), kind="stable") if masses else np.arange(len(raw))
            ids = np.array([i for i, _ in held], np.int64)
            left = _left(whole[places]).tobytes() if masses else b""
            columns = ["block", "ids", "values", "dims", "places", "masses"]
            return pd.DataFrame([(first + number, ids.tobytes(), raw[places].tobytes(), len(raw), places.astype(np.int64).tobytes(), left)], columns=columns)

        for batch in batches:
            for row in zip(batch["id"], batch["vector"], strict=True):
                held.append(row)
                if len(held) == size:
                    yield packed()
                    held, number = [], number + 1
        if held:
            yield packed()

    return run


def best_of_block(query: np.ndarray, own: int, ids: np.ndarray, values: np.ndarray, left_mass: np.ndarray, k: int, floor_: float = -np.inf, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best columns of `values` for a query, ties to the smaller id; those under `floor_` may be missing.

    first: the scores over the first dimension block, if they are known.
    """
    cuts = _cuts(len(values))
    alive = np.flatnonzero(ids != own)
    query_left = _left(query[:, None])[:, 0]
    partial = np.zeros(len(alive))
    for step, cut in enumerate(cuts):
        if step == 0 and first is not None:
            partial = first[alive]
        else:
            partial = partial + query[cut] @ (values[cut] if len(alive) == values.shape[1] else values[cut][:, alive])
        bound = left_mass[step][alive] * query_left[step]
        if len(alive) > k:
            # The k-th best of what is certain is a floor for the final k-th best.
            floor_ = max(floor_, float(np.partition(partial - bound, len(alive) - k)[len(alive) - k]))
        stays = partial + bound >= floor_
        if not stays.all():
            alive, partial = alive[stays], partial[stays]
    order = np.lexsort((ids[alive], -partial))[:k]
    return ids[alive[order]], partial[order]


def _whole(x: float) -> int:
    """floor(256 * x), whatever its size."""
    return int(x) * SCALE if abs(x) >= 2.0**45 else floor(x * SCALE)


def _exact_best(query: list[int], own: int, ids: np.ndarray, raw: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(id, score) in Python integers, for components whose products don't fit a double."""
    scores = sorted((-sum(a * _whole(b) for a, b in zip(query, raw[:, j].tolist(), strict=True)), int(ids[j])) for j in range(len(ids)) if ids[j] != own)
    return [(i, -s) for s, i in scores[:k]]


def _digits(score: int) -> str:
    """A text that sorts as the number does."""
    text = str(abs(score))
    return f"1{len(text):04d}{text}" if score >= 0 else f"0{9999 - len(text):04d}" + "".join(str(9 - int(c)) for c in text)


def _padded(raw: bytes, places: bytes, dims: int, order: np.ndarray, n: int) -> np.ndarray:
    """A block's values by dimension in the given order of dimensions."""
    values = np.zeros((max(dims, len(order)), n))
    if dims:
        values[np.frombuffer(places, np.int64)] = np.frombuffer(raw).reshape(dims, n)
    return values[order]


def _searcher(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floors: dict[int, list[float]] = defaultdict(list)  # a query's best scores so far, at most k
        for batch in batches:
            for row in batch.itertuples():
                ids, query_ids = np.frombuffer(row.ids, np.int64), np.frombuffer(row.q_ids, np.int64)
                order = np.concatenate([np.frombuffer(row.places, np.int64), np.arange(row.dims, max(row.dims, row.q_dims))])
                raw = _padded(row.values, row.places, row.dims, order, len(ids))
                raw_queries = _padded(row.q_values, row.q_places, row.q_dims, order, len(query_ids))
                out: list[tuple[int, int, int, int, str | None]] = []
                with np.errstate(over="ignore"):
                    values, queries = np.floor(raw * SCALE), np.floor(raw_queries * SCALE)
                    small = len(order) * np.abs(values).max(initial=0) * np.abs(queries).max(initial=0) < 2**52
                if small:
                    steps = len(_cuts(len(order)))
                    left = np.frombuffer(row.masses).reshape(-1, len(ids))
                    # Dimensions that only queries have add nothing, and no candidate has mass there.
                    left = np.concatenate([left, np.repeat(left[-1:], steps - len(left), 0)]) if steps > len(left) else left
                    cut = _cuts(len(order))[0]
                    first = queries[cut].T @ values[cut]
                    for j, own in enumerate(query_ids.tolist()):
                        known = floors[own]
                        at_least = known[-1] if len(known) == k else -np.inf
                        found, scores = best_of_block(np.ascontiguousarray(queries[:, j]), own, ids, values, left, k, at_least, first[j])
                        floors[own] = sorted([*known, *scores.tolist()], reverse=True)[:k]
                        out += [(own, i, int(s), 0, None) for i, s in zip(found.tolist(), scores.tolist(), strict=True)]
                else:
                    for j, own in enumerate(query_ids.tolist()):
                        for i, s in _exact_best([_whole(x) for x in raw_queries[:, j].tolist()], own, ids, raw, k):
                            beyond = (s > _MOST) - (s < _LEAST)
                            out.append((own, i, min(max(s, _LEAST), _MOST), beyond, _digits(s) if beyond else None))
                yield pd.DataFrame(out, columns=[x.split()[0] for x in FOUND.split(", ")])

    return run


def grid(candidates: int, queries: int, cells: int) -> tuple[int, int]:
    """(rows, columns) of at most so many cells that send least: each candidate block goes to every column, each query block to every row."""
    size = lambda r, c: candidates * CANDIDATES * c + queries * QUERIES * r
    shapes = [(min(r, max(candidates, 1)), min(max(cells // r, 1), max(queries, 1))) for r in range(1, isqrt(cells) + 1)]
    shapes += [(min(max(cells // c, 1), max(candidates, 1)), min(c, max(queries, 1))) for c in range(1, isqrt(cells) + 1)]
    work = lambda r, c: ceil(max(candidates, 1) / r) * ceil(max(queries, 1) / c)
    return min(shapes, key=lambda x: (work(*x), size(*x)))


def top_k(vectors: DataFrame, is_query: Column, scratch, k: int = K, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows."""
    used = vectors.where(F.col(key).isNotNull() & takes_part(F.col(embedding)))
    rows = used.select(F.col(key).cast("long").alias("id"), F.transform(F.col(embedding), lambda x: x.cast("double")).alias("vector"), is_query.alias("_query"))
    blocks = scratch.keep(rows.select("id", "vector").mapInPandas(_packer(CANDIDATES, True), PACKED))
    asked = rows.where("_query").select("id", "vector").mapInPandas(_packer(QUERIES, False), PACKED).drop("masses")
    asked = scratch.keep(asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns]))
    cells = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    down, across = grid(blocks.count(), asked.count(), cells)
    place = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    sent = blocks.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda c: place("block", down) * across + c)))
    dealt = asked.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(down - 1)), lambda r: r * across + place("q_block", across))))
    found = sent.join(dealt.hint("merge"), "cell").mapInPandas(_searcher(k), FOUND)
    rank = Window.partitionBy("query_id").orderBy(F.desc("beyond"), F.desc("score"), F.desc("exact"), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
