"""Route search: a distinct top-n, exhaustive enumeration, and randomised greedy construction.

The contracted network is mostly small next to the data it comes from (its climbs
and connectors); then the search broadcasts it, and tasks are independent seeded
workers. A larger one stays where it is: walks go to the components of their
starts, of which only those edges are fetched that walks can get to. Both ways
make the same routes.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions.measures import segment_id
from ridgeline.functions.tags import descends_over, sac_rank
from ridgeline.operators.networks import weak_components
from ridgeline.session import ensure_checkpoint_dir

CHOICES = 5
DRAWS = 1024
#: Larger networks are not broadcast; for them, walks made at a time, steps tried to get around from their starts, and nodes that are broadcast or listed.
BROADCAST_EDGES = 1_000_000
WALKS_AT_ONCE = 1000
HOPS = 12
FEW_NODES = 50_000


class Params(NamedTuple):
    """Options of a search. time_budget: seconds a round, 0 for none; difficulty_cap: a rank from 1 to 6; max_descent: gradient, None for any."""

    theta: float = 0.2
    most_shared: float = 0.0
    n: int = 10
    iterations: int = 1000
    stagnation: int = 0
    seed: int = 0
    time_budget: float = 0.0
    difficulty_cap: int = 6
    max_descent: float | None = None
    start_at_junction: bool = False


def check_params(p: Params) -> None:
    """Finiteness first, then ranges; the first fault is raised."""
    for name in ("theta", "most_shared", "time_budget", "max_descent"):
        if getattr(p, name) is not None and not np.isfinite(getattr(p, name)):
            raise ValueError(f"{name} must be finite")
    if p.theta < 0:
        raise ValueError("theta must be at least 0")
    if not 0 <= p.most_shared <= 1:
        raise ValueError("most_shared must be from 0 to 1")
    if p.time_budget < 0 or (p.max_descent is not None and p.max_descent <= 0):
        raise ValueError("time_budget must be at least 0, and max_descent over 0")
    if not 1 <= p.difficulty_cap <= 6:
        raise ValueError("difficulty_cap must be from 1 to 6")
    if p.n < 1 or p.iterations < 1 or p.stagnation < 0:
        raise ValueError("n and iterations must be at least 1, stagnation at least 0")


class DistinctTop:
    """The best n candidates of which no two overlap by more than a share.

    A candidate that overlaps members must beat every one of them and replaces
    them all; one that overlaps none fills a place or replaces a worse member.
    """

    def __init__(self, n: int, most_shared: float) -> None:
        if n < 1 or not 0 <= most_shared <= 1:
            raise ValueError("n must be at least 1 and most_shared from 0 to 1")
        self.n, self.most_shared = n, most_shared
        self.held: list[tuple[float, list, frozenset, object]] = []

    def overlaps(self, x: frozenset, y: frozenset) -> bool:
        union = len(x | y)
        distance = 1 - len(x & y) / union if union else 0.0
        return distance < 1 - self.most_shared

    def offer(self, objective: float, segments: frozenset, what: object = None) -> bool:
        if not np.isfinite(objective):
            raise ValueError("an objective must be finite")
        entry = (objective, sorted(segments), segments, what)
        rivals = [h for h in self.held if self.overlaps(h[2], segments)]
        if rivals:
            if objective <= max(h[0] for h in rivals):
                return False
            self.held = [h for h in self.held if h not in rivals]
        elif len(self.held) == self.n:
            worst = max(self.held, key=lambda h: (-h[0], h[1]))
            if objective <= worst[0]:
                return False
            self.held.remove(worst)
        self.held.append(entry)
        return True

    def top(self) -> list[tuple[float, list, frozenset, object]]:
        return sorted(self.held, key=lambda h: (-h[0], h[1]))


def distinct_top(candidates: DataFrame, n: int, most_shared: float) -> DataFrame:
    """(group, rank, id, objective) of candidates (group, ord, id, objective, segments array<string>), offered in order of ord.

    A group is one search's candidates, of bounded number by its iterations.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tracker = DistinctTop(n, most_shared)
        for r in rows.sort_values("ord").itertuples():
            tracker.offer(float(r.objective), frozenset(r.segments), int(r.id))
        out = [(int(rows["group"].iloc[0]), k + 1, what, objective) for k, (objective, _, _, what) in enumerate(tracker.top())]
        return pd.DataFrame(out, columns=["group", "rank", "id", "objective"])

    return candidates.groupBy("group").applyInPandas(run, "group long, rank int, id long, objective double")


class Network(NamedTuple):
    """Edges by source, best gain first, as arrays. Pieces of way of edge e are segments[pieces[e]:pieces[e + 1]]; of these, `once` may be used once."""

    nodes: np.ndarray
    first: np.ndarray
    edges: np.ndarray  # node_u, node_v, key
    target: np.ndarray  # position of node_v in nodes
    metrics: np.ndarray  # length, gain
    pieces: np.ndarray
    segments: np.ndarray
    once: np.ndarray
    starts: np.ndarray  # positions in nodes
    names: np.ndarray  # a, b, k of each piece of way

    def used_by(self, path: list[int]) -> frozenset:
        own = np.concatenate([self.segments[self.pieces[e] : self.pieces[e + 1]] for e in path]) if path else []
        return frozenset(map(tuple, self.names[np.unique(own)].tolist())) if len(own) else frozenset()

    def blocking(self, e: int) -> list[int]:
        own = self.segments[self.pieces[e] : self.pieces[e + 1]]
        return own[self.once[own]].tolist()


def usable(edges: DataFrame, p: Params) -> DataFrame:
    """Edges that the options allow: under the difficulty cap, and not steeper down than the descent cap. Columns that are missing allow all."""
    if "sac_scale" in edges.columns:
        rank = sac_rank(F.col("sac_scale"))
        edges = edges.where(rank.isNull() | (rank <= p.difficulty_cap))
    if p.max_descent is not None and "max_windowed_descent_grad" in edges.columns:
        edges = edges.where(~F.coalesce(descends_over(p.max_descent, F.col("d_plus_m"), F.col("d_minus_m"), F.col("max_windowed_descent_grad")), F.lit(False)))
    return edges


def _columns(edges: DataFrame) -> DataFrame:
    if "base_segment_ids" not in edges.columns:
        edges = edges.withColumn("base_segment_ids", F.array(segment_id(F.col("node_u"), F.col("node_v"), F.col("key"))))
    rows = edges.withColumn("gain", F.col("d_plus_m") + F.col("d_minus_m"))
    return rows.select(*[F.col(c).cast("long") for c in ("node_u", "node_v", "key")], *[F.col(c).cast("double") for c in ("length_m", "gain")], "reusable", *[F.col(f"base_segment_ids.{c}").alias(c) for c in "abk"])


def _pieces(flat: pa.Table, names: str) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and rows of the lists in three columns."""
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    lists = [flat.column(c).combine_chunks() for c in names]
    lists = [x.chunk(0) if hasattr(x, "chunk") else x for x in lists]
    sizes = np.array(lists[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    return sizes, np.stack([np.asarray(x.flatten().to_numpy(zero_copy_only=False), np.int64) for x in lists], axis=1)


def _network(flat: pa.Table, wanted: np.ndarray | None = None) -> Network:
    """flat: rows of `_columns`, sorted; columns oa, ob, ok list pieces that some edge elsewhere may use once only. wanted: nodes where routes may begin."""
    column = lambda c: flat.column(c).to_numpy()
    ends = np.stack([column(c).astype(np.int64) for c in ("node_u", "node_v", "key")], axis=1)
    nodes = np.unique(ends[:, :2])
    sizes, parts = _pieces(flat, "abk")
    told = _pieces(flat.rename_columns({"oa": "x", "ob": "y", "ok": "z"}), "xyz")[1] if "oa" in flat.column_names else parts[:0]
    named = np.concatenate([parts, told])
    names, own = np.unique(named, axis=0, return_inverse=True) if len(named) else (named, np.zeros(0, np.int64))
    own, elsewhere = np.split(own.reshape(-1), [len(parts)])
    once = np.zeros(len(names), bool)
    once[own[np.repeat(~column("reusable").astype(bool), sizes)]] = True
    once[elsewhere] = True
    return Network(
        nodes,
        np.searchsorted(ends[:, 0], np.append(nodes, np.iinfo(np.int64).max)),
        ends,
        np.searchsorted(nodes, ends[:, 1]),
        np.stack([column("length_m"), column("gain")], axis=1).astype(float),
        np.concatenate(([0], np.cumsum(sizes))),
        own,
        once,
        np.arange(len(nodes)) if wanted is None else np.flatnonzero(np.isin(nodes, wanted)),
        names,
    )


def load_network(edges: DataFrame, starts: DataFrame | None = None) -> Network:
    """edges: (node_u, node_v, key, length_m, d_plus_m, d_minus_m, reusable, optionally base_segment_ids), usable ones only.

    starts: (node_id) where routes may begin; all nodes if there is none.
    """
    flat = _columns(edges).orderBy("node_u", F.desc("gain"), "node_v", "key").toArrow().combine_chunks()
    wanted = None if starts is None else np.asarray(starts.select(F.col("node_id").cast("long")).distinct().toArrow().column(0).to_numpy(), np.int64)
    return _network(flat, wanted)


def draws(p: Params, worker: int, iteration: int) -> Callable[[], float]:
    """Random numbers of one iteration; it has a generator of its own, so that its start is known without the walks before it."""
    rng = np.random.default_rng(np.random.SeedSequence(p.seed, spawn_key=(worker, iteration)))
    buffer: list[float] = []

    def draw() -> float:
        if not buffer:
            buffer.extend(rng.random(DRAWS)[::-1].tolist())
        return buffer.pop()

    return draw


def construct(network: Network, at: int, draw: Callable[[], float]) -> list[int]:
    """Edge numbers of one random greedy walk from a node's position: each step picks among the first CHOICES usable edges."""
    path: list[int] = []
    gone: set[int] = set()
    used: set[int] = set()
    while True:
        choices = []
        for e in range(network.first[at], network.first[at + 1]):
            if e not in gone and not any(s in used for s in network.blocking(e)):
                choices.append(e)
                if len(choices) == CHOICES:
                    break
        if not choices:
            return path
        e = choices[int(draw() * len(choices))]
        path.append(e)
        gone.add(e)
        used.update(network.blocking(e))
        at = int(network.target[e])


def best_prefix(network: Network, path: list[int], theta: float) -> int:
    """Size of the longest prefix with a mean gradient of at least theta; 0 if there is none."""
    if not path:
        return 0
    length, gain = np.cumsum(network.metrics[path], axis=0).T
    clear = np.flatnonzero(np.where(length > 0, gain / np.where(length > 0, length, 1), 0.0) >= theta)
    return int(clear[-1]) + 1 if len(clear) else 0


def walk(network: Network, p: Params, at: int, draw: Callable[[], float]) -> tuple[float, list, frozenset]:
    """Objective, edges (node_u, node_v, key) and pieces of way of one random walk's best prefix."""
    path = construct(network, at, draw)
    path = path[: best_prefix(network, path, p.theta)]
    return float(network.metrics[path, 1].sum()), network.edges[path].tolist(), network.used_by(path)


def walks_of(network: Network, p: Params, worker: int) -> Iterator[tuple[float, list, frozenset]]:
    for k in range(p.iterations if len(network.starts) else 0):
        draw = draws(p, worker, k)
        yield walk(network, p, int(network.starts[int(draw() * len(network.starts))]), draw)


def grasp(found: Iterator[tuple[float, list, frozenset]], p: Params, elite: list | None = None) -> tuple[DistinctTop, dict]:
    """One seeded search over its walks; elite solutions of earlier rounds are offered first."""
    tracker, still, last, done = DistinctTop(p.n, p.most_shared), 0, 0, 0
    for objective, path, segments in elite or []:
        tracker.offer(objective, segments, path)
    status, began = "budget-exhausted", time.monotonic()
    for done in range(1, p.iterations + 1):
        if (p.time_budget and time.monotonic() - began > p.time_budget) or (one := next(found, None)) is None:
            break
        objective, path, segments = one
        admitted = bool(path) and tracker.offer(objective, segments, path)
        still, last = (0, done) if admitted else (still + 1, last)
        if p.stagnation and still >= p.stagnation:
            status = "converged"
            break
    return tracker, {"iterations": done, "converged_at": last, "status": status}


FOUND = "worker int, rank int, objective double, path array<long>, segments array<long>, iterations int, converged_at int, status string"
WALKS = "worker long, iteration long, objective double, path array<long>, segments array<long>"
ROUTES = "route int, seq int, node_u long, node_v long, key int, objective double, status string"


def rounds(iterations: int, interval: int, workers: int) -> list[list[int]]:
    """Iterations of each worker in each round."""
    count = max(1, -(-iterations // max(interval, 1))) if interval else 1
    count = min(count, max(1, iterations // max(workers, 1)))
    share = lambda total, parts: [total // parts + (k < total % parts) for k in range(parts)]
    return [share(n, workers) for n in share(iterations, count)]


def context_key(network: Network, p: Params) -> str:
    """What a stored result was made of: the network's arrays and the options."""
    told = hashlib.sha256(repr(tuple(p)).encode())
    for part in network:
        told.update(np.ascontiguousarray(part).tobytes())
    return told.hexdigest()


def edges_key(edges: DataFrame, starts: DataFrame | None, p: Params) -> str:
    """The same of a network that is not broadcast."""
    rows = [frame.agg(F.count("*"), F.sum(F.xxhash64(*frame.columns).cast("decimal(38,0)"))).first() for frame in (_columns(edges), *([] if starts is None else [starts.select("node_id").distinct()]))]
    return hashlib.sha256(repr((tuple(p), [tuple(map(str, r)) for r in rows])).encode()).hexdigest()


def degradation_message(returned: int, p: Params) -> str | None:
    """Why there are fewer routes than asked for; None if there are enough (fixed wording)."""
    if returned >= p.n:
        return None
    bounds, levers = f"theta={p.theta:.2f}, J_max <= {p.most_shared:.2f}", "relax --theta or --j-max"
    if p.start_at_junction:
        bounds, levers = f"{bounds}, start-at-junction", f"{levers} or drop --start-at-junction"
    if p.max_descent is not None:
        bounds, levers = f"{bounds}, max-descent-slope={p.max_descent:.2f}", f"{levers} or raise/drop --max-descent-slope"
    return f"Only {returned} of {p.n} requested routes satisfy the current constraints ({bounds}); {levers} to admit more."


def exit_code(violations: DataFrame, pairs: DataFrame) -> int:
    """1 if a route fails a constraint or two routes overlap too much, else 0."""
    return 0 if violations.isEmpty() and pairs.isEmpty() else 1


def search(spark: SparkSession, edges: DataFrame, p: Params, workers: int = 4, interval: int = 0, junctions: DataFrame | None = None, snapshots: str | None = None, expected: str | None = None) -> DataFrame:
    """ROUTES: distinct top routes of an island search.

    Workers search on their own for a round, their tops are merged in worker
    order, and the merged top seeds the next round. The same seed and number of
    workers give the same routes wherever tasks run (without a time budget): an
    iteration's generator depends on its number, worker and round only. Networks
    of up to BROADCAST_EDGES edges are broadcast to the workers; in larger ones
    a component has to fit a task. junctions:
    (node_id, is_junction). snapshots: a folder that gets the best routes after
    each round, so that the best so far can be read at any time; after an
    interrupt the last completed round's routes are the result.
    """
    check_params(p)
    if p.start_at_junction and junctions is None:
        raise ValueError("start_at_junction needs the junctions")
    edges, starts = usable(edges, p), junctions.where("is_junction") if p.start_at_junction else None
    plans = rounds(p.iterations, interval, workers)
    if edges.select("node_u").count() <= BROADCAST_EDGES:
        network = load_network(edges, starts)
        key = context_key(network, p) if expected is not None else None
        tops = _tops_of_network(spark, network, p, plans)
    else:
        key = edges_key(edges, starts, p) if expected is not None else None
        tops = _tops_of_components(spark, edges, starts, p, plans)
    if key != expected:
        raise ValueError("the network or the options are not those of the stored context")
    elite: list[tuple[float, list, frozenset]] = []
    status = "budget-exhausted"
    for turn in range(len(plans)):
        try:
            told = tops(turn, elite)
        except KeyboardInterrupt:
            status = "interrupted"
            break
        merged = DistinctTop(p.n, p.most_shared)
        for objective, path, segments, _ in told:
            merged.offer(objective, segments, path)
        elite = [(objective, path, segments) for objective, _, segments, path in merged.top()]
        if snapshots:
            _routes(spark, elite, status).write.mode("error").parquet(f"{snapshots}/round={turn}")
        status = "converged" if told and all(x[-1] == "converged" for x in told) else "budget-exhausted"
        if status == "converged":
            break
    return _routes(spark, elite, status)


def _flat(triples) -> list[int]:
    return [x for t in triples for x in t]


def _triples(flat: list[int]) -> list[tuple[int, int, int]]:
    return list(zip(flat[::3], flat[1::3], flat[2::3], strict=True))


def _tops_of_network(spark: SparkSession, network: Network, p: Params, plans: list[list[int]]) -> Callable:
    """What the workers find in a round from the elite: (objective, path, segments, status), by worker and rank. A task a worker."""
    shared = spark.sparkContext.broadcast(tuple(network))  # of arrays, which workers can read without this module

    def tops(turn: int, elite: list) -> list:
        plan = plans[turn]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for w in map(int, batch["id"]):
                    own = p._replace(iterations=max(plan[w], 1))
                    tracker, told = grasp(walks_of(Network(*shared.value), own, turn * len(plan) + w), own, elite)
                    out = [(w, k, o, _flat(path), _flat(segments), told["iterations"], told["converged_at"], told["status"]) for k, (o, _, segments, path) in enumerate(tracker.top())]
                    yield pd.DataFrame(out, columns=[x.split()[0] for x in FOUND.split(", ")])

        rows = spark.range(0, len(plan), 1, len(plan)).mapInPandas(run, FOUND).orderBy("worker", "rank").collect()  # n rows a worker
        return [(r["objective"], _triples(r["path"]), frozenset(_triples(r["segments"])), r["status"]) for r in rows]

    return tops


def _tops_of_components(spark: SparkSession, edges: DataFrame, starts: DataFrame | None, p: Params, plans: list[list[int]]) -> Callable:
    """The same, with walks made WALKS_AT_ONCE at a time in the order in which they are used: a task a component, and what they find is offered here.

    Workers take turns here, so each has its share of a round's time budget to ask for more walks; those that are made are offered.
    """
    ensure_checkpoint_dir(spark)
    nodes = edges.select(F.explode(F.array(*[F.col(c).cast("long") for c in ("node_u", "node_v")])).alias("node_id")).distinct()
    if starts is not None:
        nodes = nodes.join(starts.select(F.col("node_id").cast("long")), "node_id", "left_semi")
    # A node's place in the order, as partition and row.
    placed = nodes.orderBy("node_id").withColumn("place", F.monotonically_increasing_id()).checkpoint()
    counts = sorted(placed.groupBy(F.shiftright("place", 33).alias("part")).count().collect())
    ends = np.cumsum([r["count"] for r in counts])
    rows, one, last = iter(()), None, (-1, -1)  # walks made and not used yet, the first of them, and the last that was asked for

    def ahead(turn: int, worker: int, iteration: int) -> Iterator[tuple[int, int]]:
        for t in range(turn, len(plans)):
            for w in range(worker if t == turn else 0, len(plans[t])):
                for k in range(iteration if (t, w) == (turn, worker) else 0, max(plans[t][w], 1)):
                    yield t * len(plans[t]) + w, k

    def make(wanted: list[tuple[int, int]]) -> Iterator[Row]:
        begun = []
        for w, k in wanted:
            at = int(draws(p, w, k)() * ends[-1])
            part = int(np.searchsorted(ends, at, side="right"))
            begun.append((w, k, (counts[part]["part"] << 33) + at - int(ends[part] - counts[part]["count"])))
        begun = placed.join(F.broadcast(spark.createDataFrame(begun, "worker long, iteration long, place long")), "place").drop("place")
        walked = _walks_in_components(edges, begun.checkpoint(), p).checkpoint()
        return walked.orderBy("worker", "iteration").checkpoint().toLocalIterator()  # a partition at a time

    def found(turn: int, w: int, until: float) -> Iterator[tuple[float, list, frozenset]]:
        nonlocal rows, one, last
        worker = turn * len(plans[turn]) + w
        for k in range(max(plans[turn][w], 1) if len(ends) else 0):
            if (worker, k) > last:
                if p.time_budget and w + k and time.monotonic() > until:
                    return
                wanted = list(islice(ahead(turn, w, k), WALKS_AT_ONCE))
                rows, last = make(wanted), wanted[-1]
                one = next(rows, None)
            while one is not None and one[:2] < (worker, k):
                one = next(rows, None)
            if one is not None and one[:2] == (worker, k):
                yield one["objective"], _triples(one["path"]), frozenset(_triples(one["segments"]))
            else:
                yield 0.0, [], frozenset()

    def tops(turn: int, elite: list) -> list:
        out, began = [], time.monotonic()
        for w, n in enumerate(plans[turn]):
            until = began + p.time_budget * (w + 1) / len(plans[turn])
            tracker, told = grasp(found(turn, w, until), p._replace(iterations=max(n, 1), time_budget=0.0), elite)
            out += [(o, path, segments, told["status"]) for o, _, segments, path in tracker.top()]
        return out

    return tops


def _around(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node_id, component) of the nodes that walks from starts (node_id) can get to, perhaps of more; no edge leads out of a component.

    Steps from the starts, and if these don't end soon, components of the whole network, whose rounds grow with the logarithm of its diameter.
    """
    ends = edges.select(F.col("node_u").cast("long").alias("node_u"), F.col("node_v").cast("long").alias("node_v"))
    known = new = starts.select("node_id").distinct().checkpoint()
    for _ in range(HOPS):
        next_ = ends.join(_few(new).withColumnRenamed("node_id", "node_u"), "node_u", "left_semi").select(F.col("node_v").alias("node_id")).distinct()
        new = next_.join(known, "node_id", "left_anti").checkpoint()
        if new.isEmpty():
            return weak_components(ends.join(_few(known).withColumnRenamed("node_id", "node_u"), "node_u", "left_semi"))
        known = known.unionAll(new)
    return weak_components(ends)


def _few(nodes: DataFrame) -> DataFrame:
    return F.broadcast(nodes) if nodes.limit(FEW_NODES + 1).count() <= FEW_NODES else nodes


def _leaving(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that leave from nodes (node_id). A list of these, if they are few, is looked up before edges are numbered or sorted, which a join isn't."""
    few = [str(r["node_id"]) for r in nodes.limit(FEW_NODES + 1).collect()]
    if 0 < len(few) <= FEW_NODES:
        return edges.where(f"cast(node_u as bigint) in ({','.join(few)})")
    return edges.join(nodes.withColumnRenamed("node_id", "node_u"), "node_u", "left_semi")


def _walks_in_components(edges: DataFrame, begun: DataFrame, p: Params) -> DataFrame:
    """WALKS of begun (worker, iteration, node_id), without empty ones."""
    labels = _around(edges, begun)
    begun = begun.join(labels, "node_id")
    labels = labels.join(begun.select("component"), "component", "left_semi").select("node_id", "component").checkpoint()
    near = _leaving(edges, labels.select("node_id"))
    flat = _columns(near)
    if "base_segment_ids" in edges.columns:  # pieces may also lie under edges elsewhere
        near = near.select("node_u", "node_v", "key", "base_segment_ids").checkpoint()
        piece = F.explode("base_segment_ids").alias("s")
        bad = edges.where(~F.col("reusable")).select(piece).join(near.select(piece).distinct(), "s", "left_semi").distinct()
        own = near.select("node_u", "node_v", "key", piece).distinct().join(bad, "s")
        listed = own.groupBy(*[F.col(c).cast("long").alias(c) for c in ("node_u", "node_v", "key")]).agg(*[F.collect_list(f"s.{c}").alias(f"o{c}") for c in "abk"])
        flat = flat.join(listed, ["node_u", "node_v", "key"], "left")
        flat = flat.withColumns({f"o{c}": F.coalesce(f"o{c}", F.array().cast("array<long>")) for c in "abk"})
    flat = flat.join(labels.select(F.col("node_id").alias("node_u"), F.col("component").alias("part")), "node_u")

    def run(walks: pa.Table, rows: pa.Table) -> pa.Table:
        network = _network(rows.sort_by([("node_u", "ascending"), ("gain", "descending"), ("node_v", "ascending"), ("key", "ascending")]).combine_chunks())
        out = []
        for w, k, node in zip(*[walks.column(c).to_pylist() for c in ("worker", "iteration", "node_id")], strict=True):
            draw = draws(p, w, k)
            draw()  # it chose the start
            objective, path, segments = walk(network, p, int(np.searchsorted(network.nodes, node)), draw)
            if path:
                out.append((w, k, objective, _flat(path), _flat(segments)))
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        return pa.table({x.split()[0]: pa.array(list(c), kind) for x, c, kind in zip(WALKS.split(", "), columns, kinds, strict=True)})

    return begun.groupBy("component").cogroup(flat.groupBy("part")).applyInArrow(run, WALKS)


def _routes(spark: SparkSession, elite: list[tuple[float, list, frozenset]], status: str) -> DataFrame:
    out = [(k, s, *map(int, e), objective, status) for k, (objective, path, _) in enumerate(elite) for s, e in enumerate(path)]
    return spark.createDataFrame(out, ROUTES)


def walks(edges: DataFrame, depth: int) -> DataFrame:
    """All walks of up to `depth` edges that use no piece of way twice: (last, path, segments, objective, length_m).

    edges: (id, node_u, node_v, segment, length_m, gain). Walks grow by one join a step; their number is the answer's size.
    """
    step = edges.select(F.array("id").alias("path"), F.array("segment").alias("segments"), F.col("node_v").alias("last"), F.col("gain").alias("objective"), "length_m")
    out = step
    ahead = edges.select(F.col("id").alias("_id"), F.col("node_u").alias("last"), F.col("node_v").alias("_v"), F.col("segment").alias("_s"), F.col("length_m").alias("_m"), F.col("gain").alias("_g"))
    for _ in range(depth - 1):
        grown = step.join(ahead, "last").where(~F.array_contains("segments", F.col("_s")))
        step = grown.select(F.array_append("path", F.col("_id")).alias("path"), F.array_append("segments", F.col("_s")).alias("segments"), F.col("_v").alias("last"), (F.col("objective") + F.col("_g")).alias("objective"), (F.col("length_m") + F.col("_m")).alias("length_m"))
        out = out.unionByName(step)
    return out
