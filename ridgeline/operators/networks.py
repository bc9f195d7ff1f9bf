"""Networks: nodes (node_id, lon, lat) and directed edges (node_u, node_v, key, ...).

Relational steps are joins and aggregations on node ids. Climb detection is
sequential inside a connected part, so it runs as one kernel a group.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgeline.functions.measures import KM_PER_DEGREE, finite, ratio, segment_id
from ridgeline.functions.tags import has_road, has_trail, sac_name, sac_rank
from ridgeline.session import ensure_checkpoint_dir


def normalize_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Fills missing geometries with the straight line between an edge's nodes."""
    side = lambda x: nodes.select(F.col("node_id").alias(f"node_{x}"), F.struct("lon", "lat").alias(f"_{x}"))
    joined = edges.join(side("u"), "node_u", "left").join(side("v"), "node_v", "left")
    return joined.withColumn("geometry", F.coalesce("geometry", F.array("_u", "_v"))).drop("_u", "_v")


def endpoints(edges: DataFrame) -> DataFrame:
    """(node_id) of both ends of each edge, with repeats."""
    return edges.select(F.explode(F.array("node_u", "node_v")).alias("node_id"))


def drop_orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(endpoints(edges), "node_id", "left_semi")


def degree(edges: DataFrame) -> DataFrame:
    return endpoints(edges).groupBy("node_id").agg(F.count("*").alias("degree"))


def inside_box(lon: Column, lat: Column, centre_lon: float, centre_lat: float, half_lon: float, half_lat: float) -> Column:
    return F.abs(lon - centre_lon).__le__(half_lon) & F.abs(lat - centre_lat).__le__(half_lat)


def inside_area(lon: Column, lat: Column, area: dict) -> Column:
    """Whether a point is in a rectangle (of `resolve_area`) turned clockwise from north; the boundary counts, and a place that isn't finite is outside."""
    scale, a = KM_PER_DEGREE * math.cos(math.radians(area["lat"])), math.radians(area["angle_deg"])
    east, north = (lon - area["lon"]) * scale, (lat - area["lat"]) * KM_PER_DEGREE
    x, y = east * math.cos(a) - north * math.sin(a), east * math.sin(a) + north * math.cos(a)
    return finite(lon) & finite(lat) & (F.abs(x) <= area["half_width_km"] + 1e-9) & (F.abs(y) <= area["half_height_km"] + 1e-9)


def truncate(edges: DataFrame, nodes: DataFrame, inside: Column) -> DataFrame:
    """Edges with both ends inside."""
    kept = nodes.where(inside).select("node_id")
    ends = lambda x: kept.withColumnRenamed("node_id", f"node_{x}")
    return edges.join(ends("u"), "node_u", "left_semi").join(ends("v"), "node_v", "left_semi")


def weak_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node_id, component): the smallest node id reachable.

    Labels sink along edges and jump to their label's label; each round is
    checkpointed in the shared folder, and rounds grow with the logarithm of the diameter.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    both = edges.select(F.col("node_u").alias("a"), F.col("node_v").alias("b"))
    both = both.unionAll(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.select(F.col("a").alias("node_id"), F.col("a").alias("component")).distinct()
    before = None
    for _ in range(most_rounds):
        near = both.join(labels, both["b"] == labels["node_id"]).groupBy("a").agg(F.min("component").alias("low"))
        sunk = labels.join(near, labels["node_id"] == near["a"]).select("node_id", F.least("component", "low").alias("component"))
        jump = sunk.select(F.col("node_id").alias("j"), F.col("component").alias("to"))
        labels = sunk.join(jump, sunk["component"] == jump["j"]).select("node_id", F.least("component", "to").alias("component")).checkpoint()
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return labels
        before = now
    raise RuntimeError("components did not settle")


def strong_components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node_id, component): the smallest node id of those that a node reaches and is reached by.

    Colouring: the smallest id that reaches a node is its colour, and what
    reaches that id back inside the colour is its component; the rest goes on
    among itself. Each round is a join and an aggregation in the shared folder.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    links = edges.select(F.col("node_u").alias("a"), F.col("node_v").alias("b")).where("a <> b").distinct().checkpoint()
    nodes, done = endpoints(edges).distinct().checkpoint(), None
    for _ in range(most_rounds):
        colour = _spread(links, nodes.withColumn("colour", F.col("node_id")), most_rounds)
        side = lambda x: colour.select(F.col("node_id").alias(x), F.col("colour").alias(f"colour_{x}"))  # noqa: B023, E731
        inner = links.join(side("a"), "a").join(side("b"), "b").where("colour_a = colour_b").select("a", "b").checkpoint()
        # Back from the roots: 0 reaches its root, 1 isn't known to.
        back = _spread(inner.select(F.col("b").alias("a"), F.col("a").alias("b")), colour.withColumn("colour", (F.col("node_id") != F.col("colour")).cast("long")).select("node_id", "colour"), most_rounds)
        settled = back.where("colour = 0").select("node_id").join(colour, "node_id").select("node_id", F.col("colour").alias("component")).checkpoint()
        done = settled if done is None else done.unionByName(settled)
        nodes = nodes.join(settled, "node_id", "left_anti").checkpoint()
        if nodes.isEmpty():
            return done
        links = inner.join(nodes.withColumnRenamed("node_id", "a"), "a", "left_semi").join(nodes.withColumnRenamed("node_id", "b"), "b", "left_semi").checkpoint()
    raise RuntimeError("components did not settle")


def _spread(links: DataFrame, labels: DataFrame, most_rounds: int) -> DataFrame:
    """Labels (node_id, colour), each lowered to the least that reaches the node along links."""
    before = None
    for _ in range(most_rounds):
        near = links.join(labels, links["a"] == labels["node_id"]).groupBy("b").agg(F.min("colour").alias("low"))
        labels = labels.join(near, labels["node_id"] == near["b"], "left").select("node_id", F.least("colour", F.coalesce("low", "colour")).alias("colour")).checkpoint()
        now = labels.agg(F.sum(F.col("colour").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return labels
        before = now
    raise RuntimeError("labels did not settle")


def largest_component(labels: DataFrame) -> DataFrame:
    """(node_id) of the component with most nodes; the smallest label wins a tie."""
    top = labels.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return labels.join(top, "component", "left_semi").select("node_id")


def adjacency(edges: DataFrame, cap: int, most: int | None = None) -> DataFrame:
    """(node_u, rank, node_v, key, gain): the usable edges of each node, most gain first, ties by node and key."""
    rank = sac_rank(F.col("sac_scale"))
    usable = edges.where(rank.isNull() | (rank <= cap)).withColumn("gain", F.col("d_plus_m") + F.col("d_minus_m"))
    order = Window.partitionBy("node_u").orderBy(F.desc("gain"), "node_v", "key")
    out = usable.withColumn("rank", F.row_number().over(order))
    return (out.where(F.col("rank") <= most) if most else out).select("node_u", "rank", "node_v", "key", "gain")


def non_exempt_segments(edges: DataFrame) -> DataFrame:
    """(a, b, k): pieces of way that some edge holds which may not be used again."""
    return edges.where(~F.col("reusable")).select(F.explode("base_segment_ids").alias("s")).select("s.*").distinct()


def junctions(edges: DataFrame) -> DataFrame:
    """(node_id, is_junction): touched by a road and by a trail, in either direction. Climbs (is_super) are trails."""
    trail, road = F.col("is_super") | has_trail(F.col("highway")), ~F.col("is_super") & has_road(F.col("highway"))
    ends = edges.select(F.explode(F.array("node_u", "node_v")).alias("node_id"), trail.alias("t"), road.alias("r"))
    return ends.groupBy("node_id").agg((F.bool_or("t") & F.bool_or("r")).alias("is_junction"))


def junction_flags(nodes: DataFrame, flags: DataFrame) -> DataFrame:
    """`nodes` with is_junction; nodes without a flag are none."""
    return nodes.join(flags.select("node_id", "is_junction"), "node_id", "left").withColumn("is_junction", F.coalesce("is_junction", F.lit(False)))


class ContractError(ValueError):
    """A stage's input breaks what the stage relies on."""


def guard(edges: DataFrame, vertices: DataFrame, what: str) -> None:
    """Raises unless there are edges, and all places and elevations are finite."""
    if edges.isEmpty():
        raise ContractError(f"{what}: no edges are left")
    bad = broken_vertices(vertices).first()
    if bad["places"] or bad["elevations"]:
        raise ContractError(f"{what}: {bad['places']} places and {bad['elevations']} elevations are not finite, first on edge {bad['edge']}")


def broken_vertices(vertices: DataFrame) -> DataFrame:
    """(places, elevations, edge): how many vertices have a place or an elevation that isn't finite, and the first edge with one."""
    place, elev = finite(F.col("lon")) & finite(F.col("lat")), finite(F.col("elev"))
    return vertices.agg(F.count_if(~place).alias("places"), F.count_if(~elev).alias("elevations"), F.min(F.when(~(place & elev), F.col("edge"))).alias("edge"))


def climb_seeds(edges: DataFrame, slope: float) -> DataFrame:
    return edges.where(F.col("length_m") > 0).where(F.col("d_plus_m") / F.col("length_m") >= slope)


CLIMBS = "component long, climb_id long, seq int, node_u long, node_v long, key int, length_m double, d_plus_m double"


def grow_climbs(edges: list[tuple[int, int, int, float, float]], slope: float, least_length: float) -> list[list[tuple[int, int, int, float, float]]]:
    """Climbs of edges (u, v, key, length, d_plus).

    Seeds go in order of (u, v, key). A climb grows down over edges that are
    steep themselves, then up while its mean slope holds, always by the
    steepest edge to a node that it has not visited. Long climbs use up their edges.
    """
    leaving: dict[int, list] = {}
    arriving: dict[int, list] = {}
    for edge in sorted(edges):
        leaving.setdefault(edge[0], []).append(edge)
        arriving.setdefault(edge[1], []).append(edge)
    used: set[tuple[int, int, int]] = set()
    climbs = []

    def steepest(options: list, visited: set[int], end: int, fits) -> tuple | None:
        free = [e for e in options if e[:3] not in used and e[end] not in visited and fits(e)]
        return max(free, key=lambda e: e[4] / e[3], default=None)  # the first of equals: options are sorted

    for seed in sorted(edges):
        if seed[:3] in used or seed[4] / seed[3] < slope:
            continue
        path, visited = [seed], {seed[0], seed[1]}
        length, climbed = seed[3], seed[4]
        while edge := steepest(arriving.get(path[0][0], []), visited, 0, lambda e: e[4] / e[3] >= slope):
            path.insert(0, edge)
            visited.add(edge[0])
            length, climbed = length + edge[3], climbed + edge[4]
        while edge := steepest(leaving.get(path[-1][1], []), visited, 1, lambda e: (climbed + e[4]) / (length + e[3]) >= slope):
            path.append(edge)
            visited.add(edge[1])
            length, climbed = length + edge[3], climbed + edge[4]
        if length >= least_length:
            climbs.append(path)
            used.update(e[:3] for e in path)
    return climbs


def detect_climbs(edges: DataFrame, slope: float, least_length: float) -> DataFrame:
    """Climbs (CLIMBS) of edges (component, node_u, node_v, key, length_m, d_plus_m); components run side by side."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        component = int(group["component"].iloc[0])
        rows = list(group[["node_u", "node_v", "key", "length_m", "d_plus_m"]].itertuples(index=False, name=None))
        out = [(component, c, s, *e) for c, path in enumerate(grow_climbs(rows, slope, least_length)) for s, e in enumerate(path)]
        return pd.DataFrame(out, columns=[x.split()[0] for x in CLIMBS.split(", ")])

    usable = edges.where("length_m > 0").select("component", "node_u", "node_v", "key", "length_m", "d_plus_m")
    return usable.groupBy("component").applyInPandas(run, CLIMBS)


def connectors(edges: DataFrame, climbs: DataFrame, least_connector: float, on: tuple[str, ...] = ("component", "node_u", "node_v", "key")) -> DataFrame:
    """Edges in no climb, with their piece of way and whether they may be used again."""
    rest = edges.join(climbs.select(*on), list(on), "left_anti")
    own = F.array(segment_id(F.col("node_u"), F.col("node_v"), F.col("key")))
    return rest.withColumns({"base_segment_ids": own, "reusable": F.col("length_m") < least_connector, "is_super": F.lit(False)})


def split_climbs(climbs: DataFrame, edges: DataFrame) -> DataFrame:
    """`climbs` with part: cut at inner nodes that touch a piece of way outside the climb."""
    ident = segment_id(F.col("node_u"), F.col("node_v"), F.col("key"))
    ends = edges.select("component", F.explode(F.array("node_u", "node_v")).alias("node"), ident.alias("sid")).distinct()
    own = climbs.select("component", "climb_id", ident.alias("sid")).distinct()
    last = Window.partitionBy("component", "climb_id").orderBy("seq")
    inner = climbs.withColumn("node", F.lag("node_v").over(last))
    touched = inner.where("node is not null").select("component", "climb_id", "seq", "node").join(ends, ["component", "node"])
    cuts = touched.join(own, ["component", "climb_id", "sid"], "left_anti").select("component", "climb_id", "seq").distinct().withColumn("cut", F.lit(1))
    marked = climbs.join(cuts, ["component", "climb_id", "seq"], "left")
    return marked.withColumn("part", F.sum(F.coalesce("cut", F.lit(0))).over(last.rowsBetween(Window.unboundedPreceding, 0))).drop("cut")


def super_edges(parts: DataFrame, kept: DataFrame) -> DataFrame:
    """One edge for each part of a climb, with the metrics of its edges and the next free key between its ends.

    parts: rows of split_climbs with d_minus_m, sac_scale and max_windowed_descent_grad.
    """
    ident = segment_id(F.col("node_u"), F.col("node_v"), F.col("key"))
    merged = parts.groupBy("component", "climb_id", "part").agg(
        F.min_by("node_u", "seq").alias("node_u"),
        F.max_by("node_v", "seq").alias("node_v"),
        F.sum("length_m").alias("length_m"),
        F.sum("d_plus_m").alias("d_plus_m"),
        F.sum("d_minus_m").alias("d_minus_m"),
        F.max(sac_rank(F.col("sac_scale"))).alias("_rank"),
        F.max(F.coalesce("max_windowed_descent_grad", F.lit(0.0))).alias("max_windowed_descent_grad"),
        F.array_sort(F.collect_set(ident)).alias("base_segment_ids"),
    )
    taken = kept.groupBy("component", "node_u", "node_v").agg(F.max("key").alias("_top"))
    order = Window.partitionBy("component", "node_u", "node_v").orderBy("climb_id", "part")
    out = merged.join(taken, ["component", "node_u", "node_v"], "left")
    out = out.withColumn("key", (F.coalesce("_top", F.lit(-1)) + F.row_number().over(order)).cast("int"))
    out = out.withColumns({"avg_gradient": ratio(F.col("d_plus_m"), F.col("d_minus_m"), F.col("length_m")), "sac_scale": F.when(F.col("_rank").isNotNull(), F.array(sac_name(F.col("_rank")))), "reusable": F.lit(False), "is_super": F.lit(True)})
    return out.drop("_top", "_rank")


def contract(edges: DataFrame, climbs: DataFrame, least_connector: float) -> DataFrame:
    """The search network: connectors and one edge for each part of a climb."""
    kept = connectors(edges, climbs, least_connector)
    extra = edges.select("component", "node_u", "node_v", "key", "d_minus_m", "sac_scale", "max_windowed_descent_grad")
    parts = split_climbs(climbs, edges).join(extra, ["component", "node_u", "node_v", "key"])
    return kept.unionByName(super_edges(parts, kept), allowMissingColumns=True)
