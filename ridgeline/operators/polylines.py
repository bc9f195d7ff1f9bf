"""Polylines as rows: (edge, idx, lon, lat, elev).

All steps window or group by edge, so one shuffle by edge serves a whole chain
of them; an edge is the unit of parallelism, however many there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgeline.functions.measures import DEM_M_PER_DEGREE, easting, finite, northing, ratio

SPACING_M = 10.0
SHORT_EDGE_M = 1e-3
DESCENT_RUN_M = 30.0
DIFFUSION = 0.5


def _by(edge: str = "edge"):
    return Window.partitionBy(edge).orderBy("idx")


def valid_edges(vertices: DataFrame) -> DataFrame:
    """(edge, valid): two vertices or more, all finite, not all the same."""
    place = F.struct("lon", "lat")
    return vertices.groupBy("edge").agg(
        ((F.count("*") >= 2) & F.every(finite(F.col("lon")) & finite(F.col("lat"))) & (F.min(place) != F.max(place))).alias("valid")
    )


def smooth(vertices: DataFrame) -> DataFrame:
    """Mean of each vertex with its two neighbours; end points stay."""
    w = _by()

    def mean(x: str) -> Column:
        left, right = F.lag(x).over(w), F.lead(x).over(w)
        return F.when(left.isNull() | right.isNull(), F.col(x)).otherwise((left + F.col(x) + right) / 3)

    return vertices.select("edge", "idx", mean("lon").alias("lon"), mean("lat").alias("lat"), *[c for c in vertices.columns if c not in ("edge", "idx", "lon", "lat")])


def arc_length(vertices: DataFrame) -> DataFrame:
    """Adds seg (m from the vertex before, 0 at the first) and cum, in a projection at the edge's mean latitude."""
    whole, w = Window.partitionBy("edge"), _by()
    flat = vertices.withColumn("_lat", F.avg("lat").over(whole)).withColumns({"_x": easting(F.col("lon"), F.col("_lat")), "_y": northing(F.col("lat"))})
    dx, dy = F.col("_x") - F.lag("_x").over(w), F.col("_y") - F.lag("_y").over(w)
    out = flat.withColumn("seg", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)))
    out = out.withColumn("cum", F.sum("seg").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.drop("_lat", "_x", "_y")


def edge_metrics(vertices: DataFrame) -> DataFrame:
    """One row an edge: length_m, d_plus_m, d_minus_m, avg_gradient, max_windowed_descent_grad.

    The windowed descent looks from each vertex to the first one at least 30 m
    ahead; an edge without any such pair falls back to its ends.
    """
    w = _by()
    # From the far end on, the vertices at least so far ahead are a running frame: linear, where a look ahead would be quadratic.
    far = f"min(struct(cum, idx, elev)) over (partition by edge order by cum desc range between unbounded preceding and {DESCENT_RUN_M}D preceding)"
    rows = arc_length(vertices).withColumns({"dz": F.col("elev") - F.lag("elev").over(w), "far": F.expr(far)})
    rows = rows.withColumns({"far_z": F.col("far.elev"), "far_cum": F.col("far.cum")})
    drop, run = F.col("elev") - F.col("far_z"), F.col("far_cum") - F.col("cum")
    grade = F.when(F.col("far_cum").isNotNull(), F.when(drop > 0, drop / run).otherwise(F.lit(0.0)))
    out = rows.withColumn("grade", grade).groupBy("edge").agg(
        F.sum("seg").alias("length_m"),
        F.sum(F.greatest(F.coalesce("dz", F.lit(0.0)), F.lit(0.0))).alias("d_plus_m"),
        F.sum(F.greatest(-F.coalesce("dz", F.lit(0.0)), F.lit(0.0))).alias("d_minus_m"),
        F.max("grade").alias("grade"),
        (F.min_by("elev", "idx") - F.max_by("elev", "idx")).alias("fall"),
    )
    ends = F.when((F.col("fall") > 0) & (F.col("length_m") > 0), F.col("fall") / F.col("length_m")).otherwise(F.lit(0.0))
    return out.select(
        "edge",
        "length_m",
        "d_plus_m",
        "d_minus_m",
        ratio(F.col("d_plus_m"), F.col("d_minus_m"), F.col("length_m")).alias("avg_gradient"),
        F.coalesce("grade", ends).alias("max_windowed_descent_grad"),
    )


def long_enough(vertices: DataFrame, least_m: float = SHORT_EDGE_M) -> DataFrame:
    """Vertices of edges that are not degenerate."""
    keep = arc_length(vertices).groupBy("edge").agg(F.sum("seg").alias("_m")).where(F.col("_m") >= least_m).select("edge")
    return vertices.join(keep, "edge", "left_semi")


def resample(vertices: DataFrame, spacing: float = SPACING_M) -> DataFrame:
    """Vertices at even spacing: rint(length / spacing) steps (1 at least), end points exact.

    Each segment makes the samples that fall into it, so the work is linear in
    vertices and samples.
    """
    whole, w = Window.partitionBy("edge"), _by()
    rows = arc_length(vertices).withColumns({"total": F.sum("seg").over(whole), "lon0": F.lag("lon").over(w), "lat0": F.lag("lat").over(w), "cum0": F.lag("cum").over(w)})
    rows = rows.withColumn("n", F.greatest(F.lit(1.0), F.rint(F.col("total") / spacing)).cast("int")).withColumn("step", F.col("total") / F.col("n"))
    first, last = F.floor(F.col("cum0") / F.col("step")).cast("int"), F.ceil(F.col("cum") / F.col("step")).cast("int")
    inside = rows.where("seg > 0").withColumn("k", F.explode(F.sequence(F.greatest(first, F.lit(1)), F.greatest(last, F.greatest(first, F.lit(1))))))
    d = F.col("k") * F.col("step")
    inside = inside.where((F.col("k") < F.col("n")) & (d > F.col("cum0")) & (d <= F.col("cum")))
    t = F.least(F.greatest((d - F.col("cum0")) / F.col("seg"), F.lit(0.0)), F.lit(1.0))
    inside = inside.select("edge", F.col("k").alias("idx"), (F.col("lon0") + t * (F.col("lon") - F.col("lon0"))).alias("lon"), (F.col("lat0") + t * (F.col("lat") - F.col("lat0"))).alias("lat"))
    ends = rows.groupBy("edge").agg(F.min_by(F.struct("lon", "lat"), "idx").alias("a"), F.max_by(F.struct("lon", "lat"), "idx").alias("b"), F.max("n").alias("n"))
    heads = ends.select("edge", F.lit(0).alias("idx"), "a.lon", "a.lat")
    tails = ends.select("edge", F.col("n").alias("idx"), "b.lon", "b.lat")
    return inside.unionByName(heads).unionByName(tails)


def deadband(vertices: DataFrame, threshold: float) -> DataFrame:
    """Elevations without reversals under the threshold: kept vertices are those that far from the last kept one, and both ends; between them by index.

    A reference that moves with each kept vertex is sequential, so each edge is one linear pass over its elevations.
    """
    if threshold <= 0:
        return vertices

    def level(edge: pd.DataFrame) -> pd.DataFrame:
        edge = edge.sort_values("idx", kind="stable")
        place, elev = edge["idx"].to_numpy(float), edge["elev"].to_numpy(float)
        kept, ref = [0], elev[0]
        for k, z in enumerate(elev.tolist()):
            if abs(z - ref) >= threshold:
                ref = z
                if k:
                    kept.append(k)
        if kept[-1] != len(elev) - 1:
            kept.append(len(elev) - 1)
        at = np.maximum(np.searchsorted(kept, np.arange(len(elev)), "right") - 1, 0)
        a, b = np.array(kept)[at], np.array(kept)[np.minimum(at + 1, len(kept) - 1)]
        span = np.where(b > a, place[b] - place[a], 1.0)
        edge["elev"] = elev[a] + (place - place[a]) / span * (elev[b] - elev[a])
        return edge

    return vertices.groupBy("edge").applyInPandas(level, vertices.schema)


def valid_for_metrics(vertices: DataFrame, least_m: float = 1e-6) -> DataFrame:
    """(edge, valid): two vertices or more, all numbers finite, and a length that isn't nothing."""
    sound = finite(F.col("lon")) & finite(F.col("lat")) & finite(F.col("elev"))
    whole = arc_length(vertices.withColumn("_sound", sound)).groupBy("edge").agg(F.count("*").alias("n"), F.every("_sound").alias("sound"), F.sum("seg").alias("m"))
    return whole.select("edge", ((F.col("n") >= 2) & F.col("sound") & F.coalesce(F.col("m") >= least_m, F.lit(False))).alias("valid"))


def margin_box(vertices: DataFrame, margin_m: float) -> DataFrame:
    """(left, bottom, right, top) of all finite vertices and a margin on the ground, at the box's middle latitude."""
    box = vertices.where(finite(F.col("lon")) & finite(F.col("lat"))).agg(F.min("lon").alias("l"), F.min("lat").alias("b"), F.max("lon").alias("r"), F.max("lat").alias("t"))
    up = F.lit(margin_m / DEM_M_PER_DEGREE)
    across = up / F.cos(F.radians((F.col("b") + F.col("t")) / 2))
    return box.select((F.col("l") - across).alias("left"), (F.col("b") - up).alias("bottom"), (F.col("r") + across).alias("right"), (F.col("t") + up).alias("top"))


def diffusion_steps(strength_m: float, spacing: float = SPACING_M) -> int:
    """Sweeps for a smoothing length; 0 at or under the spacing."""
    window = strength_m / spacing
    return 0 if window <= 1 else max(1, round(window * window / 6))


def smooth_elevation(field: DataFrame, neighbours: DataFrame, sweeps: int) -> DataFrame:
    """Diffusion over a whole network: field (point, elev), neighbours (point, other).

    A sweep moves each point half-way to the mean of its neighbours. Sweeps are
    few (diffusion_steps), so they unroll into one plan of joins on point.
    """
    for _ in range(sweeps):
        means = neighbours.join(field.select(F.col("point").alias("other"), F.col("elev").alias("z")), "other").groupBy("point").agg(F.avg("z").alias("z"))
        field = field.join(means, "point", "left").select("point", F.coalesce((1 - DIFFUSION) * F.col("elev") + DIFFUSION * F.col("z"), F.col("elev")).alias("elev"))
    return field


def smooth_elevation_of_edges(edges: DataFrame, strength_m: float, component: str = "component") -> DataFrame:
    """The same for edges (component, node_u, node_v, key, elevs): nodes are shared points, inner vertices are not.

    Components are independent, and each is relaxed as arrays in one task.
    """
    sweeps = diffusion_steps(strength_m)
    if not sweeps:
        return edges

    def relax(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["node_u", "node_v", "key"], kind="stable").reset_index(drop=True)
        nodes, seeds, values, layout, pairs = {}, [], [], [], []
        for u, v, elevs in zip(group["node_u"], group["node_v"], group["elevs"], strict=True):
            for node, z in ((u, elevs[0]), (v, elevs[-1])):
                if node not in nodes:
                    nodes[node] = len(seeds)
                    seeds.append(z)
        at = len(seeds)
        for u, v, elevs in zip(group["node_u"], group["node_v"], group["elevs"], strict=True):
            inner = range(at, at + max(len(elevs) - 2, 0))
            chain = [nodes[u], *inner, nodes[v]]
            values.extend(elevs[1:-1])
            layout.append(chain)
            pairs += [x for a, b in zip(chain, chain[1:], strict=False) for x in ((a, b), (b, a))]
            at += len(inner)
        x = np.array([*seeds, *values], float)
        here, there = np.array(pairs, np.int64).T
        degree = np.bincount(here, minlength=len(x))
        for _ in range(sweeps):
            x = (1 - DIFFUSION) * x + DIFFUSION * (np.bincount(here, weights=x[there], minlength=len(x)) / degree)
        group["elevs"] = [x[chain].tolist() for chain in layout]
        return group

    return edges.groupBy(component).applyInPandas(relax, edges.schema)


def operationalize(vertices: DataFrame, ends: DataFrame, strength_m: float, threshold: float) -> DataFrame:
    """`vertices` with elevations smoothed over the whole network, then levelled along each edge: what metrics are taken of.

    ends: (edge, node_u, node_v); an edge's first and last vertex are its nodes,
    which edges share. A node starts at the elevation of its first edge.
    """
    last = F.max("idx").over(Window.partitionBy("edge"))
    rows = vertices.join(ends, "edge").withColumn("_last", last)
    inner = F.concat_ws("-", "edge", "idx")
    point = F.when(F.col("idx") == 0, F.concat(F.lit("n"), "node_u")).when(F.col("idx") == F.col("_last"), F.concat(F.lit("n"), "node_v")).otherwise(inner)
    rows = rows.withColumn("point", point).drop("_last", "node_u", "node_v")
    sweeps = diffusion_steps(strength_m)
    if sweeps:
        links = rows.select(F.col("point").alias("a"), F.lead("point").over(_by()).alias("b")).where("b is not null")
        both = links.select(F.col("a").alias("point"), F.col("b").alias("other")).unionAll(links.select(F.col("b").alias("point"), F.col("a").alias("other")))
        field = smooth_elevation(rows.groupBy("point").agg(F.min_by("elev", F.struct("edge", "idx")).alias("elev")), both, sweeps)
        rows = rows.drop("elev").join(field, "point")
    return deadband(rows.select(vertices.columns), threshold)


def without_repeats(vertices: DataFrame) -> DataFrame:
    """Drops vertices equal to the one before."""
    before = F.lag(F.struct("lon", "lat", "elev")).over(_by())
    return vertices.withColumn("_same", before.eqNullSafe(F.struct("lon", "lat", "elev"))).where("not _same").drop("_same")


def baseline_slope(vertices: DataFrame, reach: int = 2) -> DataFrame:
    """Signed slope over `reach` vertices to either side, clipped at the ends."""
    w = _by().rowsBetween(-reach, reach)
    rows = arc_length(vertices)
    rise, run = F.last("elev").over(w) - F.first("elev").over(w), F.last("cum").over(w) - F.first("cum").over(w)
    return rows.withColumn("slope", F.when(run > 0, rise / run).otherwise(F.lit(0.0)))
