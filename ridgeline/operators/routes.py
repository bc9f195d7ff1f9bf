"""Routes: (route, seq, node_u, node_v, key, length_m, d_plus_m, d_minus_m, ...) in walking order.

Validation is relational: one branch for each constraint, and failures are rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgeline.functions.measures import ratio
from ridgeline.functions.tags import descends_over, sac_rank

ID = ("node_u", "node_v", "key")
VIOLATION = ("route", "ord", "seq", "constraint_id", "observed", "required")


def route_metrics(routes: DataFrame) -> DataFrame:
    out = routes.groupBy("route").agg(F.sum("length_m").alias("length_m"), F.sum("d_plus_m").alias("d_plus_m"), F.sum("d_minus_m").alias("d_minus_m"))
    return out.withColumn("avg_gradient", ratio(F.col("d_plus_m"), F.col("d_minus_m"), F.col("length_m")))


def theta_prefix(routes: DataFrame, theta: float) -> DataFrame:
    """Each route's longest prefix whose mean gradient is at least theta; routes without one go."""
    w = Window.partitionBy("route").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = routes.withColumns({"_m": F.sum("length_m").over(w), "_h": F.sum(F.col("d_plus_m") + F.col("d_minus_m")).over(w)})
    clears = F.when(F.col("_m") > 0, F.col("_h") / F.col("_m")).otherwise(F.lit(0.0)) >= theta
    last = F.max(F.when(clears, F.col("seq"))).over(Window.partitionBy("route"))
    return rows.withColumn("_last", last).where("seq <= _last").drop("_m", "_h", "_last")


def first_occurrences(routes: DataFrame) -> DataFrame:
    """Distinct edges of each route, at their first place."""
    order = Window.partitionBy("route", *ID).orderBy("seq")
    return routes.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def reuse(routes: DataFrame, segments: str = "blocking") -> DataFrame:
    """(route, sid, n): pieces of way that a route uses more than once."""
    return routes.select("route", F.explode(segments).alias("sid")).groupBy("route", "sid").agg(F.count("*").alias("n")).where("n > 1")


def not_in_network(routes: DataFrame, network: DataFrame) -> DataFrame:
    return routes.join(network.select(*ID), list(ID), "left_anti")


def violations(routes: DataFrame, network: DataFrame, theta: float, cap: int, max_descent: float | None = None, starts: DataFrame | None = None) -> DataFrame:
    """VIOLATION rows. network: edges with max_windowed_descent_grad and blocking (pieces of way that may be used once).

    starts: (node_id) where routes may begin, if that is asked for.
    """

    def rows(frame: DataFrame, ord_: int, name: str, observed: Column, required: Column, seq: Column | None = None) -> DataFrame:
        return frame.select("route", F.lit(ord_).alias("ord"), (F.lit(0) if seq is None else seq).cast("long").alias("seq"), F.lit(name).alias("constraint_id"), observed.cast("double").alias("observed"), required.cast("double").alias("required"))

    metrics, unique = route_metrics(routes), first_occurrences(routes)
    out = rows(metrics.where(F.col("avg_gradient") < theta), 1, "slope_floor", F.col("avg_gradient"), F.lit(theta))
    if starts is not None:
        heads = routes.groupBy("route").agg(F.min_by("node_u", "seq").alias("node_id"))
        out = out.unionByName(rows(heads.join(starts, "node_id", "left_anti"), 2, "start_at_junction", F.lit(0), F.lit(1)))
    rank = sac_rank(F.col("sac_scale"))
    out = out.unionByName(rows(unique.where(rank > cap), 3, "difficulty_cap", rank, F.lit(cap), F.col("seq")))
    out = out.unionByName(rows(not_in_network(unique, network), 4, "graph_membership", F.lit(0), F.lit(1), F.col("seq")))
    known = network.select(*ID, F.col("d_plus_m").alias("_p"), F.col("d_minus_m").alias("_n"), F.col("max_windowed_descent_grad").alias("_g"), "blocking")
    if max_descent is not None:
        steep = unique.join(known, list(ID)).where(descends_over(max_descent, F.col("_p"), F.col("_n"), F.col("_g")))
        out = out.unionByName(rows(steep, 5, "max_descent_slope", F.col("_g"), F.lit(max_descent), F.col("seq")))
    twice = reuse(routes.drop("blocking").join(known, list(ID)))
    return out.unionByName(rows(twice, 6, "edge_reuse", F.col("n"), F.lit(1)))


def shared_pairs(sets: DataFrame, most_shared: float) -> DataFrame:
    """(a, b, similarity): pairs of sets (id, item) whose Jaccard similarity is over a limit.

    Items are joined, so only pairs that share something are formed.
    """
    items = sets.distinct()
    sizes = items.groupBy("id").agg(F.count("*").alias("n"))
    left, right = items.withColumnRenamed("id", "a"), items.withColumnRenamed("id", "b")
    common = left.join(right, "item").where("a < b").groupBy("a", "b").agg(F.count("*").alias("c"))
    both = common.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    out = both.select("a", "b", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("similarity"))
    return out.where(F.col("similarity") > most_shared)


def top_by_objective(candidates: DataFrame, n: int, group: str | None = None) -> DataFrame:
    """The first n by falling objective, ties by their sorted segments."""
    order = Window.partitionBy(*([group] if group else [])).orderBy(F.desc("objective"), F.array_sort("segments"))
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def worst_held(held: DataFrame) -> DataFrame:
    """The member that a better one replaces: least objective, then the largest segments, then the least id; no row if none is held."""
    return held.orderBy(F.asc_nulls_last("objective"), F.desc_nulls_last(F.array_sort("segments")), "id").select("id").limit(1)


def with_base_edges(routes: DataFrame, base: DataFrame) -> DataFrame:
    """Routes with climbs expanded. base: (node_u, node_v, key, base_seq, base_u, base_v, base_key)."""
    joined = routes.join(base, list(ID), "left")
    return joined.select(
        "route",
        "seq",
        F.coalesce("base_seq", F.lit(0)).alias("base_seq"),
        F.coalesce("base_u", "node_u").alias("node_u"),
        F.coalesce("base_v", "node_v").alias("node_v"),
        F.coalesce("base_key", "key").alias("key"),
    )


def base_ids(routes: DataFrame, network: DataFrame) -> DataFrame:
    """(route, seq, base_segment_ids) of each edge; an edge that the network doesn't have is an error."""
    joined = routes.select("route", "seq", *ID).join(network.select(*ID, "base_segment_ids"), list(ID), "left")
    unknown = F.raise_error(F.concat(F.lit("no such edge: "), F.concat_ws(" ", *ID)))
    return joined.select("route", "seq", F.coalesce("base_segment_ids", unknown.cast(network.schema["base_segment_ids"].dataType)).alias("base_segment_ids"))


def run_summary(objectives: DataFrame, found: DataFrame) -> DataFrame:
    """(routes, total_objective, failures) of routes (route, objective) and their violations (route, ...)."""
    bad = found.select("route").distinct().withColumn("bad", F.lit(1))
    joined = objectives.join(bad, "route", "left")
    return joined.agg(F.count("*").alias("routes"), F.coalesce(F.sum("objective"), F.lit(0.0)).alias("total_objective"), F.count("bad").alias("failures"))


def sequence_hash(routes: DataFrame) -> DataFrame:
    """(route, hash): SHA-256 of the canonical JSON of each route's sorted edges."""
    triple = F.array(*[F.col(c).cast("long") for c in ID])
    return routes.groupBy("route").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(triple))), 256).alias("hash"))


def golden_diff(old: DataFrame, new: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(route, field, old, new) where two result sets differ; a missing route differs in all fields."""
    side = lambda df, x: df.select("route", *[F.col(f).cast("string").alias(f"{x}_{f}") for f in fields])
    both = side(old, "old").join(side(new, "new"), "route", "full_outer")
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"old_{f}").alias("old"), F.col(f"new_{f}").alias("new")) for f in fields]))
    return both.select("route", cells.alias("c")).select("route", "c.*").where(~F.col("old").eqNullSafe(F.col("new")))


def feature_collection(vertices: DataFrame) -> DataFrame:
    """(edge, feature): a GeoJSON line for each edge, coordinates as [lon, lat]."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("idx", "lon", "lat"))), lambda p: F.array(p["lon"], p["lat"]))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), line.alias("coordinates")).alias("geometry"))
    return vertices.groupBy("edge").agg(F.to_json(feature).alias("feature"))
