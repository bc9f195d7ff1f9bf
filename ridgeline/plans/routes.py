"""Queries over routes and the search. An order's lines stand in for a route, parts for pieces of way."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgeline.functions.measures import portable_round
from ridgeline.operators import networks as N
from ridgeline.operators import polylines as P
from ridgeline.operators import routes as R
from ridgeline.operators import search as S
from ridgeline.plans import networks as plans
from ridgeline.plans import polylines
from ridgeline.plans.polylines import rounded, vertices

R_SQL = """r AS (
  SELECT l_orderkey AS route, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_tax, l_discount, l_returnflag, l_linestatus) - 1 AS seq,
         l_partkey % 50 AS node_u, l_suppkey % 50 AS node_v, l_linenumber % 3 AS key, l_quantity * 10 AS length_m, floor(l_extendedprice / 500) AS d_plus_m, floor(l_tax * 1000) AS d_minus_m,
         CASE l_linenumber % 7 WHEN 0 THEN NULL WHEN 1 THEN ['hiking'] WHEN 2 THEN ['mountain_hiking'] WHEN 3 THEN ['demanding_mountain_hiking'] WHEN 4 THEN ['alpine_hiking'] ELSE ['hiking'] END AS sac_scale
  FROM lineitem)"""


def routes(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = Window.partitionBy("l_orderkey").orderBy(*"l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_shipdate l_tax l_discount l_returnflag l_linestatus".split())
    seven = F.col("l_linenumber") % 7
    one = lambda x: F.array(F.lit(x))
    sac = F.when(seven == 0, None).when(seven == 2, one("mountain_hiking")).when(seven == 3, one("demanding_mountain_hiking")).when(seven == 4, one("alpine_hiking")).otherwise(one("hiking"))
    return lines.select(
        F.col("l_orderkey").alias("route"),
        (F.row_number().over(order) - 1).cast("long").alias("seq"),
        (F.col("l_partkey") % 50).alias("node_u"),
        (F.col("l_suppkey") % 50).alias("node_v"),
        (F.col("l_linenumber") % 3).alias("key"),
        (F.col("l_quantity") * 10).alias("length_m"),
        F.floor(F.col("l_extendedprice") / 500).cast("double").alias("d_plus_m"),
        F.floor(F.col("l_tax") * 1000).cast("double").alias("d_minus_m"),
        sac.alias("sac_scale"),
    )


def route_metrics(spark, sf_dir):
    return R.route_metrics(routes(spark, sf_dir)).withColumn("avg_gradient", portable_round(F.col("avg_gradient"), 9))


METRICS = f"WITH {R_SQL} SELECT route, sum(length_m) AS length_m, sum(d_plus_m) AS d_plus_m, sum(d_minus_m) AS d_minus_m, {rounded('CASE WHEN sum(length_m) > 0 THEN (sum(d_plus_m) + sum(d_minus_m)) / sum(length_m) ELSE 0 END', 9)} AS avg_gradient FROM r GROUP BY route"


def theta_prefix(spark, sf_dir):
    return R.theta_prefix(routes(spark, sf_dir), 0.4).select("route", "seq", "node_u", "node_v")


THETA = f"""WITH {R_SQL}, c AS (SELECT *, sum(length_m) OVER w AS m, sum(d_plus_m + d_minus_m) OVER w AS h FROM r WINDOW w AS (PARTITION BY route ORDER BY seq ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, max(CASE WHEN CASE WHEN m > 0 THEN h / m ELSE 0 END >= 0.4::DOUBLE THEN seq END) OVER (PARTITION BY route) AS last FROM c) SELECT route, seq, node_u, node_v FROM l WHERE seq <= last"""


def distinct_edges(spark, sf_dir):
    return R.first_occurrences(routes(spark, sf_dir)).select("route", "seq", "node_u", "node_v", "key")


DISTINCT = f"WITH {R_SQL} SELECT route, min(seq) AS seq, node_u, node_v, key FROM r GROUP BY route, node_u, node_v, key"


def reuse_violations(spark, sf_dir):
    return R.reuse(routes(spark, sf_dir).withColumn("blocking", F.array(F.col("node_u") % 10))).select("route", F.col("sid"), "n")


REUSE = f"WITH {R_SQL} SELECT route, node_u % 10 AS sid, count(*) AS n FROM r GROUP BY ALL HAVING count(*) > 1"


def _network(spark, sf_dir):
    e = routes(spark, sf_dir).where("route % 10 <> 3")
    one = e.groupBy("node_u", "node_v", "key").agg(F.max("d_plus_m").alias("d_plus_m"), F.min("d_minus_m").alias("d_minus_m"), (F.max("length_m") / 500).alias("max_windowed_descent_grad"))
    return one.withColumns({"d_minus_m": F.col("d_minus_m") + F.col("node_u") * 5, "blocking": F.when(F.col("key") == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.least("node_u", "node_v") % 10))})


NET = """net AS (SELECT node_u, node_v, key, max(d_plus_m) AS p, min(d_minus_m) + node_u * 5 AS n, max(length_m) / 500 AS g FROM r WHERE route % 10 <> 3 GROUP BY node_u, node_v, key),
u AS (SELECT route, min(seq) AS seq, node_u, node_v, key, arg_min(sac_scale, seq) AS sac_scale FROM r GROUP BY route, node_u, node_v, key)"""


def validation(spark, sf_dir):
    starts = spark.range(0, 50).where("id % 3 <> 0").select(F.col("id").alias("node_id"))
    out = R.violations(routes(spark, sf_dir), _network(spark, sf_dir), 0.3, 2, 0.9, starts)
    return out.withColumn("observed", portable_round(F.col("observed"), 9))


VALIDATION = f"""WITH {R_SQL}, {NET}, m AS (SELECT route, CASE WHEN sum(length_m) > 0 THEN (sum(d_plus_m) + sum(d_minus_m)) / sum(length_m) ELSE 0 END AS a FROM r GROUP BY route),
rk AS (SELECT *, CASE sac_scale[1] WHEN 'hiking' THEN 1 WHEN 'mountain_hiking' THEN 2 WHEN 'demanding_mountain_hiking' THEN 3 WHEN 'alpine_hiking' THEN 4 END AS rank FROM u),
v AS (
SELECT route, 1 AS ord, 0 AS seq, 'slope_floor' AS constraint_id, CAST(a AS DOUBLE) AS observed, CAST(0.3 AS DOUBLE) AS required FROM m WHERE a < 0.3::DOUBLE
UNION ALL SELECT route, 2, 0, 'start_at_junction', 0, 1 FROM (SELECT route, arg_min(node_u, seq) AS s FROM r GROUP BY route) WHERE s % 3 = 0
UNION ALL SELECT route, 3, seq, 'difficulty_cap', rank, 2 FROM rk WHERE rank > 2
UNION ALL SELECT route, 4, seq, 'graph_membership', 0, 1 FROM u WHERE NOT EXISTS (SELECT 1 FROM net WHERE net.node_u = u.node_u AND net.node_v = u.node_v AND net.key = u.key)
UNION ALL SELECT route, 5, seq, 'max_descent_slope', g, 0.9 FROM u JOIN net USING (node_u, node_v, key) WHERE n > p AND g > 0.9::DOUBLE
UNION ALL SELECT route, 6, 0, 'edge_reuse', count(*), 1 FROM (SELECT route, least(node_u, node_v) % 10 AS sid FROM r JOIN net USING (node_u, node_v, key) WHERE key <> 0) GROUP BY route, sid HAVING count(*) > 1)
SELECT route, ord, CAST(seq AS BIGINT) AS seq, constraint_id, {rounded('observed', 9)} AS observed, CAST(required AS DOUBLE) AS required FROM v"""


def _sets(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") * 7 + F.col("l_suppkey")).alias("item"))


def jaccard_pairs(spark, sf_dir):
    return R.shared_pairs(_sets(spark, sf_dir), 0.2).withColumn("similarity", portable_round(F.col("similarity"), 9))


JACCARD = f"""WITH s AS (SELECT DISTINCT l_orderkey AS id, l_partkey * 7 + l_suppkey AS item FROM lineitem), n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM s x JOIN s y ON x.item = y.item AND x.id < y.id GROUP BY ALL)
SELECT a, b, {rounded('c / CAST(p.n + q.n - c AS DOUBLE)', 9)} AS similarity FROM c JOIN n p ON a = p.id JOIN n q ON b = q.id WHERE c / CAST(p.n + q.n - c AS DOUBLE) > 0.2::DOUBLE"""


def _candidates(spark, sf_dir):
    r = routes(spark, sf_dir).withColumn("segment", F.concat_ws("-", F.col("node_u") % 12, F.col("key")))
    c = r.groupBy(F.col("route").alias("id")).agg(F.sum("d_plus_m").alias("objective"), F.array_sort(F.collect_set("segment")).alias("segments"))
    return c.withColumns({"group": F.col("id") % 50, "ord": F.col("id")})


def topn_greedy(spark, sf_dir):
    """Offered best first, the tracker is a greedy choice, which a recursive query can follow."""
    ranked = Window.partitionBy("group").orderBy(F.desc("objective"), "id")
    best_first = _candidates(spark, sf_dir).withColumn("ord", F.row_number().over(ranked))
    return S.distinct_top(best_first, 1000000, 0.0).select("group", "id", "objective")


TOPN = f"""WITH RECURSIVE {R_SQL}, c AS (SELECT route % 50 AS grp, route AS id, sum(d_plus_m) AS objective, list_distinct(list((node_u % 12) || '-' || key)) AS segs FROM r GROUP BY route),
o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY objective DESC, id) AS k FROM c),
w AS (SELECT grp, k, segs AS used, TRUE AS taken, id, objective FROM o WHERE k = 1
  UNION ALL SELECT o.grp, o.k, CASE WHEN list_has_any(w.used, o.segs) THEN w.used ELSE list_concat(w.used, o.segs) END, NOT list_has_any(w.used, o.segs), o.id, o.objective FROM w JOIN o ON o.grp = w.grp AND o.k = w.k + 1)
SELECT grp AS "group", id, objective FROM w WHERE taken"""


def topn_tracker(spark, sf_dir):
    return S.distinct_top(_candidates(spark, sf_dir), 5, 0.25)


def top_ordering(spark, sf_dir):
    return R.top_by_objective(_candidates(spark, sf_dir), 3, "group").select("group", "rank", "id", "objective")


TOP = f"""WITH {R_SQL}, c AS (SELECT route AS id, route % 50 AS "group", sum(d_plus_m) AS objective, list_sort(list_distinct(list((node_u % 12) || '-' || key))) AS segs FROM r GROUP BY route),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY "group" ORDER BY objective DESC, segs) AS INTEGER) AS rank FROM c) SELECT "group", rank, id, objective FROM o WHERE rank <= 3"""


def worst_held(spark, sf_dir):
    return R.worst_held(_candidates(spark, sf_dir))


WORST = f"WITH {R_SQL}, c AS (SELECT route AS id, sum(d_plus_m) AS objective, list_sort(list_distinct(list((node_u % 12) || '-' || key))) AS segs FROM r GROUP BY route) SELECT id FROM c ORDER BY objective, segs DESC LIMIT 1"


def base_expansion(spark, sf_dir):
    n = F.col("node_u") % 3
    base = _network(spark, sf_dir).where("key = 1").withColumn("base_seq", F.explode(F.sequence(F.lit(0), F.lit(1)))).select("node_u", "node_v", "key", "base_seq", (F.col("node_u") * 10 + F.col("base_seq")).alias("base_u"), (F.col("node_v") * 10 + F.col("base_seq")).alias("base_v"), n.alias("base_key"))
    return R.with_base_edges(routes(spark, sf_dir), base)


EXPANSION = f"""WITH {R_SQL}, {NET}, b AS (SELECT node_u, node_v, key, s AS base_seq, node_u * 10 + s AS base_u, node_v * 10 + s AS base_v, node_u % 3 AS base_key FROM net, (VALUES (0), (1)) t(s) WHERE key = 1)
SELECT route, seq, coalesce(base_seq, 0) AS base_seq, coalesce(base_u, node_u) AS node_u, coalesce(base_v, node_v) AS node_v, coalesce(base_key, key) AS key FROM r LEFT JOIN b USING (node_u, node_v, key)"""


def edge_seq_hash(spark, sf_dir):
    return R.sequence_hash(routes(spark, sf_dir))


HASH = f"WITH {R_SQL} SELECT route, sha256(CAST(to_json(list_sort(list([node_u, node_v, key]))) AS VARCHAR)) AS hash FROM r GROUP BY route"


def golden_diff(spark, sf_dir):
    m = R.route_metrics(routes(spark, sf_dir)).select("route", F.col("length_m").cast("long").alias("length_m"), F.col("d_plus_m").cast("long").alias("d_plus_m"))
    new = m.where("route % 97 <> 0").withColumn("d_plus_m", F.when(F.col("route") % 89 == 0, F.col("d_plus_m") + 1).otherwise(F.col("d_plus_m")))
    return R.golden_diff(m.where("route % 101 <> 0"), new, ("length_m", "d_plus_m"))


GOLDEN = f"""WITH {R_SQL}, m AS (SELECT route, CAST(sum(length_m) AS BIGINT) AS l, CAST(sum(d_plus_m) AS BIGINT) AS p FROM r GROUP BY route),
o AS (SELECT * FROM m WHERE route % 101 <> 0), n AS (SELECT route, l, CASE WHEN route % 89 = 0 THEN p + 1 ELSE p END AS p FROM m WHERE route % 97 <> 0),
f AS (SELECT coalesce(o.route, n.route) AS route, o.l AS ol, n.l AS nl, o.p AS op, n.p AS np FROM o FULL JOIN n ON o.route = n.route)
SELECT route, 'length_m' AS field, CAST(ol AS VARCHAR) AS old, CAST(nl AS VARCHAR) AS new FROM f WHERE ol IS DISTINCT FROM nl
UNION ALL SELECT route, 'd_plus_m', CAST(op AS VARCHAR), CAST(np AS VARCHAR) FROM f WHERE op IS DISTINCT FROM np"""


def geojson(spark, sf_dir):
    v = vertices(spark, sf_dir).withColumns({x: F.floor(F.col(x) * 10000).cast("long") for x in ("lon", "lat")})
    return R.feature_collection(v)


GEOJSON = """WITH v AS (SELECT user_id AS edge, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx, CAST(floor((CAST(5.7 AS DOUBLE) + event_id % 97 * CAST(0.0001 AS DOUBLE)) * 10000) AS BIGINT) AS lon, CAST(floor((CAST(45.1 AS DOUBLE) + event_id % 89 * CAST(0.0001 AS DOUBLE)) * 10000) AS BIGINT) AS lat FROM events)
SELECT edge, CAST(to_json({'type': 'Feature', 'geometry': {'type': 'LineString', 'coordinates': list([lon, lat] ORDER BY idx)}}) AS VARCHAR) AS feature FROM v GROUP BY edge"""


def walk_enumeration(spark, sf_dir):
    """Walks of up to two edges over the whole network, parallel edges included."""
    e = plans.flat(plans.edges(spark, sf_dir)).withColumn("gain", F.col("d_plus_m") + F.col("d_minus_m"))
    segment = F.concat_ws("-", F.least("node_u", "node_v"), F.greatest("node_u", "node_v"), "key")
    e = e.select(F.concat_ws(">", "node_u", "node_v", "key").alias("id"), "node_u", "node_v", segment.alias("segment"), "length_m", "gain")
    return S.walks(e, 2).groupBy(F.size("path").cast("long").alias("depth")).agg(F.count("*").alias("n"), F.max("objective").alias("best"), F.sum("length_m").alias("length_m"))


WALKS = f"""WITH {plans.F_SQL}, w AS (SELECT node_u AS u, node_v AS v, length_m AS m, d_plus_m + d_minus_m AS g, least(node_u, node_v) || '-' || greatest(node_u, node_v) || '-' || key AS s FROM fl),
p AS (SELECT 1 AS depth, g, m FROM w UNION ALL SELECT 2, x.g + y.g, x.m + y.m FROM w x JOIN w y ON x.v = y.u AND x.s <> y.s)
SELECT CAST(depth AS BIGINT) AS depth, count(*) AS n, max(g) AS best, sum(m) AS length_m FROM p GROUP BY depth"""


def route_base_ids(spark, sf_dir):
    n = _network(spark, sf_dir).withColumn("base_segment_ids", F.array(F.struct(F.least("node_u", "node_v").alias("a"), F.greatest("node_u", "node_v").alias("b"), F.col("key").alias("k"))))
    known = routes(spark, sf_dir).where("route % 10 <> 3")
    return R.base_ids(known, n).select("route", "seq", F.col("base_segment_ids")[0]["a"].alias("a"), F.col("base_segment_ids")[0]["b"].alias("b"), F.size("base_segment_ids").alias("n"))


BASE_IDS = f"WITH {R_SQL} SELECT route, seq, least(node_u, node_v) AS a, greatest(node_u, node_v) AS b, 1 AS n FROM r WHERE route % 10 <> 3"


def run_summary(spark, sf_dir):
    m = R.route_metrics(routes(spark, sf_dir))
    return R.run_summary(m.withColumn("objective", F.col("d_plus_m") + F.col("d_minus_m")), m.where("avg_gradient < 0.3"))


SUMMARY = f"WITH {R_SQL}, m AS (SELECT sum(d_plus_m) + sum(d_minus_m) AS o, sum(length_m) AS l FROM r GROUP BY route) SELECT count(*) AS routes, sum(o) AS total_objective, count(*) FILTER (WHERE CASE WHEN l > 0 THEN o / l ELSE 0 END < 0.3::DOUBLE) AS failures FROM m"


CHAIN = S.Params(theta=0.02, n=5, iterations=300, seed=3, most_shared=0.5, difficulty_cap=3, max_descent=0.9, start_at_junction=True)


def chain(spark, sf_dir):
    """One network from vertices to routes: guards, metrics of smoothed and levelled profiles, climbs, contraction, search. (network, routes, junctions)."""
    v = vertices(spark, sf_dir)
    ends = polylines.ends_of(v)
    valid = P.valid_for_metrics(v).where("valid").select("edge")
    v = v.join(valid, "edge", "left_semi")
    N.guard(ends, v, "metrics")
    metrics = P.edge_metrics(P.operationalize(v, ends, 40.0, 5.0))
    word = F.when(F.col("edge") % 3 == 0, "path").when(F.col("edge") % 3 == 1, "residential").otherwise("track")
    numbered = F.row_number().over(Window.partitionBy("node_u", "node_v").orderBy("edge")) - 1
    base = metrics.join(ends, "edge").withColumns({"key": numbered.cast("int"), "highway": F.array(word), "sac_scale": F.when(F.col("edge") % 5 == 0, F.array(F.lit("alpine_hiking"))), "component": F.lit(0).cast("long")})
    base = base.drop("edge").checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else base.drop("edge")
    climbs_ = N.detect_climbs(base, 0.02, 1000.0)
    network = N.contract(base, climbs_, 3000.0)
    junctions = N.junctions(network)
    return network, S.search(spark, network, CHAIN, workers=2, interval=100, junctions=junctions), junctions


def chain_violations(spark, sf_dir):
    """What the validation finds in the routes of the chain: nothing, if all its parts agree."""
    network, found, junctions = chain(spark, sf_dir)
    network = network.withColumn("blocking", F.when(F.col("reusable"), F.array().cast(network.schema["base_segment_ids"].dataType)).otherwise(F.col("base_segment_ids")))
    exempt_only = N.non_exempt_segments(network).select(F.struct("a", "b", "k").alias("s")).withColumn("_once", F.lit(True))
    once = network.select(*R.ID, F.explode("base_segment_ids").alias("s")).join(exempt_only, "s").groupBy(*R.ID).agg(F.collect_list("s").alias("once"))
    network = network.join(once, list(R.ID), "left").withColumn("blocking", F.coalesce("once", F.array().cast(network.schema["base_segment_ids"].dataType))).drop("once")
    walked = found.select("route", "seq", *R.ID).join(network, list(R.ID))
    starts = junctions.where("is_junction").select("node_id")
    return R.violations(walked, network, CHAIN.theta, CHAIN.difficulty_cap, CHAIN.max_descent, starts)


NO_VIOLATIONS = "SELECT CAST(0 AS INTEGER) AS route, CAST(0 AS INTEGER) AS ord, CAST(0 AS BIGINT) AS seq, '' AS constraint_id, CAST(0 AS DOUBLE) AS observed, CAST(0 AS DOUBLE) AS required WHERE FALSE"


def chain_routes(spark, sf_dir):
    return chain(spark, sf_dir)[1]


def grasp_routes(spark, sf_dir):
    e = plans.flat(plans.edges(spark, sf_dir)).withColumn("reusable", F.col("length_m") < 410)
    return S.search(spark, e, S.Params(theta=0.2, n=10, iterations=400, seed=7), workers=4, interval=200)


def blocking_ids(spark, sf_dir):
    e = plans.flat(plans.edges(spark, sf_dir)).withColumns({"base_segment_ids": F.array(F.struct(F.least("node_u", "node_v").alias("a"), F.greatest("node_u", "node_v").alias("b"), F.col("key").alias("k"))), "reusable": F.col("length_m") < 200})
    bad = N.non_exempt_segments(e).withColumn("blocks", F.lit(True))
    s = e.select("node_u", "node_v", "key", F.explode("base_segment_ids").alias("s")).select("node_u", "node_v", "key", "s.*")
    return s.join(bad, ["a", "b", "k"], "left").groupBy("node_u").agg(F.count_if(F.coalesce("blocks", F.lit(False))).alias("n_blocking"))


BLOCKING = f"""WITH {plans.F_SQL}, x AS (SELECT *, least(node_u, node_v) AS a, greatest(node_u, node_v) AS b FROM fl), bad AS (SELECT DISTINCT a, b, key FROM x WHERE NOT length_m < 200)
SELECT node_u, count(bad.a) AS n_blocking FROM x LEFT JOIN bad USING (a, b, key) GROUP BY node_u"""

QUERIES = {
    "route_metrics": (route_metrics, METRICS),
    "theta_prefix": (theta_prefix, THETA),
    "distinct_edges": (distinct_edges, DISTINCT),
    "reuse_violations": (reuse_violations, REUSE),
    "validation": (validation, VALIDATION),
    "jaccard_pairs": (jaccard_pairs, JACCARD),
    "topn_greedy": (topn_greedy, TOPN),
    "topn_tracker": (topn_tracker, None),
    "top_ordering": (top_ordering, TOP),
    "worst_held": (worst_held, WORST),
    "base_expansion": (base_expansion, EXPANSION),
    "edge_seq_hash": (edge_seq_hash, HASH),
    "golden_diff": (golden_diff, GOLDEN),
    "geojson": (geojson, GEOJSON),
    "walk_enumeration": (walk_enumeration, WALKS),
    "route_base_ids": (route_base_ids, BASE_IDS),
    "run_summary": (run_summary, SUMMARY),
    "chain_violations": (chain_violations, NO_VIOLATIONS),
    "chain_routes": (chain_routes, None),
    "grasp_routes": (grasp_routes, None),
    "blocking_ids": (blocking_ids, BLOCKING),
}
