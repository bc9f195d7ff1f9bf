"""Queries over networks. `lineitem` stands in: a line is an edge, a supplier's lines are a component."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgeline.functions.measures import portable_round
from ridgeline.functions.tags import cap_rank, descends_over, has_road, has_trail, highway_class, keep_way, sac_rank, tag_list
from ridgeline.operators import networks as N
from ridgeline.plans.polylines import rounded

NODES_A_COMPONENT = 40
E_SQL = """e AS (
  SELECT l_suppkey AS component, l_partkey % 40 AS node_u, l_orderkey % 40 AS node_v,
         CAST(row_number() OVER (PARTITION BY l_suppkey, l_partkey % 40, l_orderkey % 40 ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS INTEGER) AS key,
         l_quantity * 10 AS length_m, floor(l_extendedprice / 500) AS d_plus_m, floor(l_tax * l_quantity * 100) AS d_minus_m, l_discount * 10 AS max_windowed_descent_grad,
         CASE WHEN l_returnflag = 'A' THEN ['path'] WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN ['residential', ' service '] WHEN l_returnflag = 'N' THEN ['service', 'footway'] WHEN l_linenumber = 1 THEN ['motorway', 'service'] ELSE ['tertiary'] END AS highway,
         l_tax > 0.07 AS had_non_string,
         CASE l_linenumber % 7 WHEN 0 THEN NULL WHEN 1 THEN ['hiking'] WHEN 2 THEN ['mountain_hiking', ' hiking'] WHEN 3 THEN ['demanding_mountain_hiking'] WHEN 4 THEN ['alpine_hiking', 'hiking'] WHEN 5 THEN [] ELSE ['unknown', 'hiking'] END AS sac_scale
  FROM lineitem
)"""
TAG_SQL = """tr AS (SELECT *, [trim(t) FOR t IN highway] AS hw, [list_position(['hiking','mountain_hiking','demanding_mountain_hiking','alpine_hiking','demanding_alpine_hiking','difficult_alpine_hiking'], trim(t)) FOR t IN sac_scale] AS rk FROM e),
tg AS (SELECT *, list_has_any(hw, ['path','footway','track','steps','bridleway']) AS is_trail, list_has_any(hw, ['residential','unclassified','service','living_street','tertiary']) AS is_road,
  len(hw) > 0 AND list_has_all(['residential','unclassified','service','living_street','tertiary'], hw) AND NOT had_non_string AS pure,
  CASE WHEN len(rk) > 0 AND len([r FOR r IN rk IF coalesce(r, 0) = 0]) = 0 THEN CAST(list_max(rk) AS INTEGER) END AS rank FROM tr),
cl AS (SELECT *, CASE WHEN is_trail THEN 'trail' WHEN pure THEN 'connector' END AS kind FROM tg)"""


def edges(spark, sf_dir):
    """Ends are columns before keys are numbered, so that a choice of nodes is made before lines are sorted."""
    u, v, c = F.col("l_partkey") % NODES_A_COMPONENT, F.col("l_orderkey") % NODES_A_COMPONENT, F.col("l_suppkey")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumns({"component": c, "node_u": u, "node_v": v})
    order = Window.partitionBy("component", "node_u", "node_v").orderBy(*"l_orderkey l_linenumber l_partkey l_shipdate l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus".split())
    words = lambda *x: F.array(*[F.lit(w) for w in x]) if x else F.array().cast("array<string>")
    flag, status, line, seven = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber"), F.col("l_linenumber") % 7
    return lines.select(
        "component",
        "node_u",
        "node_v",
        (F.row_number().over(order) - 1).alias("key"),
        (F.col("l_quantity") * 10).alias("length_m"),
        F.floor(F.col("l_extendedprice") / 500).cast("double").alias("d_plus_m"),
        F.floor(F.col("l_tax") * F.col("l_quantity") * 100).cast("double").alias("d_minus_m"),
        (F.col("l_discount") * 10).alias("max_windowed_descent_grad"),
        F.when(flag == "A", words("path")).when((flag == "N") & (status == "O"), words("residential", " service ")).when(flag == "N", words("service", "footway")).when(line == 1, words("motorway", "service")).otherwise(words("tertiary")).alias("highway"),
        (F.col("l_tax") > 0.07).alias("had_non_string"),
        F.when(seven == 1, words("hiking")).when(seven == 2, words("mountain_hiking", " hiking")).when(seven == 3, words("demanding_mountain_hiking")).when(seven == 4, words("alpine_hiking", "hiking")).when(seven == 5, words()).when(seven == 6, words("unknown", "hiking")).alias("sac_scale"),
    )


def classify_tags(spark, sf_dir):
    e = edges(spark, sf_dir)
    kind = highway_class(F.col("highway"), F.col("had_non_string"))
    return e.groupBy(kind.alias("kind"), has_trail(F.col("highway")).alias("is_trail"), has_road(F.col("highway")).alias("is_road")).agg(F.count("*").alias("n"))


CLASSIFY = f"WITH {E_SQL}, {TAG_SQL} SELECT kind, is_trail, is_road, count(*) AS n FROM cl GROUP BY ALL"


def sac_ranks(spark, sf_dir):
    return edges(spark, sf_dir).select("component", "node_u", "node_v", "key", sac_rank(F.col("sac_scale")).alias("rank"))


SAC = f"WITH {E_SQL}, {TAG_SQL} SELECT component, node_u, node_v, key, rank FROM cl"


def trail_filter(spark, sf_dir):
    keep = [keep_way(F.col("highway"), F.col("sac_scale"), 3, policy, F.col("had_non_string")) for policy in (True, False)]
    e = edges(spark, sf_dir).withColumns({"with_untagged": keep[0], "without_untagged": keep[1]})
    return e.where("with_untagged").select("component", "node_u", "node_v", "key", "without_untagged")


FILTER = f"""WITH {E_SQL}, {TAG_SQL}
SELECT component, node_u, node_v, key, CASE kind WHEN 'trail' THEN sac_scale IS NOT NULL ELSE TRUE END AS without_untagged FROM cl
WHERE CASE kind WHEN 'trail' THEN sac_scale IS NULL OR coalesce(rank <= 3, FALSE) WHEN 'connector' THEN rank IS NULL OR rank <= 3 ELSE FALSE END"""


def descent_cap(spark, sf_dir):
    over = descends_over(0.4, F.col("d_plus_m"), F.col("d_minus_m"), F.col("max_windowed_descent_grad"))
    return edges(spark, sf_dir).where(over).groupBy("component").agg(F.count("*").alias("n"), F.sum("d_minus_m").alias("down"))


DESCENT = f"WITH {E_SQL} SELECT component, count(*) AS n, sum(d_minus_m) AS down FROM e WHERE d_minus_m > d_plus_m AND max_windowed_descent_grad > 0.4 GROUP BY component"


def difficulty_caps(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = F.concat(F.when(F.col("o_orderkey") % 3 == 0, F.lit(" t")).otherwise(F.lit("T")), F.substring("o_orderpriority", 1, 1), F.when(F.col("o_orderkey") % 5 == 0, F.lit("x")).otherwise(F.lit(" ")))
    return o.groupBy(text.alias("text"), cap_rank(text).alias("rank")).agg(F.count("*").alias("n"))


CAPS = """WITH t AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN ' t' ELSE 'T' END || substr(o_orderpriority, 1, 1) || CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE ' ' END AS text FROM orders)
SELECT text, TRY_CAST(regexp_extract(upper(trim(text)), '^T([1-6])$', 1) AS INTEGER) AS rank, count(*) AS n FROM t GROUP BY ALL"""


def flat(e):
    """One network: nodes are numbered across components."""
    return e.withColumns({"node_u": F.col("component") * 100 + F.col("node_u"), "node_v": F.col("component") * 100 + F.col("node_v")})


def degree(spark, sf_dir):
    return N.degree(flat(edges(spark, sf_dir)))


F_SQL = E_SQL + ", fl AS (SELECT * REPLACE (component * 100 + node_u AS node_u, component * 100 + node_v AS node_v) FROM e)"
DEGREE = f"WITH {F_SQL} SELECT node_id, count(*) AS degree FROM (SELECT node_u AS node_id FROM fl UNION ALL SELECT node_v FROM fl) GROUP BY node_id"


def orphan_nodes(spark, sf_dir):
    e = flat(edges(spark, sf_dir)).where("length_m > 450")
    nodes = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("node_id"), F.col("p_size").alias("size"))
    return N.drop_orphans(nodes, e)


ORPHANS = f"WITH {F_SQL}, k AS (SELECT node_u AS n FROM fl WHERE length_m > 450 UNION SELECT node_v FROM fl WHERE length_m > 450) SELECT p_partkey AS node_id, p_size AS size FROM part WHERE p_partkey IN (SELECT n FROM k)"


def components(spark, sf_dir):
    return N.weak_components(flat(edges(spark, sf_dir)))


COMPONENTS = f"""WITH RECURSIVE {F_SQL}, l AS (SELECT node_u AS a, node_v AS b FROM fl UNION SELECT node_v, node_u FROM fl),
r AS (SELECT DISTINCT a AS n, a AS m FROM l UNION SELECT l.b, r.m FROM r JOIN l ON r.n = l.a)
SELECT n AS node_id, min(m) AS component FROM r GROUP BY n"""


def largest_component(spark, sf_dir):
    return N.largest_component(components(spark, sf_dir))


LARGEST = COMPONENTS.replace("SELECT n AS node_id, min(m) AS component FROM r GROUP BY n", "") + """, c AS (SELECT n AS node_id, min(m) AS component FROM r GROUP BY n)
SELECT node_id FROM c WHERE component = (SELECT component FROM c GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)"""


def strong_components(spark, sf_dir):
    return N.strong_components(flat(edges(spark, sf_dir)))


STRONG = f"""WITH RECURSIVE {F_SQL}, l AS (SELECT DISTINCT node_u AS a, node_v AS b FROM fl), nd AS (SELECT a AS n FROM l UNION SELECT b FROM l),
r AS (SELECT n AS s, n FROM nd UNION SELECT r.s, l.b FROM r JOIN l ON r.n = l.a)
SELECT x.s AS node_id, min(x.n) AS component FROM r x JOIN r y ON x.s = y.n AND x.n = y.s GROUP BY x.s"""


def junction_reads(spark, sf_dir):
    flags = N.junctions(flat(edges(spark, sf_dir)).withColumn("is_super", F.lit(False)))
    nodes = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("node_id"))
    return N.junction_flags(nodes, flags)


JUNCTION_READS = f"""WITH {E_SQL}, {TAG_SQL}, n AS (SELECT component * 100 + node_u AS node_id, is_trail, is_road FROM cl UNION ALL SELECT component * 100 + node_v, is_trail, is_road FROM cl),
j AS (SELECT node_id, bool_or(is_trail) AND bool_or(is_road) AS f FROM n GROUP BY node_id) SELECT p_partkey AS node_id, coalesce(f, FALSE) AS is_junction FROM part LEFT JOIN j ON p_partkey = node_id"""


def tag_lists(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, word = F.col("o_orderkey") % 5, F.concat(F.lit('"'), "o_orderpriority", F.lit('"'))
    raw = F.when(k == 0, word).when(k == 1, F.concat(F.lit("["), word, F.lit(", 3]"))).when(k == 2, F.concat(F.lit('["path", '), word, F.lit("]"))).when(k == 3, F.lit("7"))
    return o.select("o_orderkey", tag_list(raw).alias("t")).select("o_orderkey", F.array_join("t.values", "|").alias("tags"), "t.had_non_string")


TAG_LISTS = """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderpriority WHEN 2 THEN 'path|' || o_orderpriority ELSE '' END AS tags, o_orderkey % 5 IN (1, 3) AS had_non_string FROM orders"""


AREA = {"lat": 0.2, "lon": 0.2, "half_width_km": 15.0, "half_height_km": 8.0, "angle_deg": 30.0}


def truncated(spark, sf_dir):
    e = flat(edges(spark, sf_dir))
    nodes = N.endpoints(e).distinct().select("node_id", (F.col("node_id") % 100 * F.lit(0.01)).alias("lon"), (F.col("node_id") % 37 * F.lit(0.01)).alias("lat"))
    kept = N.truncate(e, nodes, N.inside_area(F.col("lon"), F.col("lat"), AREA))
    return kept.groupBy("node_u").agg(F.count("*").alias("n"))


TRUNCATED = f"""WITH {F_SQL}, n AS (SELECT DISTINCT unnest([node_u, node_v]) AS node_id FROM fl),
xy AS (SELECT node_id, (node_id % 100 * 0.01::DOUBLE - 0.2::DOUBLE) * 111 * cos(radians(0.2::DOUBLE)) AS e, (node_id % 37 * 0.01::DOUBLE - 0.2::DOUBLE) * 111 AS n, radians(30.0::DOUBLE) AS a FROM n),
k AS (SELECT node_id FROM xy WHERE abs(e * cos(a) - n * sin(a)) <= 15 AND abs(e * sin(a) + n * cos(a)) <= 8)
SELECT node_u, count(*) AS n FROM fl WHERE node_u IN (SELECT node_id FROM k) AND node_v IN (SELECT node_id FROM k) GROUP BY node_u"""


def normalized_edges(spark, sf_dir):
    e = flat(edges(spark, sf_dir))
    geometry = F.when(F.col("length_m") > 250, F.array(F.struct(F.lit(0.0).alias("lon"), F.lit(1.0).alias("lat")))).alias("geometry")
    nodes = N.endpoints(e).distinct().where("node_id % 5 <> 0").select("node_id", (F.col("node_id") * F.lit(0.5)).alias("lon"), (F.col("node_id") * F.lit(0.25)).alias("lat"))
    out = N.normalize_edges(e.select("node_u", "node_v", "key", geometry), nodes)
    return out.select("node_u", "node_v", "key", F.size("geometry").alias("n"), F.col("geometry")[0]["lon"].alias("lon0"), F.element_at("geometry", -1)["lat"].alias("lat1"))


NORMALIZED = f"""WITH {F_SQL}, g AS (SELECT node_u, node_v, key, length_m > 250 AS has FROM fl)
SELECT node_u, node_v, key, CASE WHEN has THEN 1 ELSE 2 END AS n, CASE WHEN has THEN 0.0::DOUBLE WHEN node_u % 5 <> 0 THEN node_u * 0.5::DOUBLE END AS lon0, CASE WHEN has THEN 1.0::DOUBLE WHEN node_v % 5 <> 0 THEN node_v * 0.25::DOUBLE END AS lat1 FROM g"""


def adjacency_top5(spark, sf_dir):
    return N.adjacency(flat(edges(spark, sf_dir)), 2, 5)


ADJACENCY = f"""WITH {E_SQL}, {TAG_SQL}, r AS (SELECT component * 100 + node_u AS node_u, component * 100 + node_v AS node_v, key, d_plus_m + d_minus_m AS gain FROM cl WHERE rank IS NULL OR rank <= 2),
o AS (SELECT node_u, CAST(row_number() OVER (PARTITION BY node_u ORDER BY gain DESC, node_v, key) AS INTEGER) AS rank, node_v, key, gain FROM r) SELECT * FROM o WHERE rank <= 5"""


def climb_seeds(spark, sf_dir):
    return N.climb_seeds(edges(spark, sf_dir), 0.3).groupBy("component").agg(F.count("*").alias("n"), F.sum("d_plus_m").alias("up"))


SEEDS = f"WITH {E_SQL} SELECT component, count(*) AS n, sum(d_plus_m) AS up FROM e WHERE length_m > 0 AND d_plus_m / length_m >= 0.3 GROUP BY component"


def prefixed(spark, sf_dir):
    """Chains that stand in for climbs: three lines after one another of a component."""
    w = Window.partitionBy("component").orderBy("node_u", "node_v", "key")
    e = edges(spark, sf_dir).withColumn("_n", F.row_number().over(w) - 1)
    return e, e.where("_n % 10 < 3 and node_u <> node_v").select("component", (F.floor(F.col("_n") / 10)).alias("climb_id"), (F.col("_n") % 10).cast("int").alias("seq"), "node_u", "node_v", "key", "length_m", "d_plus_m")


P_SQL = E_SQL + """, nn AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY node_u, node_v, key) - 1 AS n FROM e),
cb AS (SELECT component, n // 10 AS climb_id, CAST(n % 10 AS INTEGER) AS seq, node_u, node_v, key, length_m, d_plus_m, d_minus_m, sac_scale, max_windowed_descent_grad, highway, had_non_string FROM nn WHERE n % 10 < 3 AND node_u <> node_v),
sid AS (SELECT component, climb_id, seq, least(node_u, node_v) AS a, greatest(node_u, node_v) AS b, key AS k FROM cb),
inn AS (SELECT component, climb_id, seq, lag(node_v) OVER (PARTITION BY component, climb_id ORDER BY seq) AS node FROM cb),
ends AS (SELECT DISTINCT component, unnest([node_u, node_v]) AS node, least(node_u, node_v) AS a, greatest(node_u, node_v) AS b, key AS k FROM e),
cut AS (SELECT DISTINCT i.component, i.climb_id, i.seq FROM inn i JOIN ends x ON i.component = x.component AND i.node = x.node
  WHERE NOT EXISTS (SELECT 1 FROM sid s WHERE s.component = i.component AND s.climb_id = i.climb_id AND s.a = x.a AND s.b = x.b AND s.k = x.k)),
parts AS (SELECT cb.*, CAST(sum(CASE WHEN cut.seq IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY cb.component, cb.climb_id ORDER BY cb.seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part FROM cb LEFT JOIN cut ON cb.component = cut.component AND cb.climb_id = cut.climb_id AND cb.seq = cut.seq)"""


def climb_islands(spark, sf_dir):
    e, climbs = prefixed(spark, sf_dir)
    return N.split_climbs(climbs, e).select("component", "climb_id", "seq", "part")


ISLANDS = f"WITH {P_SQL} SELECT component, climb_id, seq, part FROM parts"


def membership_anti(spark, sf_dir):
    e, climbs = prefixed(spark, sf_dir)
    return N.connectors(e, climbs, 100.0).groupBy("component", "reusable").agg(F.count("*").alias("n"))


ANTI = f"WITH {P_SQL} SELECT component, length_m < 100 AS reusable, count(*) AS n FROM e WHERE NOT EXISTS (SELECT 1 FROM cb WHERE cb.component = e.component AND cb.node_u = e.node_u AND cb.node_v = e.node_v AND cb.key = e.key) GROUP BY ALL"


def contract_agg(spark, sf_dir):
    e, climbs = prefixed(spark, sf_dir)
    out = N.contract(e.drop("_n"), climbs, 100.0).where("is_super")
    return out.select("component", "climb_id", "part", "node_u", "node_v", "key", "length_m", "d_plus_m", "d_minus_m", portable_round(F.col("avg_gradient"), 9).alias("avg_gradient"), F.col("sac_scale")[0].alias("sac"), "max_windowed_descent_grad", F.size("base_segment_ids").alias("n_ids"))


CONTRACT = f"""WITH {P_SQL},
rk AS (SELECT *, CASE WHEN len(sac_scale) > 0 THEN (SELECT CASE WHEN count(*) FILTER (WHERE coalesce(p, 0) = 0) = 0 THEN max(p) END FROM (SELECT list_position(['hiking','mountain_hiking','demanding_mountain_hiking','alpine_hiking','demanding_alpine_hiking','difficult_alpine_hiking'], trim(t)) AS p FROM (SELECT unnest(sac_scale) AS t))) END AS rank FROM parts),
m AS (SELECT component, climb_id, part, arg_min(node_u, seq) AS node_u, arg_max(node_v, seq) AS node_v, sum(length_m) AS length_m, sum(d_plus_m) AS d_plus_m, sum(d_minus_m) AS d_minus_m, max(rank) AS rank, max(max_windowed_descent_grad) AS max_windowed_descent_grad,
  CAST(count(DISTINCT (least(node_u, node_v), greatest(node_u, node_v), key)) AS INTEGER) AS n_ids FROM rk GROUP BY component, climb_id, part),
t AS (SELECT component, node_u, node_v, max(key) AS top FROM e WHERE NOT EXISTS (SELECT 1 FROM cb WHERE cb.component = e.component AND cb.node_u = e.node_u AND cb.node_v = e.node_v AND cb.key = e.key) GROUP BY ALL)
SELECT m.component, climb_id, part, m.node_u, m.node_v, CAST(coalesce(top, -1) + row_number() OVER (PARTITION BY m.component, m.node_u, m.node_v ORDER BY climb_id, part) AS INTEGER) AS key, length_m, d_plus_m, d_minus_m,
  {rounded('CASE WHEN length_m > 0 THEN (d_plus_m + d_minus_m) / length_m ELSE 0 END', 9)} AS avg_gradient, ['hiking','mountain_hiking','demanding_mountain_hiking','alpine_hiking','demanding_alpine_hiking','difficult_alpine_hiking'][rank] AS sac, max_windowed_descent_grad, n_ids
FROM m LEFT JOIN t ON m.component = t.component AND m.node_u = t.node_u AND m.node_v = t.node_v"""


def contracted(spark, sf_dir):
    e, climbs = prefixed(spark, sf_dir)
    return N.contract(e.drop("_n"), climbs, 100.0)


def junction_nodes(spark, sf_dir):
    return N.junctions(flat(contracted(spark, sf_dir)))


JUNCTIONS = f"""WITH {P_SQL}, m AS (SELECT component, climb_id, part, arg_min(node_u, seq) AS node_u, arg_max(node_v, seq) AS node_v FROM parts GROUP BY ALL),
c AS (SELECT component, node_u, node_v, list_has_any([trim(x) FOR x IN highway], ['path','footway','track','steps','bridleway']) AS t, list_has_any([trim(x) FOR x IN highway], ['residential','unclassified','service','living_street','tertiary']) AS r FROM e
  WHERE NOT EXISTS (SELECT 1 FROM cb WHERE cb.component = e.component AND cb.node_u = e.node_u AND cb.node_v = e.node_v AND cb.key = e.key)
  UNION ALL SELECT component, node_u, node_v, TRUE, FALSE FROM m),
n AS (SELECT component * 100 + node_u AS node_id, t, r FROM c UNION ALL SELECT component * 100 + node_v, t, r FROM c)
SELECT node_id, bool_or(t) AND bool_or(r) AS is_junction FROM n GROUP BY node_id"""


def non_exempt(spark, sf_dir):
    return N.non_exempt_segments(flat(edges(spark, sf_dir)).withColumns({"base_segment_ids": F.array(F.struct(F.least("node_u", "node_v").alias("a"), F.greatest("node_u", "node_v").alias("b"), F.col("key").alias("k"))), "reusable": F.col("length_m") < 200}))


NON_EXEMPT = f"WITH {F_SQL} SELECT DISTINCT least(node_u, node_v) AS a, greatest(node_u, node_v) AS b, key AS k FROM fl WHERE NOT length_m < 200"


def climbs(spark, sf_dir):
    return N.detect_climbs(edges(spark, sf_dir), 0.25, 300.0)


QUERIES = {
    "classify_tags": (classify_tags, CLASSIFY),
    "sac_rank": (sac_ranks, SAC),
    "trail_filter": (trail_filter, FILTER),
    "descent_cap": (descent_cap, DESCENT),
    "difficulty_caps": (difficulty_caps, CAPS),
    "degree": (degree, DEGREE),
    "orphan_nodes": (orphan_nodes, ORPHANS),
    "components": (components, COMPONENTS),
    "largest_component": (largest_component, LARGEST),
    "strong_components": (strong_components, STRONG),
    "junction_reads": (junction_reads, JUNCTION_READS),
    "tag_lists": (tag_lists, TAG_LISTS),
    "truncated_edges": (truncated, TRUNCATED),
    "normalized_edges": (normalized_edges, NORMALIZED),
    "adjacency_top5": (adjacency_top5, ADJACENCY),
    "climb_seeds": (climb_seeds, SEEDS),
    "climb_islands": (climb_islands, ISLANDS),
    "membership_anti": (membership_anti, ANTI),
    "contract_agg": (contract_agg, CONTRACT),
    "junctions": (junction_nodes, JUNCTIONS),
    "non_exempt": (non_exempt, NON_EXEMPT),
    "detect_climbs": (climbs, None),
}
