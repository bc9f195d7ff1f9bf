"""Queries over polylines. `events` stands in: a user is an edge, an event a vertex."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgeline.functions.measures import haversine_m, portable_round
from ridgeline.operators import polylines as P
from ridgeline.operators.networks import broken_vertices

V_SQL = """v AS (
  SELECT user_id AS edge, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS idx,
         CAST(5.7 AS DOUBLE) + event_id % 97 * CAST(0.0001 AS DOUBLE) AS lon,
         CAST(45.1 AS DOUBLE) + event_id % 89 * CAST(0.0001 AS DOUBLE) AS lat, value AS elev
  FROM events
)"""
X_SQL = """m AS (SELECT *, avg(lat) OVER (PARTITION BY edge) AS ml FROM v),
xy AS (SELECT *, radians(lon) * 6378137.0::DOUBLE * cos(radians(ml)) AS x, radians(lat) * 6378137.0::DOUBLE AS y FROM m),
d AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM xy WINDOW w AS (PARTITION BY edge ORDER BY idx)),
s AS (SELECT *, coalesce(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 0.0::DOUBLE) AS seg FROM d),
arc AS (SELECT *, sum(seg) OVER (PARTITION BY edge ORDER BY idx ROWS UNBOUNDED PRECEDING) AS cum FROM s)"""


def rounded(sql: str, digits: int = 6) -> str:
    scale = f"CAST(1{'0' * digits} AS DOUBLE)"
    return f"floor(({sql}) * {scale} + CAST(0.5 AS DOUBLE)) / {scale}"


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return events.select(
        F.col("user_id").alias("edge"),
        idx.alias("idx"),
        (F.lit(5.7) + F.col("event_id") % 97 * F.lit(0.0001)).alias("lon"),
        (F.lit(45.1) + F.col("event_id") % 89 * F.lit(0.0001)).alias("lat"),
        F.col("value").alias("elev"),
    )


def r6(name: str, digits: int = 6):
    return portable_round(F.col(name), digits).alias(name)


def edge_metrics(spark, sf_dir):
    names = ["length_m", "d_plus_m", "d_minus_m", "avg_gradient", "max_windowed_descent_grad"]
    return P.edge_metrics(vertices(spark, sf_dir)).select("edge", *[r6(x) for x in names])


EDGE_METRICS = f"""WITH {V_SQL}, {X_SQL},
f AS (SELECT *, elev - lag(elev) OVER o AS dz, first_value(elev) OVER a AS fz, first_value(cum) OVER a AS fc FROM arc
  WINDOW o AS (PARTITION BY edge ORDER BY idx), a AS (PARTITION BY edge ORDER BY cum RANGE BETWEEN 30.0 FOLLOWING AND UNBOUNDED FOLLOWING)),
g AS (SELECT edge, sum(seg) AS l, sum(greatest(coalesce(dz, 0), 0)) AS p, sum(greatest(-coalesce(dz, 0), 0)) AS n,
  max(CASE WHEN fc IS NOT NULL THEN CASE WHEN elev > fz THEN (elev - fz) / (fc - cum) ELSE 0 END END) AS gr, arg_min(elev, idx) - arg_max(elev, idx) AS fall FROM f GROUP BY edge)
SELECT edge, {rounded('l')} AS length_m, {rounded('p')} AS d_plus_m, {rounded('n')} AS d_minus_m,
  {rounded('CASE WHEN l > 0 THEN (p + n) / l ELSE 0 END')} AS avg_gradient,
  {rounded('coalesce(gr, CASE WHEN fall > 0 AND l > 0 THEN fall / l ELSE 0 END)')} AS max_windowed_descent_grad FROM g"""


def smooth3(spark, sf_dir):
    return P.smooth(vertices(spark, sf_dir)).select("edge", "idx", "lon", "lat")


SMOOTH3 = f"""WITH {V_SQL}, n AS (SELECT *, lag(lon) OVER w AS a, lead(lon) OVER w AS b, lag(lat) OVER w AS c, lead(lat) OVER w AS e FROM v WINDOW w AS (PARTITION BY edge ORDER BY idx))
SELECT edge, idx, CASE WHEN a IS NULL OR b IS NULL THEN lon ELSE (a + lon + b) / 3 END AS lon,
  CASE WHEN a IS NULL OR b IS NULL THEN lat ELSE (c + lat + e) / 3 END AS lat FROM n"""


def arc_length(spark, sf_dir):
    return P.arc_length(vertices(spark, sf_dir)).select("edge", "idx", r6("seg"), r6("cum"))


ARC = f"WITH {V_SQL}, {X_SQL} SELECT edge, idx, {rounded('seg')} AS seg, {rounded('cum')} AS cum FROM arc"


def resample(spark, sf_dir):
    return P.resample(vertices(spark, sf_dir), 150.0).select("edge", "idx", r6("lon", 9), r6("lat", 9))


RESAMPLE = f"""WITH {V_SQL}, {X_SQL},
t AS (SELECT edge, max(cum) AS total, CAST(greatest(1, round_even(max(cum) / 150.0, 0)) AS INTEGER) AS n, arg_min(lon, idx) AS lon0, arg_min(lat, idx) AS lat0, arg_max(lon, idx) AS lon1, arg_max(lat, idx) AS lat1 FROM arc GROUP BY edge),
seg AS (SELECT edge, seg, cum, lag(cum) OVER w AS cum0, lon, lat, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM arc WINDOW w AS (PARTITION BY edge ORDER BY idx)),
k AS (SELECT edge, n, total / n AS step, unnest(generate_series(1, n - 1)) AS k FROM t),
j AS (SELECT k.edge, k.k AS idx, least(greatest((k.k * step - cum0) / seg, 0), 1) AS f, plon, plat, lon, lat FROM k JOIN seg ON k.edge = seg.edge AND k.k * step > cum0 AND k.k * step <= cum)
SELECT edge, CAST(idx AS INTEGER) AS idx, {rounded('plon + f * (lon - plon)', 9)} AS lon, {rounded('plat + f * (lat - plat)', 9)} AS lat FROM j
UNION ALL SELECT edge, 0, {rounded('lon0', 9)}, {rounded('lat0', 9)} FROM t UNION ALL SELECT edge, n, {rounded('lon1', 9)}, {rounded('lat1', 9)} FROM t"""


def deadband_profile(spark, sf_dir):
    return P.deadband(vertices(spark, sf_dir), 20.0).select("edge", "idx", r6("elev"))


DEADBAND = f"""WITH RECURSIVE {V_SQL},
walk AS (
  SELECT edge, idx, elev, elev AS ref, TRUE AS kept FROM v WHERE idx = 0
  UNION ALL
  SELECT v.edge, v.idx, v.elev, CASE WHEN abs(v.elev - walk.ref) >= 20 THEN v.elev ELSE walk.ref END, abs(v.elev - walk.ref) >= 20
  FROM walk JOIN v ON v.edge = walk.edge AND v.idx = walk.idx + 1
), k AS (SELECT edge, idx, elev, kept OR idx = max(idx) OVER (PARTITION BY edge) AS kept FROM walk),
n AS (SELECT edge, idx, last_value(CASE WHEN kept THEN idx END IGNORE NULLS) OVER b AS ai, last_value(CASE WHEN kept THEN elev END IGNORE NULLS) OVER b AS az,
  first_value(CASE WHEN kept THEN idx END IGNORE NULLS) OVER f AS bi, first_value(CASE WHEN kept THEN elev END IGNORE NULLS) OVER f AS bz FROM k
  WINDOW b AS (PARTITION BY edge ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY edge ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT edge, idx, {rounded('az + (CASE WHEN bi > ai THEN (idx - ai) / CAST(bi - ai AS DOUBLE) ELSE 0 END) * (bz - az)')} AS elev FROM n"""


def _field(spark, sf_dir):
    v = vertices(spark, sf_dir)
    point = F.when(F.col("idx") % 12 == 0, F.concat(F.lit("n"), (F.col("idx") / 12 + F.col("edge")).cast("long") % 40)).otherwise(F.concat_ws("-", "edge", "idx"))
    v = v.withColumn("point", point)
    after = F.lead("point").over(Window.partitionBy("edge").orderBy("idx"))
    links = v.select(F.col("point").alias("a"), after.alias("b")).where("b is not null")
    both = links.select(F.col("a").alias("point"), F.col("b").alias("other")).unionAll(links.select(F.col("b").alias("point"), F.col("a").alias("other")))
    return v.groupBy("point").agg(F.min("elev").alias("elev")), both


def laplacian(spark, sf_dir):
    field, neighbours = _field(spark, sf_dir)
    return P.smooth_elevation(field, neighbours, 3).select("point", r6("elev", 11))


LAPLACIAN = f"""WITH {V_SQL}, p AS (SELECT *, CASE WHEN idx % 12 = 0 THEN 'n' || CAST((idx // 12 + edge) % 40 AS VARCHAR) ELSE edge || '-' || idx END AS point FROM v),
l AS (SELECT point AS a, lead(point) OVER (PARTITION BY edge ORDER BY idx) AS b FROM p),
nb AS (SELECT a AS point, b AS other FROM l WHERE b IS NOT NULL UNION ALL SELECT b, a FROM l WHERE b IS NOT NULL),
f0 AS (SELECT point, min(elev) AS elev FROM p GROUP BY point),
""" + ",\n".join(
    f"f{k} AS (SELECT f.point, coalesce(0.5 * f.elev + 0.5 * z, f.elev) AS elev FROM f{k - 1} f LEFT JOIN (SELECT nb.point, avg(elev) AS z FROM nb JOIN f{k - 1} g ON nb.other = g.point GROUP BY nb.point) USING (point))"
    for k in (1, 2, 3)
) + f"\nSELECT point, {rounded('elev', 11)} AS elev FROM f3"


def polyline_validity(spark, sf_dir):
    v = vertices(spark, sf_dir)
    odd = v.withColumn("lon", F.when((F.col("edge") % 7 == 0) & (F.col("idx") == 3), F.lit(float("nan"))).when(F.col("edge") % 11 == 0, F.lit(1.0)).otherwise(F.col("lon")))
    odd = odd.withColumn("lat", F.when(F.col("edge") % 11 == 0, F.lit(1.0)).otherwise(F.col("lat"))).where("edge % 13 <> 0 or idx = 0")
    return P.valid_edges(odd)


VALIDITY = f"""WITH {V_SQL}, o AS (SELECT edge, idx, CASE WHEN edge % 7 = 0 AND idx = 3 THEN 'nan'::DOUBLE WHEN edge % 11 = 0 THEN 1 ELSE lon END AS lon, CASE WHEN edge % 11 = 0 THEN 1 ELSE lat END AS lat FROM v WHERE edge % 13 <> 0 OR idx = 0)
SELECT edge, count(*) >= 2 AND bool_and(isfinite(lon) AND isfinite(lat)) AND count(DISTINCT (lon, lat)) > 1 AS valid FROM o GROUP BY edge"""


def short_edges(spark, sf_dir):
    v = vertices(spark, sf_dir)
    return P.long_enough(v, 30000.0).groupBy("edge").agg(F.count("*").alias("n"))


SHORT = f"WITH {V_SQL}, {X_SQL} SELECT edge, count(*) AS n FROM arc GROUP BY edge HAVING sum(seg) >= 30000"


def consecutive_dedup(spark, sf_dir):
    v = vertices(spark, sf_dir).select("edge", "idx", *[F.floor(F.col("idx") / 2 * F.lit(1.0)).alias(x) for x in ("lon", "lat", "elev")])
    return P.without_repeats(v).select("edge", "idx", "lon")


DEDUP = f"""WITH {V_SQL}, f AS (SELECT edge, idx, CAST(floor(idx / 2) AS BIGINT) AS lon FROM v)
SELECT edge, idx, lon FROM (SELECT *, lag(lon) OVER (PARTITION BY edge ORDER BY idx) AS p FROM f) WHERE p IS DISTINCT FROM lon"""


def profile_series(spark, sf_dir):
    w = Window.partitionBy("edge").orderBy("idx")
    v = vertices(spark, sf_dir)
    step = F.coalesce(haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), F.lit(0.0))
    v = v.withColumn("step", step).withColumn("m", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return v.select("edge", "idx", r6("m", 1), r6("elev", 1))


PROFILE = f"""WITH {V_SQL}, l AS (SELECT *, lag(lat) OVER w AS a, lag(lon) OVER w AS b FROM v WINDOW w AS (PARTITION BY edge ORDER BY idx)),
h AS (SELECT *, coalesce(2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin(radians(lat - a) / 2), 2) + cos(radians(a)) * cos(radians(lat)) * pow(sin(radians(lon - b) / 2), 2))), 0) AS st FROM l),
c AS (SELECT *, sum(st) OVER (PARTITION BY edge ORDER BY idx ROWS UNBOUNDED PRECEDING) AS m FROM h)
SELECT edge, idx, {rounded('m', 1)} AS m, {rounded('elev', 1)} AS elev FROM c"""


def baseline_slope(spark, sf_dir):
    return P.baseline_slope(vertices(spark, sf_dir)).select("edge", "idx", r6("slope"))


SLOPE = f"""WITH {V_SQL}, {X_SQL}, e AS (SELECT *, last_value(elev) OVER w - first_value(elev) OVER w AS rise, last_value(cum) OVER w - first_value(cum) OVER w AS run FROM arc WINDOW w AS (PARTITION BY edge ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT edge, idx, {rounded('CASE WHEN run > 0 THEN rise / run ELSE 0 END')} AS slope FROM e"""


def bbox(spark, sf_dir):
    return P.margin_box(vertices(spark, sf_dir), 100.0).select(*[r6(c, 9) for c in ("left", "bottom", "right", "top")])


BBOX = f"""WITH {V_SQL}, b AS (SELECT min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM v WHERE isfinite(lon) AND isfinite(lat)),
m AS (SELECT *, 100 / 111194.93::DOUBLE AS up, 100 / (111194.93::DOUBLE * cos(radians((s + n) / 2))) AS across FROM b)
SELECT {rounded('w - across', 9)} AS "left", {rounded('s - up', 9)} AS bottom, {rounded('e + across', 9)} AS "right", {rounded('n + up', 9)} AS top FROM m"""


def _odd(spark, sf_dir):
    v = vertices(spark, sf_dir)
    odd = v.withColumn("elev", F.when((F.col("edge") % 7 == 0) & (F.col("idx") == 3), F.lit(float("nan"))).otherwise(F.col("elev")))
    odd = odd.withColumns({x: F.when(F.col("edge") % 11 == 0, F.lit(1.0)).when((F.col("edge") % 17 == 0) & (F.col("idx") == 1), F.lit(float("inf"))).otherwise(F.col(x)) for x in ("lon", "lat")})
    return odd.where("edge % 13 <> 0 or idx = 0")


ODD = """o AS (SELECT edge, idx, CASE WHEN edge % 11 = 0 THEN 1 WHEN edge % 17 = 0 AND idx = 1 THEN 'inf'::DOUBLE ELSE lon END AS lon,
  CASE WHEN edge % 11 = 0 THEN 1 WHEN edge % 17 = 0 AND idx = 1 THEN 'inf'::DOUBLE ELSE lat END AS lat, CASE WHEN edge % 7 = 0 AND idx = 3 THEN 'nan'::DOUBLE ELSE elev END AS elev FROM v WHERE edge % 13 <> 0 OR idx = 0)"""


def metrics_validity(spark, sf_dir):
    return P.valid_for_metrics(_odd(spark, sf_dir))


METRICS_VALIDITY = f"""WITH {V_SQL}, {ODD}
SELECT edge, count(*) >= 2 AND bool_and(isfinite(lon) AND isfinite(lat) AND isfinite(elev)) AND count(DISTINCT (lon, lat)) > 1 AS valid FROM o GROUP BY edge"""


def contract_guards(spark, sf_dir):
    return broken_vertices(_odd(spark, sf_dir))


GUARDS = f"WITH {V_SQL}, {ODD} SELECT count(*) FILTER (WHERE NOT (isfinite(lon) AND isfinite(lat))) AS places, count(*) FILTER (WHERE NOT isfinite(elev)) AS elevations, min(edge) FILTER (WHERE NOT (isfinite(lon) AND isfinite(lat) AND isfinite(elev))) AS edge FROM o"


def ends_of(v):
    """Edges of one network: 40 nodes, of which neighbours in number share ends."""
    return v.select("edge").distinct().select("edge", (F.col("edge") % 40).alias("node_u"), ((F.col("edge") * 7 + 3) % 40).alias("node_v"))


def operationalized(spark, sf_dir):
    v = vertices(spark, sf_dir)
    return P.operationalize(v, ends_of(v), 40.0, 15.0).select("edge", "idx", r6("elev", 4))


OPERATIONALIZED = f"""WITH RECURSIVE {V_SQL}, lasts AS (SELECT edge, max(idx) AS li FROM v GROUP BY edge),
p AS (SELECT v.*, CASE WHEN idx = 0 THEN 'n' || edge % 40 WHEN idx = li THEN 'n' || (edge * 7 + 3) % 40 ELSE edge || '-' || idx END AS point FROM v JOIN lasts USING (edge)),
l AS (SELECT point AS a, lead(point) OVER (PARTITION BY edge ORDER BY idx) AS b FROM p),
nb AS (SELECT a AS point, b AS other FROM l WHERE b IS NOT NULL UNION ALL SELECT b, a FROM l WHERE b IS NOT NULL),
f0 AS (SELECT point, arg_min(elev, (edge, idx)) AS elev FROM p GROUP BY point),
""" + ",\n".join(
    f"f{k} AS (SELECT f.point, coalesce(0.5 * f.elev + 0.5 * z, f.elev) AS elev FROM f{k - 1} f LEFT JOIN (SELECT nb.point, avg(elev) AS z FROM nb JOIN f{k - 1} g ON nb.other = g.point GROUP BY nb.point) USING (point))"
    for k in (1, 2, 3)
) + f""", s AS (SELECT p.edge, p.idx, f3.elev FROM p JOIN f3 USING (point)),
walk AS (
  SELECT edge, idx, elev, elev AS ref, TRUE AS kept FROM s WHERE idx = 0
  UNION ALL
  SELECT s.edge, s.idx, s.elev, CASE WHEN abs(s.elev - walk.ref) >= 15 THEN s.elev ELSE walk.ref END, abs(s.elev - walk.ref) >= 15
  FROM walk JOIN s ON s.edge = walk.edge AND s.idx = walk.idx + 1
), k AS (SELECT edge, idx, elev, kept OR idx = max(idx) OVER (PARTITION BY edge) AS kept FROM walk),
n AS (SELECT edge, idx, last_value(CASE WHEN kept THEN idx END IGNORE NULLS) OVER b AS ai, last_value(CASE WHEN kept THEN elev END IGNORE NULLS) OVER b AS az,
  first_value(CASE WHEN kept THEN idx END IGNORE NULLS) OVER f AS bi, first_value(CASE WHEN kept THEN elev END IGNORE NULLS) OVER f AS bz FROM k
  WINDOW b AS (PARTITION BY edge ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY edge ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT edge, idx, {rounded('az + (CASE WHEN bi > ai THEN (idx - ai) / CAST(bi - ai AS DOUBLE) ELSE 0 END) * (bz - az)', 4)} AS elev FROM n"""


QUERIES = {
    "edge_metrics": (edge_metrics, EDGE_METRICS),
    "smooth3": (smooth3, SMOOTH3),
    "arc_length": (arc_length, ARC),
    "resample": (resample, RESAMPLE),
    "deadband_profile": (deadband_profile, DEADBAND),
    "laplacian": (laplacian, LAPLACIAN),
    "polyline_validity": (polyline_validity, VALIDITY),
    "short_edges": (short_edges, SHORT),
    "consecutive_dedup": (consecutive_dedup, DEDUP),
    "profile_series": (profile_series, PROFILE),
    "baseline_slope": (baseline_slope, SLOPE),
    "bbox": (bbox, BBOX),
    "metrics_validity": (metrics_validity, METRICS_VALIDITY),
    "contract_guards": (contract_guards, GUARDS),
    "operationalized": (operationalized, OPERATIONALIZED),
}
