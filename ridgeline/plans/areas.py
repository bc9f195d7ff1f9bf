"""Queries over areas, grids, jobs and progress; customers, suppliers, embeddings and events stand in."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgeline.functions.measures import portable_round
from ridgeline.operators import areas as A
from ridgeline.plans.polylines import rounded
from ridgeline.sources import records
from ridgeline.streaming import progress as S

EN_SQL = "en AS (SELECT s_suppkey AS area_id, 44 + s_suppkey % 5 * 0.5::DOUBLE AS lat, 5 + s_suppkey % 7 * 0.5::DOUBLE AS lon, 10.0::DOUBLE + s_suppkey % 9 * 10 AS hw, 10.0::DOUBLE + s_suppkey % 4 * 20 AS hh, CAST(s_suppkey % 4 * 20 AS DOUBLE) AS ang FROM supplier)"
QU_SQL = "qu AS (SELECT c_custkey AS area_id, 44 + c_custkey % 41 * 0.05::DOUBLE AS lat, 5 + c_custkey % 61 * 0.05::DOUBLE AS lon, 1.0::DOUBLE + c_custkey % 5 AS hw, 2.0::DOUBLE AS hh, CAST(c_custkey % 3 * 15 AS DOUBLE) AS ang FROM customer)"


def _corners(t: str) -> str:
    return f"""(SELECT {t}.*, corner, lon + (sx * hw * cos(radians(ang)) + sy * hh * sin(radians(ang))) * (1 / (111.0::DOUBLE * cos(radians(lat)))) AS clon,
  lat + (sy * hh * cos(radians(ang)) - sx * hw * sin(radians(ang))) / 111.0::DOUBLE AS clat FROM {t}, (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1)) s(corner, sx, sy))"""


def entries(spark, sf_dir):
    k = F.col("s_suppkey")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("area_id"), (44 + k % 5 * F.lit(0.5)).alias("lat"), (5 + k % 7 * F.lit(0.5)).alias("lon"), (F.lit(10.0) + k % 9 * 10).alias("half_width_km"), (F.lit(10.0) + k % 4 * 20).alias("half_height_km"), (k % 4 * 20).cast("double").alias("angle_deg"))


def asked(spark, sf_dir):
    k = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("area_id"), (44 + k % 41 * F.lit(0.05)).alias("lat"), (5 + k % 61 * F.lit(0.05)).alias("lon"), (F.lit(1.0) + k % 5).alias("half_width_km"), F.lit(2.0).alias("half_height_km"), (k % 3 * 15).cast("double").alias("angle_deg"))


def area_ring(spark, sf_dir):
    return A.corners(asked(spark, sf_dir)).select("area_id", "corner", portable_round(F.col("lon"), 9).alias("lon"), portable_round(F.col("lat"), 9).alias("lat"))


RING = f"WITH {QU_SQL} SELECT area_id, corner, {rounded('clon', 9)} AS lon, {rounded('clat', 9)} AS lat FROM {_corners('qu')}"


def area_bbox(spark, sf_dir):
    b = A.bounding_boxes(entries(spark, sf_dir))
    return b.select("area_id", *[portable_round(F.col(c), 9).alias(c) for c in ("left", "bottom", "right", "top")])


BOX = f"WITH {EN_SQL} SELECT area_id, {rounded('min(clon)', 9)} AS \"left\", {rounded('min(clat)', 9)} AS bottom, {rounded('max(clon)', 9)} AS \"right\", {rounded('max(clat)', 9)} AS top FROM {_corners('en')} GROUP BY area_id"


def covering_smallest(spark, sf_dir):
    return A.covering(asked(spark, sf_dir), entries(spark, sf_dir))


COVERING = f"""WITH {EN_SQL}, {QU_SQL}, c AS (SELECT area_id AS q, clon, clat FROM {_corners('qu')}),
h AS (SELECT q, en.area_id, hw, hh, (clon - lon) * 111.0::DOUBLE * cos(radians(lat)) AS e, (clat - lat) * 111.0::DOUBLE AS n, radians(ang) AS a FROM c, en),
i AS (SELECT q, area_id, any_value(hw * hh) AS km FROM h GROUP BY q, area_id HAVING bool_and(abs(e * cos(a) - n * sin(a)) <= hw + 1e-9 AND abs(e * sin(a) + n * cos(a)) <= hh + 1e-9))
SELECT q AS query_id, area_id FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY km, area_id) AS k FROM i) WHERE k = 1"""


def nearest_area(spark, sf_dir):
    return A.nearest(asked(spark, sf_dir), entries(spark, sf_dir)).select("query_id", "area_id", portable_round(F.col("distance_km"), 6).alias("distance_km"))


_KM = "sqrt(((q.lat - en.lat) * 111) ** 2 + ((q.lon - en.lon) * 111 * cos(radians((q.lat + en.lat) / 2))) ** 2)"
NEAREST = f"""WITH {EN_SQL}, {QU_SQL}, d AS (SELECT q.area_id AS query_id, en.area_id, {_KM} AS km FROM qu q, en)
SELECT query_id, arg_min(area_id, (floor(km * 1e9), area_id)) AS area_id, {rounded('min(km)')} AS distance_km FROM d GROUP BY query_id"""


def coverage_hints(spark, sf_dir):
    return A.coverage_hint(asked(spark, sf_dir), _squares(entries(spark, sf_dir))).select("query_id", "area_id", portable_round(F.col("largest_radius_km"), 6).alias("largest_radius_km"))


def _squares(e):
    """Entries of which every second is an upright square, small enough that many queries are not covered."""
    even = F.col("area_id") % 2 == 0
    return e.withColumns({"half_width_km": F.lit(4.0), "half_height_km": F.when(even, 4.0).otherwise(3.0), "angle_deg": F.lit(0.0)})


HINTS = f"""WITH {EN_SQL}, {QU_SQL}, sq AS (SELECT area_id, lat, lon, 4.0::DOUBLE AS hw, CASE WHEN area_id % 2 = 0 THEN 4.0::DOUBLE ELSE 3.0::DOUBLE END AS hh, 0.0::DOUBLE AS ang FROM en),
c AS (SELECT area_id AS q, clon, clat FROM {_corners('qu')}),
i AS (SELECT q, sq.area_id FROM c, sq GROUP BY q, sq.area_id HAVING bool_and(abs((clon - lon) * 111.0::DOUBLE * cos(radians(lat))) <= hw + 1e-9 AND abs((clat - lat) * 111.0::DOUBLE) <= hh + 1e-9)),
m AS (SELECT * FROM qu WHERE area_id NOT IN (SELECT q FROM i)),
d AS (SELECT q.area_id AS query_id, en.area_id, {_KM} AS km, q.hw = q.hh AND q.ang = 0 AND en.hw = en.hh AS square,
  en.hw - greatest(abs(q.lat - en.lat) * 111, abs(q.lon - en.lon) * 111 * cos(radians((q.lat + en.lat) / 2))) AS r FROM m q, sq en),
b AS (SELECT query_id, arg_min((area_id, square, r), (floor(km * 1e9), area_id)) AS x FROM d GROUP BY query_id)
SELECT query_id, x[1] AS area_id, CASE WHEN x[2] AND x[3] > 0 THEN {rounded('x[3]')} END AS largest_radius_km FROM b"""


def dem_keys(spark, sf_dir):
    b = A.bounding_boxes(entries(spark, sf_dir).where("angle_deg = 0"))
    r = lambda c: F.floor(F.col(c) * 1000) / 1000
    return b.select("area_id", A.dem_cache_key(r("left"), r("bottom"), r("right"), r("top"), F.lit(0.5), "terrain", "v2").alias("key"))


DEM_KEYS = f"""WITH {EN_SQL}, b AS (SELECT area_id, floor(min(clon) * 1000) / 1000 AS w, floor(min(clat) * 1000) / 1000 AS s, floor(max(clon) * 1000) / 1000 AS e, floor(max(clat) * 1000) / 1000 AS n FROM {_corners('en')} WHERE ang = 0 GROUP BY area_id)
SELECT area_id, substr(sha256(concat_ws('|', printf('%.6f', w), printf('%.6f', s), printf('%.6f', e), printf('%.6f', n), printf('%.6f', 0.5), 'terrain', 'v2')), 1, 16) AS key FROM b"""


def cache_keys(spark, sf_dir):
    return A.cache_key(entries(spark, sf_dir), "include", "v3")


KEYS = f"WITH {EN_SQL} SELECT area_id, substr(sha256(concat_ws('|', printf('%.6f', lat), printf('%.6f', lon), printf('%.3f', hw), printf('%.3f', hh), printf('%.3f', ang), 'include', 'v3')), 1, 16) AS key FROM en"


def stale_entries(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    all_ = o.select(F.col("o_custkey").alias("area_id"), F.col("o_orderstatus").alias("policy"), F.substring("o_orderpriority", 1, 1).alias("dem_version"), F.col("o_orderkey").alias("key"))
    return A.stale_siblings(all_, all_.groupBy("area_id", "policy", "dem_version").agg(F.max("key").alias("key")))


STALE = """SELECT o_custkey AS area_id, o_orderstatus AS policy, substr(o_orderpriority, 1, 1) AS dem_version, o_orderkey AS key FROM orders o
WHERE o_orderkey <> (SELECT max(o_orderkey) FROM orders i WHERE i.o_custkey = o.o_custkey AND i.o_orderstatus = o.o_orderstatus AND substr(i.o_orderpriority, 1, 1) = substr(o.o_orderpriority, 1, 1))"""


def area_features(spark, sf_dir):
    f = A.bounds_feature(entries(spark, sf_dir))
    ring = F.from_json("feature", "type string, geometry struct<type:string, coordinates:array<array<array<double>>>>")
    return f.withColumn("f", ring).select("area_id", F.col("f.geometry.type").alias("kind"), F.size(F.col("f.geometry.coordinates")[0]).alias("n"), portable_round(F.col("f.geometry.coordinates")[0][4][0], 6).alias("lon"))


FEATURES = f"WITH {EN_SQL} SELECT area_id, 'Polygon' AS kind, 5 AS n, {rounded('clon')} AS lon FROM {_corners('en')} WHERE corner = 0"


def tile_plan(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return A.tile_plan(p.select(F.col("p_partkey").alias("grid_id"), (F.col("p_size") * 100).alias("width"), (F.col("p_size") * 70).alias("height")))


TILES = """SELECT p_partkey AS grid_id, r AS row0, c AS col0, least(2048, p_size * 70 - r) AS rows, least(2048, p_size * 100 - c) AS cols
FROM (SELECT *, CAST(unnest(generate_series(0, p_size * 70 - 1, 2048)) AS INTEGER) AS r FROM part), LATERAL (SELECT CAST(unnest(generate_series(0, p_size * 100 - 1, 2048)) AS INTEGER) AS c)"""


def raster_sample(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    cells = e.select(F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "elev"))
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    points = ev.select("event_id", (F.col("event_id") % 700 / F.lit(10.0) - 2).alias("lon"), (F.lit(400.0) - F.col("event_id") % 430).alias("lat"))
    return A.sample_grid(points, cells, 0.0, 400.0, 64, 1_000_000, 1.0).select("event_id", F.col("elev").cast("double").alias("elev"))


SAMPLE = """WITH c AS (SELECT vec_id AS row, generate_subscripts(embedding, 1) - 1 AS col, unnest(embedding) AS elev FROM embeddings),
p AS (SELECT event_id, floor((event_id % 700) / 10.0::DOUBLE - 2) AS col, floor(400 - (400 - CAST(event_id % 430 AS DOUBLE))) AS row FROM events)
SELECT event_id, CAST(elev AS DOUBLE) AS elev FROM p LEFT JOIN c ON p.row = c.row AND p.col = c.col"""


def _lines(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    k = F.col("event_id")
    said = [
        F.concat(F.lit("stage: "), "event_type", F.lit(" (first, second) ...")),
        F.concat(F.lit("stage: "), "event_type", F.lit(": "), k % 50, F.lit(".5 s")),
        F.concat(F.lit("progress: iter="), k, F.lit(" best_objective="), k % 77, F.lit(".2 elapsed="), k % 31, F.lit(".1s eta=3s stagnation=4")),
        F.concat(F.lit("progress: workers=1/4 iters="), k, F.lit(" best_worker_objective=-"), k % 77, F.lit(".7 elapsed="), k % 29, F.lit(".3s")),
        F.lit("  "),
        F.concat(F.lit("total_objective: "), k % 90, F.lit(".4")),
        F.concat(F.lit("stage: "), "event_type", F.lit(" ...")),
    ]
    line = F.concat(F.lit("note stage: x ... "), k)
    for m, text in enumerate(said):
        line = F.when(k % 8 == m, text).otherwise(line)
    return ev.select(F.col("user_id").cast("string").alias("job_id"), seq.cast("long").alias("seq"), line.alias("line"))


L_SQL = r"""t AS (SELECT CAST(user_id AS VARCHAR) AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, CASE event_id % 8
  WHEN 0 THEN 'stage: ' || event_type || ' (first, second) ...' WHEN 1 THEN 'stage: ' || event_type || ': ' || event_id % 50 || '.5 s'
  WHEN 2 THEN 'progress: iter=' || event_id || ' best_objective=' || event_id % 77 || '.2 elapsed=' || event_id % 31 || '.1s eta=3s stagnation=4'
  WHEN 3 THEN 'progress: workers=1/4 iters=' || event_id || ' best_worker_objective=-' || event_id % 77 || '.7 elapsed=' || event_id % 29 || '.3s'
  WHEN 4 THEN '  ' WHEN 5 THEN 'total_objective: ' || event_id % 90 || '.4' WHEN 6 THEN 'stage: ' || event_type || ' ...' ELSE 'note stage: x ... ' || event_id END AS line FROM events),
g AS (SELECT *, regexp_extract(line, '^stage: (.+?) [.][.][.]$', 1) AS b, regexp_extract(line, '^stage: (.+): (\d+(?:[.]\d+)?) s$', ['n', 's']) AS d,
  regexp_extract(line, '^progress: (?:iter|workers=\d+/\d+ iters)=(\d+) best_(?:worker_)?objective=(-?\d+(?:[.]\d+)?) elapsed=(\d+(?:[.]\d+)?)s', ['i', 'o', 's']) AS p,
  regexp_extract(line, '^total_objective: (-?\d+(?:[.]\d+)?)$', 1) AS o FROM t WHERE trim(line) <> ''),
l AS (SELECT job_id, seq, line, CASE WHEN b <> '' THEN 'start' WHEN d.n <> '' THEN 'done' WHEN p.i <> '' THEN 'solve' WHEN o <> '' THEN 'summary' ELSE 'other' END AS kind,
  CASE WHEN b <> '' THEN split_part(b, ' (', 1) ELSE nullif(d.n, '') END AS stage_name, TRY_CAST(p.i AS BIGINT) AS iter,
  coalesce(TRY_CAST(p.o AS DOUBLE), TRY_CAST(o AS DOUBLE)) AS best, coalesce(TRY_CAST(d.s AS DOUBLE), TRY_CAST(p.s AS DOUBLE)) AS elapsed FROM g)""".replace("\\\\", "\\")


def progress_regex(spark, sf_dir):
    return S.parse_lines(_lines(spark, sf_dir)).select("job_id", "seq", "kind", "stage_name", "iter", "best", "elapsed")


REGEX = f"WITH {L_SQL} SELECT job_id, seq, kind, stage_name, iter, best, elapsed FROM l"


def progress_states(spark, sf_dir):
    return S.states(_lines(spark, sf_dir)).withColumn("log_tail", F.array_join("log_tail", "\n"))


STATES = f"""WITH {L_SQL}, s AS (SELECT *, CAST(sum(CASE WHEN kind = 'start' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS INTEGER) AS k FROM l)
SELECT job_id, seq, CASE WHEN max(CASE WHEN kind = 'solve' THEN 1 ELSE 0 END) OVER w = 1 THEN 'solve' ELSE 'query' END AS phase, k AS stage_index, 6 AS stage_total,
  last_value(stage_name IGNORE NULLS) OVER j AS stage_name, last_value(iter IGNORE NULLS) OVER w AS iter, last_value(CASE WHEN kind = 'solve' THEN best END IGNORE NULLS) OVER w AS best,
  last_value(elapsed IGNORE NULLS) OVER j AS elapsed, array_to_string(list(line) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), chr(10)) AS log_tail
FROM s WINDOW w AS (PARTITION BY job_id, k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), j AS (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def summary_objectives(spark, sf_dir):
    return S.summary_objective(_lines(spark, sf_dir))


OBJECTIVES = f"WITH {L_SQL} SELECT job_id, arg_max(best, seq) AS objective FROM l WHERE kind = 'summary' GROUP BY job_id"


def snapshot_tail(spark, sf_dir):
    log = _lines(spark, sf_dir)
    return S.snapshot_then_tail(log.where("seq < 30"), log.where("seq >= 20").unionAll(log.where("seq = 40"))).select("job_id", "seq")


TAIL = f"WITH {L_SQL} SELECT job_id, seq FROM t"


def stage_timing(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return S.stage_timing(ev.select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("stage"))).select("job_id", "stage", "seconds")


TIMING = "SELECT user_id AS job_id, event_id AS stage, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6::DOUBLE AS seconds FROM events"


def stagnation(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return S.stagnation(ev.select(F.col("user_id").alias("worker"), F.col("event_id").alias("iter"), (F.col("event_type") == "purchase").alias("admitted"))).select("worker", "iter", "still")


STAGNATION = "SELECT user_id AS worker, event_id AS iter, event_id - coalesce(max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS still FROM events"


def worker_progress(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return S.worker_progress(ev.select(F.col("user_id").alias("worker"), F.col("event_id").alias("iter"), F.struct("ts", "event_id").alias("ts"), F.col("value").alias("best")))


WORKERS = "WITH w AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS i, max(value) AS b FROM events GROUP BY user_id) SELECT CAST(sum(i) AS BIGINT) AS iterations, max(b) AS best, count(*) AS workers FROM w"


def merged_status(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return S.merged_status(ev.select(F.when(F.col("value") >= 0, "converged").otherwise("budget-exhausted").alias("status"), F.col("event_id").alias("iter")))


STATUS = "SELECT CASE WHEN bool_and(value >= 0) THEN 'converged' ELSE 'budget-exhausted' END AS status, max(event_id) AS iter FROM events"


def time_left(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    left = S.remaining_seconds(F.col("event_id") % 1000, F.lit(800), F.col("value"))
    return ev.select("event_id", portable_round(left, 6).alias("seconds"))


LEFT = f"SELECT event_id, CASE WHEN event_id % 1000 > 0 AND value > 0 THEN {rounded('greatest(0, (800 - event_id % 1000) * value / (event_id % 1000))')} END AS seconds FROM events"


def throttled(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return S.throttled(ev.select(F.col("user_id").alias("key"), F.col("event_id").cast("double").alias("t")), 1500.0)


THROTTLED = """WITH RECURSIVE f AS (SELECT user_id AS key, min(event_id) AS t FROM events GROUP BY user_id
  UNION ALL SELECT f.key, (SELECT min(event_id) FROM events e WHERE e.user_id = f.key AND e.event_id >= f.t + 1500) FROM f WHERE f.t IS NOT NULL)
SELECT key, CAST(t AS DOUBLE) AS t FROM f WHERE t IS NOT NULL"""


def data_age(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = F.when(F.col("o_orderkey") % 9 == 0, F.lit("never")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return o.select("o_orderkey", records.age_days(text, F.lit("2000-01-01T00:00:00")).alias("days"))


AGE = "SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(ceil((epoch_us(TIMESTAMP '2000-01-01') - epoch_us(date_trunc('second', o_orderdate))) / 86400000000.0::DOUBLE) AS BIGINT) END AS days FROM orders"


def place_label(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    address = F.create_map(F.lit("village"), F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_mktsegment")), F.lit("town"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")))
    return c.select("c_custkey", records.place_label(address, ("village", "town"), F.when(F.col("c_custkey") % 5 == 0, "named"), F.concat("c_name", F.lit(", somewhere"))).alias("label"))


LABEL = """SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN nullif(trim(c_mktsegment), '') END, CASE WHEN c_custkey % 2 = 0 THEN nullif(trim(c_name), '') END, CASE WHEN c_custkey % 5 = 0 THEN 'named' END, c_name) AS label FROM customer"""


def latest_jobs(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "done").otherwise("queued")
    return records.latest_jobs(o.select(F.col("o_custkey").cast("string").alias("job_id"), F.struct("o_orderdate", "o_orderkey").alias("updated"), status.alias("status")), recover=True).select("job_id", "status")


JOBS = "SELECT CAST(o_custkey AS VARCHAR) AS job_id, CASE arg_max(o_orderstatus, (o_orderdate, o_orderkey)) WHEN 'O' THEN 'failed' WHEN 'F' THEN 'done' ELSE 'queued' END AS status FROM orders GROUP BY o_custkey"


def job_transitions(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "running").otherwise("done")
    rows = o.select(F.col("o_custkey").cast("string").alias("job_id"), F.col("o_orderkey").alias("updated"), status.alias("status"))
    return records.bad_transitions(rows)


TRANSITIONS = """WITH r AS (SELECT CAST(o_custkey AS VARCHAR) AS job_id, o_orderkey AS updated, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'running' ELSE 'done' END AS status FROM orders),
b AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY updated) AS before FROM r)
SELECT job_id, updated, before, status FROM b WHERE NOT ((before IS NULL AND status = 'queued') OR coalesce(before = 'queued' AND status = 'running', FALSE) OR coalesce(before = 'running' AND status = 'done', FALSE))"""


QUERIES = {
    "area_ring": (area_ring, RING),
    "area_bbox": (area_bbox, BOX),
    "covering_smallest": (covering_smallest, COVERING),
    "nearest_area": (nearest_area, NEAREST),
    "coverage_hints": (coverage_hints, HINTS),
    "dem_keys": (dem_keys, DEM_KEYS),
    "cache_keys": (cache_keys, KEYS),
    "stale_entries": (stale_entries, STALE),
    "area_features": (area_features, FEATURES),
    "tile_plan": (tile_plan, TILES),
    "raster_sample": (raster_sample, SAMPLE),
    "progress_regex": (progress_regex, REGEX),
    "progress_states": (progress_states, STATES),
    "summary_objectives": (summary_objectives, OBJECTIVES),
    "job_transitions": (job_transitions, TRANSITIONS),
    "snapshot_tail": (snapshot_tail, TAIL),
    "stage_timing": (stage_timing, TIMING),
    "stagnation": (stagnation, STAGNATION),
    "worker_progress": (worker_progress, WORKERS),
    "merged_status": (merged_status, STATUS),
    "time_left": (time_left, LEFT),
    "throttled": (throttled, THROTTLED),
    "data_age": (data_age, AGE),
    "place_label": (place_label, LABEL),
    "latest_jobs": (latest_jobs, JOBS),
}
