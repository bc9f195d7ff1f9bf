"""Operators on small hand-made inputs, and every query with SQL against DuckDB."""

import glob
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgeline.functions import tags
from ridgeline.operators import areas, networks, polylines, routes, search
from ridgeline.plans import catalog
from ridgeline.sources import records
from ridgeline.streaming import progress

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return float(value) if value.__class__.__name__ == "Decimal" else value


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    frame = catalog.queries()[name](spark, SF)
    cursor = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    want = sorted(([plain(v) for v in row] for row in cursor.fetchall()), key=str)
    got = sorted(([plain(row[c]) for c in names] for row in frame.collect()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_tags(spark):
    rows = [
        (["service", "footway"], False, ["hiking"], "trail", 1),
        (["motorway", "service"], False, ["hiking", "odd"], None, None),
        (["service "], False, None, "connector", None),
        (["service"], True, [], None, None),
        ([], False, [" alpine_hiking", "hiking"], None, 4),
        (None, False, ["difficult_alpine_hiking"], None, 6),
    ]
    frame = spark.createDataFrame(rows, "h array<string>, odd boolean, s array<string>, kind string, rank int")
    out = frame.select("kind", "rank", tags.highway_class(F.col("h"), F.col("odd")).alias("k"), tags.sac_rank(F.col("s")).alias("r")).collect()
    assert all(r["kind"] == r["k"] and r["rank"] == r["r"] for r in out)
    assert tags.difficulty_cap(" t4 ") == 4
    with pytest.raises(ValueError, match="T1 to T6"):
        tags.difficulty_cap("T7")


def test_diffusion_steps():
    assert [polylines.diffusion_steps(x) for x in (5, 10, 20, 50, 500)] == [0, 0, 1, 4, 417]


def test_diffusion_kernel_equals_joins(spark):
    rows = [(1, 1, 2, 0, [0.0, 9.0, 3.0, 6.0]), (1, 2, 3, 0, [6.0, 1.0, 2.0]), (1, 3, 1, 0, [2.0, 0.0])]
    edges = spark.createDataFrame(rows, "component long, node_u long, node_v long, key int, elevs array<double>")
    got = {(r["node_u"], r["node_v"]): r["elevs"] for r in polylines.smooth_elevation_of_edges(edges, 50.0).collect()}
    names = {(1, 2): ["n1", "a", "b", "n2"], (2, 3): ["n2", "c", "n3"], (3, 1): ["n3", "n1"]}
    field = {p: z for (_, u, v, _, zs) in rows for p, z in zip(names[u, v], zs, strict=True)}
    links = [x for ps in names.values() for a, b in zip(ps, ps[1:], strict=False) for x in ((a, b), (b, a))]
    out = polylines.smooth_elevation(spark.createDataFrame(list(field.items()), "point string, elev double"), spark.createDataFrame(links, "point string, other string"), 4)
    want = {r["point"]: r["elev"] for r in out.collect()}
    assert all(abs(z - want[p]) < 1e-12 for key, zs in got.items() for p, z in zip(names[key], zs, strict=True))


def chain(*specs, labels=None):
    names = labels or list(range(len(specs) + 1))
    return [(names[i], names[i + 1], 0, float(m), float(up)) for i, (m, up) in enumerate(specs)]


@pytest.mark.parametrize("labels", [[0, 1, 2, 3], [10, 5, 30, 40]])
def test_climbs_are_maximal(labels):
    found = networks.grow_climbs(chain((200, 100), (200, 100), (200, 100), labels=labels), 0.2, 300)
    assert [[e[:2] for e in c] for c in found] == [[(a, b) for a, b in zip(labels, labels[1:], strict=False)]]


def test_climbs_choose_and_stop():
    assert networks.grow_climbs(chain((100, 50), (100, 0)), 0.3, 150) == []
    fork = [*chain((100, 50)), (1, 2, 0, 100.0, 30.0), (1, 3, 0, 100.0, 60.0), (1, 4, 0, 100.0, 60.0)]
    assert [e[1] for e in networks.grow_climbs(fork, 0.2, 150)[0]] == [1, 3]
    loop = [(0, 1, 0, 100.0, 50.0), (1, 0, 0, 100.0, 50.0)]
    assert [len(c) for c in networks.grow_climbs(loop, 0.2, 50)] == [1, 1]


def test_contraction(spark):
    names = "component long, node_u long, node_v long, key int, length_m double, d_plus_m double, d_minus_m double, max_windowed_descent_grad double, highway array<string>, sac_scale array<string>"
    climb = [(1, u, u + 1, 0, 100.0, 50.0, 0.0, 0.0, ["path"], ["hiking"]) for u in range(3)]
    side = [(1, 2, 9, 0, 30.0, 0.0, 5.0, 0.1, ["service"], None), (1, 0, 2, 4, 80.0, 0.0, 0.0, 0.0, ["path"], None)]
    edges = spark.createDataFrame(climb + side, names)
    found = networks.detect_climbs(edges, 0.3, 250.0)
    assert found.count() == 3
    out = networks.contract(edges, found, 50.0).orderBy("is_super", "node_u", "node_v").collect()
    assert [(r["node_u"], r["node_v"], r["key"], r["length_m"], r["reusable"], r["is_super"]) for r in out] == [
        (0, 2, 4, 80.0, False, False),
        (2, 9, 0, 30.0, True, False),
        (0, 2, 5, 200.0, False, True),
        (2, 3, 0, 100.0, False, True),
    ]
    flags = {r["node_id"]: r["is_junction"] for r in networks.junctions(networks.contract(edges, found, 50.0)).collect()}
    assert flags == {0: False, 2: True, 3: False, 9: False}


def test_distinct_top_rules():
    top = search.DistinctTop(2, 0.0)
    assert top.offer(5, frozenset("ab")) and top.offer(4, frozenset("cd"))
    assert not top.offer(4.5, frozenset("bx"))
    assert not top.offer(3, frozenset("e")) and top.offer(6, frozenset("f"))
    assert top.offer(9, frozenset("af")) and [h[0] for h in top.top()] == [9]
    with pytest.raises(ValueError, match="finite"):
        top.offer(float("nan"), frozenset("z"))
    for wrong in ((0, 0.0), (1, 1.5)):
        with pytest.raises(ValueError, match="n must"):
            search.DistinctTop(*wrong)


def toy(spark, seed):
    rng = np.random.default_rng(seed)
    edges = {}
    for layer in range(4):
        for a in range(3):
            for b in range(3):
                if a == b or rng.random() < 0.45:
                    edges[layer * 3 + a, (layer + 1) * 3 + b] = (float(rng.uniform(150, 600)), float(rng.uniform(0.05, 0.55)))
    rows = [(u, v, 0, m, m * g, 0.0, False) for (u, v), (m, g) in edges.items()]
    return spark.createDataFrame(rows, "node_u long, node_v long, key int, length_m double, d_plus_m double, d_minus_m double, reusable boolean")


@pytest.mark.parametrize("seed", [11, 23])
def test_search_against_all_walks(spark, seed):
    edges = toy(spark, seed)
    ident = edges.select(F.concat_ws("-", "node_u", "node_v").alias("id"), "node_u", "node_v", F.concat_ws("-", "node_u", "node_v").alias("segment"), "length_m", F.col("d_plus_m").alias("gain"))
    best = search.walks(ident, 4).where("objective / length_m >= 0.2").agg(F.max("objective")).first()[0]
    p = search.Params(theta=0.2, n=3, iterations=600, seed=seed)
    one = search.search(spark, edges, p, workers=3, interval=300).collect()
    two = search.search(spark, edges, p, workers=3, interval=300).collect()
    assert one == two
    assert 0.8 * best <= one[0]["objective"] <= best + 1e-9
    used = {}
    for r in one:
        used.setdefault((r["node_u"], r["node_v"]), set()).add(r["route"])
    assert all(len(x) == 1 for x in used.values())


def test_rounds():
    assert search.rounds(10, 0, 3) == [[4, 3, 3]]
    assert [sum(x) for x in search.rounds(1000, 250, 4)] == [250] * 4
    with pytest.raises(ValueError, match="finite"):
        search.check_params(search.Params(theta=float("inf")))


def test_descent_cap(spark):
    e = spark.createDataFrame([(0.0, 300.0, 0.7), (250.0, 0.0, 0.9), (0.0, 300.0, None)], "p double, n double, g double")
    assert [r[0] for r in e.select(tags.descends_over(0.45, F.col("p"), F.col("n"), F.col("g"))).collect()] == [True, False, False]
    assert not any(r[0] for r in e.select(tags.descends_over(None, F.col("p"), F.col("n"), F.col("g"))).collect())


def test_area_spelling():
    assert areas.resolve_area(45, 5, width_km=4, height_km=2)["half_width_km"] == 2
    for wrong in ({}, {"radius_km": 1, "width_km": 2}, {"width_km": 1}, {"radius_km": -1}, {"radius_km": float("nan")}):
        with pytest.raises(ValueError, match="."):
            areas.resolve_area(45, 5, **wrong)
    with pytest.raises(ValueError, match="globe"):
        areas.resolve_area(95, 5, radius_km=1)


def test_entries_round_trip(spark, tmp_path):
    root, nodes = str(tmp_path), spark.range(3)
    records.write_entry(spark, root, "k1", {"nodes": nodes}, {"area": "a"})
    records.write_entry(spark, root, "k2", {"nodes": nodes}, {"area": "b"})
    records.write_text(spark, f"{root}/areas/k2/manifest.json", "{broken")
    assert [r["key"] for r in records.read_index(spark, root).collect()] == ["k1"]
    assert records.read_entry(spark, root, "k1", ("nodes",))["nodes"].count() == 3
    with pytest.raises(records.CorruptEntry):
        records.read_entry(spark, root, "k2", ("nodes",))
    assert records.rebuild_index(spark, root) == 1 and json.loads((tmp_path / "index.jsonl").read_text())["key"] == "k1"
    records.write_entry(spark, root, "k1", {"nodes": spark.range(5)}, {"area": "a"})  # a new generation, and the old one goes
    assert records.read_entry(spark, root, "k1", ("nodes",))["nodes"].count() == 5
    assert sum(x.is_dir() for x in (tmp_path / "areas/k1").iterdir()) == 1
    same = {"area": "a", "policy": "include", "dem_version": "v1"}
    for key, told in (("o1", same), ("o2", same | {"policy": "exclude"}), ("o3", same | {"dem_version": "v2"}), ("o4", same)):
        records.write_entry(spark, root, key, {"nodes": nodes}, told)
    assert records.collect_superseded(spark, root, "o4") == ["o1"]
    records.drop_entries(spark, root, ["k1"])
    assert not (tmp_path / "areas/k1").exists() and records.read_index(spark, str(tmp_path / "none")).isEmpty()


def test_golden_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([(0, 3, 10.5, 2.0, 5.0, "ab"), (1, 2, 4.0, 1.0, 2.0, "cd")], records.GOLDEN)
    records.write_golden(spark, frame, str(tmp_path / "golden.json"), {"n": 2})
    assert records.read_golden(spark, str(tmp_path / "golden.json"), {"n": 2}).collect() == frame.collect()
    with pytest.raises(records.CorruptEntry, match="other parameters"):
        records.read_golden(spark, str(tmp_path / "golden.json"), {"n": 3})


def test_nearest_at_the_pole_and_far_away(spark):
    names = "area_id long, lat double, lon double, half_width_km double, half_height_km double, angle_deg double"
    asked = spark.createDataFrame([(1, 45.0, 0.0, 1.0, 1.0, 0.0), (2, 90.0, 0.0, 1.0, 1.0, 0.0)], names)
    held = spark.createDataFrame([(7, 55.0, 2.0, 1.0, 1.0, 0.0), (8, 45.0, 14.27, 1.0, 1.0, 0.0), (9, 90.0, 5.0, 1.0, 1.0, 0.0)], names)
    got = {r["query_id"]: r["area_id"] for r in areas.nearest(asked, held).collect()}

    def km(a, b):
        return math.hypot((a[0] - b[0]) * 111, (a[1] - b[1]) * 111 * math.cos(math.radians((a[0] + b[0]) / 2)))

    assert got[1] == min((km((45, 0), p), k) for k, p in ((7, (55, 2)), (8, (45, 14.27))))[1]
    assert got[2] in (7, 8)  # the entry at the pole has no distance


def test_long_edge_is_linear(spark):
    import time

    n = 100_000
    frame = spark.range(n).select(F.lit(1).alias("edge"), F.col("id").cast("int").alias("idx"), (5 + F.col("id") * 1e-4).alias("lon"), F.lit(45.0).alias("lat"), (F.col("id") % 50).cast("double").alias("elev"))
    began = time.time()
    assert polylines.edge_metrics(frame).count() == 1 and polylines.deadband(frame, 20.0).count() == n
    assert time.time() - began < 60


def test_strong_components(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (5, 7)]
    found = networks.strong_components(spark.createDataFrame(pairs, "node_u long, node_v long"))
    assert {r["node_id"]: r["component"] for r in found.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}


def test_guards(spark):
    edges = spark.createDataFrame([(1,)], "edge long")
    vertices = spark.createDataFrame([(1, 5.0, 45.0, 1.0), (1, 5.1, 45.0, float("nan"))], "edge long, lon double, lat double, elev double")
    networks.guard(edges, vertices.limit(1), "here")
    with pytest.raises(networks.ContractError, match="1 elevations"):
        networks.guard(edges, vertices, "here")
    with pytest.raises(networks.ContractError, match="no edges"):
        networks.guard(edges.limit(0), vertices, "here")


def test_search_options(spark, tmp_path):
    edges = toy(spark, 11)
    everything = search.load_network(edges)
    p = search.Params(theta=0.2, n=50, iterations=200, seed=1, start_at_junction=True)
    flags = spark.createDataFrame([(n, n in (0, 1)) for n in range(15)], "node_id long, is_junction boolean")
    found = search.search(spark, edges, p, workers=2, interval=100, junctions=flags, snapshots=str(tmp_path / "best")).collect()
    assert found and {r["node_u"] for r in found if r["seq"] == 0} <= {0, 1}
    assert sorted(x.name for x in (tmp_path / "best").iterdir()) == ["round=0", "round=1"]
    with pytest.raises(ValueError, match="junctions"):
        search.search(spark, edges, p)
    with pytest.raises(ValueError, match="stored context"):
        search.search(spark, edges, p._replace(start_at_junction=False), expected="other")
    assert search.context_key(everything, p) != search.context_key(everything, p._replace(n=3))
    quick = search.search(spark, edges, search.Params(iterations=10**9, time_budget=0.5), workers=2)
    assert quick.count() > 0
    hard = edges.withColumn("sac_scale", F.when(F.col("node_u") < 3, F.array(F.lit("alpine_hiking"))))
    assert search.usable(hard, search.Params(difficulty_cap=3)).where("node_u < 3").isEmpty() and search.usable(hard, search.Params()).count() == edges.count()
    assert search.degradation_message(50, p) is None and "start-at-junction" in search.degradation_message(2, p)
    assert search.exit_code(edges.limit(0), edges.limit(0)) == 0 and search.exit_code(edges, edges.limit(0)) == 1


def test_unknown_edge_is_an_error(spark):
    network = spark.createDataFrame([(1, 2, 0, [1])], "node_u long, node_v long, key int, base_segment_ids array<long>")
    walked = spark.createDataFrame([(0, 0, 1, 2, 0), (0, 1, 2, 9, 0)], "route int, seq int, node_u long, node_v long, key int")
    assert routes.base_ids(walked.limit(1), network).first()["base_segment_ids"] == [1]
    with pytest.raises(Exception, match="no such edge: 2 9 0"):
        routes.base_ids(walked, network).collect()


def test_stream_equals_batch(spark, tmp_path):
    lines = ["stage: load (a note) ...", "progress: iter=5 best_objective=2.5 elapsed=0.1s eta=1s stagnation=0", "", "stage: load: 3.5 s", "stage: solve ..."]
    lines += ["progress: workers=1/4 iters=9 best_worker_objective=4.5 elapsed=0.9s", "noise", "total_objective: 4.5"] + [f"more {k}" for k in range(30)]
    rows = [{"job_id": j, "seq": k, "line": x} for j in ("a", "b") for k, x in enumerate(lines)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/log.json").write_text("\n".join(json.dumps(r) for r in [*rows, rows[0]]) + "\n{cut off")
    stream = progress.stream_states(progress.read_log(spark, str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        got = sorted(map(tuple, spark.table("states").collect()), key=str)
    finally:
        query.stop()
    want = progress.states(spark.createDataFrame(rows, progress.LOG)).select(*[c.split()[0] for c in progress.STATE.split(", ")])
    assert got == sorted(map(tuple, want.collect()), key=str)


def test_lat_lon(spark):
    frame = spark.createDataFrame([("45.5, 5",), ("95,5",), ("x",), (None,)], "t string")
    assert [r[0] and tuple(r[0]) for r in frame.select(records.parse_lat_lon(F.col("t"))).collect()] == [(45.5, 5.0), None, None, None]


def test_sequence_hash_is_canonical(spark):
    import hashlib

    frame = spark.createDataFrame([(1, 2, 3, 0), (1, 1, 2, 0)], "route long, node_u long, node_v long, key int")
    assert routes.sequence_hash(frame).first()["hash"] == hashlib.sha256(b"[[1,2,0],[2,3,0]]").hexdigest()


@pytest.fixture(scope="module")
def few_lines(spark, tmp_path_factory):
    """A folder with 90 lines of three suppliers, parallel edges among them."""
    from ridgeline.plans import networks as plans

    folder = str(tmp_path_factory.mktemp("few"))
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_suppkey between 1 and 3")
    lines = lines.withColumns({"l_partkey": F.col("l_partkey") % 8, "l_orderkey": F.col("l_orderkey") % 11})
    order = ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice"]
    w = Window.partitionBy("l_suppkey").orderBy(*order[1:])
    lines.withColumn("_n", F.row_number().over(w)).where("_n <= 30").drop("_n").coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    rows = plans.flat(plans.edges(spark, folder)).collect()
    assert len(rows) == 90 and any(r.key > 0 for r in rows)
    return folder, rows


def test_components_of_all_edges(spark, few_lines):
    folder, rows = few_lines
    label = {n: n for r in rows for n in (r.node_u, r.node_v)}
    for _ in label:
        for r in rows:
            label[r.node_u] = label[r.node_v] = min(label[r.node_u], label[r.node_v])
    queries = catalog.queries()
    assert {r.node_id: r.component for r in queries["components"](spark, folder).collect()} == label
    sizes = {c: list(label.values()).count(c) for c in label.values()}
    top = min(sizes, key=lambda c: (-sizes[c], c))
    assert {r.node_id for r in queries["largest_component"](spark, folder).collect()} == {n for n, c in label.items() if c == top}


def test_walks_of_all_edges(spark, few_lines):
    folder, rows = few_lines
    segment = lambda r: (min(r.node_u, r.node_v), max(r.node_u, r.node_v), r.key)
    walks, expected = [[r] for r in rows], []
    for depth in (1, 2):
        gains = [sum(r.d_plus_m + r.d_minus_m for r in walk) for walk in walks]
        expected.append((depth, len(walks), max(gains), sum(float(r.length_m) for walk in walks for r in walk)))
        walks = [[*walk, r] for walk in walks for r in rows if r.node_u == walk[-1].node_v and segment(r) not in map(segment, walk)]
    found = catalog.queries()["walk_enumeration"](spark, folder).orderBy("depth").collect()
    assert [(r.depth, r.n, r.best, float(r.length_m)) for r in found] == expected


def test_routes_and_geometries_of_all_edges(spark, few_lines):
    folder, rows = few_lines
    queries, ends = catalog.queries(), lambda found: sorted((r.node_u, r.node_v) for r in found)
    assert ends(queries["normalized_edges"](spark, folder).collect()) == ends(rows)
    used = {(r.node_u, r.node_v, r.key) for r in queries["grasp_routes"](spark, folder).collect()}
    by_place = {(r.node_u, r.node_v, r.key): r for r in rows}
    assert used <= set(by_place) and any(by_place[e].length_m <= 400 or by_place[e].key for e in used)


def test_worst_held_of_ties_is_the_least_id(spark):
    rows = [(5, 1.0, ["b", "a"]), (7, 1.0, ["a", "b"]), (3, 1.0, ["b", "a"]), (1, 1.0, ["a"]), (0, 2.0, ["c"]), (2, float("nan"), ["d"]), (4, None, ["e"])]
    held = spark.createDataFrame(rows, "id long, objective double, segments array<string>")
    for order in (F.asc("id"), F.desc("id")):
        for n in (1, 3, 7):
            assert routes.worst_held(held.orderBy(order).repartition(n)).collect() == [(3,)]
    assert routes.worst_held(held.limit(0)).collect() == []


def joined_rows(node):
    """The most rows that a join of an executed plan made."""
    if node.nodeName() == "AdaptiveSparkPlan":
        return joined_rows(node.executedPlan())
    if node.nodeName().endswith("QueryStage"):
        return joined_rows(node.plan())
    below = [joined_rows(node.children().apply(k)) for k in range(node.children().size())]
    return max([*below, node.metrics().apply("numOutputRows").value() if "Join" in node.nodeName() else 0])


def test_covering_does_not_pair_copies(spark):
    shape = "lat double, lon double, half_width_km double, half_height_km double, angle_deg double, area_id long"
    entries = [(45.0, 5.0, w, 20.0, a, k) for k, (w, a) in enumerate([(40.0, 0.0), (30.0, 0.0), (30.0, 90.0)] * 60, 7)]
    queries = [(45.0, lon, 1.0, 1.0, 0.0, k) for k, lon in enumerate([5.0, 5.45, 9.0, None] * 60)]
    queries.append(queries[0])
    found = areas.covering(spark.createDataFrame(queries, shape), spark.createDataFrame(entries, shape))
    assert sorted(found.collect()) == sorted((k, {0: 8, 1: 7}[k % 4]) for k in range(240) if k % 4 < 2)
    assert joined_rows(found._jdf.queryExecution().executedPlan()) <= len(queries)


def test_search_of_a_network_that_is_not_broadcast(spark, few_lines, monkeypatch):
    """Both ways make the same routes, with any number of walks at a time and with pieces of way that lie under several edges."""
    rows = few_lines[1]
    plain_edges = spark.createDataFrame([r.asDict() for r in rows], "node_u long, node_v long, key int, length_m double, d_plus_m double, d_minus_m double").withColumn("reusable", F.col("length_m") < 250)
    piece = lambda a, b, k: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), k.cast("long").alias("k"))
    u, v, k = F.col("node_u"), F.col("node_v"), F.col("key")
    shared = plain_edges.withColumn("base_segment_ids", F.array(piece(F.least(u, v), F.greatest(u, v), k), piece(u % 4, v % 4, F.lit(9))))
    flags = spark.createDataFrame([(n, n % 2 == 0) for n in range(100, 400)], "node_id long, is_junction boolean")
    p = search.Params(theta=0.2, n=6, iterations=60, seed=5, most_shared=0.4)
    cases = [(plain_edges, p, {}), (shared, p._replace(stagnation=9), {}), (shared, p._replace(start_at_junction=True), {"junctions": flags})]
    run = lambda e, q, more: search.search(spark, e, q, workers=3, interval=30, **more).collect()
    want = [run(*case) for case in cases]
    assert all(want) and any(x != want[0] for x in want)
    monkeypatch.setattr(search, "BROADCAST_EDGES", len(rows) - 1)
    assert [run(*case) for case in cases] == want
    monkeypatch.setattr(search, "WALKS_AT_ONCE", 25)
    monkeypatch.setattr(search, "HOPS", 1)
    monkeypatch.setattr(search, "FEW_NODES", 3)
    assert run(*cases[1]) == want[1]
    with pytest.raises(ValueError, match="stored context"):
        search.search(spark, plain_edges, p, expected="other")
    assert search.search(spark, plain_edges, p, workers=3, interval=30, expected=search.edges_key(plain_edges, None, p)).collect() == want[0]
    assert search.search(spark, plain_edges, p._replace(iterations=10**9, time_budget=0.1), workers=3).count() > 0
    monkeypatch.setattr(search, "BROADCAST_EDGES", -1)
    assert search.search(spark, plain_edges.limit(0), p, workers=3).collect() == []
