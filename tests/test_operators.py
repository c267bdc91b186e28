"""Operators against small models of their own, and every registered query against its SQL."""

import math
import random
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plumbline.functions import las, text
from plumbline.operators import editing, listing, mesh, octree, points, project, regions, selection, terrain
from plumbline.plans import catalog, details, formats, more, picks, projects, solids  # noqa: F401
from plumbline.sources import project as project_source
from plumbline.streaming import state

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v.item() if hasattr(v, "item") else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_sql(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalog.ORACLES:
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(catalog.ORACLES[name])
    names, cols = [d[0] for d in found.description], sorted(df.columns)
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=str) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def model(n, capacity, depth):
    """Owners by a sequential run over the points: counts first, then even samples with nodes made on demand."""
    pts = [(i * 7919 % 100000 * 0.01, i * 104729 % 100000 * 0.01, i * 1299709 % 20000 * 0.01) for i in range(n)]

    def child(box, p):
        a, b = box
        m = [(x + y) / 2 for x, y in zip(a, b)]
        up = [v >= c for v, c in zip(p, m)]
        return tuple(up), (tuple(c if u else x for u, c, x in zip(up, m, a)), tuple(y if u else c for u, c, y in zip(up, m, b)))

    root = ((0.0,) * 3, (1000.0,) * 3)
    reached, owner = {}, {}
    for i, p in enumerate(pts):
        path, box = (), root
        while True:
            reached[path] = reached.get(path, 0) + 1
            if reached[path] <= capacity or len(path) == depth:
                break
            o, box = child(box, p)
            path += (o,)
    arrived = {}
    for i, p in enumerate(pts):
        path, box = (), root
        while True:
            arrived[path] = t = arrived.get(path, 0) + 1
            n_here = reached.get(path, 0)
            k = max(1, n_here // capacity)
            if n_here <= capacity or len(path) == depth or (t % k == 0 and t // k <= capacity):
                break
            o, box = child(box, p)
            path += (o,)
        owner[i] = len(path)
    return owner


@pytest.mark.parametrize("n, capacity, local", [(600, 32, 200), (5000, 32, 900), (5000, 32, 1 << 20)])
def test_every_point_has_one_owner(spark, n, capacity, local):
    i = F.col("id")
    df = spark.range(n).select(i.alias("idx"), *[(i * k % m * 0.01).alias(d) for d, k, m in (("x", 7919, 100000), ("y", 104729, 100000), ("z", 1299709, 20000))])
    out = octree.own(df, (0.0,) * 3, (1000.0,) * 3, capacity, 12, block=500, local=local).select("idx", "level").collect()
    assert len(out) == n and {r.idx: r.level for r in out} == model(n, capacity, 12)


def test_surfel_normals(spark):
    rng = np.random.default_rng(1)
    rows = [(float(x), float(y), float(0.5 * x + rng.normal(0, 1e-4)), 9, 9, 9) for x, y in rng.uniform(0, 10, (400, 2))]
    df = spark.createDataFrame(rows, "x double, y double, z double, r int, g int, b int")
    s = points.surfels(df, 100.0, 1.0, (0.0, 0.0, 0.0)).collect()[0]
    want = np.array([-0.5, 0, 1]) / math.sqrt(1.25)
    assert np.allclose([s.nx, s.ny, s.nz], want, atol=1e-3) and s.flags == 0 and s.n == 400
    m = np.cov(np.array([r[:3] for r in rows]).T, bias=True)
    e = points.fit_planes(df.withColumn("k", F.lit(1)), "k").collect()[0]
    assert np.allclose([e.e1, e.e2, e.e3], np.linalg.eigvalsh(m), atol=1e-6)


@pytest.mark.parametrize("rows", [[(0, 0, 0)] * 5, [(i, 2 * i, 3 * i) for i in range(6)], [(0, 0, 0), (1, 0, 0)]])
def test_planes_that_are_none(spark, rows):
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "x double, y double, z double").withColumn("k", F.lit(1))
    assert points.fit_planes(df, "k").collect()[0].nz is None


def test_small_cells_stay_if_all_are_small(spark):
    df = spark.createDataFrame([(1, 1), (1, 3), (2, 1)], "node int, n int")
    assert sorted(map(tuple, points.drop_small_cells(df, 2, "node").collect())) == [(1, 3), (2, 1)]


def test_budgeted_selection_skips_and_goes_on():
    rows = pd.DataFrame(
        [("r", 0, 0, 0, 0, 9.0, 0.0, 10), ("a", 1, 0, 0, 0, 8.0, 0.0, 100), ("b", 1, 1, 0, 0, 7.0, 0.0, 5), ("c", 2, 2, 0, 0, 6.0, 0.0, 5)],
        columns=["key", "level", "nx", "ny", "nz", "sse", "distance", "point_count"],
    )
    assert selection.best_first(rows, 1.0, 50)["key"].tolist() == ["r", "b", "c"]
    assert selection.best_first(rows, 7.5, 500)["key"].tolist() == ["r", "a", "b"]


def test_strides():
    rows = pd.DataFrame({"idx": [0, 1, 2], "n": [800, 800, 800], "distance": [1.0, 2.0, 3.0]})
    assert selection.strides_within_budget(rows, 1200)["stride"].tolist() == [1, 4, 4]
    assert selection.strides_within_budget(rows, 100)["stride"].tolist() == [8, 8, 8]


def test_residency():
    held = selection.Residency([])
    assert held.step([("a", 5), ("b", 5), ("c", 5)], 12, 2) == (["a", "b"], [])
    assert held.step([("c", 5), ("b", 5)], 12, 2) == (["c"], ["a"])


def test_loops():
    edges = pd.DataFrame([(0, 1), (1, 2), (0, 2), (5, 6), (6, 7), (5, 7)], columns=["lo", "hi"])
    out = mesh.walk_loops(edges)
    assert out.groupby("loop")["vertex"].apply(list).tolist() == [[0, 1, 2], [5, 6, 7]] and out["closed"].all()


def test_commands_replay(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, "c", 7)], "k int, name string, v int")
    commands = spark.createDataFrame([(1, 1, "set", "x", None), (2, 1, "set", None, 9), (3, 2, "delete", None, None)], "seq int, k int, op string, name string, v int")
    assert sorted(map(tuple, project.replay(rows, commands, "k", ["name", "v"]).collect())) == [(1, "x", 9), (3, "c", 7)]


def test_reports_merge(spark):
    df = spark.createDataFrame([("o", {"a": 1, "b": 2}), ("o", {"a": 3})], "owner_id string, counts map<string,bigint>")
    assert project.merge_reports(df).collect()[0].counts == {"a": 4, "b": 2}


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).collect()[0].v
    for n, label in ((0, "0"), (999, "999"), (1234, "1.2K"), (999_499, "999K"), (999_500, "1M"), (1_250_000, "1.3M"), (12_000_000, "12M")):
        assert one(text.compact(F.lit(n))) == label
    for n, label in ((5, "5 B"), (1536, "1.5 KB"), (200 * 1024, "200 KB"), (-1, "--")):
        assert one(text.byte_size(F.lit(n))) == label
    v = one(text.numbers(F.lit(" 1 2.50 x 3.125\n")))
    assert (v["values"], v.max_decimals, v.bad) == ([1.0, 2.5, 3.125], 3, 1)
    assert one(text.decode_entities(F.lit("&lt;a&gt; &amp;amp;"))) == "<a> &amp;"
    assert one(las.unit_from_text(F.lit("US survey foot"))) == "usSurveyFoot"
    c = one(las.terrain_color(F.lit(0.33)))
    assert (c.r, c.g, c.b) == (0, 200, 0)


def test_regions(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 3.0), (0.0, 10.0)]
    area = lambda t, p: abs(regions.signed_area([p[k] for k in t]))
    assert math.isclose(sum(area(t, ring) for t in regions.ear_clip(ring)), abs(regions.signed_area(ring)))
    assert len(spark.range(1).select(regions.grid_points((0, 0), (10, 10), 5.0).alias("g")).collect()[0].g) == 4


def test_terrain(spark):
    v, f = terrain.vertices(spark, 65, 7), terrain.faces(spark, 65)
    rows, told = {r.vertex_id: r for r in v.collect()}, sorted(f.collect(), key=lambda r: r.face_id)
    assert len(rows) == 64 and len(told) == 98 and [r.face_id for r in told] == list(range(98)) and {r.source_id - k for k, r in rows.items()} == {1}
    assert (rows[0].x, rows[0].y) == (3_507_500.0, 1_508_500.0) and (rows[63].x, rows[63].y) == pytest.approx((3_512_500.0, 1_513_500.0)) and rows[8].x == rows[0].x
    at = lambda k: (rows[k].x, rows[k].y)
    areas = [regions.signed_area([at(r.a), at(r.b), at(r.c)]) for r in told]
    assert min(areas) > 0 and math.isclose(sum(areas), 5000.0**2)
    assert len({r.z for r in rows.values()}) > 60 and max(abs(r.z - 4190) for r in rows.values()) <= 120
    assert {r.vertex_id: r.z for r in v.repartition(5).collect()} == {k: r.z for k, r in rows.items()}
    assert {r.z for r in terrain.vertices(spark, 65, 8).collect()} != {r.z for r in rows.values()}
    assert terrain.vertices(spark, 0).count() == 4 and terrain.faces(spark, 0).count() == 2


def test_smoothing_stream(spark, tmp_path):
    rows = [(k % 2, k * 100, k, float(k)) for k in range(20)]
    schema = "track long, ts_ms long, seq long, z double"
    for part in (rows[:10], rows[10:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(f"{tmp_path}/in")
    q = state.follow_ground(events).writeStream.format("memory").queryName("levels").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got, level, last = {r.seq: r.level for r in spark.table("levels").collect()}, {}, {}
    for track, ts, seq, z in rows:
        level[track] = state.smooth(level.get(track), z, ts - last.get(track, ts))
        last[track] = ts
        assert math.isclose(got[seq], level[track])


def test_residency_stream(spark, tmp_path):
    rows = [(1, t, p, k, 5) for t, keys in enumerate(("ab", "bc", "cd")) for p, k in enumerate(keys)]
    schema = "viewer long, tick long, priority long, key string, points long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    told = state.tile_residency(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 10)
    q = told.writeStream.format("memory").queryName("tiles").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.tick, r.action, r.key) for r in spark.table("tiles").collect())
    assert got == [(0, "fetch", "a"), (0, "fetch", "b"), (1, "evict", "a"), (1, "fetch", "c"), (2, "evict", "b"), (2, "fetch", "d")]


def test_octree_store(spark, tmp_path):
    i = F.col("id")
    df = spark.range(3000).select(i.alias("idx"), *[(i * k % m * 0.01).alias(d) for d, k, m in (("x", 7919, 100000), ("y", 104729, 100000), ("z", 1299709, 20000))])
    low, high, folder = (0.0,) * 3, (1000.0,) * 3, tmp_path.as_uri() + "/index"
    owned = octree.own(df, low, high, 64, 12)
    with pytest.raises(FileNotFoundError):
        octree.read_manifest(spark, folder)
    with pytest.raises(ValueError):
        octree.write_index(owned, folder + "-short", low, high, 3001)
    with pytest.raises(FileNotFoundError):
        octree.read_nodes(spark, folder + "-short")
    octree.write_index(owned, folder, low, high, 3000, source="cloud")
    with pytest.raises(FileExistsError):
        octree.write_index(owned, folder, low, high, 3000)
    assert octree.read_manifest(spark, folder)["point_count"] == 3000
    stored = octree.read_points(spark, folder).select("idx", "x", "y", "z")
    assert {r.n for r in listing.bag_difference(df, stored).collect()} == {0}
    box = ((100.0, 50.0, 0.0), (400.0, 700.0, 90.0))
    got = octree.read_points(spark, folder, *box)
    inside = df.filter(" AND ".join(f"{d} BETWEEN {a} AND {b}" for d, a, b in zip("xyz", *box)))
    assert {r.idx for r in got.collect()} == {r.idx for r in inside.collect()} and inside.count() > 50
    assert octree.read_points(spark, folder, levels=(0, 1)).filter("level > 1").isEmpty()
    nodes = octree.read_nodes(spark, folder)
    assert nodes.agg(F.sum("point_count")).first()[0] == 3000 and selection.orphans(nodes).isEmpty()


def test_drafts_follow_their_states(spark):
    rng, names = random.Random(3), ("start", "place", "close", "confirm", "cancel")
    least = {"point": 1, "polyline": 2, "polygon": 3}
    rows, want = [], {}
    for d in range(60):
        mode = rng.choice(list(least))
        state, n = "idle", 0
        for k in range(rng.randint(0, 12) + 1):
            e = rng.choice(names)
            rows.append((d, k, mode, e))
            if e == "start" and state in ("idle", "complete", "cancelled"):
                state, n = "placing", 0
            elif e == "place" and state in ("placing", "adding"):
                state, n = ("complete" if mode == "point" else "adding"), n + 1
            elif e == "close" and state == "adding" and n >= least[mode]:
                state = "closing"
            elif e == "confirm" and state == "closing":
                state = "complete"
            elif e == "cancel" and state in ("placing", "adding", "closing"):
                state, n = "cancelled", 0
        want[d] = (state, n)
    out = editing.drafts(spark.createDataFrame(rows, "draft long, seq long, mode string, event string")).collect()
    assert {r.draft: (r.state, r.vertices) for r in out} == want


def test_moves_undo_by_their_inverse(spark):
    vertices = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 9.0, 0.0, 0.0), (2, 0.0, 9.0, 0.0), (3, 9.0, 9.0, 0.0)], "vertex_id long, x double, y double, z double")
    faces = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 3, 2)], "face_id long, a long, b long, c long")
    moves = spark.createDataFrame([(0, 1.0, 1.0), (1, -5.0, 12.0), (3, 4.5, 4.5)], "vertex_id long, x double, y double")
    judged = editing.blocked_moves(faces, vertices, moves)
    assert {r.vertex_id: r.blocked for r in judged.collect()} == {0: False, 1: True, 3: True}
    after, commands = editing.apply_moves(vertices, judged)
    assert {r.vertex_id: (r.x, r.y) for r in after.collect()} == {0: (1.0, 1.0), 1: (9.0, 0.0), 2: (0.0, 9.0), 3: (9.0, 9.0)}
    back = editing.inverse(commands).select("vertex_id", F.col("to_x").alias("x"), F.col("to_y").alias("y"), F.lit(False).alias("blocked"))
    assert sorted(editing.apply_moves(after, back)[0].collect()) == sorted(vertices.collect())
    e = {(r.lo, r.hi): (r.first, r.second) for r in editing.edge_faces(faces).collect()}
    assert e[1, 2] == (0, 1) and e[0, 1] == (0, None)
    s = editing.edge_swaps(faces, vertices).collect()
    assert len(s) == 1 and {s[0].a1, s[0].a2, s[0].a3} == {0, 3, 1} and {s[0].b1, s[0].b2, s[0].b3} == {0, 3, 2}
    hits = spark.createDataFrame([(7, 0, 4.0, 0.5, 0.0), (8, 0, 0.2, 3.0, 0.0)], "hit_id long, face_id long, x double, y double, z double")
    assert {r.hit_id: (r.from_id, r.to_id, r.distance) for r in editing.nearest_edges(hits, faces, vertices).collect()} == {7: (0, 1, 0.5), 8: (2, 0, 0.2)}


def test_regions_within_budgets(spark):
    rng = random.Random(5)
    rows, cells = [], [(0, 0, 0, 0)]
    while cells:
        level, *n = cells.pop(0)
        size = 1000.0 / 2**level
        count = rng.randint(1, 90)
        rows.append(("c", "-".join(map(str, (level, *n))), level, *n, count, *[v * size for v in n], *[(v + 1) * size for v in n]))
        if level < 3:
            cells += [(level + 1, *(2 * v + (k >> i & 1) for i, v in enumerate(n))) for k in range(8) if rng.random() < 0.5]
    names = ["cloud", "key", "level", "nx", "ny", "nz", "point_count", *selection.BOX]
    nodes = spark.createDataFrame(rows, names)
    low, high, budget = (100.0, 100.0), (700.0, 600.0), 400
    by_key = {r[2:6]: r for r in rows}
    queue, told, used, limited = [(0, 0, 0, 0)], [], 0, False
    while queue:
        r = by_key.get(queue.pop(0))
        if r is None or r[10] < low[0] or r[7] > high[0] or r[11] < low[1] or r[8] > high[1]:
            continue
        if used + r[6] > budget:
            limited = True
            continue
        used += r[6]
        told.append(r[1])
        level, *n = r[2:6]
        queue += [(level + 1, *(2 * v + (k >> i & 1) for i, v in enumerate(n))) for k in range(8)]
    out = selection.region_within_budget(nodes, low, high, budget).orderBy("seq").collect()
    assert [r.key for r in out] == told and out[0].limited == limited
    asked = spark.createDataFrame([("c", 1, *low, *high, budget), ("c", 2, 2000.0, 2000.0, 2100.0, 2100.0, 1)], "cloud string, region long, lx double, ly double, hx double, hy double, budget long")
    parts = [r for r in selection.sectors(nodes, asked, 8).collect() if r.region == 1]
    assert 1 < len(parts) <= 8
    assert sum((r.max_x - r.min_x) * (r.max_y - r.min_y) for r in parts) == pytest.approx(600 * 500)
    assert [(r.sector, r.points) for r in selection.sectors(nodes, asked.filter("region = 2"), 8).collect()] == [("2:", 0)]


def test_edges_of_a_concave_ring(spark):
    corners = [(0, 0), (60, 5), (45, 30), (70, 80), (30, 50), (5, 75)]
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    def inside(p):
        hits = 0
        for a, b in zip(corners, corners[1:] + corners[:1]):
            if turn(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1]):
                return True
            hits += (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]
        return hits % 2 == 1

    want = {}
    for i in range(6):
        for j in range(i):
            steps = [tuple(corners[i][d] + (corners[j][d] - corners[i][d]) * t / 997 for d in (0, 1)) for t in range(1, 997)]
            want[i, j] = (i - j) in (1, 5) or all(map(inside, steps))
    rows = more.edges_within_work_areas(spark, SF).filter("polygon_id <= 3").collect()
    assert rows and all(r.allowed == want[r.i, r.j] for r in rows)


def star(rng, n, wide):
    """A concave ring around the origin."""
    return [(wide * (r := rng.uniform(0.3, 1)) * math.cos(a), wide * r * math.sin(a)) for a in sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))]


def test_regions_are_covered(spark):
    from plumbline.operators import triangulation

    rng = random.Random(11)
    rings = {k: star(rng, 5 + 6 * k, 10.0 * (k + 1)) for k in range(6)}
    rings[6] = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    rings[7] = [(0.0, 0.0), (30.0, 0.0), (30.0, 9.0), (20.0, 9.0), (20.0, 3.0), (18.0, 3.0), (18.0, 9.0), (10.0, 9.0), (10.0, 2.0), (9.0, 2.0), (9.0, 9.0), (0.0, 9.0)][::-1]
    rings[8] = [(0.0, 0.0), (1.0, 1.0)]
    inner = {}
    for k, ring in rings.items():
        wide = max(abs(v) for p in ring for v in p)
        inner[k] = [(rng.uniform(-wide, wide), rng.uniform(-wide, wide)) for _ in range(400)] + [(float(i), float(j)) for i in range(10) for j in range(10)] + [(3.0, 4.0)] * 5 + [ring[0]]
    r = spark.createDataFrame([(k, i, *p) for k, ring in rings.items() for i, p in enumerate(ring)], "region long, seq int, x double, y double").repartition(3)
    p = spark.createDataFrame([(k, *q) for k, qs in inner.items() for q in qs if k != 5], "region long, x double, y double").repartition(3)
    for strip_points in (10_000, 120):
        out = triangulation.region_triangles(r, p, strip_points).collect()
        for k, ring in rings.items():
            mine = [((t.x1, t.y1), (t.x2, t.y2), (t.x3, t.y3), t.strip) for t in out if t.region == k]
            if k == 8:
                assert not mine
                continue
            assert (len({t[3] for t in mine}) > 2) == (strip_points < 1000 and k != 5)
            areas = [regions.signed_area(list(t[:3])) for t in mine]
            assert min(areas) > -1e-9 and math.isclose(sum(areas), abs(regions.signed_area(ring)), rel_tol=1e-9)
            edges = {}
            for t in mine:  # triangles meet edge to edge
                for a, b in zip(t[:3], t[1:3] + t[:1]):
                    edges[a, b] = edges.get((a, b), 0) + 1
            assert set(edges.values()) == {1}
            want = {q for q in inner[k] if regions.inside(q, ring, 0.0)} if k != 5 else set()
            corners = {c for t in mine for c in t[:3]}
            away = lambda q: min(math.dist(q, c) for c in corners)
            assert all(q in corners or away(q) <= 2e-6 for q in want | set(ring))
            if strip_points == 10_000:  # no point in the circle of a triangle, unless the ring lies between
                border = {frozenset((tuple(a), tuple(b))) for a, b in zip(ring, ring[1:] + ring[:1])}
                apex = {(a, b): c for t in mine for a, b, c in (t[:3], (t[1], t[2], t[0]), (t[2], t[0], t[1]))}
                for (a, b), c in apex.items():
                    d = apex.get((b, a))
                    if d and frozenset((a, b)) not in border and triangulation._cross(a, d, c) > 1e-9 and triangulation._cross(d, b, c) > 1e-9:
                        assert not triangulation._in_circle(a, b, c, d) or len(ring) > 4


def test_strips_meet_at_their_seams():
    from plumbline.operators import triangulation

    rng = random.Random(12)
    for n in (3, 4, 9, 40):
        ring = star(rng, n, 50.0)
        seams = sorted(rng.uniform(-45, 45) for _ in range(5)) + [ring[0][0]]
        seams.sort()
        found = [list(triangulation.cover(ring, [(rng.uniform(-50, 50), rng.uniform(-50, 50)) for _ in range(50)], seams, k)) for k in range(len(seams) + 1)]
        assert math.isclose(sum(regions.signed_area(list(t)) for f in found for t in f), abs(regions.signed_area(ring)), rel_tol=1e-9)
        for s in seams[:5]:  # one side's edges on a seam are the other's
            on = [{frozenset((a, b)) for t in f for a, b in zip(t, t[1:] + t[:1]) if a[0] == s and b[0] == s} for f in found]
            met = [e for e in on if e]
            assert not met or (len(met) == 2 and met[0] == met[1])


def test_outline_of_a_polygon(spark):
    from plumbline.functions import geometry as geo

    rows = [(0.0, 1.0), (2.0, 2.0), (1.0, 1.0), (1.0, -1e-8), (1.0, -1e-5), (2.0 + 1e-8, 1.0), (3.0, 1.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    told = lambda eps: [r[0] for r in df.select(geo.in_polygon_or_boundary(F.col("x"), F.col("y"), square, eps)).collect()]
    assert told(1e-6) == [True, True, True, True, False, True, False]
    assert told(1e-9) == [True, True, True, False, False, False, False]
    assert told(1e-6)[:1] == [r[0] for r in df.limit(1).select(geo.on_segment((F.lit(0.0), F.lit(0.0)), (F.lit(0.0), F.lit(2.0)), (F.col("x"), F.col("y")))).collect()]


def test_preview_octrees_against_a_walk(spark):
    from plumbline.operators import preview

    rng = random.Random(3)
    rows = []
    for cloud, (wide, high, n) in enumerate([(100.0, 7.0, 900), (0.003, 0.001, 400), (50.0, 0.0, 1), (10.0, 10.0, 300)]):
        for k in range(n):
            same = cloud == 3 and k % 2
            rows.append((cloud, k, 3.0 if same else rng.random() * wide, 3.0 if same else rng.random() * wide, rng.choice([0.0, rng.random()]) * high, k % 5, k % 3, 2 + k % 2))
    df = spark.createDataFrame(rows, "cloud long, idx long, x double, y double, z double, classification int, return_number int, number_of_returns int").repartition(5)
    nodes, sample = preview.build(df, "all-detail", 20)
    want_nodes, want_sample, depths = set(), set(), {}
    for cloud in range(4):
        own = [r for r in rows if r[0] == cloud]
        low = [min(r[2 + d] for r in own) for d in range(3)]
        high = [max(r[2 + d] for r in own) for d in range(3)]
        count = 0

        def walk(points, lo, hi, level, path):
            nonlocal count
            children = []
            if len(points) > 20 and level < 7 and max(b - a for a, b in zip(lo, hi)) > 0.001:
                mid = [(a + b) / 2 for a, b in zip(lo, hi)]
                for octant in range(8):
                    up = [octant >> d & 1 for d in range(3)]
                    inside = [r for r in points if all((r[2 + d] >= mid[d]) == bool(up[d]) for d in range(3))]
                    if inside:
                        children.append(walk(inside, [m if u else a for m, u, a in zip(mid, up, lo)], [b if u else m for m, u, b in zip(mid, up, hi)], level + 1, path * 8 + octant))
            count += 1
            mine = count
            found = [(mine, level, path, len(points), not children)]
            for c in children:
                found += [(*c[0], mine)] + c[1:]
            if not children:
                stride = max(1, 64 >> level)
                want_sample.update((cloud, mine, r[1]) for r in [r for r in points if r[1] % stride == 0][:200_000])
            return found

        tree = walk(own, low, high, 0, 0)
        want_nodes.update((cloud, *(t if len(t) == 6 else (*t, None))) for t in tree)
        depths[cloud] = max(t[1] for t in tree)
    got = {(r.cloud, r.id, r.level, r.node, r.point_count, r.leaf, r.parent_id) for r in nodes.collect()}
    assert got == want_nodes and max(depths.values()) == 7
    assert {(r.cloud, r.id, r.idx) for r in sample.collect()} == want_sample
    told = {r.cloud: r for r in preview.summary(nodes, sample).collect()}
    assert {c: r.max_depth for c, r in told.items()} == depths and told[0].returns == [1, 2] and told[2].sampled == 1 and told[2].classes == [0]
    assert preview.build(df.limit(0))[0].count() == 0


def test_rays_that_graze_their_boxes(spark):
    from plumbline.operators import extents, rays

    names = "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double, reach double"
    asked = spark.createDataFrame([
        (1, -5.0, 0.5, 0.5, 1.0, 0.0, 0.0, 100.0), (2, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 9.0), (3, None, 0.0, 0.0, 1.0, 0.0, 0.0, 9.0), (4, 2.0, 2.0, 9.0, 0.0, 0.0, -1.0, 20.0),
        (5, 2.0, 2.0, 9.0, 0.0, 0.0, -1.0, 3.0), (6, 0.0, 11.0, 0.0, 1.0, 0.0, 0.0, 50.0), (7, -1.0, -1.0, -1.0, 1.0, 1.0, 1.0, 50.0),
    ], names)
    cloud = [(k, float(k % 11), float(k // 11 % 11), float(k // 121), k % 3) for k in range(1331)]
    points = spark.createDataFrame(cloud, "idx long, x double, y double, z double, source long")
    for radius, cell in ((0.75, 1.0), (1.2, 0.7), (0.3, 4.0)):
        got = {(r.ray_id, r.source, r["rank"]): r.idx for r in rays.cloud_hits(asked, points, cell, radius, most=5).collect()}
        want = {}
        for ray in asked.collect():
            o, d = (ray.ox, ray.oy, ray.oz), (ray.dx, ray.dy, ray.dz)
            size = sum(v * v for v in d)
            if None in o or not size:
                continue
            for source in range(3):
                met = []
                for idx, x, y, z, s in cloud:
                    p = (x - o[0], y - o[1], z - o[2])
                    t = sum(a * b for a, b in zip(p, d)) / size
                    away = math.sqrt(sum((a - t * b) ** 2 for a, b in zip(p, d)))
                    if s == source and 0 <= t <= ray.reach and away <= radius:
                        met.append((t, away, idx))
                want |= {(ray.ray_id, source, k): m[2] for k, m in enumerate(sorted(met)[:5], 1)}
        assert got == want
    flat = spark.createDataFrame([(0, 7, 0.0, 0.0, 2.0, 4.0, 0.0, 2.0, 0.0, 4.0, 2.0), (1, 8, 0.0, 0.0, 5.0, 4.0, 0.0, 5.0, 0.0, 4.0, 5.0)], "surface long, face_id long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    hits = {r.ray_id: (r.surface, r.z) for r in rays.surface_hits(asked, flat, 2.5).collect()}
    assert hits == {4: (1, 5.0), 7: (0, 2.0)}
    assert rays.surface_hits(asked, flat.limit(0), 1.0).count() == 0 and rays.cloud_hits(asked, points.limit(0), 1.0, 1.0).count() == 0
    # pointers on a screen
    vertices = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 10.0, 10.0), (2, 0.0, 0.0, 0.0, 21.0, 10.0), (3, 0.0, 0.0, 0.0, None, None)], "feature_id long, x double, y double, z double, sx double, sy double")
    edges = spark.createDataFrame([(9, 0.0, 0.0, 0.0, 10.0, 0.0, 5.0, -100.0, 12.0, 100.0, 12.0)], "feature_id long, ax double, ay double, az double, bx double, by double, bz double, asx double, asy double, bsx double, bsy double")
    pointers = spark.createDataFrame([(0, 11.0, 11.0), (1, 150.0, 12.0), (2, 20.0, 30.0)], "pointer_id long, px double, py double")
    found = {(r.pointer_id, r.kind, r.feature_id): (r.x, r.z, r.sx) for r in rays.feature_candidates(pointers, vertices, edges, 5.0).collect()}
    assert set(found) == {(0, "authored-vertex", 1), (0, "authored-vertex", 2), (0, "authored-edge", 9)}
    x, z, sx = found[0, "authored-edge", 9]
    assert abs(x - 5.55) < 1e-9 and abs(z - 2.775) < 1e-9 and abs(sx - 11) < 1e-9
    rng = random.Random(8)
    box = lambda k: (k, (x := rng.randint(-40, 40) / 2), (y := rng.randint(-40, 40) / 2), x + rng.choice([0, 0.5, 3, 50, 1000]), y + rng.choice([0, 1, 7, 300]))
    a, b = [box(k) for k in range(80)], [box(k) for k in range(60)]
    odd = [(900, None, 0.0, 1.0, 1.0), (901, 5.0, 5.0, 4.0, 9.0)]
    schema = "k long, min_x double, min_y double, max_x double, max_y double"
    left, right = spark.createDataFrame(a + odd, schema), spark.createDataFrame(b + odd, schema).withColumn("_l", F.lit(1))
    pairs = [(r[0], r[1]) for r in extents.meeting(left, right, 1.5).select("l.k", F.col("r.k").alias("j")).collect()]
    want = {(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2]}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    assert extents.meeting(left.limit(0), right, 1.0).count() == 0


def test_shapes_of_all_records(spark):
    import json

    from plumbline.operators import opening

    dated, owned = {"createdAt": "t", "modifiedAt": "t"}, {"id": "a", "simulationId": "s"}
    box = {f"{m}{d}": 1.5 for m in ("min", "max") for d in "XYZ"}
    surfel = {"sourceAssetId": "c", "indexAssetId": None, "surfelType": "analytic-surfel-octree", "surfelVersion": 2, "surfelCellScale": 0.5, "source": {"headerSha256": "h", "fileSize": 0, "mtimeMs": 7.5},
              "surfelCount": 3, "bounds": box, "generatedAt": "t", "generator": {"name": "plumbline", "version": "1"}}
    cloud = {"format": "las", "extension": ".las", "fileSize": 1, "pointCount": 2, "lasVersion": "1.4", "pointFormat": 7, "pointRecordLength": 36, "bounds": box, "scale": [0.1, 0.1, 1], "offset": [0, 0, 0], "crsText": None,
             "unitsLinear": "foot", "unitsRaw": "ft", "headerSha256": "h"}
    evidence = {"kind": "asset-point", "coordinate": [1, 2.5, 3], "sourceRGB": [1, 2, 3], "sourceClass": 2}
    good = {
        "assets": {"id": "a", "name": "n", "kind": "point-cloud", "truthStatus": "x", "importPolicy": "copy", "sourcePath": None, "managedPath": "", "units": "ft", "warnings": ["", "w"], "hashes": {}, "pointCloud": cloud, "analyticSurfel": surfel},
        "simulationLayers": owned | {"name": "n", "status": "active", "assetId": None} | dated,
        "features": owned | {"type": "marker", "name": "n", "geometry": {"x": 1}, "evidenceRefs": [evidence, evidence], "parentFeatureId": None} | dated,
        "exclusionZones": owned | {"featureId": "f", "polygon": [[0, 0, 0], [1, 0, 0], [0, 1.5, 0]]} | dated,
        "reviewFlags": owned | {"severity": "low", "message": "m", "status": "open"} | dated,
        "comparisonRefs": owned | {"name": "n", "target": "t"} | dated, "analysisResults": owned | {"name": "n", "summary": "t"} | dated,
    }
    assert set(good) == set(project_source.LISTS) == set(opening.SHAPES)
    bad = {
        "assets": [("importPolicy", "move", "not-allowed"), ("warnings", ["ok", 5], "wrong-type"), ("hashes", None, "wrong-type"), ("sourcePath", 5, "wrong-type"), ("name", "", "empty"), ("units", ..., "missing")],
        "features": [("type", "blob", "not-allowed"), ("evidenceRefs", [evidence | {"coordinate": [1, 2]}], "wrong-length"), ("evidenceRefs", [5], "wrong-type"), ("parentFeatureId", 5, "wrong-type")],
        "exclusionZones": [("polygon", [[0, 0, 0], [1, 1, 1]], "wrong-length"), ("polygon", [[0, 0, 0], [1, 1, "x"], [1, 1, 1]], "wrong-type")],
        "simulationLayers": [("assetId", ..., "missing")],
    }
    for name, record in good.items():
        rows, want = [("good", json.dumps(record)), ("extra", json.dumps(record | {"unknown": [1]})), ("null", "null"), ("list", "[1]"), ("torn", "{")], {("null", "not-object"), ("list", "not-object"), ("torn", "not-json")}
        for k, (field, value, issue) in enumerate(bad.get(name, [])):
            rows.append((f"b{k}", json.dumps({f: v for f, v in (record | {field: value}).items() if v is not ...})))
            want.add((f"b{k}", issue))
        found = opening.shape_issues(spark.createDataFrame(rows, "id string, record string"), opening.SHAPES[name]).collect()
        assert {(r.id, r.issue) for r in found} == want
        assert all(r.path.startswith(bad[name][int(r.id[1:])][0]) for r in found if r.id[0] == "b")
    deep = [("v3", surfel | {"surfelVersion": 3}, "surfelVersion"), ("scale", surfel | {"surfelCellScale": 0}, "surfelCellScale"), ("print", surfel | {"source": {"headerSha256": "", "fileSize": 0, "mtimeMs": None}}, "source.headerSha256")]
    found = opening.shape_issues(spark.createDataFrame([(k, json.dumps(v)) for k, v, _ in deep], "id string, record string"), opening.SURFEL).collect()
    assert {(r.id, r.path) for r in found} == {(k, p) for k, _, p in deep}
    plane = {k: [0, 0, 1] for k in ("origin", "normal", "xAxis", "yAxis")}
    face = {"id": "f", "name": "", "kind": "wall", "plane": plane, "extents": {"minU": 0, "maxU": 1, "minV": 0, "maxV": 2.5}}
    door = {"id": "d", "faceId": "f", "type": "door", "offsetU": 0, "offsetV": 0, "width": 1, "height": 2, "depth": 0.1}
    rows = [("face", json.dumps(face)), ("flat", json.dumps(face | {"plane": plane | {"normal": [0, 0]}})), ("floor", json.dumps(face | {"kind": "floor"}))]
    assert {(r.id, r.path) for r in opening.shape_issues(spark.createDataFrame(rows, "id string, record string"), opening.COMPONENTS["face"]).collect()} == {("flat", "plane.normal"), ("floor", "kind")}
    rows = [("door", json.dumps(door)), ("wide", json.dumps(door | {"width": "1"}))]
    assert {(r.id, r.path, r.issue) for r in opening.shape_issues(spark.createDataFrame(rows, "id string, record string"), opening.COMPONENTS["feature"]).collect()} == {("wide", "width", "wrong-type")}


def test_edits_of_buildings(spark):
    from plumbline.operators import components

    rng = random.Random(21)
    buildings, edits = [], []
    for b in range(12):
        faces = [(f"f{k}", f"n{k}", "wall") for k in range(rng.randint(0, 3))]
        buildings.append((b, faces, [(f"h{k}", f"f{k % 3}", "door", 1.0) for k in range(2) if k < len(faces)]))
        for seq in range(rng.randint(0, 30)):
            part, op = rng.choice(["face", "hosted"]), rng.choice(["add", "update", "update", "delete"])
            one = f"{part[0]}{rng.randint(0, 3)}"
            some = lambda v: v if op == "add" or rng.random() < 0.5 else None  # noqa: E731, B023
            face = part == "face"
            edits.append((b, seq, op, part, one, f"f{rng.randint(0, 3)}" if op == "add" and not face else None, some(f"n{seq}") if face else None, some(rng.choice(["wall", "roof"])) if face else None, some("vent") if not face else None, some(float(seq)) if not face else None))
    edits.append((99, 0, "add", "face", "f0", None, "n", "wall", None, None))
    df = spark.createDataFrame(buildings, f"building_id long, faces array<struct<id:string,name:string,kind:string>>, hosted array<struct<id:string,face_id:string,type:string,width:double>>")
    log = spark.createDataFrame(edits, "building_id long, seq long, op string, part string, id string, face_id string, name string, kind string, type string, width double").repartition(4)
    want = {}
    for b, faces, hosted in buildings:
        held = {"face": {f[0]: [None, f[1], f[2], None, None] for f in faces}, "hosted": {h[0]: [h[1], None, None, h[2], h[3]] for h in hosted}}
        for _, _, op, part, one, *values in sorted((e for e in edits if e[0] == b), key=lambda e: e[1]):
            mine = held[part]
            if op == "add":
                mine.pop(one, None)
                mine[one] = list(values)
            elif op == "update" and one in mine:
                mine[one] = [v if v is not None else w for v, w in zip(values, mine[one])]
            elif op == "delete":
                mine.pop(one, None)
                if part == "face":
                    held["hosted"] = {k: v for k, v in held["hosted"].items() if v[0] != one}
        there = held["face"]
        want[b] = ([(k, v[1], v[2]) for k, v in there.items()], [(k, v[0], v[3], v[4]) for k, v in held["hosted"].items() if v[0] in there])
    got = {r.building_id: ([tuple(f) for f in r.faces], [tuple(h) for h in r.hosted]) for r in components.edited(df, log).collect()}
    assert got == want and any(h for _, h in want.values())
