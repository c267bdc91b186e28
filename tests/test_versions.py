"""Numbers in groups, created features, and versions with their conflicts."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import creation, numbering, octree, solids
from plumbline.sources import versions


def test_numbers_within_hot_null_and_small_groups(spark):
    rows = [(None if k % 5 == 0 else "a" if k % 5 < 4 else f"g{k}", (k * 7919) % 1000, k) for k in range(1000)]
    got = numbering.numbered(spark.createDataFrame(rows, "g string, seq int, k int"), ["seq", "k"], "g").collect()
    assert len(got) == 1000
    groups = {}
    for g, seq, k in rows:
        groups.setdefault(g, []).append((seq, k))
    want = {k: i + 1 for v in groups.values() for i, (_, k) in enumerate(sorted(v))}
    assert {r.k: r.number for r in got} == want
    assert numbering.numbered(spark.createDataFrame([], "g string, seq int"), ["seq"], "g").count() == 0


DRAFT = f"draft_id int, simulation_id string, family string, subtype string, template_id string, geometry string, seq int, vertices array<{solids.POINT}>, evidence array<string>, at string"


def test_created_features(spark):
    at = lambda n: [(float(k), 0.0, 0.0) for k in range(n)]
    drafts = spark.createDataFrame(
        [
            (1, "s", "region", "lawn", "region.lawn", "polyline", 5, at(3), ["a", "b", "c"], "t"), (2, "s", "region", "lawn", None, "polygon", 4, at(4), None, "t"), (3, "s", "region", "lawn", None, "polygon", 3, at(2), [], "t"),
            (4, "s", "building", "envelope", "b", "polygon", 1, at(4), ["a"], "t"), (5, "s", "building", "flat", "b", "polygon", 2, at(4), ["a"], "t"), (6, "s", "object", "box", "o", "point", 1, at(1), ["a"], "t"),
            (7, "s", "object", "box", "?", "point", 2, at(1), ["a"], "t"), (8, "s", "utility", "pipe", "u", "polyline", 1, at(2), [], "t"), (9, "s", "line", "curb", "l", "polyline", 1, at(2), [], "t"), (13, "s", "utility", "pole", "?", "point", 2, at(1), [], "t"), (10, "s", "line", "curb", "l", "polyline", 2, at(1), [], "t"),
            (11, "s", "marker", "note", None, "point", 1, None, [], "t"), (12, "r", "marker", "note", None, "point", 1, at(1), [], "t"),
        ],
        DRAFT,
    )
    features = spark.createDataFrame([("s", "region"), ("s", "region"), ("r", "region"), ("s", "object")], "simulation_id string, family string")
    templates = spark.createDataFrame(
        [("region.lawn", None, None, {"verticalScale": "0"}), ("b", None, None, {}), ("o", "Box", None, {"width": "6"}), ("u", "Pipe", "Storm", {}), ("l", None, None, {"breaklineType": "x", "k": "v"})],
        "template_id string, display_name string, system string, params map<string, string>",
    )
    made, zones = creation.create(drafts, features, templates)
    got = {r.feature_id: r for r in made.collect()}
    assert {k: r.name for k, r in got.items()} == {
        "feat-2": "Region 3 (lawn)", "feat-1": "Region 4 (lawn)", "feat-4": "Building 1 (envelope)", "feat-5": "Building 2 (flat)", "feat-6": "Box 2", "feat-7": "Object 3", "feat-8": "Storm Pipe 1", "feat-13": "Utility Utility 2",
        "feat-9": "Line 1 (curb)", "feat-12": "Marker 1 (note)",
    }
    assert got["feat-1"].evidence_refs == [] and got["feat-1"].edge_evidence == ["a", "b", "c"] and got["feat-4"].evidence_refs == [] and got["feat-5"].evidence_refs == ["a"]
    assert got["feat-9"].parameters == {"breaklineType": "curb", "k": "v"} and got["feat-6"].parameters == {"width": "6"} and got["feat-7"].parameters == {}
    assert [got[k].type for k in ("feat-1", "feat-6", "feat-8")] == ["polyline", "marker", "polyline"]
    assert {(z.zone_id, z.feature_id, z.name, len(z.polygon)) for z in zones.collect()} == {("zone-4", "feat-4", "Building 1 (envelope) footprint", 4), ("zone-5", "feat-5", "Building 2 (flat) footprint", 4)}


def test_replaced_records(spark):
    rows, new = spark.createDataFrame([("a", 1), ("b", 1), (None, 1)], "id string, v int"), spark.createDataFrame([("b", 2), ("c", 2)], "id string, v int")
    assert {tuple(r) for r in creation.replaced(rows, new, "id").collect()} == {("a", 1), ("b", 2), ("c", 2), (None, 1)}


def test_of_two_writers_one_wins(spark, tmp_path):
    root = (tmp_path / "t").as_uri()
    assert versions.current(spark, root) == 0
    with pytest.raises(FileNotFoundError):
        versions.read(spark, root)
    assert versions.commit(spark.range(3), root, 0, "first") == 1
    before = versions.read(spark, root)
    assert versions.commit(before.union(spark.range(3, 5)), root, 1) == 2
    with pytest.raises(versions.Conflict):
        versions.commit(spark.range(9), root, 1)
    assert versions.current(spark, root) == 2 and before.count() == 3 and versions.read(spark, root).count() == 5 and versions.read(spark, root, 1).count() == 3
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2 and not [p for p in (tmp_path / "t" / "log").iterdir() if p.name.startswith("_")]
    assert versions.undo(spark, root, 2) == 3 and versions.read(spark, root).count() == 3
    assert versions.undo(spark, root, 3) == 4 and versions.read(spark, root).count() == 5
    with pytest.raises(versions.Conflict):
        versions.undo(spark, root, 3)
    assert [e["note"] for e in versions.entries(spark, root)] == ["first", "", "undo of 2", "undo of 3"]


def test_a_failed_build_leaves_the_last_version(spark, tmp_path):
    root, points = (tmp_path / "i").as_uri(), spark.range(50).select(F.col("id").alias("idx"), *[(F.col("id") % 7).cast("double").alias(d) for d in "xyz"])
    build = lambda at, n: octree.write_index(points.withColumns({k: F.lit(0) for k in octree.NODE if k not in points.columns}), at, (0.0,) * 3, (8.0,) * 3, n)
    check = lambda at: octree.read_manifest(spark, at)
    assert versions.swap(spark, root, lambda at: build(at, 50), check, 0) == 1
    with pytest.raises(ValueError):
        versions.swap(spark, root, lambda at: build(at, 51), check, 1)
    with pytest.raises(FileNotFoundError):
        versions.swap(spark, root, lambda at: spark.range(1).write.parquet(f"{at}/points"), check, 1)
    assert versions.current(spark, root) == 1 and octree.read_points(spark, versions.folder(spark, root)).count() == 50
    (tmp_path / "i" / "data" / "left").mkdir()
    assert versions.drop_unreferenced(spark, root) == 1
    assert versions.swap(spark, root, lambda at: build(at, 50), check, 1) == 2
