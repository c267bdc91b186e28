"""Queries against their SQL on small tables that the findings of round 4 are about."""

from datetime import datetime
from urllib.parse import urlparse

import duckdb
import pandas as pd
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from plumbline.llm import decontaminate
from plumbline.operators import preview, triangulation
from plumbline.sources.tables import materialize


def both(spark, folder, name, sql=None, **tables):
    """The rows of a query, sorted, and those of its SQL."""
    for table, rows in tables.items():
        spark.createDataFrame(*rows).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    found = entry.queries()[name](spark, str(folder))
    with duckdb.connect() as c:
        for table in tables:
            c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
        c.execute(f"CREATE TABLE o AS {sql or entry.oracle_sql()[name]}")
        told = c.execute(f"SELECT {', '.join(found.columns)} FROM o").fetchall()
    return sorted(map(tuple, found.collect())), sorted(told)


def test_ema_takes_milliseconds_as_rounded(spark, tmp_path):
    at = ["2024-01-17 05:31:18.618948", "2024-01-17 05:31:20.320454", "2024-01-17 05:31:20.3205", "2024-01-17 05:31:20.6215", "1969-12-31 23:59:59.9985", "1969-12-31 23:59:59.5"]
    rows = [(i, 1, t, 6.12 + 60 * i) for i, t in enumerate(map(datetime.fromisoformat, at))]
    found, told = both(spark, tmp_path, "ema_ground_follow", events=(rows, "event_id long, user_id long, ts timestamp_ntz, value double"))
    assert found == told


def test_disclosures_have_letters_up_to_m(spark, tmp_path):
    keys = [0, 1, 999, 1_111_499, 1_112_399, 8_999_999, 8_999_100, 8_999_099]
    found, told = both(spark, tmp_path, "area_disclosures", orders=([(k,) for k in keys], "o_orderkey long"))
    assert found == told
    assert any("M indexed" in line for _, line in found)


def test_byte_sizes_beyond_a_long(spark, tmp_path):
    keys = [0, 1, 10, 11, 101, 102, 1024, 2_097_151, 2_097_152, 3_037_500, 8_999_999]
    wide = entry.oracle_sql()["byte_size_label"].replace("CAST(o_orderkey AS BIGINT)", "CAST(o_orderkey AS HUGEINT)")
    found, told = both(spark, tmp_path, "byte_size_label", wide, orders=([(k,) for k in keys], "o_orderkey long"))
    assert found == told
    assert dict(found)[2_097_152] == "8388608 TB"


def keyed(n, name, step=1):
    return [(i * step,) for i in range(n)], f"{name} long"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pairs_met(spark, folder, name):
    """Rows that come out of the joins of a query, at most, as its stages count them."""
    df = entry.queries()[name](spark, str(folder))
    df.collect()
    stack, most = [df._jdf.queryExecution().executedPlan()], 0
    while stack:
        node = stack.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
        if "QueryStage" in node.nodeName():
            stack.append(node.plan())
        metrics = node.metrics()
        if "Join" in node.nodeName() and metrics.contains("numOutputRows"):
            most = max(most, metrics.apply("numOutputRows").value())
        stack += [node.children().apply(k) for k in range(node.children().size())]
    return most


def test_polygons_of_one_ring_are_counted_once(spark, tmp_path):
    # 1800 polygons of 900 rings and, beyond key 100 000, points at places of earlier ones
    points = [(i + k,) for i in range(0, 3000, 3) for k in (0, 100_000)]
    found, told = both(spark, tmp_path, "points_in_work_areas", customer=keyed(1800, "c_custkey"), orders=(points, "o_orderkey long"))
    assert found == told
    assert "Broadcast" not in plan(entry.queries()["points_in_work_areas"](spark, str(tmp_path)))
    pairs = sum(n for _, n, _ in told)
    assert 0 < pairs_met(spark, tmp_path, "points_in_work_areas") < pairs


def again(keys, by, name):
    """Keys, and as many more that are a period further on."""
    return [(k + j * by,) for k in keys for j in (0, 1)], f"{name} long"


#: Query, its tables, and a bound on the rows that a join may give, below the pairs that all rows would make.
LIKE = {
    "ground_ladder": ({"customer": again(range(40), 1000, "c_custkey"), "orders": again(range(0, 4000), 100_000, "o_orderkey")}, 10_000),
    "cursor_read_outs": ({"customer": again(range(60), 3000, "c_custkey"), "orders": again(range(0, 1200), 100_000, "o_orderkey")}, 4000),
    "crop_tile_masks": ({"customer": again(range(36), 36, "c_custkey")}, None),
    "ray_cloud_hits": ({"customer": again(range(60), 1000, "c_custkey"), "orders": ([(k + j * 100_000,) for k in range(0, 300, 3) for j in range(30)], "o_orderkey long")}, None),
    "meeting_extents": ({"customer": again(range(200), 63_000, "c_custkey"), "part": again(range(300), 1000, "p_partkey")}, None),
}


@pytest.mark.parametrize("name", LIKE)
def test_equal_rows_are_worked_on_once(spark, tmp_path, name):
    tables, most = LIKE[name]
    found, told = both(spark, tmp_path, name, **tables)
    assert found == told and told
    df = entry.queries()[name](spark, str(tmp_path))
    assert "Broadcast" not in plan(df)
    if most:
        assert 0 < pairs_met(spark, tmp_path, name) <= most


def test_preview_cells_are_not_broadcast(spark):
    counts = spark.createDataFrame([(0, 5, 10), (0, 6, 10), (0, 60, 1)], "cloud long, cell long, n long")
    of = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 8.0, 8.0, 8.0)], "cloud long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")
    nodes = preview.topology(counts, of, 15, 2)
    leaves = preview.leaf_of(counts, nodes, 2)
    assert "Broadcast" not in plan(nodes) + plan(leaves)
    assert sorted((r.cell, r.level) for r in leaves.collect()) == [(5, 2), (6, 2), (60, 1)]


def test_segments_are_held_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", 1)
    docs = spark.createDataFrame([(i, f"one two w{i} three") for i in range(40)], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([("a", "one two w7 three")], "item_id string, text string")
    # one task writes all segments here, as SEGMENT_BYTES is read where the function came from
    index = decontaminate.build_index(docs)
    rows = [pq.ParquetFile(urlparse(f).path) for f in index.inputFiles()]
    assert max(f.metadata.row_group(k).num_rows for f in rows for k in range(f.num_row_groups)) <= decontaminate.GROUP

    def sizes(found, slop):
        def run(batches):
            for b in batches:
                yield pd.DataFrame([("s", len(b), None, None)], columns=["segment", "doc", "hits", "items"])

        return run

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(decontaminate, "_search", sizes)
    many = index.unionByName(index).unionByName(index).coalesce(1)
    assert {r.doc for r in decontaminate.search(many, items).collect()} == {1}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_row_groups_of_materialized_frames(spark):
    held = materialize(spark.range(0, 30, 1, 1), "groups", parquet_block_row_count_limit=decontaminate.GROUP)
    files = [pq.ParquetFile(urlparse(f).path) for f in held.inputFiles()]
    assert max(f.metadata.row_group(k).num_rows for f in files for k in range(f.num_row_groups)) == decontaminate.GROUP


def test_small_regions_are_rows_of_a_batch(spark, tmp_path):
    tables = {"customer": keyed(60, "c_custkey"), "orders": keyed(600, "o_orderkey")}
    found, told = both(spark, tmp_path, "covered_regions", **tables)
    assert found == told
    k = [[(r, i, *p) for r in (1, 2) for i, p in enumerate(((0.0, 0.0), (9.0, 1.0), (8.0, 8.0), (4.0, 3.0), (1.0, 9.0)))], [(r, x + 0.1, y + 0.2) for r in (1, 2, 3) for x in range(9) for y in range(9)]]
    rings = spark.createDataFrame(k[0] + [(4, None, 0.0, 0.0), (4, 1, 1.0, 1.0)], "region long, seq int, x double, y double")
    points = spark.createDataFrame(k[1] + [(1, None, 2.0)], "region long, x double, y double")
    grouped, batch = (sorted(map(tuple, triangulation.region_triangles(rings, points, small=small).collect())) for small in (0, 1000))
    assert grouped == batch and len(batch) > 50
    # regions of few points make no groups, and no percentiles
    held = plan(triangulation.region_triangles(rings, points))
    assert "MapInPandas" in held
