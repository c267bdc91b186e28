"""Survey data sets as deterministic projections of the driver's tables, in DataFrame and SQL form."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import las
from plumbline.sources.tables import table

SCALE = 0.01


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey").cast("long")
    cols = {
        "idx": i, "xi": (i * 7919) % 100000, "yi": (i * 104729) % 100000, "zi": (i * 1299709) % 20000, "intensity": (i * 37) % 65536,
        "classification": i % 32, "return_byte": (i * 3) % 128, "r": (i * 5) % 65536, "g": (i * 7) % 65536, "b": (i * 11) % 65536,
    }
    df = table(spark, sf_dir, "orders").select(*[c.alias(n) for n, c in cols.items()])
    return df.select(
        "*", *[las.world(F.col(f"{d}i"), SCALE).alias(d) for d in "xyz"],
        las.return_number(F.col("return_byte")).alias("return_number"), las.number_of_returns(F.col("return_byte")).alias("number_of_returns"),
    )


POINTS = """v0 AS (SELECT CAST(o_orderkey AS BIGINT) AS i FROM orders),
v_points AS (SELECT i AS idx, (i*7919)%100000 AS xi, (i*104729)%100000 AS yi, (i*1299709)%20000 AS zi,
  (i*37)%65536 AS intensity, i%32 AS classification, (i*3)%128 AS return_byte, (i*5)%65536 AS r, (i*7)%65536 AS g, (i*11)%65536 AS b,
  ((i*7919)%100000)*0.01::DOUBLE AS x, ((i*104729)%100000)*0.01::DOUBLE AS y, ((i*1299709)%20000)*0.01::DOUBLE AS z,
  ((i*3)%128)&15 AS return_number, (((i*3)%128)>>4)&15 AS number_of_returns FROM v0)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as features: family none for every seventh, else by market segment."""
    k = F.col("c_custkey")
    families = F.array(*[F.lit(x) for x in ("region", "object", "building", "utility", "line", "marker", "measurement")])
    kinds = F.array(*[F.lit(x) for x in ("polyline", "marker", "measurement", "polygon")])
    return table(spark, sf_dir, "customer").select(
        k.alias("feature_id"), F.when(k % 7 != 0, F.get(families, (k % 7).cast("int"))).alias("family"),
        F.get(kinds, (k % 4).cast("int")).alias("type"), (k % 3).alias("simulation_id"), F.col("c_nationkey").alias("layer_id"),
    )


FEATURES = """v_features AS (SELECT c_custkey AS feature_id,
  CASE WHEN c_custkey%7<>0 THEN (['region','object','building','utility','line','marker','measurement'])[(c_custkey%7)+1] END AS family,
  (['polyline','marker','measurement','polygon'])[(c_custkey%4)+1] AS type, c_custkey%3 AS simulation_id, c_nationkey AS layer_id FROM customer)"""


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as assets: every third a source cloud, the others an index or surfels of one of the clouds before."""
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "point-cloud").when(k % 3 == 1, "point-cloud-index").otherwise("analytic-surfel-render")
    return table(spark, sf_dir, "part").select(
        k.alias("asset_id"), kind.alias("kind"), F.when(k % 3 == 0, None).otherwise((F.floor(k / 5) * 3).cast("long")).alias("source_asset_id"),
        F.col("p_size").cast("long").alias("file_size"), F.col("p_name").alias("header_sha256"), (k % 11).cast("long").alias("mtime_ms"),
    )


ASSETS = """v_assets AS (SELECT p_partkey AS asset_id,
  CASE p_partkey%3 WHEN 0 THEN 'point-cloud' WHEN 1 THEN 'point-cloud-index' ELSE 'analytic-surfel-render' END AS kind,
  CASE WHEN p_partkey%3<>0 THEN CAST(floor(p_partkey/5.0)*3 AS BIGINT) END AS source_asset_id,
  CAST(p_size AS BIGINT) AS file_size, p_name AS header_sha256, CAST(p_partkey%11 AS BIGINT) AS mtime_ms FROM part)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("tin-vertex", "picked-coordinate", "cloud-point", "manual-note", "dwg-vertex")])
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("feature_id"), F.col("o_orderkey").alias("seq"), F.get(kinds, (F.col("o_orderkey") % 5).cast("int")).alias("kind")
    )


EVIDENCE = """v_evidence AS (SELECT o_custkey AS feature_id, o_orderkey AS seq,
  (['tin-vertex','picked-coordinate','cloud-point','manual-note','dwg-vertex'])[(o_orderkey%5)+1] AS kind FROM orders)"""


def grid_side(spark: SparkSession, sf_dir: str) -> int:
    """A square grid of about as many vertices as there are orders."""
    return max(8, math.isqrt(table(spark, sf_dir, "orders").count()))


def grid_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    side, i = grid_side(spark, sf_dir), F.col("id")
    row, col = F.floor(i / side).cast("long"), i % side
    return spark.range(side * side).select(
        i.alias("vertex_id"), (col * 10).cast("double").alias("x"), (row * 10).cast("double").alias("y"), ((row * 7 + col * 13) % 17).cast("double").alias("z")
    )


def grid_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = grid_side(spark, sf_dir)
    q = side - 1
    row, col = F.floor(F.col("id") / q).cast("long"), F.col("id") % q
    a = row * side + col
    two = F.array(F.struct(a.alias("a"), (a + 1).alias("b"), (a + side).alias("c")), F.struct((a + 1).alias("a"), (a + side + 1).alias("b"), (a + side).alias("c")))
    return spark.range(q * q).select(F.col("id").alias("q"), F.posexplode(two).alias("k", "f")).select(
        (F.col("q") * 2 + F.col("k")).cast("long").alias("face_id"), F.col("f.a").alias("a"), F.col("f.b").alias("b"), F.col("f.c").alias("c")
    )


TIN = """v_side AS (SELECT greatest(8, CAST(floor(sqrt(count(*))) AS BIGINT)) AS s FROM orders),
v_vertices AS (SELECT i AS vertex_id, CAST((i%s)*10 AS DOUBLE) AS x, CAST((i//s)*10 AS DOUBLE) AS y, CAST(((i//s)*7+(i%s)*13)%17 AS DOUBLE) AS z FROM (SELECT s, unnest(range(s*s)) AS i FROM v_side)),
v_quads AS (SELECT q, s, (q//(s-1))*s+q%(s-1) AS a FROM (SELECT s, unnest(range((s-1)*(s-1))) AS q FROM v_side)),
v_faces AS (SELECT q*2 AS face_id, a, a+1 AS b, a+s AS c FROM v_quads UNION ALL SELECT q*2+1, a+1, a+s+1, a+s FROM v_quads)"""


def nodes(spark: SparkSession, sf_dir: str, depth: int = 4) -> DataFrame:
    """Octree nodes of the points to a depth, on the cube of 1000 units at the origin, with the points below each."""
    # On this cube the coordinates are whole hundredths and no cell edge is rounded; points are counted once, in the deepest cells.
    side, smallest = 1000.0, 1000.0 / 2**depth
    cell = [F.floor(F.col(d) / smallest).cast("long").alias(f"n{d}") for d in "xyz"]
    deepest = points(spark, sf_dir).groupBy(*cell).agg(F.count("*").alias("k"))
    up = [F.expr(f"shiftright(n{d}, {depth} - level)").alias(f"n{d}") for d in "xyz"]
    each = deepest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    found = each.groupBy("level", *up).agg(F.sum("k").alias("point_count"))
    size = F.lit(side) / F.pow(F.lit(2.0), F.col("level"))
    bounds = [((F.col(f"n{d}") + k) * size).alias(f"{m}_{d}") for m, k in (("min", 0), ("max", 1)) for d in "xyz"]
    return found.select(F.concat_ws("-", "level", "nx", "ny", "nz").alias("key"), "level", "nx", "ny", "nz", "point_count", *bounds)


def nodes_sql(depth: int = 4) -> str:
    each = " UNION ALL ".join(
        f"SELECT {k} AS level, CAST(floor(x/{1000.0 / 2**k}) AS BIGINT) AS nx, CAST(floor(y/{1000.0 / 2**k}) AS BIGINT) AS ny, "
        f"CAST(floor(z/{1000.0 / 2**k}) AS BIGINT) AS nz, count(*) AS point_count FROM v_points GROUP BY ALL"
        for k in range(depth + 1)
    )
    return f"""v_cells AS ({each}),
v_nodes AS (SELECT concat_ws('-',level,nx,ny,nz) AS key, level, nx, ny, nz, point_count,
  nx*(1000.0/(1<<level))::DOUBLE AS min_x, ny*(1000.0/(1<<level))::DOUBLE AS min_y, nz*(1000.0/(1<<level))::DOUBLE AS min_z,
  (nx+1)*(1000.0/(1<<level))::DOUBLE AS max_x, (ny+1)*(1000.0/(1<<level))::DOUBLE AS max_y, (nz+1)*(1000.0/(1<<level))::DOUBLE AS max_z FROM v_cells)"""
