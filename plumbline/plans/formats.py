"""Registered queries that write survey files from the tables into the shared folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import preview, raster
from plumbline.plans import views
from plumbline.plans.catalog import P, query
from plumbline.sources import landxml, tiff
from plumbline.sources import preview as cache
from plumbline.sources.tables import shared_dir, table

#: Orders in one surface file; two surfaces a file.
FILE_ORDERS = 20_000
#: A sheet of pixels, one an order.
SHEET = 128
WINDOW = (13, 5, 100, 90)


def _new(spark, label: str) -> str:
    return f"{shared_dir(spark)}/plumbline/{label}-{uuid.uuid4().hex}"


_SURFACES = f"""{P}, v AS (SELECT idx // {FILE_ORDERS} AS file, idx % 2 AS surface, xi, yi, zi, row_number() OVER (PARTITION BY idx // {FILE_ORDERS}, idx % 2 ORDER BY idx) - 1 AS vertex FROM v_points)
SELECT file, surface, count(*) AS points, CAST(sum((vertex + 1) * (xi + 2 * yi + 3 * zi)) AS BIGINT) AS places, count(*) // 3 AS faces,
CAST(sum(CASE WHEN vertex % 3 = 2 AND vertex % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS shown FROM v GROUP BY ALL"""


@query(_SURFACES)
def surface_files_by_blocks(spark, sf_dir):
    """Orders as vertices of surface files, three to a face, written and read again; numbers of points and faces come from the files."""
    p = views.points(spark, sf_dir).select(F.floor(F.col("idx") / FILE_ORDERS).cast("string").alias("file"), (F.col("idx") % 2).cast("int").alias("surface"), "idx", "x", "y", "z")
    v = p.withColumn("vertex", F.row_number().over(Window.partitionBy("file", "surface").orderBy("idx")) - 1)
    faces = v.filter("vertex % 3 = 2").select("file", "surface", (F.col("vertex") - 2).alias("a"), (F.col("vertex") - 1).alias("b"), F.col("vertex").alias("c"), (F.col("vertex") % 2 == 0).alias("visible"))
    surfaces = v.select("file", "surface").distinct().withColumn("name", F.concat(F.lit("a > b & <"), F.col("surface")))
    folder = _new(spark, "surfaces")
    landxml.write(surfaces, v, faces, places=2).select(F.col("file").alias("n"), "xml").write.partitionBy("n").text(folder)
    t = landxml.read(spark, folder)
    number = F.regexp_extract("file", "n=(\\d+)", 1).cast("long").alias("file")
    hundredths = lambda c: F.round(F.col(c) * 100).cast("long")
    place = (F.col("vertex") + 1) * (hundredths("x") + 2 * hundredths("y") + 3 * hundredths("z"))
    points = t["vertices"].groupBy("file", "surface").agg(F.count("*").alias("points"), F.sum(place).alias("places"))
    drawn = t["faces"].groupBy("file", "surface").agg(F.count("*").alias("faces"), F.count_if("visible").alias("shown"))
    found = points.join(drawn, ["file", "surface"], "left").fillna(0, ["faces", "shown"])
    return found.select(number, F.col("surface").cast("long").alias("surface"), "points", "places", "faces", "shown")


_PIXELS = f"""WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS i FROM orders),
p AS MATERIALIZED (SELECT i // {SHEET * SHEET} AS sheet, i % {SHEET} AS px, (i // {SHEET}) % {SHEET} AS py, [(i * 7) % 256, (i * 11) % 256, (i * i) % 256] AS v FROM o),
z AS MATERIALIZED (SELECT sheet, x AS px, y AS py FROM (SELECT DISTINCT sheet FROM p) CROSS JOIN range({SHEET}) a(x) CROSS JOIN range({SHEET}) b(y)),
s AS MATERIALIZED (SELECT sheet, px, py, coalesce(v, [0, 0, 0]) AS v FROM z LEFT JOIN p USING (sheet, px, py))"""


def _shrunk_sql(x0: int, y0: int, n: tuple[int, int], out: tuple[int, int]) -> str:
    corner = lambda name, x, y: f"JOIN s {name} ON {name}.sheet = k.sheet AND {name}.px = k.{x} AND {name}.py = k.{y}"
    band = lambda k, name: f"CAST(floor((1 - u) * ((1 - t) * ll.v[{k}] + t * hl.v[{k}]) + u * ((1 - t) * lh.v[{k}] + t * hh.v[{k}])) AS INT) AS {name}"
    return f"""{_PIXELS},
k AS MATERIALIZED (SELECT sheet, ox, oy, rx - floor(rx) AS t, ry - floor(ry) AS u, {x0} + CAST(floor(rx) AS BIGINT) AS xl, {x0} + least(CAST(ceil(rx) AS BIGINT), {n[0] - 1}) AS xh,
{y0} + CAST(floor(ry) AS BIGINT) AS yl, {y0} + least(CAST(ceil(ry) AS BIGINT), {n[1] - 1}) AS yh FROM (SELECT sheet, ox, oy, {n[0] / out[0]!r}::DOUBLE * ox AS rx, {n[1] / out[1]!r}::DOUBLE * oy AS ry
FROM (SELECT DISTINCT sheet FROM p) CROSS JOIN range({out[0]}) a(ox) CROSS JOIN range({out[1]}) b(oy)))
SELECT k.sheet AS sheet, CAST(ox AS BIGINT) AS ox, CAST(oy AS BIGINT) AS oy, {band(1, "r")}, {band(2, "g")}, {band(3, "b")}, 255 AS a FROM k
{corner("ll", "xl", "yl")} {corner("hl", "xh", "yl")} {corner("lh", "xl", "yh")} {corner("hh", "xh", "yh")}"""


def _sheets(spark, sf_dir, window=None):
    """Orders as pixels of 128 by 128, written as one raster file a sheet; their pixels."""
    i = F.col("o_orderkey").cast("long")
    pixels = table(spark, sf_dir, "orders").select(
        F.floor(i / (SHEET * SHEET)).cast("string").alias("sheet"), (i % SHEET).cast("int").alias("px"), (F.floor(i / SHEET) % SHEET).cast("int").alias("py"),
        F.array((i * 7) % 256, (i * 11) % 256, (i * i) % 256).alias("v"),
    )
    folder = _new(spark, "sheets")
    tiff.write_sheets(pixels, folder, SHEET, SHEET, 3).write.parquet(_new(spark, "sheet-names"))
    return tiff.read(spark, folder, window)


def _colours(found):
    c = raster.rgba(F.col("v"), F.col("bands"))
    sheet = F.regexp_extract("file", "(\\d+)\\.tif$", 1).cast("long").alias("sheet")
    return found.withColumn("c", c).select(sheet, F.col("ox").cast("long").alias("ox"), F.col("oy").cast("long").alias("oy"), "c.r", "c.g", "c.b", "c.a")


_X0, _Y0, _X1, _Y1 = WINDOW


@query(f"{_PIXELS} SELECT sheet, px - {_X0} AS ox, py - {_Y0} AS oy, CAST(v[1] AS INT) AS r, CAST(v[2] AS INT) AS g, CAST(v[3] AS INT) AS b, 255 AS a FROM s WHERE px >= {_X0} AND px < {_X1} AND py >= {_Y0} AND py < {_Y1}")
def raster_window(spark, sf_dir):
    return _colours(raster.window(_sheets(spark, sf_dir, WINDOW), WINDOW))


@query(_shrunk_sql(_X0, _Y0, (_X1 - _X0, _Y1 - _Y0), (-(-(_X1 - _X0) // 2), -(-(_Y1 - _Y0) // 2))))
def raster_window_halved(spark, sf_dir):
    return _colours(raster.window(_sheets(spark, sf_dir, WINDOW), WINDOW, 2))


@query(_shrunk_sql(0, 0, (SHEET, SHEET), (43, 43)))
def raster_overview(spark, sf_dir):
    """Overviews of at most 50 pixels a side: a third, rounded."""
    return _colours(raster.overview(_sheets(spark, sf_dir), 50))


#: Points over which a preview node is split here, and the levels below the root.
PREVIEW_CAPACITY, PREVIEW_DEPTH = 40, 4


def _clouds(spark, sf_dir):
    """The points as clouds, one for each 20 000 orders and parity; all in the cube of 1000 units, cut off at z = 200."""
    p = views.points(spark, sf_dir)
    return p.withColumn("cloud", F.floor(F.col("idx") / FILE_ORDERS) * 2 + F.col("idx") % 2)


def _cube(clouds):
    side = [F.lit(v).alias(f"{m}_{d}") for m, corner in (("min", (0.0, 0.0, 0.0)), ("max", (1000.0, 1000.0, 200.0))) for d, v in zip("xyz", corner)]
    return clouds.select("cloud").distinct().select("cloud", *side)


_D = PREVIEW_DEPTH
_CELL = " + ".join(
    f"((CAST(floor(x / {1000 / 2**k}) AS BIGINT) & 1) + 2 * (CAST(floor(y / {1000 / 2**k}) AS BIGINT) & 1) + 4 * (CAST(floor(z / {200 / 2**k}) AS BIGINT) & 1)) * {8 ** (_D - k)}" for k in range(1, _D + 1)
)
_PREVIEW = f"""{P.replace("WITH", "WITH RECURSIVE", 1)}, c AS MATERIALIZED (SELECT *, idx // {FILE_ORDERS} * 2 + idx % 2 AS cloud, {_CELL} AS cell FROM v_points),
counted AS MATERIALIZED (SELECT cloud, level, cell >> (3 * ({_D} - level)) AS node, count(*) AS n FROM c CROSS JOIN range({_D + 1}) r(level) GROUP BY ALL),
tree AS (
  SELECT cloud, level, node, n, '9' AS place FROM counted WHERE level = 0
  UNION ALL
  SELECT k.cloud, k.level, k.node, k.n, left(t.place, -1) || (k.node & 7) || '9' FROM tree t JOIN counted k ON k.cloud = t.cloud AND k.level = t.level + 1 AND k.node >> 3 = t.node WHERE t.n > {PREVIEW_CAPACITY}),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY cloud ORDER BY place) AS id, n <= {PREVIEW_CAPACITY} OR level = {_D} AS leaf FROM tree)"""


@query(f"""{_PREVIEW} SELECT t.cloud, t.id, CAST(t.level AS BIGINT) AS level, t.node, p.id AS parent_id, t.n AS point_count, t.leaf,
(SELECT count(*) FROM numbered u WHERE u.cloud = t.cloud AND u.level >= t.level AND u.node >> (3 * (u.level - t.level)) = t.node) AS subtree
FROM numbered t LEFT JOIN numbered p ON p.cloud = t.cloud AND p.level = t.level - 1 AND p.node = t.node >> 3""")
def preview_octree(spark, sf_dir):
    """Nodes of the preview octrees, numbered in post-order."""
    clouds = _clouds(spark, sf_dir)
    nodes, _ = preview.build(clouds, "all-detail", PREVIEW_CAPACITY, _cube(clouds), PREVIEW_DEPTH)
    return nodes.withColumn("level", F.col("level").cast("long"))


@query(f"""{_PREVIEW}, kept AS (SELECT c.idx, n.id, row_number() OVER (PARTITION BY n.id ORDER BY idx) AS k, x, y, z, c.r & 255 AS r, intensity, classification FROM c JOIN numbered n
ON n.cloud = c.cloud AND n.leaf AND n.node = c.cell >> (3 * ({_D} - n.level)) WHERE c.cloud = 0 AND c.idx % greatest(1, 64 >> n.level) = 0)
SELECT id, count(*) AS points, round(sum(CAST(x - 500 AS FLOAT)::DOUBLE), 3) AS lx, round(sum(CAST(z - 100 AS FLOAT)::DOUBLE), 3) AS lz, CAST(sum(r) AS BIGINT) AS r,
CAST(sum(intensity) AS BIGINT) AS intensity, CAST(sum(classification) AS BIGINT) AS classification FROM kept GROUP BY id""")
def preview_cache(spark, sf_dir):
    """The sample of the first cloud, written to a cache and read back by node."""
    clouds = _clouds(spark, sf_dir).withColumns({c: F.col(c) % 256 for c in "rgb"})
    nodes, sample = preview.build(clouds, "all-detail", PREVIEW_CAPACITY, _cube(clouds), PREVIEW_DEPTH)
    folder = _new(spark, "preview")
    cache.write(sample.filter("cloud = 0"), folder, {"quality": "all-detail"})
    whole = lambda c: F.sum(c).cast("long").alias(c)
    length = lambda c: F.round(F.sum(F.col(c).cast("double")), 3).alias(c)
    return cache.read(spark, folder).groupBy("id").agg(F.count("*").alias("points"), length("lx"), length("lz"), whole("r"), whole("intensity"), whole("classification"))


@query(f"""{_PREVIEW}, kept AS (SELECT c.cloud, classification, return_number, number_of_returns FROM c JOIN numbered n ON n.cloud = c.cloud AND n.leaf AND n.node = c.cell >> (3 * ({_D} - n.level)) WHERE c.idx % greatest(1, 64 >> n.level) = 0),
k AS (SELECT cloud, count(*) AS sampled, count(DISTINCT classification) AS classes, sum(DISTINCT return_number) AS returns, greatest(max(number_of_returns), 1) AS most_returns FROM kept GROUP BY cloud)
SELECT n.cloud, max(level) AS max_depth, count(*) AS nodes, any_value(coalesce(sampled, 0)) AS sampled, any_value(coalesce(classes, 0)) AS classes, CAST(any_value(coalesce(returns, 0)) AS BIGINT) AS returns, CAST(any_value(coalesce(most_returns, 1)) AS BIGINT) AS most_returns
FROM numbered n LEFT JOIN k USING (cloud) GROUP BY n.cloud""")
def preview_summaries(spark, sf_dir):
    """Depth and number of nodes of each preview octree, and what its samples hold."""
    clouds = _clouds(spark, sf_dir)
    told = preview.summary(*preview.build(clouds, "all-detail", PREVIEW_CAPACITY, _cube(clouds), PREVIEW_DEPTH))
    classes, returns = F.coalesce(F.size("classes"), F.lit(0)), F.aggregate(F.coalesce("returns", F.array().cast("array<int>")), F.lit(0).cast("long"), lambda a, v: a + v)
    long = lambda c, name: c.cast("long").alias(name)
    return told.select("cloud", long(F.col("max_depth"), "max_depth"), "nodes", "sampled", long(F.greatest(classes, F.lit(0)), "classes"), long(returns, "returns"), long(F.col("most_returns"), "most_returns"))
