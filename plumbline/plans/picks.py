"""Registered queries for rays, extents and crops, each against all pairs in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import geometry as geo
from plumbline.functions import noise
from plumbline.operators import copies, crops, extents, mesh, points, rays, selection, triangulation
from plumbline.plans import views
from plumbline.plans.catalog import P, RING, crossings, query, r6
from plumbline.sources.tables import table

RADIUS, SLOPE, CELL = 4.0, 0.002, 50.0
SHOWN = ((500.0, 500.0, 100.0), 450.0)


def _rays(spark, sf_dir):
    """Customers look down from a height of 1200 at places on the ground."""
    k = F.col("c_custkey")
    o = [((k * 37) % 1000).cast("double"), ((k * 53) % 1000).cast("double"), F.lit(1200.0)]
    to = [((k * 91) % 1000).cast("double"), ((k * 17) % 1000).cast("double"), F.lit(0.0)]
    return table(spark, sf_dir, "customer").select(
        k.alias("ray_id"), *[c.alias(f"o{d}") for c, d in zip(o, "xyz")], *[(b - a).alias(f"d{d}") for a, b, d in zip(o, to, "xyz")], F.lit(1.0).alias("reach")
    )


_RAYS = """v_rays AS (SELECT *, dx*dx + dy*dy + dz*dz AS size FROM (SELECT c_custkey AS ray_id, ((c_custkey*37)%1000)::DOUBLE AS ox, ((c_custkey*53)%1000)::DOUBLE AS oy, 1200.0::DOUBLE AS oz,
((c_custkey*91)%1000)::DOUBLE - ((c_custkey*37)%1000)::DOUBLE AS dx, ((c_custkey*17)%1000)::DOUBLE - ((c_custkey*53)%1000)::DOUBLE AS dy, -1200.0::DOUBLE AS dz FROM customer))"""


@query(f"""{P}, {_RAYS}, seen AS (SELECT *, idx % 2 AS source FROM v_points WHERE {crossings("x", "y")} AND (x-500)*(x-500)+(y-500)*(y-500)+(z-100)*(z-100) <= 202500),
m AS (SELECT ray_id, source, idx, x, y, z, ox, oy, oz, dx, dy, dz, size, ((x-ox)*dx + (y-oy)*dy + (z-oz)*dz) / size AS t FROM v_rays, seen),
d AS (SELECT *, sqrt(pow(x-ox-t*dx, 2) + pow(y-oy-t*dy, 2) + pow(z-oz-t*dz, 2)) AS distance FROM m WHERE t >= 0 AND t <= 1),
r AS (SELECT *, row_number() OVER (PARTITION BY ray_id, source ORDER BY t, distance, idx) AS rank FROM d WHERE distance <= {RADIUS} + {SLOPE} * t * sqrt(size))
SELECT ray_id, source, CAST(rank AS BIGINT) AS rank, idx, round(t, 6) AS t, round(distance, 6) AS distance FROM r WHERE rank <= 8""")
def ray_cloud_hits(spark, sf_dir):
    """The first points of two sources along each ray, of those within the work area and the distance shown."""
    x, y, z = (F.col(d) for d in "xyz")
    seen = views.points(spark, sf_dir).filter(geo.in_polygon(x, y, RING) & geo.within_range(x, y, z, *SHOWN)).select("idx", "x", "y", "z", (F.col("idx") % 2).alias("source"))
    found = rays.cloud_hits(_rays(spark, sf_dir), seen, CELL, RADIUS, SLOPE)
    return found.select("ray_id", "source", F.col("rank").cast("long").alias("rank"), "idx", r6(F.col("t"), "t"), r6(F.col("distance"), "distance"))


_FACES = """v_tri AS (SELECT idx AS face_id, idx % 5 AS surface, x AS ax, y AS ay, z AS az, x + 20 AS bx, y + 3 AS by_, z + 5 AS bz, x - 4 AS cx, y + 30 AS cy, z - 3 AS cz FROM v_points)"""


@query(f"""{P}, {_RAYS}, {_FACES}, e AS (SELECT *, bx-ax AS ux, by_-ay AS uy, bz-az AS uz, cx-ax AS vx, cy-ay AS vy, cz-az AS vz, ox-ax AS px, oy-ay AS py, oz-az AS pz FROM v_rays, v_tri),
h AS (SELECT *, dy*vz-dz*vy AS hx, dz*vx-dx*vz AS hy, dx*vy-dy*vx AS hz, py*uz-pz*uy AS sx, pz*ux-px*uz AS sy, px*uy-py*ux AS sz FROM e),
w AS (SELECT *, nullif(ux*hx+uy*hy+uz*hz, 0) AS turn FROM h),
t AS (SELECT ray_id, surface, face_id, ox, oy, oz, dx, dy, dz, (vx*sx+vy*sy+vz*sz)/turn AS t, (px*hx+py*hy+pz*hz)/turn AS u, (dx*sx+dy*sy+dz*sz)/turn AS v FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY ray_id ORDER BY t, surface, face_id) AS k FROM t WHERE u >= 0 AND v >= 0 AND u + v <= 1 AND t >= 0 AND t <= 1 AND (ray_id % 3 <> 0 OR surface = ray_id % 5))
SELECT ray_id, surface, round(ox + t*dx + 1000, 6) AS e, round(oy + t*dy + 2000, 6) AS n, round((oz + t*dz) / 2 + 30, 6) AS z FROM r WHERE k = 1""")
def cursor_read_outs(spark, sf_dir):
    """Where each customer's ray first meets one of five surfaces of a triangle an order; a third of them look at one surface only."""
    p = views.points(spark, sf_dir)
    move = {"a": (0, 0, 0), "b": (20, 3, 5), "c": (-4, 30, -3)}
    tri = p.select(F.col("idx").alias("face_id"), (F.col("idx") % 5).alias("surface"), *[(F.col(d) + m).alias(f"{k}{d}") for k, ms in move.items() for d, m in zip("xyz", ms)])
    looking = _rays(spark, sf_dir).withColumn("active", F.when(F.col("ray_id") % 3 == 0, F.col("ray_id") % 5))
    found = rays.read_out(rays.surface_hits(looking, tri, CELL), (1000.0, 2000.0, 30.0), 2.0)
    return found.select("ray_id", "surface", r6(F.col("e"), "e"), r6(F.col("n"), "n"), r6(F.col("z"), "z"))


_BOXES = """l AS (SELECT c_custkey AS k, ((c_custkey*37)%1000)::DOUBLE AS x0, ((c_custkey*53)%1000)::DOUBLE AS y0, pow(2, c_custkey % 9)::DOUBLE AS w, pow(2, c_custkey % 7)::DOUBLE AS h FROM customer),
r AS (SELECT p_partkey AS k, ((p_partkey*91)%1000)::DOUBLE AS x0, ((p_partkey*17)%1000)::DOUBLE AS y0, pow(2, p_partkey % 10)::DOUBLE AS w, (p_partkey % 40)::DOUBLE AS h FROM part)"""


@query(f"""WITH {_BOXES} SELECT l.k AS raster, r.k AS surface FROM l, r WHERE l.x0 <= r.x0 + r.w AND l.x0 + l.w >= r.x0 AND l.y0 <= r.y0 + r.h AND l.y0 + l.h >= r.y0""")
def meeting_extents(spark, sf_dir):
    """Customers' extents of all sizes up to 256 and parts' of up to 512 by 39, all pairs that meet."""

    def boxes(name, key, a, b, w, h):
        k = F.col(key)
        x, y = ((k * a) % 1000).cast("double"), ((k * b) % 1000).cast("double")
        return table(spark, sf_dir, name).select(k.alias("k"), x.alias("min_x"), y.alias("min_y"), (x + w(k)).alias("max_x"), (y + h(k)).alias("max_y"))

    two = lambda n: lambda k: F.pow(F.lit(2.0), k % n)
    left = boxes("customer", "c_custkey", 37, 53, two(9), two(7))
    right = boxes("part", "p_partkey", 91, 17, two(10), lambda k: (k % 40).cast("double"))
    return extents.meeting(left, right, 4.0).select(F.col("l.k").alias("raster"), F.col("r.k").alias("surface"))


#: Rings of customers: six points, of which some coincide or lie on rows and columns of pixels; concave and crossing ones, too.
_CORNERS = ((0, 3, 2, 7), (1, 40, 0, 11), (0, 55, 10, 13), (1, 50, 28, 17), (0, 30, 33, 19), (1, 5, 25, 23))


def _rings(spark, sf_dir):
    k = F.col("c_custkey")
    at = [F.struct(((k * m % 9) * (1.0 if even else 0.5) + a).alias("x"), ((k * (m + 2) % 12) * 0.5 + b).alias("y")) for even, a, b, m in _CORNERS]
    return table(spark, sf_dir, "customer").select(k.alias("polygon_id"), F.array(*at).alias("ring"))


_POINTS = ", ".join(f"[((k * {m}) % 9) * {1.0 if even else 0.5} + {a}, ((k * {m + 2}) % 12) * 0.5 + {b}]" for even, a, b, m in _CORNERS)


def _holds(x: str, y: str) -> str:
    """SQL for a pixel in the ring p or on it."""
    each, on = [], []
    for i in range(6):
        ax, ay, bx, by = (f"p[{i + 1}][1]", f"p[{i + 1}][2]", f"p[{(i + 1) % 6 + 1}][1]", f"p[{(i + 1) % 6 + 1}][2]")
        each.append(f"CAST((({ay} > {y}) <> ({by} > {y})) AND {x} < ({bx} - {ax}) * ({y} - {ay}) / nullif({by} - {ay}, 0) + {ax} AS INT)")
        on.append(
            f"(abs(({bx} - {ax}) * ({y} - {ay}) - ({by} - {ay}) * ({x} - {ax})) <= 2e-9 AND {x} BETWEEN least({ax}, {bx}) - 1e-9 AND greatest({ax}, {bx}) + 1e-9 AND {y} BETWEEN least({ay}, {by}) - 1e-9 AND greatest({ay}, {by}) + 1e-9)"
        )
    return f"(({' + '.join(f'coalesce({e}, 0)' for e in each)}) % 2 = 1 OR {' OR '.join(on)})"


_RINGS = f"v_rings AS (SELECT k, CAST([{_POINTS}] AS DOUBLE[][]) AS p FROM (SELECT c_custkey AS k FROM customer))"
_KEPT = f"v_kept AS (SELECT k, x, y FROM v_rings CROSS JOIN range(64) a(x) CROSS JOIN range(46) b(y) WHERE {_holds('x', 'y')})"


@query(f"""WITH {_RINGS}, {_KEPT}, i AS (SELECT *, x - row_number() OVER (PARTITION BY k, y ORDER BY x) AS g FROM v_kept)
SELECT k AS polygon_id, y, min(x) AS first, max(x) AS last FROM i GROUP BY k, y, g""")
def crop_spans(spark, sf_dir):
    return crops.spans(_rings(spark, sf_dir))


def _met(i: int) -> str:
    """SQL for edge i of the ring p meeting an edge of the tile x0, y0, x0 + 8, y0 + 8."""
    a, b = (f"p[{i + 1}][1]", f"p[{i + 1}][2]"), (f"p[{(i + 1) % 6 + 1}][1]", f"p[{(i + 1) % 6 + 1}][2]")
    turn = lambda p, q, r: f"(({q[0]} - {p[0]}) * ({r[1]} - {p[1]}) - ({q[1]} - {p[1]}) * ({r[0]} - {p[0]}))"
    lies = lambda p, q, r: f"({turn(p, q, r)} = 0 AND {r[0]} BETWEEN least({p[0]}, {q[0]}) AND greatest({p[0]}, {q[0]}) AND {r[1]} BETWEEN least({p[1]}, {q[1]}) AND greatest({p[1]}, {q[1]}))"
    corners, out = [("x0", "y0"), ("(x0 + 8)", "y0"), ("(x0 + 8)", "(y0 + 8)"), ("x0", "(y0 + 8)")], []
    for c, d in zip(corners, corners[1:] + corners[:1]):
        out.append(f"({turn(a, b, c)} * {turn(a, b, d)} < 0 AND {turn(c, d, a)} * {turn(c, d, b)} < 0) OR {lies(a, b, c)} OR {lies(a, b, d)} OR {lies(c, d, a)} OR {lies(c, d, b)}")
    return "(" + " OR ".join(out) + ")"


_OUT = " OR ".join(f"NOT {_holds(x, y)}" for x, y in (("x0", "y0"), ("(x0 + 8)", "y0"), ("(x0 + 8)", "(y0 + 8)"), ("x0", "(y0 + 8)")))


@query(f"""WITH {_RINGS}, {_KEPT}, tiles AS (SELECT k, p, x * 8 AS x0, y * 8 AS y0 FROM v_rings CROSS JOIN range(2, 7) a(x) CROSS JOIN range(5) b(y)),
need AS (SELECT k, x0, y0 FROM tiles WHERE {_OUT} OR {' OR '.join(_met(i) for i in range(6))})
SELECT need.k AS polygon_id, x0, y0, count(x) AS kept FROM need LEFT JOIN v_kept ON v_kept.k = need.k AND x // 8 * 8 = x0 AND y // 8 * 8 = y0 GROUP BY ALL""")
def crop_tile_masks(spark, sf_dir):
    """The tiles of 8 pixels in the middle of each ring's sheet that need a mask, with the pixels kept; rings that are equal are cut once."""
    rings, members = copies.once(_rings(spark, sf_dir), "polygon_id", "ring")
    side = lambda a, b: F.sequence(F.lit(a).cast("long"), F.lit(b).cast("long"), F.lit(8).cast("long"))
    tiles = rings.select("polygon_id", F.explode(side(16, 48)).alias("x0")).withColumn("y0", F.explode(side(0, 32))).withColumns({"x1": F.col("x0") + 8, "y1": F.col("y0") + 8})
    kept = crops.tile_masks(tiles, rings, 8).groupBy("polygon_id", "x0", "y0").agg(F.sum(F.col("last") - F.col("first") + 1).alias("kept"))
    need = crops.masked_tiles(tiles, rings).filter("masked").join(copies.spread(kept), ["polygon_id", "x0", "y0"], "left")
    return copies.each(need, members, "polygon_id").select("polygon_id", "x0", "y0", F.coalesce("kept", F.lit(0)).alias("kept"))


_AREA = "abs(" + " + ".join(f"(p[{i + 1}][1] * p[{(i + 1) % 6 + 1}][2] - p[{(i + 1) % 6 + 1}][1] * p[{i + 1}][2])" for i in range(6)) + ") / 2"


@query(f"""WITH {_RINGS}, n AS (SELECT count(*) AS n FROM customer), q AS (SELECT DISTINCT 1 + o_orderkey % n AS k, ((o_orderkey * 7919) % 601) / 10 + 0.03::DOUBLE AS x, ((o_orderkey * 104729) % 401) / 10 + 0.07::DOUBLE AS y FROM orders, n),
i AS (SELECT k, count(*) AS inner_points FROM v_rings JOIN q USING (k) WHERE {_holds("x", "y")} GROUP BY k)
SELECT k AS region, 4 + 2 * coalesce(inner_points, 0) AS triangles, round({_AREA}, 6) AS area FROM v_rings LEFT JOIN i USING (k)""")
def covered_regions(spark, sf_dir):
    """Each customer's ring triangulated with the orders that lie in it: a triangle for each corner but two, and two for each point; areas add up to the ring's."""
    rings = _rings(spark, sf_dir).select(F.col("polygon_id").alias("region"), F.posexplode("ring").alias("seq", "c")).select("region", "seq", "c.x", "c.y")
    n, o = table(spark, sf_dir, "customer").count(), F.col("o_orderkey")
    at = [((o * m) % side / 10 + F.lit(off)).alias(d) for d, m, side, off in (("x", 7919, 601, 0.03), ("y", 104729, 401, 0.07))]
    found = triangulation.region_triangles(rings, table(spark, sf_dir, "orders").select((1 + o % n).alias("region"), *at))
    twice = (F.col("x2") - F.col("x1")) * (F.col("y3") - F.col("y1")) - (F.col("x3") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return found.groupBy("region").agg(F.count("*").alias("triangles"), F.round(F.sum(twice) / 2, 6).alias("area"))


_SECTORS = f"""{P}, cells AS (SELECT idx % 7 AS cloud, floor(x / 50) * 50 AS min_x, floor(y / 50) * 50 AS min_y, floor(x / 50) * 50 + 50 AS max_x, floor(y / 50) * 50 + 50 AS max_y, count(*) AS pc FROM v_points GROUP BY ALL),
asked AS (SELECT c_custkey % 7 AS cloud, c_custkey AS region, ((c_custkey*37)%500)::DOUBLE AS lx, ((c_custkey*53)%500)::DOUBLE AS ly, 100 + (c_custkey*37)%500 + ((c_custkey*11)%400)::DOUBLE AS hx,
80 + (c_custkey*53)%500 + ((c_custkey*13)%300)::DOUBLE AS hy, 2 + c_custkey % 40 AS budget FROM customer),
h0 AS MATERIALIZED (SELECT region, region || ':' AS sector, lx, ly, hx, hy, budget, min_x, min_y, max_x, max_y, pc FROM asked JOIN cells USING (cloud) WHERE max_x >= lx AND min_x <= hx AND max_y >= ly AND min_y <= hy
UNION ALL SELECT region, region || ':', lx, ly, hx, hy, budget, NULL, NULL, NULL, NULL, 0 FROM asked)"""
_ROUND = """, t{k} AS (SELECT *, sum(pc) OVER (PARTITION BY sector) AS pts, hx - lx >= hy - ly AS wide FROM h{k}),
m{k} AS (SELECT sector, CASE WHEN wide THEN lx ELSE ly END AS low, CASE WHEN wide THEN hx ELSE hy END AS high, CASE WHEN wide THEN (min_x + max_x) / 2 ELSE (min_y + max_y) / 2 END AS centre, sum(pc) AS w
FROM t{k} WHERE pts > budget AND min_x IS NOT NULL GROUP BY ALL),
u{k} AS (SELECT *, sum(w) OVER (PARTITION BY sector ORDER BY centre) AS upto, sum(w) OVER (PARTITION BY sector) AS total FROM m{k}),
c{k} AS (SELECT sector, least(greatest(min(centre) FILTER (upto >= total / 2), low + (high - low) * 0.05::DOUBLE), high - (high - low) * 0.05::DOUBLE) AS cut FROM u{k} GROUP BY sector, low, high),
h{n} AS MATERIALIZED (SELECT region, t.sector, lx, ly, hx, hy, budget, min_x, min_y, max_x, max_y, pc FROM t{k} t WHERE sector NOT IN (SELECT sector FROM c{k})
UNION ALL SELECT region, t.sector || '0', lx, ly, CASE WHEN wide THEN cut ELSE hx END, CASE WHEN wide THEN hy ELSE cut END, budget, min_x, min_y, max_x, max_y, pc
FROM t{k} t JOIN c{k} c ON c.sector = t.sector WHERE min_x IS NULL OR CASE WHEN wide THEN min_x ELSE min_y END <= cut
UNION ALL SELECT region, t.sector || '1', CASE WHEN wide THEN cut ELSE lx END, CASE WHEN wide THEN ly ELSE cut END, hx, hy, budget, min_x, min_y, max_x, max_y, pc
FROM t{k} t JOIN c{k} c ON c.sector = t.sector WHERE min_x IS NULL OR CASE WHEN wide THEN max_x ELSE max_y END >= cut)"""


@query(_SECTORS + "".join(_ROUND.format(k=k, n=k + 1) for k in range(3)) + """ SELECT region, sector, round(any_value(lx), 6) AS min_x, round(any_value(ly), 6) AS min_y, round(any_value(hx), 6) AS max_x, round(any_value(hy), 6) AS max_y,
CAST(sum(pc) AS BIGINT) AS points FROM h3 GROUP BY region, sector""")
def region_sectors(spark, sf_dir):
    """Customers' regions of seven clouds, halved until their parts hold few points, eight parts at most."""
    cell = lambda d: F.floor(F.col(d) / 50) * 50.0
    p = views.points(spark, sf_dir).select((F.col("idx") % 7).alias("cloud"), cell("x").alias("min_x"), cell("y").alias("min_y"))
    nodes = p.groupBy("cloud", "min_x", "min_y").agg(F.count("*").alias("point_count")).withColumns({"max_x": F.col("min_x") + 50, "max_y": F.col("min_y") + 50})
    k = F.col("c_custkey")
    lx, ly = ((k * 37) % 500).cast("double"), ((k * 53) % 500).cast("double")
    regions = table(spark, sf_dir, "customer").select(
        (k % 7).alias("cloud"), k.alias("region"), lx.alias("lx"), ly.alias("ly"), (lx + 100 + (k * 11) % 400).alias("hx"), (ly + 80 + (k * 13) % 300).alias("hy"), (2 + k % 40).alias("budget")
    )
    found = selection.sectors(nodes, regions, 8)
    return found.select("region", "sector", *[r6(F.col(c), c) for c in ("min_x", "min_y", "max_x", "max_y")], "points")


@query(f"{P} SELECT classification, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM v_points GROUP BY classification")
def point_centroids(spark, sf_dir):
    return points.centroids(views.points(spark, sf_dir), "classification").select("classification", r6(F.col("cx"), "cx"), r6(F.col("cy"), "cy"))


@query(f"""{P}, k AS (SELECT CAST(floor(x / 400) AS BIGINT) AS cx, idx, idx - row_number() OVER (PARTITION BY floor(x / 400) ORDER BY idx) AS g FROM v_points)
SELECT cx, min(idx) AS start, count(*) AS points FROM k GROUP BY cx, g""")
def point_runs(spark, sf_dir):
    """Runs of neighbouring records of each strip, to the single point."""
    p = views.points(spark, sf_dir).withColumn("cx", F.floor(F.col("x") / 400).cast("long"))
    return points.ranges(p, 1, "cx").select("cx", "start", F.col("blocks").alias("points"))


_FACE = "(o_orderkey * 7) % 50 + o_custkey % 13", "(o_orderkey * 11) % 30 + 0.5"


@query(f"""WITH p AS (SELECT o_custkey AS k, ({_FACE[0]})::DOUBLE AS a, ({_FACE[1]})::DOUBLE AS b FROM orders), g AS (SELECT k, count(*) AS n, max(a) - min(a) AS length, (max(b) - min(b)) * CASE WHEN k % 2 = 0 THEN 1 ELSE sqrt(2) END AS height,
var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS c FROM p GROUP BY k)
SELECT k, n, round(length, 4) AS length, round(height, 4) AS height, round(length * height, 4) AS area, CASE WHEN k % 2 = 0 THEN 'wall' ELSE 'roof' END AS kind FROM g WHERE n >= 3 AND va * vb - c * c > 0.01""")
def face_fits(spark, sf_dir):
    """Orders of a customer as points of a wall (y = 5) or of a roof (z = y); customers whose points lie on a line have no face."""
    k, a, b = F.col("o_custkey"), F.expr(_FACE[0]).cast("double"), F.expr(_FACE[1]).cast("double")
    p = table(spark, sf_dir, "orders").select(k.alias("k"), a.alias("x"), F.when(k % 2 == 0, 5.0).otherwise(b).alias("y"), b.alias("z"))
    r4 = lambda c: F.round(c, 4).alias(c)
    return points.fit_faces(p, "k").select("k", "n", r4("length"), r4("height"), r4("area"), "kind")


def _noise_sql(x: str, y: str) -> str:
    corners = ("0", "0", "0"), ("r", "1 - r", repr(noise.UNSKEW)), ("1", "1", repr(2 * noise.UNSKEW))
    each = []
    for di, dj, u in corners:
        cx, cy = f"(x0 - ({di}) + {u}::DOUBLE)", f"(y0 - ({dj}) + {u}::DOUBLE)"
        g = f"(p[(i & 255) % 256 + ({di}) + p[((j & 255) + ({dj})) % 256 + 1] + 1 - CASE WHEN (i & 255) + ({di}) + p[((j & 255) + ({dj})) % 256 + 1] >= 256 THEN 256 ELSE 0 END] % 8 + 1)"
        near = f"(0.5::DOUBLE - {cx} * {cx} - {cy} * {cy})"
        each.append(f"CASE WHEN {near} > 0 THEN {near} * {near} * ({near} * {near}) * (gx[{g}] * {cx} + gy[{g}] * {cy}) ELSE 0 END")
    return f"""(SELECT 70 * ({' + '.join(each)}) FROM (SELECT i, j, x - (i - b) AS x0, y - (j - b) AS y0, CASE WHEN x - (i - b) > y - (j - b) THEN 1 ELSE 0 END AS r FROM (SELECT x, y, i, j, (i + j) * {noise.UNSKEW!r}::DOUBLE AS b
FROM (SELECT x, y, CAST(floor(x + (x + y) * {noise.SKEW!r}::DOUBLE) AS BIGINT) AS i, CAST(floor(y + (x + y) * {noise.SKEW!r}::DOUBLE) AS BIGINT) AS j FROM (SELECT {x} AS x, {y} AS y)))))"""


@query(f"""WITH q AS (SELECT o_orderkey AS k, (o_orderkey % 997) * 0.37::DOUBLE - 150 AS ux, (o_orderkey % 613) * 0.11::DOUBLE - 30 AS uy, {noise.permutation(42)} AS p,
{[float(d[0]) for d in noise.DIRECTIONS]}::DOUBLE[] AS gx, {[float(d[1]) for d in noise.DIRECTIONS]}::DOUBLE[] AS gy FROM orders)
SELECT k, round({_noise_sql("ux", "uy")}, 9) AS noise, round((1.0::DOUBLE * {_noise_sql("ux", "uy")} + 0.5::DOUBLE * {_noise_sql("ux * 2", "uy * 2")}) / 1.5::DOUBLE, 9) AS fractal FROM q""")
def noise_fields(spark, sf_dir):
    k = F.col("o_orderkey")
    x, y = (k % 997) * F.lit(0.37) - 150, (k % 613) * F.lit(0.11) - 30
    return table(spark, sf_dir, "orders").select(k.alias("k"), F.round(noise.fractal(x, y, 42), 9).alias("noise"), F.round(noise.fractal(x, y, 42, 2), 9).alias("fractal"))


@query(f"""WITH p AS (SELECT o_custkey AS k, ({_FACE[0]})::DOUBLE AS a, ({_FACE[1]})::DOUBLE AS b FROM orders),
g AS (SELECT k, min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1, count(*) AS n, var_pop(a) * var_pop(b) - covar_pop(a, b) * covar_pop(a, b) AS wide FROM p GROUP BY k)
SELECT k, c AS corner, round(CASE WHEN (k % 2 = 0) = (c IN (0, 3)) THEN a1 ELSE a0 END, 3) AS x, round(CASE WHEN k % 2 = 0 THEN 5 WHEN c < 2 THEN b0 ELSE b1 END, 3) AS y, round(CASE WHEN c < 2 THEN b0 ELSE b1 END, 3) AS z
FROM g CROSS JOIN range(4) r(c) WHERE n >= 3 AND wide > 0.01""")
def face_quads(spark, sf_dir):
    """The corners of the faces of `face_fits`; a wall's level line runs toward lower x, a roof's toward higher."""
    k, a, b = F.col("o_custkey"), F.expr(_FACE[0]).cast("double"), F.expr(_FACE[1]).cast("double")
    p = table(spark, sf_dir, "orders").select(k.alias("k"), a.alias("x"), F.when(k % 2 == 0, 5.0).otherwise(b).alias("y"), b.alias("z"))
    each = points.fit_faces(p, "k").select("k", F.posexplode(points.face_corners()).alias("corner", "c"))
    return each.select("k", F.col("corner").cast("long").alias("corner"), *[F.round(F.col(f"c.{d}"), 3).alias(d) for d in "xyz"])


_HOLED = f"""{views.TIN}, cut AS (SELECT (face_id // 2) // (s - 1) // 17 * 1000 + (face_id // 2) % (s - 1) // 23 AS surface, a, b, c FROM v_faces, v_side WHERE NOT ((face_id // 2) // (s - 1) % 5 = 2 AND (face_id // 2) % (s - 1) % 7 = 3)),
d AS (SELECT surface, a AS u, b AS v FROM cut UNION ALL SELECT surface, b, c FROM cut UNION ALL SELECT surface, c, a FROM cut),
e AS MATERIALIZED (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM d r WHERE r.surface = d.surface AND r.u = d.v AND r.v = d.u)),
w AS (SELECT surface, u AS start, u AS vertex, v, 0 AS seq, u AS least FROM e UNION ALL SELECT w.surface, start, e.u, e.v, seq + 1, least(least, e.u) FROM w JOIN e ON e.surface = w.surface AND e.u = w.v WHERE e.u > start)"""


@query(f"WITH RECURSIVE {_HOLED} SELECT w.surface, start AS ring, vertex, CAST(seq AS BIGINT) AS seq FROM w JOIN (SELECT surface, start FROM w WHERE v = start) USING (surface, start)")
def tin_boundary_rings(spark, sf_dir):
    """Outlines and holes of surfaces cut out of the grid in blocks of 17 by 23 squares, every some of which is missing."""
    q = views.grid_side(spark, sf_dir) - 1
    square = F.floor(F.col("face_id") / 2).cast("long")
    row, col = F.floor(square / q).cast("long"), square % q
    faces = views.grid_faces(spark, sf_dir).filter(~((row % 5 == 2) & (col % 7 == 3)))
    cut = faces.select((F.floor(row / 17) * 1000 + F.floor(col / 23)).cast("long").alias("surface"), "a", "b", "c")
    return mesh.boundary_rings(cut, "surface").select("surface", "ring", "vertex", "seq")
