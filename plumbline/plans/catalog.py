"""Registered queries over the survey views, each beside its SQL form."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as geo
from plumbline.functions import las, text
from plumbline.operators import listing, mesh, octree, points, project, selection
from plumbline.plans import views
from plumbline.sources.tables import shared_dir, table
from plumbline.streaming import state

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: A concave work area, and a box and a camera over the points' square of 1000 units.
RING = [(100.0, 100.0), (900.0, 150.0), (700.0, 500.0), (850.0, 900.0), (400.0, 650.0), (120.0, 880.0)]
BOX = ((200.0, 300.0, 20.0), (600.0, 800.0, 150.0))
CAMERA, SCALE, THRESHOLD = (500.0, 500.0, 1200.0), 1000.0, 400.0
CELL = 50.0


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL form."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c, name):
    return F.round(c, 6).alias(name)


def crossings(x: str, y: str, ring=RING) -> str:
    """SQL for the even-odd rule with half-open edges."""
    each = [
        f"CAST((({ay} > {y}) <> ({by} > {y})) AND {x} < ({bx - ax} * ({y} - {ay}) / {by - ay} + {ax}) AS INT)"
        for (ax, ay), (bx, by) in zip(ring, ring[-1:] + ring[:-1])
        if ay != by
    ]
    return f"(({' + '.join(each)}) % 2 = 1)"


P = f"WITH {views.POINTS}"
N = f"WITH {views.POINTS}, {views.nodes_sql()}"


@query(f"{P} SELECT idx, round(x,6) AS x, round(y,6) AS y, round(z,6) AS z, round(x-500,6) AS lx, round(y-500,6) AS ly FROM v_points")
def las_world_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.points(spark, sf_dir)
    return p.select("idx", *[r6(F.col(d), d) for d in "xyz"], r6(F.col("x") - 500, "lx"), r6(F.col("y") - 500, "ly"))


@query(f"""{P} SELECT return_number, number_of_returns, CASE WHEN return_number<=1 THEN 'first' WHEN return_number>=number_of_returns THEN 'last'
ELSE 'intermediate' END AS role, count(*) AS n FROM v_points GROUP BY ALL""")
def las_return_decode(spark, sf_dir):
    p = views.points(spark, sf_dir)
    role = las.return_role(F.col("return_number"), F.col("number_of_returns")).alias("role")
    return p.groupBy("return_number", "number_of_returns", role).agg(F.count("*").alias("n"))


@query(f"""{P} SELECT idx FROM v_points WHERE classification NOT IN (2,7,18) AND
NOT (return_number>1 AND return_number<number_of_returns)""")
def class_return_filter(spark, sf_dir):
    role = las.return_role(F.col("return_number"), F.col("number_of_returns"))
    return views.points(spark, sf_dir).filter(las.passes(F.col("classification"), role, [2, 7, 18], ["intermediate"])).select("idx")


@query(f"""{P} SELECT CASE classification {' '.join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(las.CLASS_NAMES))}
ELSE 'Class '||classification END AS label, count(*) AS n FROM v_points GROUP BY ALL""")
def class_label_histogram(spark, sf_dir):
    return views.points(spark, sf_dir).groupBy(las.class_label(F.col("classification")).alias("label")).agg(F.count("*").alias("n"))


@query(f"""{P} SELECT 'classification' AS attribute, classification AS value, count(*) AS n FROM v_points GROUP BY ALL
UNION ALL SELECT 'return_number', return_number, count(*) FROM v_points GROUP BY ALL
UNION ALL SELECT 'number_of_returns', number_of_returns, count(*) FROM v_points GROUP BY ALL""")
def attribute_counts(spark, sf_dir):
    return points.attribute_counts(views.points(spark, sf_dir), "classification", "return_number", "number_of_returns")


@query(f"""{P} SELECT min(intensity) AS lo_intensity, max(intensity) AS hi_intensity, min(r) AS lo_r, max(r) AS hi_r, max(return_number) AS most_returns,
count(DISTINCT classification) AS classes, count(*) AS n FROM v_points""")
def attribute_summary(spark, sf_dir):
    return views.points(spark, sf_dir).agg(
        F.min("intensity").alias("lo_intensity"), F.max("intensity").alias("hi_intensity"), F.min("r").alias("lo_r"), F.max("r").alias("hi_r"),
        F.max("return_number").alias("most_returns"), F.countDistinct("classification").alias("classes"), F.count("*").alias("n"),
    )


@query(f"{P}, k AS (SELECT greatest(1, CAST(ceil(count(*)/1000.0) AS BIGINT)) AS s FROM v_points) SELECT idx FROM v_points, k WHERE idx % s = 0")
def strided_sample(spark, sf_dir):
    return points.strided(views.points(spark, sf_dir), 1000).select("idx")


@query(f"""{P}, e AS (SELECT max(greatest(r,g,b)) > 255 AS u16 FROM v_points) SELECT idx, CASE WHEN u16 THEN r>>8 ELSE least(r,255) END AS r8,
CASE WHEN u16 THEN g>>8 ELSE least(g,255) END AS g8, CASE WHEN u16 THEN b>>8 ELSE least(b,255) END AS b8 FROM v_points, e""")
def rgb_normalize(spark, sf_dir):
    p = views.points(spark, sf_dir)
    kind = p.agg(las.rgb_encoding(F.max(F.greatest("r", "g", "b"))).alias("kind"))
    told = p.crossJoin(F.broadcast(kind))  # one row
    return told.select("idx", *[las.rgb_channel(F.col(c), F.col("kind")).alias(f"{c}8") for c in "rgb"])


@query(f"""{P}, t AS (SELECT idx, zi/19999.0::DOUBLE AS t FROM v_points) SELECT idx,
CAST(CASE WHEN t<=0.33 THEN 0 WHEN t<=0.66 THEN floor(255*((t-0.33::DOUBLE)/(0.66::DOUBLE-0.33::DOUBLE))+0.5) ELSE 255 END AS BIGINT) AS r,
CAST(CASE WHEN t<=0.33 THEN floor(200*(t/0.33::DOUBLE)+0.5) WHEN t<=0.66 THEN floor(200+55*((t-0.33::DOUBLE)/(0.66::DOUBLE-0.33::DOUBLE))+0.5)
ELSE floor(255-255*((t-0.66::DOUBLE)/(1.0::DOUBLE-0.66::DOUBLE))+0.5) END AS BIGINT) AS g,
CAST(CASE WHEN t<=0.33 THEN floor(255-255*(t/0.33::DOUBLE)+0.5) ELSE 0 END AS BIGINT) AS b FROM t""")
def terrain_ramp(spark, sf_dir):
    return views.points(spark, sf_dir).select("idx", las.terrain_color(F.col("zi") / F.lit(19999.0)).alias("c")).select("idx", "c.r", "c.g", "c.b")


@query(f"""{P}, b AS (SELECT count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM v_points)
SELECT n, round(x0,6) AS min_x, round(x1,6) AS max_x, round(z0,6) AS min_z, round(z1,6) AS max_z,
round(n/((x1-x0)*(y1-y0)),6) AS density, round(pow((x1-x0)*(y1-y0)*(z1-z0)/n, 1.0/3),6) AS spacing FROM b""")
def cloud_bbox_density(spark, sf_dir):
    b = points.spacing(points.bounds(views.points(spark, sf_dir)))
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    return b.select("n", *[r6(F.col(c), c) for c in ("min_x", "max_x", "min_z", "max_z")], r6(F.col("n") / area, "density"), r6(F.col("spacing"), "spacing"))


@query(f"{P} SELECT idx FROM v_points WHERE x BETWEEN 200 AND 600 AND y BETWEEN 300 AND 800 AND z BETWEEN 20 AND 150")
def box_crop(spark, sf_dir):
    return views.points(spark, sf_dir).filter(geo.in_box(F.col("x"), F.col("y"), F.col("z"), *BOX)).select("idx")


@query(f"""{P} SELECT count(*) AS inside, count(*) FILTER (classification<>2) AS inside_filtered FROM v_points WHERE {crossings('x', 'y')}""")
def polygon_count_half_open(spark, sf_dir):
    inside = views.points(spark, sf_dir).filter(geo.in_polygon(F.col("x"), F.col("y"), RING))
    return inside.agg(F.count("*").alias("inside"), F.count_if(F.col("classification") != 2).alias("inside_filtered"))


SQUARE = [(100.0, 100.0), (500.0, 100.0), (500.0, 500.0), (100.0, 500.0)]


@query(f"""{P} SELECT count(*) AS inside FROM v_points WHERE ({crossings('x', 'y', SQUARE)}) OR
(abs(x-100)*200<=1e-6 AND y BETWEEN 100-1e-6 AND 500+1e-6) OR (abs(x-500)*200<=1e-6 AND y BETWEEN 100-1e-6 AND 500+1e-6) OR
(abs(y-100)*200<=1e-6 AND x BETWEEN 100-1e-6 AND 500+1e-6) OR (abs(y-500)*200<=1e-6 AND x BETWEEN 100-1e-6 AND 500+1e-6)""")
def polygon_count_inclusive(spark, sf_dir):
    return views.points(spark, sf_dir).filter(geo.in_polygon_or_boundary(F.col("x"), F.col("y"), SQUARE)).agg(F.count("*").alias("inside"))


@query(f"{P} SELECT idx FROM v_points WHERE (x-500)*(x-500)+(y-500)*(y-500)+(z-100)*(z-100) <= 62500")
def range_clip(spark, sf_dir):
    return views.points(spark, sf_dir).filter(geo.within_range(F.col("x"), F.col("y"), F.col("z"), (500.0, 500.0, 100.0), 250.0)).select("idx")


@query(f"""{P}, c AS (SELECT CAST(floor(x/50) AS BIGINT) AS cx, CAST(floor(y/50) AS BIGINT) AS cy, CAST(floor(z/50) AS BIGINT) AS cz, count(*) AS n,
sum(xi) AS sx, sum(yi) AS sy, sum(zi) AS sz, sum(r) AS sr FROM v_points WHERE classification<>7 GROUP BY ALL), m AS (SELECT max(n) AS most FROM c)
SELECT cx, cy, cz, n, round(sx*0.01::DOUBLE/n,6) AS x, round(sy*0.01::DOUBLE/n,6) AS y, round(sz*0.01::DOUBLE/n,6) AS z,
CAST(floor(sr/n::DOUBLE+0.5) AS BIGINT) AS r FROM c, m WHERE n>=2 OR most<2""")
def voxel_surfels(spark, sf_dir):
    p = views.points(spark, sf_dir).filter("classification <> 7")
    cell = [F.floor(F.col(d) / CELL).cast("long").alias(f"c{d}") for d in "xyz"]
    # Grid coordinates are whole numbers, so that their sums are exact in any order.
    c = p.groupBy(*cell).agg(F.count("*").alias("n"), *[F.sum(f"{d}i").alias(f"s{d}") for d in "xyz"], F.sum("r").alias("sr"))
    kept = points.drop_small_cells(c)
    return kept.select(
        "cx", "cy", "cz", "n", *[r6(F.col(f"s{d}") * F.lit(0.01) / F.col("n"), d) for d in "xyz"],
        las.half_up(F.col("sr") / F.col("n")).cast("long").alias("r"),
    )


@query(f"""{P}, c AS (SELECT CAST(floor(x/100) AS BIGINT) AS cx, CAST(floor(y/100) AS BIGINT) AS cy, CAST(floor(z/100) AS BIGINT) AS cz, count(*) AS n,
sum(x) AS sx, sum(y) AS sy, sum(z) AS sz, sum(x*x) AS sxx, sum(x*y) AS sxy, sum(x*z) AS sxz, sum(y*y) AS syy, sum(y*z) AS syz, sum(z*z) AS szz
FROM v_points GROUP BY ALL) SELECT cx, cy, cz, n, round(sxx/n-sx/n*(sx/n),3) AS vxx, round(sxy/n-sx/n*(sy/n),3) AS vxy, round(sxz/n-sx/n*(sz/n),3) AS vxz,
round(syy/n-sy/n*(sy/n),3) AS vyy, round(syz/n-sy/n*(sz/n),3) AS vyz, round(szz/n-sz/n*(sz/n),3) AS vzz FROM c""")
def voxel_covariance(spark, sf_dir):
    c = points.covariance(points.voxel_sums(views.points(spark, sf_dir), 100.0, (0.0, 0.0, 0.0)))
    return c.select("cx", "cy", "cz", "n", *[F.round(f"v{x}", 3).alias(f"v{x}") for x in ("xx", "xy", "xz", "yy", "yz", "zz")])


@query()
def analytic_surfels(spark, sf_dir):
    """Surfels with normals, radius and confidence over all points."""
    return points.surfels(views.points(spark, sf_dir), CELL, CELL / 1.5, (0.0, 0.0, 0.0))


V = "v_vec AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


def _vectors(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.get(e, k).cast("double").alias(d) for k, d in enumerate("xyz")])


@query(f"""WITH {V}, m AS (SELECT label, count(*) AS n, avg(x) AS ox, avg(y) AS oy, avg(z) AS oz FROM v_vec GROUP BY label),
c AS (SELECT label, any_value(n) AS n, any_value(ox) AS ox, any_value(oy) AS oy, any_value(oz) AS oz, avg((x-ox)*(x-ox)) AS a, avg((y-oy)*(y-oy)) AS b,
avg((z-oz)*(z-oz)) AS d, avg((x-ox)*(y-oy)) AS xy, avg((x-ox)*(z-oz)) AS xz, avg((y-oy)*(z-oz)) AS yz FROM v_vec JOIN m USING (label) GROUP BY label),
q AS (SELECT *, (a+b+d)/3 AS q FROM c), p AS (SELECT *, sqrt(((a-q)*(a-q)+(b-q)*(b-q)+(d-q)*(d-q)+2*(xy*xy+xz*xz+yz*yz))/6) AS p FROM q),
t AS (SELECT *, acos(least(1,greatest(-1,(((a-q)/p)*(((b-q)/p)*((d-q)/p)-(yz/p)*(yz/p))-(xy/p)*((xy/p)*((d-q)/p)-(yz/p)*(xz/p))
+(xz/p)*((xy/p)*(yz/p)-((b-q)/p)*(xz/p)))/2)))/3 AS t FROM p)
SELECT label, n, round(ox,5) AS ox, round(oy,5) AS oy, round(oz,5) AS oz, round(sqrt(greatest(q+2*p*cos(t+2.0943951023931953),0)),5) AS rms,
round(q+2*p*cos(t),5) AS e3 FROM t""")
def plane_fit_by_label(spark, sf_dir):
    fit = points.fit_planes(_vectors(spark, sf_dir), "label")
    return fit.select("label", "n", *[F.round(c, 5).alias(c) for c in ("ox", "oy", "oz", "rms", "e3")])


@query(f"""{P}, r AS (SELECT classification, zi, row_number() OVER (PARTITION BY classification ORDER BY zi) AS k, count(*) OVER (PARTITION BY classification) AS n FROM v_points)
SELECT classification, n, max(CASE WHEN k-1=floor((n-1)*0.5) THEN zi END) AS p50, max(CASE WHEN k-1=floor((n-1)*0.9) THEN zi END) AS p90 FROM r GROUP BY ALL""")
def percentile_floor_index(spark, sf_dir):
    p = views.points(spark, sf_dir)
    return points.floor_percentiles(p, "zi", {"p50": 0.5, "p90": 0.9}, "classification").select("classification", "n", "p50", "p90")


@query(f"""{P}, q AS (SELECT i AS qid, (i%10)*100+50 AS qx, (i//10)*100+50 AS qy FROM range(100) t(i)),
d AS (SELECT qid, zi, row_number() OVER (PARTITION BY qid ORDER BY zi) AS k, count(*) OVER (PARTITION BY qid) AS n FROM q JOIN v_points
ON (x-qx)*(x-qx)+(y-qy)*(y-qy) <= 1600 WHERE classification<>7) SELECT qid, n, max(CASE WHEN k-1=floor((n-1)*0.1) THEN zi END) AS ground FROM d GROUP BY ALL HAVING n>=3""")
def ground_percentile_disc(spark, sf_dir):
    q = spark.range(100).select(F.col("id").alias("qid"), ((F.col("id") % 10) * 100 + 50).alias("qx"), (F.floor(F.col("id") / 10) * 100 + 50).alias("qy"))
    cell = lambda c: F.floor(c / 40).cast("long")
    near = F.explode(F.array(*[F.struct((cell(F.col("qx")) + i).alias("gx"), (cell(F.col("qy")) + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    looked = q.withColumn("g", near).select("qid", "qx", "qy", "g.*")
    p = views.points(spark, sf_dir).filter("classification <> 7").withColumns({"gx": cell(F.col("x")), "gy": cell(F.col("y"))})
    d2 = (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy"))
    met = looked.join(p, ["gx", "gy"]).filter(d2 <= 1600)
    return points.floor_percentile(met, "zi", 0.1, "qid").filter("n >= 3").select("qid", "n", F.col("value").alias("ground"))


@query(f"{N} SELECT level, nx, ny, nz, point_count AS n FROM v_nodes WHERE level<=3")
def octree_prefix_counts(spark, sf_dir):
    p = views.points(spark, sf_dir)
    return octree.prefix_counts(p, (0.0, 0.0, 0.0), (1000.0, 1000.0, 1000.0), 3).select("level", "nx", "ny", "nz", "n")


@query(f"""{P}, n AS (SELECT *, row_number() OVER (ORDER BY idx) AS k, count(*) OVER () AS n FROM v_points), s AS (SELECT *, greatest(1, n//200) AS step FROM n)
SELECT idx FROM s WHERE k%step=0 AND k//step<=200""")
def octree_root_ownership(spark, sf_dir):
    p = views.points(spark, sf_dir)
    owned = octree.own(p, (0.0, 0.0, 0.0), (1000.0, 1000.0, 1000.0), capacity=200, max_depth=3, block=1000)
    return owned.filter("level = 0").select("idx")


@query("SELECT count(*) AS stored, count(*) AS distinct_points, count(*) AS source FROM orders")
def octree_lossless(spark, sf_dir):
    p = views.points(spark, sf_dir)
    owned = octree.own(p, (0.0, 0.0, 0.0), (1000.0, 1000.0, 1000.0), capacity=256, max_depth=12, block=2000)
    return owned.agg(F.count("*").alias("stored"), F.countDistinct("idx").alias("distinct_points")).withColumn("source", F.lit(p.count()))


@query(f"""{P} SELECT idx FROM v_points WHERE x BETWEEN 200 AND 600 AND y BETWEEN 300 AND 800 AND z BETWEEN 20 AND 150
UNION ALL SELECT -1 UNION ALL SELECT -1""")
def octree_store(spark, sf_dir):
    """An index written, read back by a box, and compared with its source as a bag (rows -1, once a side, if nothing is missing or added)."""
    p, low, high = views.points(spark, sf_dir), (0.0, 0.0, 0.0), (1000.0, 1000.0, 1000.0)
    folder = f"{shared_dir(spark)}/plumbline/index-{uuid.uuid4().hex}"
    octree.write_index(octree.own(p, low, high, capacity=256, max_depth=12), folder, low, high, p.count())
    stored = octree.read_points(spark, folder).select(*p.columns)
    missing = listing.bag_difference(p, stored).select((F.lit(-1) - F.col("n")).alias("idx"))
    return octree.read_points(spark, folder, *BOX).select("idx").union(missing)


@query(f"""{P}, c AS (SELECT CAST(floor(x/250) AS BIGINT) AS nx, CAST(floor(y/250) AS BIGINT) AS ny, CAST(floor(z/250) AS BIGINT) AS nz, count(*) AS n
FROM v_points GROUP BY floor(x/{CELL}), floor(y/{CELL}), floor(z/{CELL}), 1, 2, 3)
SELECT 2 AS level, nx, ny, nz, count(*) AS surfels, CAST(sum(n) AS BIGINT) AS points, (SELECT count(*) FROM c) AS total FROM c WHERE nx%2=0 GROUP BY nx, ny, nz""")
def surfel_store(spark, sf_dir):
    """Surfels of the tiles of level 2, written and read back by tile; total is what the manifest tells."""
    cell = [F.floor(F.col(d) / 250).cast("long").alias(f"n{d}") for d in "xyz"]
    p = views.points(spark, sf_dir).select("*", F.lit(2).alias("level"), *cell)
    folder = f"{shared_dir(spark)}/plumbline/surfels-{uuid.uuid4().hex}"
    octree.write_surfels(points.voxel_sums(p, CELL, (0.0, 0.0, 0.0), *octree.NODE), folder)
    told = octree.read_manifest(spark, folder)["surfel_count"]
    tiles = spark.read.parquet(f"{folder}/nodes").filter("nx % 2 = 0")
    back = octree.read_surfels(spark, folder, tiles).groupBy(*octree.NODE).agg(F.count("*").alias("surfels"), F.sum("n").alias("points"))
    return back.withColumn("total", F.lit(told).cast("long"))


@query(f"""{P}, s AS (SELECT *, row_number() OVER (PARTITION BY classification ORDER BY idx) AS k FROM v_points WHERE idx%3=0)
SELECT classification, idx FROM s WHERE k<=20""")
def preview_leaf_sample(spark, sf_dir):
    return points.capped_sample(views.points(spark, sf_dir), 3, 20, "classification").select("classification", "idx")


@query(f"""{P}, b AS (SELECT DISTINCT CAST(floor(x/250) AS BIGINT) AS cx, CAST(floor(y/250) AS BIGINT) AS cy, idx//16 AS k FROM v_points WHERE z<20),
i AS (SELECT *, k-row_number() OVER (PARTITION BY cx,cy ORDER BY k) AS g FROM b) SELECT cx, cy, min(k) AS start, count(*) AS blocks FROM i GROUP BY cx, cy, g""")
def source_range_islands(spark, sf_dir):
    p = views.points(spark, sf_dir).filter("z < 20")
    p = p.withColumns({f"c{d}": F.floor(F.col(d) / 250).cast("long") for d in "xy"})
    return points.ranges(p, 16, "cx", "cy")


SSE_SQL = f"""scored AS (SELECT *, sqrt(pow(greatest(min_x-500,0,500-max_x),2)+pow(greatest(min_y-500,0,500-max_y),2)+pow(greatest(min_z-1200,0,1200-max_z),2)) AS distance,
sqrt(3.0)*(max_x-min_x)*{SCALE} AS e FROM v_nodes), sse AS (SELECT *, CASE WHEN distance<=1e-6 THEN 'Infinity'::DOUBLE ELSE e/distance END AS sse FROM scored)"""


@query(f"{N}, {SSE_SQL} SELECT key, level, point_count, round(distance,4) AS distance, round(sse,4) AS sse FROM sse")
def node_sse_scores(spark, sf_dir):
    s = selection.score(views.nodes(spark, sf_dir), CAMERA, SCALE)
    return s.select("key", "level", "point_count", F.round("distance", 4).alias("distance"), F.round("sse", 4).alias("sse"))


@query(f"""{N}, {SSE_SQL} SELECT key, point_count FROM sse s WHERE NOT EXISTS (SELECT 1 FROM sse a WHERE a.level<s.level AND a.nx=(s.nx>>CAST(s.level-a.level AS INT))
AND a.ny=(s.ny>>CAST(s.level-a.level AS INT)) AND a.nz=(s.nz>>CAST(s.level-a.level AS INT)) AND a.sse<=1200)""")
def unbudgeted_sse_selection(spark, sf_dir):
    return selection.select_by_error(views.nodes(spark, sf_dir), CAMERA, SCALE, 1200.0).select("key", "point_count")


@query()
def budgeted_sse_selection(spark, sf_dir):
    n = views.nodes(spark, sf_dir).withColumn("cloud", F.lit("c"))
    return selection.select_within_budget(n, CAMERA, SCALE, 600.0, 20_000)


@query(f"{N} SELECT level, count(*) AS nodes, CAST(sum(point_count) AS BIGINT) AS points FROM v_nodes WHERE max_x>=250 AND min_x<=600 AND max_y>=100 AND min_y<=480 GROUP BY level")
def region_node_estimate(spark, sf_dir):
    n = selection.region(views.nodes(spark, sf_dir), (250.0, 100.0), (600.0, 480.0))
    return n.groupBy("level").agg(F.count("*").alias("nodes"), F.sum("point_count").alias("points"))


@query(f"""{N}, c AS (SELECT (min_x+max_x)/2 AS centre, sum(point_count) AS w FROM v_nodes WHERE max_x>=250 AND min_x<=600 AND max_y>=100 AND min_y<=480 GROUP BY ALL),
r AS (SELECT centre, sum(w) OVER (ORDER BY centre) AS upto, sum(w) OVER () AS total FROM c)
SELECT least(greatest(min(centre), 250+350*0.05), 600-350*0.05)::DOUBLE AS cut FROM r WHERE upto>=total/2""")
def weighted_median_split(spark, sf_dir):
    return selection.median_split(views.nodes(spark, sf_dir), (250.0, 100.0), (600.0, 480.0))


@query("""WITH l AS (SELECT event_id AS key, user_id%20 AS viewer, user_id%97+1 AS points, CAST(epoch_us(ts) AS BIGINT) AS used, event_id%4=0 AS held FROM events),
t AS (SELECT *, sum(points) OVER (PARTITION BY viewer) AS total FROM l), f AS (SELECT *, coalesce(sum(points) OVER (PARTITION BY viewer ORDER BY used, key
ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS gone FROM t WHERE NOT held) SELECT viewer, key FROM f WHERE total-gone>10000""")
def lru_eviction(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("key"), (F.col("user_id") % 20).alias("viewer"), (F.col("user_id") % 97 + 1).alias("points"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("last_used"), (F.col("event_id") % 4 == 0).alias("held"),
    )
    return selection.evict(e, 10_000, "viewer").select("viewer", "key")


@query()
def lod_stride_budget(spark, sf_dir):
    n = selection.score(views.nodes(spark, sf_dir), CAMERA, SCALE).filter("level = 3")
    rows = n.select(F.xxhash64("key").alias("idx"), F.col("point_count").alias("n"), "distance", F.lit("c").alias("cloud"))
    return rows.groupBy("cloud").applyInPandas(lambda r: selection.strides_within_budget(r, 4000), "idx long, n long, stride int")


@query(f"""{N}, s AS (SELECT level, nx, ny, nz FROM v_nodes WHERE point_count%5=1), a AS (SELECT s.level AS l, n.level, n.nx, n.ny, n.nz FROM s JOIN v_nodes n
ON n.level<=s.level AND n.nx=(s.nx>>CAST(s.level-n.level AS INT)) AND n.ny=(s.ny>>CAST(s.level-n.level AS INT)) AND n.nz=(s.nz>>CAST(s.level-n.level AS INT)))
SELECT level, nx, ny, nz, max(l) AS finest FROM a GROUP BY ALL""")
def finest_visible_levels(spark, sf_dir):
    n = views.nodes(spark, sf_dir)
    return selection.finest_visible(n, n.filter(F.col("point_count") % 5 == 1).select("key"))


T = f"WITH {views.TIN}"
EDGES = f"""{T}, e AS (SELECT least(a,b) AS lo, greatest(a,b) AS hi FROM v_faces UNION ALL SELECT least(b,c), greatest(b,c) FROM v_faces
UNION ALL SELECT least(c,a), greatest(c,a) FROM v_faces)"""


@query(f"{EDGES} SELECT DISTINCT lo, hi FROM e")
def tin_unique_edges(spark, sf_dir):
    return mesh.unique_edges(views.grid_faces(spark, sf_dir))


@query(f"{EDGES} SELECT lo, hi FROM e GROUP BY ALL HAVING count(*)=1")
def tin_boundary_edges(spark, sf_dir):
    return mesh.boundary_edges(views.grid_faces(spark, sf_dir))


@query(f"""{T}, f AS (SELECT a, b, c, (q.y-p.y)*(r.z-p.z)-(q.z-p.z)*(r.y-p.y) AS fx, (q.z-p.z)*(r.x-p.x)-(q.x-p.x)*(r.z-p.z) AS fy,
(q.x-p.x)*(r.y-p.y)-(q.y-p.y)*(r.x-p.x) AS fz FROM v_faces JOIN v_vertices p ON a=p.vertex_id JOIN v_vertices q ON b=q.vertex_id JOIN v_vertices r ON c=r.vertex_id),
s AS (SELECT v AS vertex_id, sum(fx) AS x, sum(fy) AS y, sum(fz) AS z FROM (SELECT unnest([a,b,c]) AS v, fx, fy, fz FROM f) GROUP BY v)
SELECT vertex_id, round(x/sqrt(x*x+y*y+z*z),6) AS nx, round(y/sqrt(x*x+y*y+z*z),6) AS ny, round(z/sqrt(x*x+y*y+z*z),6) AS nz FROM s""")
def tin_vertex_normals(spark, sf_dir):
    n = mesh.vertex_normals(views.grid_faces(spark, sf_dir), views.grid_vertices(spark, sf_dir))
    return n.select("vertex_id", *[r6(F.col(c), c) for c in ("nx", "ny", "nz")])


@query()
def tin_boundary_loops(spark, sf_dir):
    return mesh.boundary_loops(views.grid_faces(spark, sf_dir).withColumn("surface_id", F.lit("s")))


@query(f"""{T}, p AS (SELECT event_id AS point_id, user_id%50 AS line, (event_id*37)%700 + 0.25::DOUBLE AS x, (event_id*91)%700 + 0.5::DOUBLE AS y FROM events),
t AS (SELECT p.x AS ax,p.y AS ay,p.z AS az,q.x AS bx,q.y AS by_,q.z AS bz,r.x AS cx,r.y AS cy,r.z AS cz FROM v_faces JOIN v_vertices p ON a=p.vertex_id
JOIN v_vertices q ON b=q.vertex_id JOIN v_vertices r ON c=r.vertex_id),
w AS (SELECT point_id, az, bz, cz, ((x-ax)*(cy-ay)-(cx-ax)*(y-ay))/((bx-ax)*(cy-ay)-(cx-ax)*(by_-ay)) AS wb,
((bx-ax)*(y-ay)-(x-ax)*(by_-ay))/((bx-ax)*(cy-ay)-(cx-ax)*(by_-ay)) AS wc FROM p JOIN t ON x BETWEEN least(ax,bx,cx) AND greatest(ax,bx,cx) AND y BETWEEN least(ay,by_,cy) AND greatest(ay,by_,cy)),
h AS (SELECT point_id, max(az+wb*(bz-az)+wc*(cz-az))+0.05::DOUBLE AS z FROM w WHERE wb>=-1e-12 AND wc>=-1e-12 AND wb+wc<=1+1e-12 GROUP BY point_id),
j AS (SELECT p.*, z FROM p LEFT JOIN h USING (point_id))
SELECT point_id, round(last_value(z IGNORE NULLS) OVER (PARTITION BY line ORDER BY point_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),6) AS z FROM j""")
def drape_points_on_tin(spark, sf_dir):
    e = F.col("event_id")
    p = table(spark, sf_dir, "events").select(
        e.alias("point_id"), (F.col("user_id") % 50).alias("line"), ((e * 37) % 700 + 0.25).alias("x"), ((e * 91) % 700 + 0.5).alias("y")
    )
    told = mesh.drape(p, views.grid_faces(spark, sf_dir), views.grid_vertices(spark, sf_dir), 20.0)
    return mesh.carry_last(told, "draped", "point_id", "line").select("point_id", r6(F.col("draped"), "z"))


LINES = "v_lines AS (SELECT o_custkey AS line, o_orderkey AS seq, CAST((o_orderkey*7919)%1000 AS DOUBLE) AS x, CAST((o_orderkey*104729)%1000 AS DOUBLE) AS y FROM orders)"


def _lines(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("line"), k.alias("seq"), ((k * 7919) % 1000).cast("double").alias("x"), ((k * 104729) % 1000).cast("double").alias("y")
    )


@query(f"""WITH {LINES}, n AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM v_lines WINDOW w AS (PARTITION BY line ORDER BY seq)),
k AS (SELECT *, coalesce(greatest(ceil(sqrt((x1-x)*(x1-x)+(y1-y)*(y1-y))/100),1),1) AS m FROM n), u AS (SELECT *, unnest(range(CAST(m AS BIGINT))) AS part FROM k)
SELECT line, seq, CAST(part AS INT) AS part, round(coalesce(x+(x1-x)*(part/m),x),6) AS x, round(coalesce(y+(y1-y)*(part/m),y),6) AS y FROM u""")
def polyline_densify(spark, sf_dir):
    d = mesh.densify(_lines(spark, sf_dir), 100.0, "line")
    return d.select("line", "seq", "part", r6(F.col("x"), "x"), r6(F.col("y"), "y"))


@query(f"""WITH {LINES}, n AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM v_lines WINDOW w AS (PARTITION BY line ORDER BY seq))
SELECT line, round(coalesce(sum(sqrt((x-x0)*(x-x0)+(y-y0)*(y-y0))),0),5) AS length FROM n GROUP BY line""")
def polyline_length(spark, sf_dir):
    return mesh.polyline_lengths(_lines(spark, sf_dir), "line").select("line", F.round("length", 5).alias("length"))


@query(f"""WITH {LINES}, n AS (SELECT line, x, y, coalesce(lead(x) OVER w, first(x) OVER w) AS x1, coalesce(lead(y) OVER w, first(y) OVER w) AS y1 FROM v_lines
WINDOW w AS (PARTITION BY line ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT line, sum(x*y1-x1*y)/2 AS area FROM n GROUP BY line""")
def ring_shoelace(spark, sf_dir):
    return mesh.ring_areas(_lines(spark, sf_dir), "line")


@query(f"""WITH g AS (SELECT i%40 AS i, i//40 AS j, 100+12.5+(i%40)*25.0::DOUBLE AS x, 100+12.5+(i//40)*25.0::DOUBLE AS y FROM range(1600) t(i)) SELECT i, j FROM g WHERE {crossings('x', 'y')}""")
def grid_points_in_region(spark, sf_dir):
    g = spark.range(1600).select((F.col("id") % 40).alias("i"), F.floor(F.col("id") / 40).cast("long").alias("j"))
    x, y = 112.5 + F.col("i") * 25.0, 112.5 + F.col("j") * 25.0
    return g.filter(geo.in_polygon(x, y, RING))


@query(f"""{P}, q AS (SELECT i AS query_id, ((i*613)%1000)::DOUBLE AS qx, ((i*457)%1000)::DOUBLE AS qy FROM range(300) t(i)),
d AS (SELECT query_id, idx AS seq, classification%6 AS precedence, sqrt((x-qx)*(x-qx)+(y-qy)*(y-qy)) AS distance FROM q JOIN v_points ON x BETWEEN qx-14 AND qx+14 AND y BETWEEN qy-14 AND qy+14)
SELECT query_id, seq, round(distance,6) AS distance, precedence FROM d WHERE distance<=14 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY precedence, distance, seq DESC)=1""")
def snap_nearest(spark, sf_dir):
    q = spark.range(300).select(F.col("id").alias("query_id"), ((F.col("id") * 613) % 1000).cast("double").alias("qx"), ((F.col("id") * 457) % 1000).cast("double").alias("qy"))
    c = views.points(spark, sf_dir).select(F.col("idx").alias("seq"), (F.col("classification") % 6).alias("precedence"), "x", "y")
    return points.nearest_within(q, c, 14.0, "precedence").select("query_id", "seq", r6(F.col("distance"), "distance"), "precedence")


@query(f"""{P}, k AS (SELECT idx, CAST(least(greatest(floor((x-100)/800.0*32),0),31) AS BIGINT) AS px, CAST(least(greatest(floor((900-y)/800.0*16),0),15) AS BIGINT) AS py
FROM v_points WHERE x BETWEEN 100 AND 900 AND y BETWEEN 100 AND 900) SELECT idx, px, py, (px*31+py*17)%256 AS red FROM k""")
def raster_pixel_lookup(spark, sf_dir):
    pixel = geo.raster_pixel(F.col("x"), F.col("y"), (100.0, 100.0), (900.0, 900.0), 32, 16).alias("p")
    at = views.points(spark, sf_dir).select("idx", pixel).filter("p IS NOT NULL").select("idx", "p.px", "p.py")
    raster = spark.range(512).select((F.col("id") % 32).alias("px"), F.floor(F.col("id") / 32).cast("long").alias("py"))
    raster = raster.withColumn("red", (F.col("px") * 31 + F.col("py") * 17) % 256)
    return at.join(raster, ["px", "py"]).select("idx", "px", "py", "red")


@query("""SELECT page_id, CASE WHEN contains(substr(html,1,4096),'<LandXML') THEN 'landxml' WHEN contains(substr(html,1,4096),'#Carlson DTM') THEN 'carlson-dtm'
WHEN contains(substr(html,1,4096),'AutoCAD') OR regexp_matches(substr(html,1,4096),'(^|\\r?\\n)[ \\t]*0[ \\t]*\\r?\\n[ \\t]*SECTION') THEN 'dxf'
WHEN regexp_matches(html,'^AC10[0-9][0-9]') THEN 'dwg' WHEN starts_with(html,'%PDF-') THEN 'pdf' WHEN starts_with(html,'LASF') THEN 'las'
WHEN lower(split_part(url,'.',-1)) IN ('xml') THEN 'landxml' WHEN lower(split_part(url,'.',-1)) IN ('tif','tiff','geotiff') THEN 'geotiff'
WHEN lower(split_part(url,'.',-1)) IN ('dxf','dwg','pdf','las') THEN lower(split_part(url,'.',-1)) WHEN lower(split_part(url,'.',-1))='tin' THEN 'carlson-dtm' ELSE 'unknown' END AS format FROM pages""")
def format_sniff(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.sniff(F.col("url"), F.col("html")).alias("format"))


@query("""WITH t AS (SELECT unnest(regexp_extract_all(html,'<([a-zA-Z][a-zA-Z0-9:]*)',1)) AS element FROM pages) SELECT element, count(*) AS n FROM t GROUP BY ALL""")
def markup_element_census(spark, sf_dir):
    found = F.explode(F.regexp_extract_all(F.col("html"), F.lit("<([a-zA-Z][a-zA-Z0-9:]*)"), F.lit(1))).alias("element")
    return table(spark, sf_dir, "pages").select(found).groupBy("element").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,4))::VARCHAR AS s FROM lineitem)
SELECT length(regexp_extract(s,'\\.([0-9]*)',1)) AS decimals, count(*) AS n FROM t GROUP BY ALL""")
def literal_precision(spark, sf_dir):
    s = F.col("l_extendedprice").cast("decimal(18,4)").cast("string")
    return table(spark, sf_dir, "lineitem").groupBy(text.decimals(s).cast("long").alias("decimals")).agg(F.count("*").alias("n"))


@query("""SELECT page_id, length(replace(replace(replace(replace(replace(html,'&','&amp;'),'<','&lt;'),'>','&gt;'),'"','&quot;'),'''','&apos;')) AS n FROM pages""")
def xml_escape_length(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(text.escape_xml(F.col("html"))).cast("long").alias("n"))


@query(f"WITH {views.EVIDENCE} SELECT feature_id, count(*) FILTER (kind NOT IN ('picked-coordinate','manual-note')) AS snapped, count(*) FILTER (kind IN ('picked-coordinate','manual-note')) AS free FROM v_evidence GROUP BY ALL")
def evidence_split(spark, sf_dir):
    return project.evidence_split(views.evidence(spark, sf_dir))


@query(f"WITH {views.FEATURES} " + " UNION ALL ".join(
    f"SELECT '{tab}' AS tab, count(*) FILTER (family='{f}'" + (f" OR (family IS NULL AND type='{t}')" if t else "") + ") AS n FROM v_features"
    for tab, (f, t) in project.FAMILIES.items()
))
def family_tab_counts(spark, sf_dir):
    return project.tab_counts(views.features(spark, sf_dir))


@query(f"""WITH {views.ASSETS}, s AS (SELECT asset_id FROM v_assets WHERE kind='point-cloud') SELECT asset_id AS source_id, asset_id FROM s
UNION ALL SELECT source_asset_id, asset_id FROM v_assets WHERE kind<>'point-cloud' AND source_asset_id IN (SELECT asset_id FROM s)""")
def asset_group_members(spark, sf_dir):
    return project.asset_groups(views.assets(spark, sf_dir))


@query(f"""WITH {views.ASSETS} SELECT s.asset_id AS source_id, v.view FROM v_assets s, (VALUES ('index','point-cloud-index'),('surfel','analytic-surfel-render')) v(view,kind)
WHERE s.kind='point-cloud' AND NOT EXISTS (SELECT 1 FROM v_assets a WHERE a.source_asset_id=s.asset_id AND a.kind=v.kind)""")
def missing_views(spark, sf_dir):
    return project.missing_views(views.assets(spark, sf_dir))


@query(f"""WITH {views.ASSETS}, c AS (SELECT asset_id, CASE WHEN asset_id%4=0 THEN header_sha256||'x' ELSE header_sha256 END AS h, file_size+(asset_id%6)//5 AS f,
CASE WHEN asset_id%3=0 THEN NULL ELSE mtime_ms+asset_id%2 END AS m FROM v_assets WHERE asset_id%9<>0)
SELECT a.asset_id, concat_ws(',', CASE WHEN c.asset_id IS NULL THEN 'source-missing' END, CASE WHEN h<>header_sha256 THEN 'header-sha-changed' END,
CASE WHEN f<>file_size THEN 'file-size-changed' END, CASE WHEN m<>mtime_ms THEN 'mtime-changed' END) AS reasons FROM v_assets a LEFT JOIN c USING (asset_id)""")
def staleness_reasons(spark, sf_dir):
    a = views.assets(spark, sf_dir)
    k = F.col("asset_id")
    current = a.filter(k % 9 != 0).select(
        k, F.when(k % 4 == 0, F.concat("header_sha256", F.lit("x"))).otherwise(F.col("header_sha256")).alias("header_sha256"),
        (F.col("file_size") + F.floor((k % 6) / 5)).alias("file_size"), F.when(k % 3 != 0, F.col("mtime_ms") + k % 2).alias("mtime_ms"),
    )
    return project.staleness(a, current).select("asset_id", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {views.FEATURES} SELECT feature_id, layer_id FROM v_features WHERE layer_id IS NOT NULL AND layer_id NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey%4<>0)")
def fk_violations(spark, sf_dir):
    layers = table(spark, sf_dir, "nation").filter("n_nationkey % 4 <> 0")
    return project.foreign_keys(views.features(spark, sf_dir), "layer_id", layers, "n_nationkey").select("feature_id", "layer_id")


def _steps(units, factor: int, line) -> str:
    return " ".join(line(unit, factor ** (len(units) - 1 - k)) for k, unit in enumerate(units))


@query(f"""WITH n AS (SELECT o_orderkey, CAST(o_orderkey AS BIGINT)*o_orderkey*o_orderkey AS n FROM orders) SELECT o_orderkey, CASE
{_steps(("TB", "GB", "MB", "KB", "B"), 1024, lambda u, s: f"WHEN n>={s} THEN CASE WHEN n/{s}.0>=100 THEN printf('%.0f {u}',floor(n/{s}.0::DOUBLE+0.5)) ELSE printf('%.1f {u}',floor(n/{s}.0::DOUBLE*10+0.5)/10) END" if s > 1 else "ELSE n||' B'")} END AS label FROM n""")
def byte_size_label(spark, sf_dir):
    """Sizes are decimals, since cubes of keys from 2 097 152 on pass a long (where the SQL ends with an error)."""
    k = F.col("o_orderkey").cast("decimal(38,0)")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.byte_size(k * k * k).alias("label"))


@query(f"""WITH n AS (SELECT o_orderkey, CAST(o_orderkey AS BIGINT)*o_orderkey AS n FROM orders), t AS (SELECT *, {", ".join(f"(n*10*2+{s})//({s}*2) AS t{u}, (n*2+{s})//({s}*2) AS w{u}" for u, s in (("B", 10**9), ("M", 10**6), ("K", 10**3)))} FROM n)
SELECT o_orderkey, CASE {" ".join(f"WHEN n>={s - s // 2000} THEN (CASE WHEN t{u}<1000 THEN (t{u}//10)||CASE WHEN t{u}%10<>0 THEN '.'||(t{u}%10) ELSE '' END ELSE CAST(w{u} AS VARCHAR) END)||'{u}'" for u, s in (("B", 10**9), ("M", 10**6)))}
WHEN n>=999.5 THEN (CASE WHEN tK<1000 THEN (tK//10)||CASE WHEN tK%10<>0 THEN '.'||(tK%10) ELSE '' END ELSE CAST(wK AS VARCHAR) END)||'K' ELSE CAST(n AS VARCHAR) END AS label FROM t""")
def compact_number_label(spark, sf_dir):
    k = F.col("o_orderkey").cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.compact(k * k).alias("label"))


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, value, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS k FROM events),
e AS (SELECT user_id, event_id, k, ms, value AS ema FROM o WHERE k=1 UNION ALL SELECT o.user_id, o.event_id, o.k, o.ms, e.ema+(1-exp(-(o.ms-e.ms)/180.0::DOUBLE))*(o.value-e.ema) FROM e JOIN o ON o.user_id=e.user_id AND o.k=e.k+1)
SELECT user_id, event_id, round(ema,6) AS ema FROM e""")
def ema_ground_follow(spark, sf_dir):
    """Exponential smoothing along each track, by the step that the stream takes; times are rounded to milliseconds, not cut off."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("long").alias("track"), F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("ts_ms"), F.col("event_id").cast("long").alias("seq"), F.col("value").cast("double").alias("z")
    )
    return state.follow_table(e).select(F.col("track").alias("user_id"), F.col("seq").alias("event_id"), r6(F.col("level"), "ema"))


RADIUS = "((nx*7+ny*13+nz*5+level*11)%101)"


@query(f"""{N}, r AS (SELECT key, level, nx, ny, nz, {RADIUS} AS radius FROM v_nodes), k AS (SELECT a.key AS a, b.key AS b, a.radius AS ra, b.radius AS rb FROM r a JOIN r b ON b.level<a.level
AND b.nx=(a.nx>>CAST(a.level-b.level AS INT)) AND b.ny=(a.ny>>CAST(a.level-b.level AS INT)) AND b.nz=(a.nz>>CAST(a.level-b.level AS INT))),
d AS (SELECT a AS key FROM k WHERE rb>=ra UNION SELECT b FROM k WHERE ra>rb) SELECT key, radius FROM r WHERE key NOT IN (SELECT key FROM d) ORDER BY radius DESC, key LIMIT 20""")
def largest_surfels_topk(spark, sf_dir):
    """The largest of the tiles' surfels that no larger one above or below them in the tree stands for."""
    n = views.nodes(spark, sf_dir).withColumn("radius", F.expr(RADIUS))
    return selection.without_kin(n, "radius").orderBy(F.col("radius").desc(), "key").limit(20).select("key", "radius")
