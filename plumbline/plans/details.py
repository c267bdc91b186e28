"""More registered queries: appearance, selection by screen, layers, slopes, arcs, edits and checks."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from plumbline.functions import geometry as geo
from plumbline.functions import las, text
from plumbline.operators import points, project, selection
from plumbline.plans import views
from plumbline.plans.catalog import CAMERA, SCALE, N, P, SSE_SQL, query, r6
from plumbline.sources.tables import table


@query(f"""{N}, a AS (SELECT key, level, min_x, max_x, min_y, max_y, min_z, max_z FROM v_nodes WHERE level=3), b AS (SELECT * FROM a)
SELECT b.key AS left_key, a.key AS right_key FROM b JOIN a ON b.key<a.key AND a.max_x>=b.min_x AND a.min_x<=b.max_x AND a.max_y>=b.min_y AND a.min_y<=b.max_y
AND a.max_z>=b.min_z AND a.min_z<=b.max_z""")
def box_overlap_pairs(spark, sf_dir):
    """Touching boxes of one level: neighbours differ by one cell at most, so that cells make an equi-join."""
    n = views.nodes(spark, sf_dir).filter("level = 3")
    step = F.explode(F.array(*[F.struct(*[F.lit(v).alias(d) for v, d in zip((i, j, k), "xyz")]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]))
    left = n.select(F.col("key").alias("left_key"), "nx", "ny", "nz", *[F.col(b).alias(f"l_{b}") for b in selection.BOX], step.alias("s"))
    left = left.select("left_key", *[(F.col(f"n{d}") + F.col(f"s.{d}")).alias(f"n{d}") for d in "xyz"], *[f"l_{b}" for b in selection.BOX])
    met = left.join(n, ["nx", "ny", "nz"]).filter(F.col("left_key") < F.col("key"))
    touch = geo.overlaps({b: F.col(f"l_{b}") for b in selection.BOX}, {b: F.col(b) for b in selection.BOX})
    return met.filter(touch).select("left_key", F.col("key").alias("right_key"))


@query(f"{N}, {SSE_SQL} SELECT key FROM sse WHERE distance<=1100")
def boxes_within_distance(spark, sf_dir):
    return selection.score(views.nodes(spark, sf_dir), CAMERA, SCALE).filter("distance <= 1100").select("key")


@query("SELECT i AS depth, greatest(128, 4096>>CAST(i AS INT)) AS fast, greatest(16, 512>>CAST(i AS INT)) AS balanced, greatest(1, 64>>CAST(i AS INT)) AS every FROM range(10) t(i)")
def tier_strides(spark, sf_dir):
    d = F.col("id").cast("int")
    return spark.range(10).select(F.col("id").alias("depth"), *[las.tier_stride(t, d).alias(n) for t, n in (("fast", "fast"), ("balanced", "balanced"), ("all-detail", "every"))])


@query(f"""{P} SELECT idx FROM v_points WHERE z*0.5+100 > 0 AND (x-500)/(z*0.5+100)*300+400 BETWEEN 100 AND 500 AND (y-500)/(z*0.5+100)*300+300 BETWEEN 50 AND 350""")
def screen_rect_selection(spark, sf_dir):
    """Points whose projection by a 4 by 4 matrix lies in a rectangle of the screen."""
    x, y, z = (F.col(d) for d in "xyz")
    w = z * 0.5 + 100
    sx, sy = (x - 500) / w * 300 + 400, (y - 500) / w * 300 + 300
    return views.points(spark, sf_dir).filter((w > 0) & sx.between(100, 500) & sy.between(50, 350)).select("idx")


@query("""SELECT c_custkey AS layer_id, CASE WHEN c_custkey%4<>0 THEN 'sheet' WHEN c_custkey%6=0 AND c_custkey%12=0 THEN 'point-cloud-index' WHEN c_custkey%5=0 THEN 'point-cloud-preview'
WHEN c_custkey%7=0 AND c_custkey%2=0 THEN 'derived-surfel' ELSE 'asset' END AS kind FROM customer""")
def layer_kinds(spark, sf_dir):
    k = F.col("c_custkey")
    asset = F.when((k % 6 == 0) & (k % 12 == 0), "point-cloud-index").when(k % 5 == 0, "point-cloud").when(k % 7 == 0, "analytic-surfel-render").otherwise("raster")
    kind = project.layer_kind(F.when(k % 4 != 0, "sheet").otherwise("asset"), asset, F.when(k % 2 == 0, "derived").otherwise("source"))
    return table(spark, sf_dir, "customer").select(k.alias("layer_id"), kind.alias("kind"))


@query("""SELECT p_partkey AS asset_id, CASE p_partkey%4 WHEN 0 THEN 'outdated' WHEN 1 THEN 'stale' WHEN 2 THEN 'managed' ELSE 'other' END AS warning,
p_partkey%3=1 AND p_partkey%4 NOT IN (0,1) AS may_stream FROM part""")
def streaming_gate(spark, sf_dir):
    k = F.col("p_partkey")
    w = F.when(k % 4 == 0, "Index: format is outdated (v1)").when(k % 4 == 1, "Index: may be out of date").when(k % 4 == 2, "Index: source is missing").otherwise("note: out of date")
    kind = F.when(k % 3 == 1, "point-cloud-index").otherwise("point-cloud")
    return table(spark, sf_dir, "part").select(k.alias("asset_id"), project.warning_kind(w, "Index:").alias("warning"), project.may_stream(kind, F.array(w), "Index:").alias("may_stream"))


@query("""WITH l AS (SELECT n_nationkey AS layer, n_nationkey%8 AS color FROM nation WHERE n_nationkey%5<>0), e AS (SELECT c_custkey AS entity, c_nationkey AS layer,
CASE c_custkey%3 WHEN 0 THEN 256 WHEN 1 THEN 0 ELSE c_custkey%200+1 END AS color, c_custkey%9 AS inherited FROM customer)
SELECT entity, CASE e.color WHEN 256 THEN coalesce(l.color,7) WHEN 0 THEN inherited ELSE e.color END AS color FROM e LEFT JOIN l USING (layer)""")
def entity_colours(spark, sf_dir):
    k = F.col("c_custkey")
    layers = table(spark, sf_dir, "nation").filter("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("layer"), (F.col("n_nationkey") % 8).alias("by_layer"))
    e = table(spark, sf_dir, "customer").select(
        k.alias("entity"), F.col("c_nationkey").alias("layer"), F.when(k % 3 == 0, 256).when(k % 3 == 1, 0).otherwise(k % 200 + 1).alias("own"), (k % 9).alias("inherited")
    )
    shown = F.when(F.col("own") == 256, F.coalesce("by_layer", F.lit(7))).when(F.col("own") == 0, F.col("inherited")).otherwise(F.col("own"))
    return e.join(layers, "layer", "left").select("entity", shown.alias("color"))


@query("""WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
s AS (SELECT *, degrees(acos(abs(z)/sqrt(x*x+y*y+z*z))) AS slope, degrees(atan2(x,y)) AS a FROM v)
SELECT vec_id, round(slope,5) AS slope, (['N','NE','E','SE','S','SW','W','NW'])[CAST(floor((CASE WHEN a<0 THEN a+360 ELSE a END)/45+0.5) AS BIGINT)%8+1] AS aspect FROM s WHERE slope>=0.5""")
def slope_aspect(spark, sf_dir):
    e = F.col("embedding")
    v = table(spark, sf_dir, "embeddings").select("vec_id", *[F.get(e, k).cast("double").alias(d) for k, d in enumerate("xyz")])
    s = v.withColumn("slope", geo.slope_degrees(F.col("x"), F.col("y"), F.col("z"))).filter("slope >= 0.5")
    return s.select("vec_id", F.round("slope", 5).alias("slope"), geo.aspect_label(F.col("x"), F.col("y"), F.col("slope")).alias("aspect"))


@query("""WITH a AS (SELECT o_orderkey, o_orderkey%50+1.0::DOUBLE AS r, (o_orderkey%36+1)*10.0::DOUBLE AS deg FROM orders)
SELECT o_orderkey, CAST(least(greatest(ceil(radians(deg)/(2*acos(1-0.1::DOUBLE/r))),2),256) AS INT) AS segments FROM a""")
def arc_segment_counts(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k, geo.arc_segments(k % 50 + F.lit(1.0), F.radians((k % 36 + 1) * F.lit(10.0))).alias("segments"))


@query("""WITH a AS (SELECT o_orderkey, o_orderkey%50+1.0::DOUBLE AS r FROM orders), p AS (SELECT o_orderkey, r, unnest(range(9)) AS i FROM a)
SELECT o_orderkey, i, round(r*cos(radians(20)*i/8*9),6) AS x, round(r*sin(radians(20)*i/8*9),6) AS y FROM p""")
def arc_points(spark, sf_dir):
    k = F.col("o_orderkey")
    pts = geo.arc_points(F.lit(0.0), F.lit(0.0), k % 50 + F.lit(1.0), F.lit(0.0), F.lit(math.radians(180)), F.lit(8))
    return table(spark, sf_dir, "orders").select(k, F.posexplode(pts).alias("i", "p")).select("o_orderkey", F.col("i").cast("long").alias("i"), r6(F.col("p.x"), "x"), r6(F.col("p.y"), "y"))


@query("""WITH s AS (SELECT o_orderkey AS k, (o_orderkey*7)%100 AS px, (o_orderkey*13)%100 AS py, (o_orderkey*3)%50 AS ax, (o_orderkey*5)%50 AS ay, 50+(o_orderkey*11)%50 AS bx, 50+(o_orderkey*17)%50 AS by_ FROM orders),
t AS (SELECT *, least(greatest(((px-ax)*(bx-ax)+(py-ay)*(by_-ay))/((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay))::DOUBLE,0),1) AS t FROM s)
SELECT k, round(t,6) AS t, round(ax+t*(bx-ax),6) AS x, round(ay+t*(by_-ay),6) AS y FROM t""")
def closest_on_segment(spark, sf_dir):
    k = F.col("o_orderkey")
    d = table(spark, sf_dir, "orders").select(
        k.alias("k"), ((k * 7) % 100).alias("px"), ((k * 13) % 100).alias("py"), ((k * 3) % 50).alias("ax"), ((k * 5) % 50).alias("ay"), ((k * 11) % 50 + 50).alias("bx"), ((k * 17) % 50 + 50).alias("by"),
    )
    c = geo.closest_on_segment(F.col("px"), F.col("py"), (F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by")))
    return d.withColumn("c", c).select("k", r6(F.col("c.t"), "t"), r6(F.col("c.x"), "x"), r6(F.col("c.y"), "y"))


@query(f"""{P}, q AS (SELECT c_custkey AS qid, (c_custkey*613)%1000 + 0.5::DOUBLE AS qx, (c_custkey*457)%1000 + 0.25::DOUBLE AS qy FROM customer), r AS (SELECT unnest([0,1,2,3]) AS rung, unnest([1,2,4,8]) AS m, unnest([12,12,8,6]) AS least),
d AS (SELECT qid, rung, least, zi, row_number() OVER (PARTITION BY qid, rung ORDER BY zi) AS p, count(*) OVER (PARTITION BY qid, rung) AS n FROM q CROSS JOIN r JOIN v_points ON (x-qx)*(x-qx)+(y-qy)*(y-qy)<=10*m*10*m AND classification<>7),
g AS (SELECT qid, rung, n, max(CASE WHEN p-1=floor((n-1)*0.1) THEN zi END) AS z FROM d WHERE n>=least GROUP BY qid, rung, n) SELECT qid, arg_min(z, rung) AS ground, CAST(min(rung) AS BIGINT) AS rung, arg_min(n, rung) AS n FROM g GROUP BY qid""")
def ground_ladder(spark, sf_dir):
    """The low ground around each customer's place, in the first of four discs with enough points that are not noise."""
    k = F.col("c_custkey")
    q = table(spark, sf_dir, "customer").select(k.alias("query_id"), ((k * 613) % 1000 + 0.5).alias("qx"), ((k * 457) % 1000 + 0.25).alias("qy"))
    p = views.points(spark, sf_dir).filter("classification <> 7").select("x", "y", F.col("zi").alias("z"))
    return points.ground_ladder(q, p, 10.0).select(F.col("query_id").alias("qid"), "ground", F.col("rung").cast("long").alias("rung"), "n")


@query(f"{N}, {SSE_SQL} SELECT key, row_number() OVER (ORDER BY CASE WHEN level=0 THEN 0 ELSE 1 END, sse DESC, key) AS k FROM sse WHERE level<=2 ORDER BY k LIMIT 6")
def fetch_order(spark, sf_dir):
    """The next six tiles to fetch: pinned levels first, then the largest errors."""
    s = selection.score(views.nodes(spark, sf_dir), CAMERA, SCALE).filter("level <= 2")
    none = s.limit(0).select("key", F.lit(0.0).alias("seq"))
    told = selection.fetch_order(s.filter("level = 0").select("key"), none, s.select("key", (-F.col("sse")).alias("seq")), none)
    return told.select("key", F.col("place").alias("k"))


@query("""WITH s AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey%3=0), l AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey%2=0), f AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey%7=0)
SELECT 'stale' AS what, count(*) AS n FROM f WHERE k NOT IN (SELECT k FROM s) UNION ALL SELECT 'unsettled', count(*) FROM s WHERE k NOT IN (SELECT k FROM l)
UNION ALL SELECT 'selected', count(*) FROM (SELECT k FROM s UNION SELECT k FROM f)""")
def residency_sets(spark, sf_dir):
    """Requests no longer wanted, tiles wanted and not there, and the union of two selections."""
    k = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    selected, loaded, asked = k.filter("k % 3 = 0"), k.filter("k % 2 = 0"), k.filter("k % 7 = 0")
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    stale, missing = selection.residency(*(df.withColumnRenamed("k", "key") for df in (selected, loaded, asked)))
    return count(stale, "stale").union(count(missing, "unsettled")).union(count(selected.union(asked).distinct(), "selected"))


@query("""WITH c AS (SELECT o_orderkey AS seq, o_custkey AS k, CASE WHEN o_orderkey%11=0 THEN 'delete' ELSE 'set' END AS op, CASE WHEN o_orderkey%2=0 THEN o_orderpriority END AS name FROM orders),
l AS (SELECT k, arg_max(op, seq) AS op, arg_max(name, seq) FILTER (name IS NOT NULL) AS name FROM c GROUP BY k)
SELECT c_custkey, coalesce(l.name, c_name) AS name FROM customer LEFT JOIN l ON k=c_custkey WHERE coalesce(op,'set')<>'delete'""")
def command_replay(spark, sf_dir):
    """Rows after an ordered list of edits: the last set of each field holds, a row whose last edit deletes it is gone."""
    k = F.col("o_orderkey")
    commands = table(spark, sf_dir, "orders").select(
        k.alias("seq"), F.col("o_custkey").alias("c_custkey"), F.when(k % 11 == 0, "delete").otherwise("set").alias("op"), F.when(k % 2 == 0, F.col("o_orderpriority")).alias("name")
    )
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    return project.replay(rows, commands, "c_custkey", ["name"])


@query("""WITH a AS (SELECT o_custkey AS feature_id, o_orderkey%40 AS x, o_orderkey%30 AS y, o_orderkey%7 AS z FROM orders WHERE o_orderkey%2=0), p AS (SELECT o_custkey AS feature_id, o_orderkey%40 AS x, o_orderkey%30 AS y, o_orderkey%7 AS z FROM orders WHERE o_orderkey%2=1)
SELECT DISTINCT feature_id, x, y, z FROM a WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.feature_id=a.feature_id AND p.x=a.x AND p.y=a.y AND p.z=a.z)""")
def new_evidence(spark, sf_dir):
    k = F.col("o_orderkey")
    e = table(spark, sf_dir, "orders").select(k, F.col("o_custkey").alias("feature_id"), (k % 40).alias("x"), (k % 30).alias("y"), (k % 7).alias("z"))
    return project.new_evidence(e.filter(k % 2 == 0).drop("o_orderkey"), e.filter(k % 2 == 1).drop("o_orderkey"))


@query("""SELECT p_partkey, sha256(p_name||p_size::VARCHAR) AS sha FROM part""")
def source_fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.header_sha(F.encode("p_name", "UTF-8"), F.col("p_size")).alias("sha"))
