"""Crop masks of sheets: which tiles a border meets, and which pixels of those it keeps, as spans of rows.

Borders are filled row by row: an edge gives each row that it crosses one place, and the sorted places of a row bound its spans, so that a pixel
is never tested by itself. Pixels on an edge are kept. Tiles are judged by their corners and by the border's edges near them; only
those that need a mask get spans. polygons: (polygon_id, ring array<struct<x, y>>); rings of less than three points keep all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as geo
from plumbline.operators import copies

#: Slack of pixels on an edge.
EPSILON = 1e-9


def _edges(polygons: DataFrame) -> DataFrame:
    told = polygons.filter(F.size("ring") >= 3).select("polygon_id", F.explode(geo.ring_edges(F.col("ring"))).alias("e"))
    return told.select("polygon_id", *[F.col(f"e.{k}.{d}").cast("double").alias(f"{k}{d}") for k in "ab" for d in "xy"])


def spans(polygons: DataFrame) -> DataFrame:
    """(polygon_id, y, first, last): the pixels that each ring keeps, in unbroken runs of each row."""
    e = _edges(polygons)
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    rows = e.withColumn("y", F.explode(F.filter(F.sequence(F.ceil(low - EPSILON).cast("long"), F.ceil(high + EPSILON).cast("long")), lambda k: k <= high + EPSILON)))
    crosses = (F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))
    place = (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0)) + F.col("ax")
    rows = rows.withColumn("place", F.when(crosses, place))
    # pixels on the edge itself: all of a level one, else the one next to its place in the row
    at = F.coalesce("place", F.when(F.abs(F.col("ay") - F.col("y")) <= EPSILON, F.col("ax")).otherwise(F.col("bx")))
    level = (F.abs(F.col("ay") - F.col("y")) <= EPSILON) & (F.abs(F.col("by") - F.col("y")) <= EPSILON)
    near = F.floor(at + 0.5).cast("long")
    lies = geo.on_segment((F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by")), (near.cast("double"), F.col("y").cast("double")), EPSILON, 2 * EPSILON)
    run = F.struct(F.ceil(F.least("ax", "bx") - EPSILON).cast("long").alias("first"), F.floor(F.greatest("ax", "bx") + EPSILON).cast("long").alias("last"))
    edge = F.when(level, run).when(lies, F.struct(near.alias("first"), near.alias("last")))
    grouped = rows.groupBy("polygon_id", "y").agg(F.array_sort(F.collect_list("place")).alias("p"), F.collect_set(edge).alias("on"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("p") / 2).cast("int")), lambda k: F.struct(F.ceil(F.get("p", 2 * k)).cast("long").alias("first"), (F.ceil(F.get("p", 2 * k + 1)) - 1).cast("long").alias("last")))
    told = grouped.select("polygon_id", "y", F.explode(F.concat(pairs, F.col("on"))).alias("s")).select("polygon_id", "y", "s.*").filter("first <= last")
    # runs that touch become one
    row = Window.partitionBy("polygon_id", "y").orderBy("first", "last")
    before = F.max("last").over(row.rowsBetween(Window.unboundedPreceding, -1))
    opens = told.withColumn("new", F.coalesce((F.col("first") > before + 1).cast("int"), F.lit(1)))
    return opens.withColumn("k", F.sum("new").over(row.rowsBetween(Window.unboundedPreceding, 0))).groupBy("polygon_id", "y", "k").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("k")


def _inside(ring: Column, x: Column, y: Column) -> Column:
    on = F.exists(geo.ring_edges(ring), lambda e: geo.on_segment((e["a"]["x"], e["a"]["y"]), (e["b"]["x"], e["b"]["y"]), (x, y), EPSILON, 2 * EPSILON))
    return on | geo.ring_holds(ring, x, y)


def masked_tiles(tiles: DataFrame, polygons: DataFrame) -> DataFrame:
    """tiles(polygon_id, x0, y0, x1, y1) with `masked`: a corner lies outside the ring, or an edge of the ring meets one of the tile."""
    told = tiles.join(copies.spread(polygons.select("polygon_id", F.col("ring").cast("array<struct<x:double,y:double>>").alias("_r"))), "polygon_id", "left")
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    out = F.lit(False)
    for c in corners:
        out = out | ~_inside(F.col("_r"), *c)

    def meets(e: Column) -> Column:
        a, b = (e["a"]["x"], e["a"]["y"]), (e["b"]["x"], e["b"]["y"])
        found = F.lit(False)
        for p, q in zip(corners, corners[1:] + corners[:1]):
            found = found | geo.segments_meet(a, b, p, q, 0.0)
        near = (F.least(a[0], b[0]) <= x1) & (F.greatest(a[0], b[0]) >= x0) & (F.least(a[1], b[1]) <= y1) & (F.greatest(a[1], b[1]) >= y0)
        return near & found

    masked = F.when(F.coalesce(F.size("_r"), F.lit(0)) < 3, False).otherwise(out | F.exists(geo.ring_edges(F.col("_r")), meets))
    return told.withColumn("masked", masked).drop("_r")


def tile_masks(tiles: DataFrame, polygons: DataFrame, size: int) -> DataFrame:
    """(polygon_id, x0, y0, y, first, last): the pixels kept of those tiles of a grid of `size` that need a mask; tiles without rows here are whole, or, if they need one, empty."""
    need = masked_tiles(tiles, polygons).filter("masked").select("polygon_id", "x0", "y0", "x1", "y1")
    column = F.explode(F.transform(F.sequence(F.floor(F.col("first") / size).cast("long"), F.floor(F.col("last") / size).cast("long")), lambda c: c * size))
    s = spans(polygons).select("*", (F.floor(F.col("y") / size) * size).cast("long").alias("y0"), column.alias("x0"))
    return s.join(copies.spread(need), ["polygon_id", "x0", "y0"]).select("polygon_id", "x0", "y0", "y", F.greatest("first", "x0").alias("first"), F.least(F.col("last"), F.col("x1") - 1).alias("last"))
