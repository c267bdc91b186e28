"""Windows and overviews of rasters, as relations over the pixels of `sources.tiff`.

A pixel of the result is blended from the four around its place in the window. Seen from a pixel of the source that is at most two
columns and two rows of the result, since the result is never larger; so that every pixel that counts is sent to its places
with its corner, and one aggregation by place puts the corners together. Pixels that no place needs are dropped before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _targets(at: Column, n: Column, out: Column) -> Column:
    """array<struct<o, high, t>>: places o of an axis shrunk from n to `out` that pixel `at` is the lower or higher neighbour of, and how far each place is from the lower one."""
    rel = n.cast("double") / out
    near = F.sequence(F.greatest(F.floor(at / rel).cast("int") - 1, F.lit(0)), F.least(F.ceil(at / rel).cast("int") + 1, out.cast("int") - 1))

    def place(o: Column) -> Column:
        raw = rel * o
        low = F.floor(raw).cast("int")
        t = raw - low
        low_one = F.struct(o.alias("o"), F.lit(False).alias("high"), t.alias("t"))
        high_one = F.struct(o.alias("o"), F.lit(True).alias("high"), t.alias("t"))
        high = F.least(F.ceil(raw).cast("int"), n.cast("int") - 1)
        return F.concat(F.when(low == at, F.array(low_one)).otherwise(F.array().cast("array<struct<o:int,high:boolean,t:double>>")), F.when(high == at, F.array(high_one)).otherwise(F.array().cast("array<struct<o:int,high:boolean,t:double>>")))

    return F.flatten(F.transform(near, place))


def _blend(a: Column, b: Column, t: Column) -> Column:
    return (1 - t) * a + t * b


def shrink(pixels: DataFrame, x: Column, y: Column, n: tuple[Column, Column], out: tuple[Column, Column]) -> DataFrame:
    """(file, bands, whole, ox, oy, v): pixels at x, y of an area of n, shrunk to `out` pixels by bilinear blending; whole samples are cut, not rounded."""
    told = pixels.select("file", "bands", "whole", "v", _targets(x, n[0], out[0]).alias("tx"), _targets(y, n[1], out[1]).alias("ty"))
    told = told.filter((F.size("tx") > 0) & (F.size("ty") > 0)).withColumn("cx", F.explode("tx")).withColumn("cy", F.explode("ty"))
    corner = lambda hx, hy: F.max(F.when((F.col("cx.high") == hx) & (F.col("cy.high") == hy), F.col("v")))
    grouped = told.groupBy("file", "bands", "whole", F.col("cx.o").alias("ox"), F.col("cy.o").alias("oy")).agg(
        F.max("cx.t").alias("t"), F.max("cy.t").alias("u"),
        corner(False, False).alias("ll"), corner(True, False).alias("hl"), corner(False, True).alias("lh"), corner(True, True).alias("hh"),
    )
    at = lambda c, k: F.get(F.col(c), k)

    def value(_, k: Column) -> Column:
        v = _blend(_blend(at("ll", k), at("hl", k), F.col("t")), _blend(at("lh", k), at("hh", k), F.col("t")), F.col("u"))
        cut = F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("double")
        return F.when(F.col("whole"), cut).otherwise(v.cast("float").cast("double"))

    return grouped.select("file", "bands", "whole", "ox", "oy", F.transform("ll", value).alias("v"))


def window(pixels: DataFrame, box: tuple[int, int, int, int], divisor: int = 1) -> DataFrame:
    """(file, bands, whole, ox, oy, v) of the pixels x0 <= px < x1, y0 <= py < y1 of each raster, which the window must lie in: themselves, or one a divisor shrunk by blending.

    Sizes are ceil(size / divisor), one at least. Give the same window to `tiff.read`, and other strips and tiles are not read."""
    x0, y0, x1, y1 = box
    met = pixels.filter((F.col("px") >= x0) & (F.col("px") < x1) & (F.col("py") >= y0) & (F.col("py") < y1))
    x, y = F.col("px") - x0, F.col("py") - y0
    if divisor == 1:
        return met.select("file", "bands", "whole", x.alias("ox"), y.alias("oy"), "v")
    n = (x1 - x0, y1 - y0)
    return shrink(met, x, y, tuple(F.lit(k) for k in n), tuple(F.lit(max(1, -(-k // divisor))) for k in n))


def overview_size(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """Size of a raster's overview: shrunk by the least whole number that brings its longer side to `most`, sides rounded."""
    scale = F.greatest(F.lit(1), F.ceil(F.greatest(width, height) / F.lit(max(1, most))))
    side = lambda n: F.greatest(F.lit(1), F.floor(n / scale + 0.5)).cast("int")
    return side(width), side(height)


def overview(pixels: DataFrame, most: int) -> DataFrame:
    """(file, bands, whole, ox, oy, v) of each raster as a whole, whatever their sizes."""
    n = F.col("width"), F.col("height")
    return shrink(pixels, F.col("px"), F.col("py"), n, overview_size(*n, most))


def rgba(v: Column, bands: Column) -> Column:
    """struct(r, g, b, a): the first three bands of three or more, else the first one as grey; rounded, 0 to 255; a is always 255."""
    byte = lambda k: F.least(F.greatest(F.floor(F.coalesce(F.get(v, F.lit(k)), F.lit(0.0)) + 0.5), F.lit(0)), F.lit(255)).cast("int")
    band = lambda k: F.when(bands >= 3, byte(k)).otherwise(byte(0))
    return F.struct(band(0).alias("r"), band(1).alias("g"), band(2).alias("b"), F.lit(255).alias("a"))
