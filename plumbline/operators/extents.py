"""Rectangles joined with rectangles: which extents of rasters and sheets meet which surfaces.

Rectangles are put on grids of doubling cells: each is at home on the level whose cells are as large as it is, where it meets four cells at
most, and visits the coarser levels that others are at home on. A pair meets on the level of the larger one, in the
cell of its reference point (the greater of the lower corners), and there alone, so that no pair is told twice and no large
rectangle is cut into small cells. Equal rectangles of a side are one while they are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import copies

BOX = ("min_x", "min_y", "max_x", "max_y")


def level_of(base: float) -> Column:
    """The level whose cells, base * 2 ** level wide, are no smaller than the rectangle."""
    side = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    return F.when(side <= base, 0).otherwise(F.ceil(F.log2(side / base))).cast("int")


def _dealt(boxes: DataFrame, base: float, levels: list[int], name: str) -> DataFrame:
    size = F.lit(base) * F.pow(F.lit(2.0), F.col("_l"))
    cells = lambda d: F.sequence(F.floor(F.col(f"min_{d}") / size).cast("long"), F.floor(F.col(f"max_{d}") / size).cast("long"))
    upper = F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: v >= F.col("_own"))
    told = boxes.withColumn("_own", level_of(base)).withColumn("_l", F.explode(upper)).withColumn("_cx", F.explode(cells("x"))).withColumn("_cy", F.explode(cells("y")))
    return told.select("_l", "_cx", "_cy", (F.col("_own") == F.col("_l")).alias(f"_home_{name}"), F.struct(*boxes.columns).alias(name))


def meeting(left: DataFrame, right: DataFrame, base: float) -> DataFrame:
    """(l, r): structs of the rows of left and right whose rectangles (min_x .. max_y) meet; touching counts.

    base: the side of the smallest cells, about that of the smaller rectangles. Rectangles with a null, or upside down, meet nothing."""
    whole = F.lit(True)
    for c in BOX:
        whole = whole & F.col(c).isNotNull()
    sound = whole & (F.col("min_x") <= F.col("max_x")) & (F.col("min_y") <= F.col("max_y"))
    left, right = left.filter(sound), right.filter(sound)
    # at most one number for each doubling between the smallest and largest rectangle
    levels = sorted(r[0] for r in left.select(level_of(base).alias("v")).union(right.select(level_of(base))).distinct().collect())
    if not levels:
        levels = [0]
    met = _dealt(left.select(*BOX).distinct(), base, levels, "l").join(copies.spread(_dealt(right.select(*BOX).distinct(), base, levels, "r")), ["_l", "_cx", "_cy"])
    size = F.lit(base) * F.pow(F.lit(2.0), F.col("_l"))
    first = lambda d: F.floor(F.greatest(F.col(f"l.min_{d}"), F.col(f"r.min_{d}")) / size)
    overlap = F.lit(True)
    for d in "xy":
        overlap = overlap & (F.col(f"l.max_{d}") >= F.col(f"r.min_{d}")) & (F.col(f"l.min_{d}") <= F.col(f"r.max_{d}"))
    pairs = met.filter((F.col("_home_l") | F.col("_home_r")) & overlap & (first("x") == F.col("_cx")) & (first("y") == F.col("_cy"))).select(F.col("l").alias("_l"), F.col("r").alias("_r"))
    for name, rows in (("l", left), ("r", right)):
        pairs = pairs.join(copies.spread(rows.select(F.struct(*[F.col(c) for c in BOX]).alias(f"_{name}"), F.struct(*rows.columns).alias(name))), f"_{name}")
    return pairs.select("l", "r")
