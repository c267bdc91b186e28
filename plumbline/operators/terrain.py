"""A square terrain of any size at survey coordinates, from seeded noise: the same places and heights however its rows are dealt to tasks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import noise

# Centre, extent, the length and height of its largest features, and octaves.
CENTRE, EXTENT, WAVELENGTH, AMPLITUDE, OCTAVES, SEED = (3_510_000.0, 1_511_000.0, 4_190.0), 5_000.0, 1_500.0, 120.0, 5, 1337


def side_of(target: int) -> int:
    """Vertices along a side, at least two, so that their square is nearest to the target's."""
    return max(2, math.floor(math.sqrt(target) + 0.5))


def vertices(spark: SparkSession, target: int = 1_000_000, seed: int = SEED) -> DataFrame:
    """(vertex_id, source_id, x, y, z), row by row from the south-west; source ids count from 1."""
    side = side_of(target)
    step = EXTENT / (side - 1)
    k = F.col("id")
    place = lambda c, i: F.lit(CENTRE[c] - EXTENT / 2) + i * F.lit(step)
    placed = spark.range(side * side).select(k.alias("vertex_id"), (k + 1).alias("source_id"), place(0, k % side).alias("x"), place(1, F.floor(k / side)).alias("y"))
    height = noise.fractal(F.col("x") / WAVELENGTH, F.col("y") / WAVELENGTH, seed, OCTAVES)
    return placed.withColumn("z", F.lit(CENTRE[2]) + F.lit(AMPLITUDE) * height)


def faces(spark: SparkSession, target: int = 1_000_000) -> DataFrame:
    """(face_id, a, b, c): two triangles a cell, counter-clockwise from above."""
    side = side_of(target)
    cells = spark.range((side - 1) * (side - 1)).select("id", (F.floor(F.col("id") / (side - 1)) * side + F.col("id") % (side - 1)).alias("k"))
    k = F.col("k")
    pair = F.array(*[F.struct(k.alias("a"), (k + b).alias("b"), (k + c).alias("c")) for b, c in ((1, side + 1), (side + 1, side))])
    return cells.select("id", F.posexplode(pair).alias("half", "t")).select((F.col("id") * 2 + F.col("half")).alias("face_id"), "t.*")
