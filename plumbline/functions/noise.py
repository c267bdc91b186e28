"""Seeded simplex noise in the plane and its sum over octaves, as columns.

The permutation is drawn on the driver, 256 numbers of a 32-bit generator, and goes into the plan once; a place is computed from array lookups alone, so that a
field is the same however its places are dealt to tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

# The skew of the plane and back, eight directions, and the scale of the result.
SKEW, UNSKEW, SCALE = 0.5 * (math.sqrt(3) - 1), (3 - math.sqrt(3)) / 6, 70.0
DIRECTIONS = ((1, 1), (-1, 1), (1, -1), (-1, -1), (1, 0), (-1, 0), (0, 1), (0, -1))
_MASK = 0xFFFFFFFF


def uniform(seed: int) -> Iterator[float]:
    """Numbers in 0..1 of the generator mulberry32, in wrapping 32-bit arithmetic."""
    state = seed & _MASK
    while True:
        state = state + 0x6D2B79F5 & _MASK
        mixed = (state ^ state >> 15) * (state | 1) & _MASK
        mixed ^= mixed + ((mixed ^ mixed >> 7) * (mixed | 61) & _MASK) & _MASK
        yield ((mixed ^ mixed >> 14) & _MASK) / 2**32


def permutation(seed: int) -> list[int]:
    """The numbers below 256, shuffled from the end."""
    out, draw = list(range(256)), uniform(seed)
    for last in reversed(range(1, 256)):
        k = int(next(draw) * (last + 1))
        out[last], out[k] = out[k], out[last]
    return out


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once; else each use of a place would be an expression of its own."""
    return F.transform(F.array(value), body)[0]


def _simplex(x: Column, y: Column, table: Column) -> Column:
    """The sum of what the three corners of the place's triangle give; table: the permutation."""
    look = lambda k: F.get(table, k % 256)
    axis = lambda k: F.array(*[F.lit(float(d[k])) for d in DIRECTIONS])

    def corner(c: Column, di: Column, dj: Column, back: float) -> Column:
        way = look(c["i"] + di + look(c["j"] + dj)) % 8
        off = F.struct((c["x"] - di + back).alias("x"), (c["y"] - dj + back).alias("y"), F.get(axis(0), way).alias("gx"), F.get(axis(1), way).alias("gy"))
        near = lambda o: F.struct((0.5 - o["x"] * o["x"] - o["y"] * o["y"]).alias("t"), (o["gx"] * o["x"] + o["gy"] * o["y"]).alias("d"))
        fourth = lambda n: F.when(n["t"] > 0, n["t"] * n["t"] * (n["t"] * n["t"]) * n["d"]).otherwise(0.0)
        return _let(_let(off, near), fourth)

    def corners(c: Column) -> Column:
        right, one = (c["x"] > c["y"]).cast("int"), F.lit(1)
        return corner(c, F.lit(0), F.lit(0), 0.0) + corner(c, right, 1 - right, UNSKEW) + corner(c, one, one, 2 * UNSKEW)

    def place(c: Column) -> Column:
        back = (c["i"] + c["j"]) * F.lit(UNSKEW)
        return F.struct(F.pmod(c["i"], F.lit(256)).alias("i"), F.pmod(c["j"], F.lit(256)).alias("j"), (c["x"] - (c["i"] - back)).alias("x"), (c["y"] - (c["j"] - back)).alias("y"))

    cell = lambda q, s: F.struct(q["x"].alias("x"), q["y"].alias("y"), F.floor(q["x"] + s).cast("long").alias("i"), F.floor(q["y"] + s).cast("long").alias("j"))
    skewed = lambda q: cell(q, (q["x"] + q["y"]) * SKEW)
    return SCALE * _let(_let(_let(F.struct(x.alias("x"), y.alias("y")), skewed), place), corners)


def fractal(x: Column, y: Column, seed: int = 1337, octaves: int = 1, lacunarity: float = 2.0, gain: float = 0.5) -> Column:
    """Noise, roughly -1 to 1: octaves of rising frequency and falling weight, over their weights' sum."""

    def summed(table: Column) -> Column:
        weights = [gain**o for o in range(octaves)]
        each = [w * _simplex(x * lacunarity**o, y * lacunarity**o, table) for o, w in enumerate(weights)]
        return sum(each[1:], each[0]) / sum(weights)

    return F.transform(F.array(F.lit(permutation(seed))), summed)[0]
