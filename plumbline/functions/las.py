"""Columns over LAS point attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The classification names of LAS 1.4, by code from 0 on.
CLASS_NAMES = (
    "Created, never classified",
    "Unclassified",
    "Ground",
    "Low Vegetation",
    "Medium Vegetation",
    "High Vegetation",
    "Building",
    "Low Point (noise)",
    "Reserved",
    "Water",
    "Rail",
    "Road Surface",
    "Reserved",
    "Wire – Guard (Shield)",
    "Wire – Conductor (Phase)",
    "Transmission Tower",
    "Wire-structure Connector",
    "Bridge Deck",
    "High Noise",
    "Overhead Structure",
    "Ignored Ground",
    "Snow",
    "Temporal Exclusion",
)

# The terrain ramp, as (position, red, green, blue).
TERRAIN = ((0.0, 0, 0, 255), (0.33, 0, 200, 0), (0.66, 255, 255, 0), (1.0, 255, 0, 0))

# Quality tiers, as (most points kept of a leaf, least stride, stride at depth 0).
TIERS = {"fast": (50_000, 128, 4096), "balanced": (50_000, 16, 512), "all-detail": (200_000, 1, 64)}


def return_number(byte: Column, point_format: int = 7) -> Column:
    return byte.bitwiseAND(F.lit(15 if point_format >= 6 else 7))


def number_of_returns(byte: Column, point_format: int = 7) -> Column:
    bits, mask = (4, 15) if point_format >= 6 else (3, 7)
    return F.shiftright(byte, bits).bitwiseAND(F.lit(mask))


def return_role(number: Column, total: Column) -> Column:
    """first, last or intermediate; a single return is first."""
    return F.when(number <= 1, "first").when(number >= total, "last").otherwise("intermediate")


def passes(classification: Column, role: Column, off_classes: list[int], off_roles: list[str]) -> Column:
    """Neither the class nor the return role is switched off."""
    return ~classification.isin(off_classes or [-1]) & ~role.isin(off_roles or [""])


def class_label(code: Column) -> Column:
    names = F.array(*[F.lit(x) for x in CLASS_NAMES])
    return F.coalesce(F.when(code >= 0, F.get(names, code.cast("int"))), F.concat(F.lit("Class "), code.cast("string")))


def half_up(value: Column) -> Column:
    """Rounding with halves towards positive infinity."""
    return F.floor(value + 0.5)


def rgb_encoding(highest: Column) -> Column:
    return F.when(highest.isNull(), None).when(highest <= 255, "u8-in-u16").otherwise("u16")


def rgb_channel(value: Column, encoding: Column) -> Column:
    """A stored channel as 0..255."""
    return F.when(encoding == "u16", F.shiftright(value, 8)).otherwise(F.least(value, F.lit(255)))


def terrain_color(t: Column) -> Column:
    """struct(r, g, b) of a position 0..1 on the terrain ramp."""
    x = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    out: Column = F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip("rgb", TERRAIN[-1][1:])])
    for (t0, *c0), (t1, *c1) in reversed(list(zip(TERRAIN, TERRAIN[1:]))):
        f = (x - t0) / (t1 - t0)
        out = F.when(x <= t1, F.struct(*[half_up(a + (b - a) * f).cast("long").alias(n) for n, a, b in zip("rgb", c0, c1)])).otherwise(out)
    return out


def stride(total: Column, budget: int) -> Column:
    return F.greatest(F.ceil(total / F.lit(budget)), F.lit(1)).cast("long")


def tier_stride(tier: str, depth: Column) -> Column:
    _, least, at_root = TIERS[tier]
    return F.greatest(F.lit(least), F.call_function("shiftright", F.lit(at_root), depth))


def world(grid: Column, scale: float, offset: float = 0.0) -> Column:
    return grid * F.lit(scale) + F.lit(offset)


def unit_from_code(code: Column) -> Column:
    """Linear unit of an EPSG unit code."""
    return F.when(code == 9001, "metre").when(code == 9002, "foot").when(code == 9003, "usSurveyFoot")


def unit_from_text(raw: Column) -> Column:
    """Survey foot is looked for before metre, and metre before foot."""
    low = F.lower(F.regexp_replace(raw, "[\\s_-]", ""))
    return (
        F.when(low.contains("ussurveyf") | low.contains("surveyfoot") | low.contains("ftus"), "usSurveyFoot")
        .when(low.contains("metre") | low.contains("meter"), "metre")
        .when(low.contains("foot") | low.contains("feet"), "foot")
    )


def feet_to_units(units: Column) -> Column:
    return F.when(units == "metre", 0.3048).otherwise(1.0)
