"""Column expressions for how survey data is shown and measured on screen: sizes, colours, sheets, labels."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import las, text

# Fixed values.
FOOT_IN_METRES, INCH_IN_METRES = 0.3048, 0.0254
SCALE_LIMITS = (0.01, 100.0)
DETAIL = {"faster": (800, 2_000_000), "balanced": (400, 5_000_000), "detailed": (200, 5_000_000), "inspect": (100, 5_000_000)}
RASTER_DISTANCES, RASTER_HOVER_DISTANCES = (180.0, 650.0), (250.0, 900.0)
PIXELS_PER_FOOT = 100.0
TILE = 1024
STALE_REASONS = {
    "source-missing": "source file is missing", "header-sha-changed": "source header content changed",
    "file-size-changed": "source file size changed", "mtime-changed": "source modified time changed",
}
INDEX_PREFIX, INDEX_VERSION = "Point-cloud index", 2
UNIT_LABELS = {"usSurveyFoot": "usft", "foot": "ft", "meter": "m"}


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounded with halves towards positive infinity."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def feet_to_units(units: Column) -> Column:
    return F.when(units == "meter", FOOT_IN_METRES).otherwise(1.0)


def inches_to_units(units: Column, inches: float | Column) -> Column:
    return F.when(units == "meter", INCH_IN_METRES).otherwise(1 / 12) * inches


def radius_step(scale: Column, factor: Column) -> Column:
    """A scale after one step, kept within its limits, to three decimals."""
    return half_up(F.least(F.greatest(scale * factor, F.lit(SCALE_LIMITS[0])), F.lit(SCALE_LIMITS[1])), 3)


def point_diameter(mode: Column, radius_ft: Column, units: Column, scale: Column, automatic: Column) -> Column:
    """A fixed radius wins over the automatic diameter; both are scaled."""
    return F.when(mode == "fixed", radius_ft * feet_to_units(units) * scale * 2).otherwise(automatic * scale)


def automatic_diameter(edge: Column, mean_count: Column, least_radius: Column) -> Column:
    """What fills the mean spacing of a level: between a least radius and a twentieth of the node's edge."""
    fill = edge * 0.7 / F.sqrt(F.greatest(mean_count, F.lit(1.0)))
    return F.greatest(least_radius, F.least(fill, edge * 0.05)) * 2


def detail(preset: Column, k: int) -> Column:
    """The preset's screen error (k = 0) or budget of points (k = 1); unknown presets are balanced."""
    out = F.lit(DETAIL["balanced"][k])
    for name, values in DETAIL.items():
        out = F.when(preset == name, values[k]).otherwise(out)
    return out


def color(mode: Column, rgb: list[Column], has_rgb: Column, intensity: Column, height: Column, raster: Column) -> Column:
    """A struct r, g, b in 0..1 by display mode; raster is a struct of bytes, null off the raster."""
    own = lambda fallback: [F.when(has_rgb, c / 255).otherwise(fallback / 255) for c in rgb]
    grey = F.least(F.greatest(intensity, F.lit(0.0)), F.lit(1.0))
    ramp = las.terrain_color(height)
    each = zip("rgb", own(255), own(200))
    return F.struct(*[
        F.when(mode == "intensity", grey).when(mode == "elevation", ramp[c] / 255)
        .when(mode == "raster", F.coalesce(raster[c] / 255, dim)).otherwise(full).alias(c) for c, full, dim in each
    ])


def raster_uv(x: Column, origin: float | Column, scale: float | Column, pixels: Column) -> Column:
    """Where a coordinate lies along a raster's side, 0 to 1."""
    width = pixels * scale
    return F.least(F.greatest(F.when(width == 0, 0.0).otherwise((x - origin) / width), F.lit(0.0)), F.lit(1.0))


def raster_divisor(distance: Column, hover: Column) -> Column:
    near, far = (F.when(hover, h).otherwise(n) for n, h in zip(RASTER_DISTANCES, RASTER_HOVER_DISTANCES))
    return F.when(distance <= near, 1).when(distance <= far, 2).otherwise(4)


def tiles(width: Column, height: Column, origin: tuple[Column, Column], scale: tuple[Column, Column], side: int = TILE) -> Column:
    """An array of the tiles of a raster or sheet: window x0, y0, x1, y1 and bounds in the world."""
    steps = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1, F.lit(side).cast("long"))).otherwise(F.array().cast("array<long>"))

    def one(x: Column, y: Column) -> Column:
        x1, y1 = F.least(width.cast("long"), x + side), F.least(height.cast("long"), y + side)
        at = [(origin[0] + scale[0] * x, origin[0] + scale[0] * x1), (origin[1] + scale[1] * y, origin[1] + scale[1] * y1)]
        bounds = [f(*p).alias(f"{m}_{d}") for m, f in (("min", F.least), ("max", F.greatest)) for d, p in zip("xy", at)]
        return F.struct(x.alias("x0"), y.alias("y0"), x1.alias("x1"), y1.alias("y1"), *bounds)

    return F.flatten(F.transform(steps(height), lambda y: F.transform(steps(width), lambda x: one(x, y))))


def pixels_per_foot(unit: Column, per_unit: Column) -> Column:
    return F.when((unit == "foot") & (per_unit > 0), per_unit).otherwise(PIXELS_PER_FOOT)


def crop_bounds(kind: Column, rect: Column, points: Column, width: Column, height: Column) -> Column:
    """struct(x, y, width, height): the whole sheet, a rectangle, or the bounds of a polygon's points."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    whole = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), width.cast("double").alias("width"), height.cast("double").alias("height"))
    box = F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("width"), (F.array_max(ys) - F.array_min(ys)).alias("height"))
    return F.when(kind == "rect", rect).when((kind == "polygon") & (F.size(points) > 0), box).otherwise(whole)


def sheet_position(anchor: tuple[Column, Column], degrees: Column, px: tuple[Column, Column], per_foot: Column) -> Column:
    """struct(x, y): a sheet's place in its layout, turned about the anchor; without an anchor the layout itself."""
    rx, ry, a = px[0] / per_foot, px[1] / per_foot, F.radians(degrees)
    placed = F.struct((anchor[0] + rx * F.cos(a) - ry * F.sin(a)).alias("x"), (anchor[1] + rx * F.sin(a) + ry * F.cos(a)).alias("y"))
    return F.when(degrees.isNotNull(), placed).otherwise(F.struct(rx.alias("x"), ry.alias("y")))


def units_per_pixel(orthographic: Column, span: Column, fov: Column, distance: Column, height_px: Column, exaggeration: Column) -> Column:
    world = F.when(orthographic, F.coalesce(span, F.lit(1.0))).otherwise(2 * distance * F.tan(F.radians(F.coalesce(fov, F.lit(50.0)) / 2)))
    return world / F.greatest(height_px, F.lit(1)) / F.greatest(exaggeration, F.lit(1e-6))


def is_derived_path(path: Column) -> Column:
    return F.coalesce(F.replace(path, F.lit("\\"), F.lit("/")).startswith("derived/"), F.lit(False))


def units_label(units: Column) -> Column:
    out = F.lit("--")
    for name, label in UNIT_LABELS.items():
        out = F.when(units == name, label).otherwise(out)
    return out


def measure(x: Column, trim: bool = True) -> Column:
    """A whole number as it is, any other with two decimals; without trailing zeros, or only without .00."""
    two = F.format_string("%.2f", x.cast("double"))
    cut = F.regexp_replace(two, "\\.?0+$" if trim else "\\.00$", "")
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(cut)


def stale_warning(missing: Column, reasons: Column) -> Column:
    """The warning of an index whose source is missing, or changed for the given reasons; null if it is fresh."""
    labels = F.create_map(*[F.lit(x) for pair in STALE_REASONS.items() for x in pair])
    gone = F.lit(f"{INDEX_PREFIX} source is missing; the existing index is still usable but cannot be re-verified or regenerated until the source is available.")
    told = F.concat(
        F.lit(f"{INDEX_PREFIX} may be out of date ("), F.array_join(F.transform(reasons, lambda r: F.try_element_at(labels, r)), ", "),
        F.lit("). Regenerate the index to match the current source."),
    )
    return F.when(missing, gone).when(F.size(reasons) > 0, told)


def outdated_warning(version: Column) -> Column:
    told = F.concat(F.lit(f"{INDEX_PREFIX} format is outdated (v"), version.cast("string"), F.lit("); rebuild the index for indexed display and Walk Mode."))
    return F.when(version < INDEX_VERSION, told)


def disclosure(drawn: Column, loaded: Column, estimated: Column, region: Column, region_loaded: Column, region_selected: Column, limited: Column, sector: Column, sectors: Column, largest: str = "B") -> Column:
    """One line about the points of a work area: how many are drawn and loaded, and what keeps it from being full; numbers have letters up to `largest`."""
    compact = partial(text.compact, largest=largest)
    part = F.when(sectors > 1, F.concat(F.lit(" · sector "), (sector + 1).cast("string"), F.lit(" of "), sectors.cast("string"))).otherwise("")
    area = F.when(drawn == loaded, F.concat(compact(drawn), F.lit(" pts in area"))).otherwise(F.concat(compact(drawn), F.lit(" drawn / "), compact(loaded), F.lit(" loaded in area")))
    view = F.concat(F.lit("Isolate: "), area, F.lit(" · view-density streaming only — Load All for full data (~"), compact(estimated), F.lit(" indexed near area)"))
    done = F.when(region_loaded >= region_selected, F.concat(F.lit("full data loaded ("), compact(region_selected), F.lit(" tile pts)"))).otherwise(
        F.concat(F.lit("loading "), compact(region_loaded), F.lit(" of "), compact(region_selected), F.lit(" tile pts"))
    )
    budget = F.when(limited, " · budget-limited: sector exceeds display budget").otherwise("")
    return (
        F.when(estimated == 0, F.concat(F.lit("Isolate: no indexed points found in area"), part)).when(~region, view)
        .otherwise(F.concat(F.lit("Isolate: "), area, F.lit(" · Load All "), done, part, budget))
    )
