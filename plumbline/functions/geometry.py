"""Columns over coordinates: boxes, polygons, segments, arcs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Ring = list[tuple[float, float]]


def in_box(x: Column, y: Column, z: Column, low: tuple, high: tuple) -> Column:
    return x.between(low[0], high[0]) & y.between(low[1], high[1]) & z.between(low[2], high[2])


def overlaps_xy(box: dict[str, Column], low: tuple, high: tuple) -> Column:
    return (box["max_x"] >= low[0]) & (box["min_x"] <= high[0]) & (box["max_y"] >= low[1]) & (box["min_y"] <= high[1])


def overlaps(a: dict[str, Column], b: dict[str, Column]) -> Column:
    out: Column = F.lit(True)
    for d in "xyz":
        out = out & (a[f"max_{d}"] >= b[f"min_{d}"]) & (a[f"min_{d}"] <= b[f"max_{d}"])
    return out


def box_distance(box: dict[str, Column], point: tuple[Column, Column, Column]) -> Column:
    """0 inside the box."""
    total: Column = F.lit(0.0)
    for d, p in zip("xyz", point):
        away = F.greatest(box[f"min_{d}"] - p, F.lit(0.0), p - box[f"max_{d}"])
        total = total + away * away
    return F.sqrt(total)


def box_diagonal(box: dict[str, Column]) -> Column:
    total: Column = F.lit(0.0)
    for d in "xyz":
        total = total + (box[f"max_{d}"] - box[f"min_{d}"]) * (box[f"max_{d}"] - box[f"min_{d}"])
    return F.sqrt(total)


def screen_error(error: Column, distance: Column, scale: Column) -> Column:
    return F.when(distance <= 1e-6, F.lit(float("inf"))).otherwise(error * scale / distance)


def _edges(ring: Ring) -> list[tuple[tuple[float, float], tuple[float, float]]]:
    return list(zip(ring, ring[-1:] + ring[:-1]))


def in_polygon(x: Column, y: Column, ring: Ring) -> Column:
    """Even-odd rule with half-open edges; the bounds are tested first, so that they reach the scan."""
    crossings: Column = F.lit(0)
    for (ax, ay), (bx, by) in _edges(ring):
        if ay == by:
            continue
        straddles = (F.lit(ay) > y) != (F.lit(by) > y)
        crossings = crossings + (straddles & (x < F.lit(bx - ax) * (y - ay) / F.lit(by - ay) + ax)).cast("int")
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & (crossings % 2 == 1)


def in_polygon_or_boundary(x: Column, y: Column, ring: Ring, eps: float = 1e-6) -> Column:
    """In the polygon, or within eps of its outline; eps is 1e-6 on the ground and 1e-9 on sheets."""
    if len(ring) < 3:
        return F.lit(False)
    edge: Column = F.lit(False)
    at = lambda p: (F.lit(p[0]), F.lit(p[1]))
    for a, b in _edges(ring):
        edge = edge | on_segment(at(b), at(a), (x, y), eps, 2 * eps)
    return edge | in_polygon(x, y, ring)


def within_range(x: Column, y: Column, z: Column, at: tuple, reach: float) -> Column:
    """Not beyond reach of a point; a point at exactly that distance is within."""
    d = (x - at[0]) * (x - at[0]) + (y - at[1]) * (y - at[1]) + (z - at[2]) * (z - at[2])
    return d <= reach * reach


def segment_length(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def closest_on_segment(px: Column, py: Column, a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """struct(t, x, y) of the point of segment ab next to p."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    size = dx * dx + dy * dy
    t = F.when(size <= 0, 0.0).otherwise(F.least(F.greatest(((px - a[0]) * dx + (py - a[1]) * dy) / size, F.lit(0.0)), F.lit(1.0)))
    return F.struct(t.alias("t"), (a[0] + t * dx).alias("x"), (a[1] + t * dy).alias("y"))


def orientation(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def arc_segments(radius: Column, sweep: Column, tolerance: float = 0.1) -> Column:
    """Chords for an arc whose sagitta stays within the tolerance: 2 to 256."""
    share = F.least(F.greatest(1 - F.lit(tolerance) / radius, F.lit(-1.0)), F.lit(1.0))
    step = 2 * F.acos(share)
    return F.when((radius <= 0) | (step <= 0), 2).otherwise(
        F.least(F.greatest(F.ceil(F.abs(sweep) / step), F.lit(2)), F.lit(256))
    ).cast("int")


def arc_points(cx: Column, cy: Column, radius: Column, start: Column, sweep: Column, segments: Column) -> Column:
    """The segments + 1 points of an arc, as an array of struct(x, y)."""
    return F.transform(
        F.sequence(F.lit(0), segments),
        lambda i: F.struct(
            (cx + radius * F.cos(start + sweep * i / segments)).alias("x"),
            (cy + radius * F.sin(start + sweep * i / segments)).alias("y"),
        ),
    )


def slope_degrees(nx: Column, ny: Column, nz: Column) -> Column:
    return F.degrees(F.acos(F.least(F.greatest(F.abs(nz) / F.sqrt(nx * nx + ny * ny + nz * nz), F.lit(0.0)), F.lit(1.0))))


def aspect_label(nx: Column, ny: Column, slope: Column) -> Column:
    """Compass direction a slope faces; none below half a degree."""
    names = F.array(*[F.lit(x) for x in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    degrees = F.pmod(F.degrees(F.atan2(nx, ny)) + 360, F.lit(360.0))
    return F.when(slope >= 0.5, F.get(names, F.pmod(F.floor(degrees / 45 + 0.5), F.lit(8)).cast("int")))


def projection_scale(height: float, fov_degrees: float) -> float:
    return height / (2 * math.tan(math.radians(fov_degrees) / 2))


def raster_pixel(x: Column, y: Column, low: tuple, high: tuple, width: int, height: int) -> Column:
    """struct(px, py) of the nearest pixel, rows from the north down; null outside."""
    u = F.lit(0.0) if high[0] == low[0] else (x - low[0]) / (high[0] - low[0])
    v = F.lit(0.0) if high[1] == low[1] else (F.lit(high[1]) - y) / (high[1] - low[1])
    inside = x.between(low[0], high[0]) & y.between(low[1], high[1])
    pixel = lambda w, n: F.least(F.greatest(F.floor(w * n), F.lit(0)), F.lit(n - 1)).cast("long")
    return F.when(inside, F.struct(pixel(u, width).alias("px"), pixel(v, height).alias("py")))


def raster_bounds(width: Column, height: Column, t: dict[str, Column]) -> Column:
    """Extent of a raster from origin and pixel size, whatever the sign of the latter."""
    x1, y1 = t["x"] + width * t["dx"], t["y"] + height * t["dy"]
    return F.struct(
        F.least(t["x"], x1).alias("min_x"), F.least(t["y"], y1).alias("min_y"),
        F.greatest(t["x"], x1).alias("max_x"), F.greatest(t["y"], y1).alias("max_y"),
    )


def sheet_to_ground(px: Column, py: Column, width: Column, height: Column, per_foot: Column) -> Column:
    return F.struct(((px - width / 2) / per_foot).alias("x"), (-((py - height / 2) / per_foot)).alias("y"))


Pair = tuple[Column, Column]


def turn(a: Pair, b: Pair, c: Pair) -> Column:
    """Twice the signed area of a, b, c."""
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def on_segment(a: Pair, b: Pair, p: Pair, epsilon: float = 1e-6, most_turn: float | None = None) -> Column:
    """Whether p lies on segment ab: within epsilon of its box, and twice their signed area is most_turn (else epsilon) at most."""
    out = F.abs(turn(a, b, p)) <= (epsilon if most_turn is None else most_turn)
    for k in (0, 1):
        out = out & (p[k] >= F.least(a[k], b[k]) - epsilon) & (p[k] <= F.greatest(a[k], b[k]) + epsilon)
    return out


def segments_meet(a: Pair, b: Pair, c: Pair, d: Pair, epsilon: float = 1e-6) -> Column:
    """Whether segments ab and cd cross, or an end of one lies on the other."""
    crossing = (turn(a, b, c) * turn(a, b, d) < 0) & (turn(c, d, a) * turn(c, d, b) < 0)
    return crossing | on_segment(a, b, c, epsilon) | on_segment(a, b, d, epsilon) | on_segment(c, d, a, epsilon) | on_segment(c, d, b, epsilon)


def ring_edges(ring: Column) -> Column:
    """An array of structs a, b from an array of structs x, y; the last point joins the first."""
    return F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.get(ring, (i + 1) % F.size(ring)).alias("b")))


def ring_holds(ring: Column, x: Column, y: Column) -> Column:
    """The even-odd rule with half-open edges, for a ring in a column."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    return F.size(F.filter(ring_edges(ring), lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


def edge_allowed(ring: Column, a: Pair, b: Pair, epsilon: float = 1e-6) -> Column:
    """Whether an edge between two points may be drawn within a ring: an edge of its border, or one whose middle lies inside or on it and that meets no border edge it shares no end with."""
    same = lambda p, q: (F.abs(p[0] - q["x"]) <= epsilon) & (F.abs(p[1] - q["y"]) <= epsilon)
    at = lambda p: (p["x"], p["y"])
    edges, middle = ring_edges(ring), ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2)
    border = F.exists(edges, lambda e: (same(a, e["a"]) & same(b, e["b"])) | (same(a, e["b"]) & same(b, e["a"])))
    inside = ring_holds(ring, *middle) | F.exists(edges, lambda e: on_segment(at(e["a"]), at(e["b"]), middle, epsilon))
    shares = lambda e: same(a, e["a"]) | same(a, e["b"]) | same(b, e["a"]) | same(b, e["b"])
    met = F.exists(edges, lambda e: ~shares(e) & segments_meet(a, b, at(e["a"]), at(e["b"]), epsilon))
    return border | (inside & ~met)
