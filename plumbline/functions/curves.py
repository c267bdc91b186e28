"""Curves as points, for small records within a task, and clipping against convex outlines."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[float, float]


def ellipse(centre: Point, major: Point, ratio: float, start: float, end: float, tolerance: float = 0.1) -> list[Point]:
    """Points of an ellipse from its centre, half its major axis, the ratio of its axes and two parameters."""
    a = math.hypot(*major)
    sweep = (end - start) % (2 * math.pi) or 2 * math.pi
    step = 2 * math.acos(max(-1.0, min(1.0, 1 - tolerance / a))) if a > 0 else 0.0
    n = max(2, min(256, math.ceil(sweep / step))) if step > 0 else 2
    minor = (-major[1] * ratio, major[0] * ratio)
    out = []
    for k in range(n + 1):
        t = start + sweep * k / n
        c, s = math.cos(t), math.sin(t)
        out.append((centre[0] + major[0] * c + minor[0] * s, centre[1] + major[1] * c + minor[1] * s))
    return out


def spline(control: list[tuple[float, ...]], degree: int, knots: list[float], weights: list[float] | None = None, samples: int = 64) -> list[tuple[float, ...]]:
    """`samples` points of a B-spline, both ends among them, rational with weights; the control points where its data do not fit together."""
    n, degree = len(control), max(1, int(degree) or 3)
    if n <= degree or len(knots) < n + degree + 1:
        return list(control)
    w = [weights[i] if weights and i < len(weights) else 1.0 for i in range(n)]
    low, high, count = knots[degree], knots[n], max(2, samples)
    out = []
    for k in range(count):
        t = low + (high - low) * k / (count - 1)
        span = max((i for i in range(degree, n) if knots[i] <= t), default=degree)
        d = [(*(c * w[i] for c in control[i]), w[i]) for i in range(span - degree, span + 1)]
        for r in range(1, degree + 1):
            for j in range(degree, r - 1, -1):
                i = j + span - degree
                width = knots[i + degree - r + 1] - knots[i]
                u = (t - knots[i]) / width if width else 0.0
                d[j] = tuple((1 - u) * a + u * b for a, b in zip(d[j - 1], d[j]))
        out.append(tuple(c / (d[degree][-1] or 1) for c in d[degree][:-1]))
    return out


def clip_ring(subject: list[Point], clip: list[Point]) -> list[Point]:
    """The part of a ring inside a convex counter-clockwise ring."""
    out = list(subject)
    for a, b in zip(clip, clip[1:] + clip[:1]):
        side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])  # noqa: B023, E731
        kept = []
        for p, q in zip(out[-1:] + out[:-1], out):
            sp, sq = side(p), side(q)
            if (sp >= 0) != (sq >= 0):
                u = sp / (sp - sq)
                kept.append((p[0] + u * (q[0] - p[0]), p[1] + u * (q[1] - p[1])))
            if sq >= 0:
                kept.append(q)
        out = kept
    return out


def clip_segment(x0: Column, y0: Column, x1: Column, y1: Column, clip: list[Point]) -> Column:
    """struct(x0, y0, x1, y1) of the part of a segment inside a convex counter-clockwise ring; null if none."""
    first, last, outside = F.lit(0.0), F.lit(1.0), F.lit(False)
    for a, b in zip(clip, clip[1:] + clip[:1]):
        nx, ny = -(b[1] - a[1]), b[0] - a[0]  # inward
        at = (x0 - a[0]) * nx + (y0 - a[1]) * ny
        rate = (x1 - x0) * nx + (y1 - y0) * ny
        t = -at / F.when(rate != 0, rate)
        first = F.when(rate > 0, F.greatest(first, t)).otherwise(first)
        last = F.when(rate < 0, F.least(last, t)).otherwise(last)
        outside = outside | ((rate == 0) & (at < 0))
    dx, dy = x1 - x0, y1 - y0
    part = F.struct((x0 + first * dx).alias("x0"), (y0 + first * dy).alias("y0"), (x0 + last * dx).alias("x1"), (y0 + last * dy).alias("y1"))
    return F.when(~outside & (first <= last), part)
