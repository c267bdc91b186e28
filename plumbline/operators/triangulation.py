"""Triangulated regions: a ring and the points in it, covered without holes, whatever the shape of the ring and the number of points.

A region is cut into upright strips of about `strip_points` points, and each strip is a task of its own. Where a seam crosses the ring
there is a new corner, the same in both strips since it comes from the same edge of the whole ring; so neighbours share their
seam's edges. Within a strip each piece of the ring is cut into ears first, which cover it exactly; then points are put into the triangles
that hold them, along a curve that stays near, and edges other than those of the ring are turned until no point lies in the circle of a
triangle beside it. So borders are never crossed, and the areas always add up to the ring's.

Points outside the ring are left out; of points within `eps` of each other the ring's, else the first by x and y, stays. Rings of
less than three corners give nothing. Edges along a seam are not turned, so that the triangles there may be long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import copies
from plumbline.operators.regions import Point, ear_clip, inside, signed_area

#: Points of a strip, and strips of a region at most; a region of more points than both allow has larger strips.
STRIP_POINTS, STRIPS = 50_000, 1024
#: Corners and points of a region that is a row of a batch.
SMALL = 128
EPS = 1e-6

TRIANGLES = "region long, strip int, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double"


def _cross(o: Point, a: Point, b: Point) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _in_circle(a: Point, b: Point, c: Point, p: Point) -> bool:
    """Whether p lies in the circle through a, b, c, which turn left."""
    ax, ay, bx, by, cx, cy = a[0] - p[0], a[1] - p[1], b[0] - p[0], b[1] - p[1], c[0] - p[0], c[1] - p[1]
    aa, bb, cc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    value = aa * (bx * cy - by * cx) - bb * (ax * cy - ay * cx) + cc * (ax * by - ay * bx)
    return value > 1e-12 * (aa + bb + cc) ** 2


def with_seams(ring: list[Point], seams: list[float]) -> list[Point]:
    """The ring with a corner where an edge crosses a seam; no corner of the ring lies on one."""
    out = []
    for a, b in zip(ring, ring[1:] + ring[:1]):
        out.append(a)
        crossed = sorted((s for s in seams if (a[0] < s) != (b[0] < s)), reverse=a[0] > b[0])
        out += [(s, a[1] + (b[1] - a[1]) * (s - a[0]) / (b[0] - a[0])) for s in crossed]
    return out


def side(ring: list[Point], seam: float, right: bool) -> list[list[Point]]:
    """The pieces of a ring on one side of a seam that its corners lie on where they cross it."""
    at = [k for k, p in enumerate(ring) if p[0] == seam]
    if not at:
        return [ring] if (ring[0][0] > seam) == right else []
    by_height = sorted(at, key=lambda k: ring[k][1])
    partner = {a: b for p, q in zip(by_height[::2], by_height[1::2]) for a, b in ((p, q), (q, p))}
    chains = {}  # from where the ring comes into the side to where it leaves it
    n = len(ring)
    for k in at:
        j = (k + 1) % n
        if ring[j][0] == seam or (ring[j][0] > seam) != right:
            continue
        chain = [ring[k]]
        while ring[j][0] != seam:
            chain.append(ring[j])
            j = (j + 1) % n
        chains[k] = (chain + [ring[j]], j)
    out = []
    while chains:
        start = at_ = next(iter(chains))
        piece = []
        while at_ in chains:
            chain, end = chains.pop(at_)
            piece += chain
            at_ = partner[end]
        if at_ == start and len(piece) > 2:
            out.append(piece)
    return out


def _along_curve(points: list[Point], low: Point, high: Point, bits: int = 10) -> list[Point]:
    """Points in the order of a Hilbert curve over their bounds."""
    if not points:
        return []
    side_ = max(high[0] - low[0], high[1] - low[1], 1e-300)
    xy = np.array(points)
    x, y = (np.minimum(((xy[:, k] - low[k]) / side_ * (1 << bits)).astype(np.int64), (1 << bits) - 1) for k in (0, 1))
    key, s = np.zeros(len(points), np.int64), 1 << bits - 1
    while s:
        rx, ry = (x & s > 0).astype(np.int64), (y & s > 0).astype(np.int64)
        key += s * s * (3 * rx ^ ry)
        flip = (ry == 0) & (rx == 1)
        x, y = np.where(flip, s - 1 - (x & s - 1), x & s - 1), np.where(flip, s - 1 - (y & s - 1), y & s - 1)
        x, y = np.where(ry == 0, y, x), np.where(ry == 0, x, y)
        s >>= 1
    return [points[k] for k in np.argsort(key, kind="stable")]


class Mesh:
    """Triangles that turn left, as the corner opposite each of their directed edges."""

    def __init__(self, ring: list[Point]):
        self.points = ring if signed_area(ring) > 0 else ring[::-1]
        n = len(self.points)
        self.fixed = {(k, (k + 1) % n) for k in range(n)} | {((k + 1) % n, k) for k in range(n)}
        self.points, self.opposite = list(self.points), {}
        for a, b, c in ear_clip(self.points):
            self._put(a, b, c)

    def _put(self, a: int, b: int, c: int) -> None:
        self.opposite[a, b], self.opposite[b, c], self.opposite[c, a] = c, a, b

    def _take(self, a: int, b: int, c: int) -> None:
        for e in ((a, b), (b, c), (c, a)):
            del self.opposite[e]

    def triangles(self) -> Iterator[tuple[int, int, int]]:
        return ((a, b, c) for (a, b), c in self.opposite.items() if a < b and a < c)

    def _holder(self, p: Point, edge: tuple[int, int]) -> tuple[int, int, int]:
        """The triangle that holds p: by going toward it from an edge, or, where the ring lies between, by looking at all."""
        at = self.points
        for _ in range(4 * len(at)):
            a, b = edge
            c = self.opposite[edge]
            out = next(((u, v) for u, v in ((a, b), (b, c), (c, a)) if _cross(at[u], at[v], p) < 0), None)
            if out is None:
                return a, b, c
            if (out[1], out[0]) not in self.opposite:
                break
            edge = out[1], out[0]
        return max(self.triangles(), key=lambda t: min(_cross(at[t[k]], at[t[(k + 1) % 3]], p) for k in range(3)))

    def add(self, p: Point, near: tuple[int, int] | None = None) -> tuple[int, int]:
        """Puts in a point; gives an edge beside it, to begin at for the next."""
        a, b, c = self._holder(p, near if near in self.opposite else next(iter(self.opposite)))
        k = len(self.points)
        self.points.append(p)
        self._take(a, b, c)
        on = next(((u, v, w) for u, v, w in ((a, b, c), (b, c, a), (c, a, b)) if _cross(self.points[u], self.points[v], p) <= 0), None)
        if on is None:
            todo = [(a, b), (b, c), (c, a)]
            for u, v in todo:
                self._put(u, v, k)
        else:  # on the edge u v
            u, v, w = on
            self._put(v, w, k)
            self._put(w, u, k)
            todo = [(v, w), (w, u)]
            d = self.opposite.get((v, u))
            if d is not None:
                self._take(v, u, d)
                self._put(u, d, k)
                self._put(d, v, k)
                todo += [(u, d), (d, v)]
            if (u, v) in self.fixed:
                self.fixed |= {(u, k), (k, u), (k, v), (v, k)}
        self._turn(k, todo)
        return next((e for e in ((a, k), (b, k), (c, k)) if e in self.opposite), next(iter(self.opposite)))

    def _turn(self, k: int, todo: list[tuple[int, int]]) -> None:
        at = self.points
        while todo:
            u, v = todo.pop()
            d = self.opposite.get((v, u))
            if d is None or (u, v) in self.fixed or self.opposite.get((u, v)) != k:
                continue
            if _in_circle(at[u], at[v], at[k], at[d]) and _cross(at[u], at[d], at[k]) > 0 and _cross(at[d], at[v], at[k]) > 0:
                self._take(u, v, k)
                self._take(v, u, d)
                self._put(u, d, k)
                self._put(d, v, k)
                todo += [(u, d), (d, v)]


def _distinct(ring: list[Point], points: list[Point], eps: float) -> list[Point]:
    """points without those within eps of a corner of the ring or of a point before."""
    cells: dict[tuple[int, int], list[Point]] = {}

    def new(p: Point) -> bool:
        i, j = (math.floor(v / (2 * eps)) for v in p)
        if any(abs(p[0] - q[0]) <= eps and abs(p[1] - q[1]) <= eps for di in (-1, 0, 1) for dj in (-1, 0, 1) for q in cells.get((i + di, j + dj), ())):
            return False
        cells.setdefault((i, j), []).append(p)
        return True

    for p in ring:
        new(p)
    return [p for p in points if new(p)]


def _apart(ring: list[Point], eps: float) -> list[Point]:
    """A ring without corners that repeat the one before."""
    out: list[Point] = []
    for p in ring:
        if not out or abs(p[0] - out[-1][0]) > eps or abs(p[1] - out[-1][1]) > eps:
            out.append(p)
    while len(out) > 1 and abs(out[0][0] - out[-1][0]) <= eps and abs(out[0][1] - out[-1][1]) <= eps:
        out.pop()
    return out


def cover(ring: list[Point], extra: list[Point], seams: list[float] = (), strip: int = 0, eps: float = EPS) -> Iterator[tuple[Point, Point, Point]]:
    """The triangles of one strip of a ring, with the points in it."""
    ring = _apart(ring, eps)
    if len(ring) < 3:
        return
    seams = [float(s) for s in seams]
    xs = {p[0] for p in ring}
    for k, s in enumerate(seams):
        while s in xs:
            s = float(np.nextafter(s, np.inf))
        seams[k] = s
    pieces = [with_seams(ring, seams)]
    if strip > 0:
        pieces = [q for p in pieces for q in side(p, seams[strip - 1], True)]
    if strip < len(seams):
        pieces = [q for p in pieces for q in side(p, seams[strip], False)]
    left = extra
    for piece in pieces:
        mesh, near = Mesh(piece), None
        low, high = (tuple(f(p[k] for p in piece) for k in (0, 1)) for f in (min, max))
        mine = [p for p in left if low[0] <= p[0] <= high[0] and low[1] <= p[1] <= high[1] and inside(p, piece, 0.0)]
        if len(pieces) > 1:
            taken = set(mine)
            left = [p for p in left if p not in taken]
        for p in _along_curve(_distinct(piece, sorted(mine), eps), low, high):
            near = mesh.add(p, near)
        yield from (tuple(mesh.points[k] for k in t) for t in mesh.triangles())


def region_triangles(rings: DataFrame, points: DataFrame, strip_points: int = STRIP_POINTS, eps: float = EPS, small: int = SMALL) -> DataFrame:
    """rings(region, seq, x, y), points(region, x, y) -> (region, strip, x1, y1 .. y3), one row a triangle.

    A region of more than strip_points points is dealt to as many tasks as it has strips; the ring goes to each of them. Regions of `small`
    corners and points at most are rows of a batch, since a group of its own costs more than its triangles."""
    sound = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    corners = rings.select("region", F.lit(True).alias("_c"), "seq", "x", "y")
    both = corners.unionByName(sound.select("region", F.lit(False).alias("_c"), F.lit(None).alias("seq"), "x", "y"))
    limit = min(small, strip_points)
    wide = both.groupBy("region").agg(F.count("*").alias("m"), F.count_if(~F.col("_c")).alias("n")).filter(F.col("m") > limit).select("region", "n")
    few = both.join(copies.spread(wide), "region", "left_anti")
    return _few_triangles(few, eps).unionByName(_wide_triangles(rings.join(wide, "region", "left_semi"), sound.join(wide, "region"), strip_points, eps))


def _few_triangles(rows: DataFrame, eps: float) -> DataFrame:
    """region_triangles of the corners (_c) and points of regions that have few of them."""
    corner = F.struct(F.col("seq").isNull().alias("last"), "seq", "x", "y")
    held = rows.groupBy("region").agg(
        F.sort_array(F.collect_list(F.when(F.col("_c"), corner))).alias("r"), F.collect_list(F.when(~F.col("_c"), F.struct("x", "y"))).alias("p")
    ).filter(F.size("r") > 0)
    axes = [F.col(f"{k}.{d}").cast("array<double>").alias(f"{k}{d}") for k in "rp" for d in "xy"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in TRIANGLES.split(", ")]
        for b in batches:
            out = []
            for region, *at in zip(b["region"].tolist(), b["rx"], b["ry"], b["px"], b["py"]):
                rx, ry, px, py = (v.tolist() for v in at)
                out += [(region, 0, *(v for p in t for v in p)) for t in cover(list(zip(rx, ry)), list(zip(px, py)), eps=eps)]
            yield pd.DataFrame(out, columns=names)

    return held.select("region", *axes).mapInPandas(run, TRIANGLES)


def _wide_triangles(rings: DataFrame, points: DataFrame, strip_points: int, eps: float) -> DataFrame:
    """region_triangles by strips; points have the number n of their region's points."""
    count = points.groupBy("region").agg(F.first("n").alias("n"), F.percentile_approx("x", [k / STRIPS for k in range(1, STRIPS)], 20_000).alias("q"))
    strips = F.least(F.ceil(F.col("n") / strip_points), F.lit(STRIPS)).cast("int")
    places = F.when(strips > 1, F.transform(F.sequence(F.lit(1), strips - 1), lambda k: F.get("q", F.floor(k * STRIPS / strips).cast("int") - 1)))
    seams = count.select("region", F.array_sort(F.array_distinct(F.coalesce(places, F.array().cast("array<double>")))).alias("seams"))
    dealt = points.join(seams, "region").withColumn("strip", F.size(F.filter("seams", lambda s: s <= F.col("x")))).select("region", "strip", "x", "y")
    every = rings.join(seams, "region", "left").withColumn("seams", F.coalesce("seams", F.array().cast("array<double>")))
    every = every.withColumn("strip", F.explode(F.sequence(F.lit(0), F.size("seams"))))

    def run(key, ring: pd.DataFrame, extra: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in TRIANGLES.split(", ")]
        if not len(ring):
            return pd.DataFrame(columns=names)
        border = list(zip(*[ring.sort_values("seq")[c].tolist() for c in "xy"]))
        found = cover(border, list(zip(extra["x"].tolist(), extra["y"].tolist())), list(ring["seams"].iloc[0]), int(key[1]), eps)
        return pd.DataFrame([(key[0], key[1], *(v for p in t for v in p)) for t in found], columns=names)

    return every.groupBy("region", "strip").cogroup(dealt.groupBy("region", "strip")).applyInPandas(run, TRIANGLES)
