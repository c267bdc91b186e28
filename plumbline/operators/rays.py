"""Rays and pointers against clouds, surfaces and drawn features, by the grid cells that they pass.

A straight line from a to b passes into another cell where it crosses a plane of the grid. The crossings of all axes in
order cut it into pieces, each within one cell, so that its cells are an array expression: no walk, and the joins
are equi-joins on cells. A point lies in one cell and a ray lists a cell once, so that a pair meets once.

rays: (ray_id, ox, oy, oz, dx, dy, dz, reach): the ray at t is o + t * d for 0 <= t <= reach. Rows with a null or without a
direction meet nothing. Equal rays are followed once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as geo
from plumbline.operators import copies

AXES = ("x", "y", "z")
RAY = (*[f"{m}{d}" for m in "od" for d in AXES], "reach")
#: Hits of a ray that are told from each source of points.
HITS = 8


def passed_cells(a: Sequence[Column], b: Sequence[Column], cell: float) -> Column:
    """array<struct<c0, c1, ..>>: the cells of a grid that the line from a to b passes, each once."""

    def crossings(p: Column, q: Column) -> Column:
        low, high = F.floor(F.least(p, q) / cell).cast("long") + 1, F.floor(F.greatest(p, q) / cell).cast("long")
        planes = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(planes, lambda k: (k * F.lit(cell) - p) / F.nullif(q - p, F.lit(0.0)))

    cuts = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), *map(crossings, a, b)))

    def piece(t: Column, i: Column) -> Column:
        return (t + F.coalesce(F.get(cuts, i + 1), t)) / 2

    at = lambda t: F.struct(*[F.floor((p + (q - p) * t) / cell).cast("long").alias(f"c{k}") for k, (p, q) in enumerate(zip(a, b))])
    return F.array_distinct(F.transform(F.transform(cuts, piece), at))


def _around(cells: Column, m: Column | int, n: int) -> Column:
    """The cells, and those within m of them along every axis."""
    near = F.sequence(-F.lit(m) if isinstance(m, int) else -m, F.lit(m) if isinstance(m, int) else m)

    def along(found: Column, k: int) -> Column:
        moved = lambda c, s: F.struct(*[(c[f"c{j}"] + (s if j == k else 0)).cast("long").alias(f"c{j}") for j in range(n)])
        return F.array_distinct(F.flatten(F.transform(found, lambda c: F.transform(near, lambda s: moved(c, s)))))

    for k in range(n):
        cells = along(cells, k)
    return cells


def _clipped(rays: DataFrame, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """rays with t0 and t1, where they enter and leave a box; those that miss it are left out."""
    t0, t1, meets = F.lit(0.0), F.col("reach").cast("double"), F.lit(True)
    for d, a, b in zip(AXES, low, high):
        o, v = F.col(f"o{d}"), F.nullif(F.col(f"d{d}").cast("double"), F.lit(0.0))
        s, e = (F.lit(float(a)) - o) / v, (F.lit(float(b)) - o) / v
        t0, t1 = F.greatest(t0, F.least(s, e)), F.least(t1, F.greatest(s, e))  # both pass over nulls: no motion along the axis
        meets = meets & (v.isNotNull() | o.between(float(a), float(b)))
    moves = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz") > 0
    return rays.withColumns({"t0": t0, "t1": t1}).filter(meets & moves & (F.col("t0") <= F.col("t1")))


def _ends(t: str) -> list[Column]:
    return [F.col(f"o{d}") + F.col(f"d{d}") * F.col(t) for d in AXES]


def _bounds(rows: DataFrame, least: Sequence[Column], most: Sequence[Column]) -> tuple[list[float], list[float]] | None:
    found = rows.agg(*[F.min(c) for c in least], *[F.max(c) for c in most]).first()
    return (list(found[:3]), list(found[3:])) if found[0] is not None else None


def cloud_hits(rays: DataFrame, points: DataFrame, cell: float, radius: float, slope: float = 0.0, most: int = HITS, by: str = "source") -> DataFrame:
    """(ray_id, source, rank, t, distance, ...columns of points): of each ray and source the first points along the ray, `most` at most.

    A point is hit if it is no farther from the ray than radius + slope * its distance along the ray, which
    is a tolerance in pixels for a camera. Take off points that are hidden before, so that they don't count. Of the points of a source
    at one place only the first `most` can be told, and only they are joined."""
    rays, members = copies.once(rays, "ray_id", *RAY)
    place = Window.partitionBy(*AXES, by).orderBy(*([c for c in ("idx",) if c in points.columns] or AXES))
    points = points.withColumn("_k", F.row_number().over(place)).filter(F.col("_k") <= most).drop("_k")
    box = _bounds(points, [F.col(d) for d in AXES], [F.col(d) for d in AXES])
    if box is None:
        box = ([0.0] * 3, [0.0] * 3)
    length = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    wide = radius + slope * F.col("reach") * length
    # a ray that passes beside the box may still be near its points
    near = rays.withColumn("wide", wide)
    margin = near.agg(F.max("wide")).first()[0] or 0.0
    inside = _clipped(near, [v - margin for v in box[0]], [v + margin for v in box[1]])
    cells = _around(passed_cells(_ends("t0"), _ends("t1"), cell), F.ceil(F.col("wide") / cell).cast("long"), 3)
    asked = inside.select("ray_id", *[f"{m}{d}" for m in "od" for d in AXES], "reach", F.explode(cells).alias("c")).select("*", *[F.col(f"c.c{k}").alias(f"_c{k}") for k in range(3)]).drop("c")
    dealt = points.withColumns({f"_c{k}": F.floor(F.col(d) / cell).cast("long") for k, d in enumerate(AXES)})
    off = [F.col(d) - F.col(f"o{d}") for d in AXES]
    size = sum((F.col(f"d{d}") * F.col(f"d{d}") for d in AXES), F.lit(0.0))
    t = sum((p * F.col(f"d{d}") for p, d in zip(off, AXES)), F.lit(0.0)) / size
    away = F.sqrt(sum(((p - F.col("t") * F.col(f"d{d}")) * (p - F.col("t") * F.col(f"d{d}")) for p, d in zip(off, AXES)), F.lit(0.0)))
    met = asked.join(copies.spread(dealt), ["_c0", "_c1", "_c2"]).withColumn("t", t).withColumn("distance", away)
    hit = met.filter((F.col("t") >= 0) & (F.col("t") <= F.col("reach")) & (F.col("distance") <= radius + slope * F.col("t") * F.sqrt(size)))
    order = Window.partitionBy("ray_id", by).orderBy("t", "distance", *[c for c in ("idx",) if c in points.columns])
    ranked = hit.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return copies.each(ranked.select("ray_id", by, "rank", "t", "distance", *[c for c in points.columns if c != by]), members, "ray_id")


def surface_hits(rays: DataFrame, triangles: DataFrame, cell: float) -> DataFrame:
    """(ray_id, t, surface, face_id, x, y, z): the first triangle along each ray; triangles: (surface, face_id, ax .. cz).

    Where rays have a column `active`, only the surface that it names counts; null stands for all."""
    has = "active" in rays.columns
    rays, members = copies.once(rays, "ray_id", *RAY, *(["active"] if has else []))
    # of equal triangles of a surface the first is told
    triangles = triangles.groupBy("surface", *[f"{k}{d}" for k in "abc" for d in AXES]).agg(F.min("face_id").alias("face_id"))
    axis = lambda d: [F.col(f"{k}{d}") for k in "abc"]
    least, most = [F.least(*axis(d)) for d in AXES], [F.greatest(*axis(d)) for d in AXES]
    box = _bounds(triangles, least, most) or ([0.0] * 3, [0.0] * 3)
    edge = 1e-9 * max(1.0, cell)
    inside = _clipped(rays, [v - edge for v in box[0]], [v + edge for v in box[1]])
    cells = passed_cells(_ends("t0"), _ends("t1"), cell)
    names = ["ray_id", *[f"{m}{d}" for m in "od" for d in AXES], "reach", *(["active"] if has else [])]
    asked = inside.select(*names, F.explode(cells).alias("c")).select(*names, *[F.col(f"c.c{k}").alias(f"_c{k}") for k in range(3)])
    dealt = triangles
    for k, (low, high) in enumerate(zip(least, most)):  # a little wider, for rays that run within a plane of the grid
        dealt = dealt.withColumn(f"_c{k}", F.explode(F.sequence(F.floor((low - edge) / cell).cast("long"), F.floor((high + edge) / cell).cast("long"))))
    u, v, d, o = ([F.col(f"b{x}") - F.col(f"a{x}") for x in AXES], [F.col(f"c{x}") - F.col(f"a{x}") for x in AXES], [F.col(f"d{x}") for x in AXES], [F.col(f"o{x}") - F.col(f"a{x}") for x in AXES])
    cross = lambda p, q: [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    h, s = cross(d, v), cross(o, u)
    turn = F.nullif(dot(u, h), F.lit(0.0))
    met = asked.join(copies.spread(dealt), ["_c0", "_c1", "_c2"])
    if has:
        met = met.filter(F.col("active").isNull() | (F.col("active") == F.col("surface")))
    told = met.withColumns({"t": dot(v, s) / turn, "_u": dot(o, h) / turn, "_v": dot(d, s) / turn})
    hit = told.filter("_u >= 0 AND _v >= 0 AND _u + _v <= 1 AND t >= 0 AND t <= reach")
    first = hit.groupBy("ray_id").agg(F.min_by(F.struct("t", "surface", "face_id", *[(F.col(f"o{x}") + F.col("t") * F.col(f"d{x}")).alias(x) for x in AXES]), F.struct("t", "surface", "face_id")).alias("h"))
    return copies.each(first.select("ray_id", "h.*"), members, "ray_id")


def read_out(hits: DataFrame, origin: tuple[float, float, float], exaggeration: float = 1.0) -> DataFrame:
    """hits with survey coordinates e, n and the true z, of places relative to an origin with stretched heights."""
    return hits.select("ray_id", "surface", (F.col("x") + origin[0]).alias("e"), (F.col("y") + origin[1]).alias("n"), (F.col("z") / exaggeration + origin[2]).alias("z"))


def feature_candidates(pointers: DataFrame, vertices: DataFrame, edges: DataFrame, tolerance: float) -> DataFrame:
    """(pointer_id, kind, feature_id, sx, sy, x, y, z): authored vertices and edges within twice the tolerance of a pointer on the screen, along both axes.

    pointers: (pointer_id, px, py). vertices: (feature_id, x, y, z, sx, sy) with their places on the screen, null behind the camera. edges: (feature_id, ax .. bz,
    asx, asy, bsx, bsy); an edge's place is the point of its line on the screen next to the pointer, at the same share of its ends in space."""
    cell = 2 * tolerance
    at = F.array(F.struct(*[F.floor(F.col(p) / cell).cast("long").alias(f"c{k}") for k, p in enumerate(("px", "py"))]))
    asked = pointers.withColumn("c", F.explode(_around(at, 1, 2))).select("pointer_id", "px", "py", F.col("c.c0").alias("_c0"), F.col("c.c1").alias("_c1"))
    near = (F.abs(F.col("sx") - F.col("px")) <= cell) & (F.abs(F.col("sy") - F.col("py")) <= cell)
    columns = ["pointer_id", "kind", "feature_id", "sx", "sy", *AXES]
    placed = vertices.filter(F.col("sx").isNotNull() & F.col("sy").isNotNull()).withColumns({"_c0": F.floor(F.col("sx") / cell).cast("long"), "_c1": F.floor(F.col("sy") / cell).cast("long")})
    found = asked.join(placed, ["_c0", "_c1"]).filter(near).withColumn("kind", F.lit("authored-vertex")).select(*columns)
    screen = (F.col("asx"), F.col("asy")), (F.col("bsx"), F.col("bsy"))
    shown = edges.filter(" AND ".join(f"{c} IS NOT NULL" for c in ("asx", "asy", "bsx", "bsy")))
    dealt = shown.withColumn("c", F.explode(passed_cells(*screen, cell))).select("*", F.col("c.c0").alias("_c0"), F.col("c.c1").alias("_c1")).drop("c")
    met = asked.join(dealt, ["_c0", "_c1"]).withColumn("n", geo.closest_on_segment(F.col("px"), F.col("py"), *screen))
    place = {d: F.col(f"a{d}") + (F.col(f"b{d}") - F.col(f"a{d}")) * F.col("n.t") for d in AXES}
    told = met.withColumns({"sx": F.col("n.x"), "sy": F.col("n.y"), **place}).filter(near).withColumn("kind", F.lit("authored-edge"))
    ends = [f"{k}{d}" for k in "ab" for d in AXES]
    return found.unionByName(told.dropDuplicates(["pointer_id", "px", "py", "feature_id", *ends]).select(*columns))


def to_screen(x: Column, y: Column, z: Column, matrix: Sequence[float], width: float, height: float) -> Column:
    """struct(x, y) in pixels of a place, by a camera's view and projection (16 numbers, row by row); null behind the camera."""
    row = lambda k: matrix[4 * k] * x + matrix[4 * k + 1] * y + matrix[4 * k + 2] * z + matrix[4 * k + 3]
    w = row(3)
    return F.when(w > 0, F.struct(((row(0) / w + 1) / 2 * width).alias("x"), ((1 - row(1) / w) / 2 * height).alias("y")))
