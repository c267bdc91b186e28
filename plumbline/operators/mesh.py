"""Operators over triangulated surfaces: edges, outlines, normals, draping."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.tables import materialize


def face_edges(faces: DataFrame) -> DataFrame:
    """(face_id, lo, hi) of the three edges of each face."""
    pairs = F.array(*[F.struct(F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])
    return faces.select("face_id", F.explode(pairs).alias("e")).select("face_id", "e.lo", "e.hi")


def unique_edges(faces: DataFrame) -> DataFrame:
    return face_edges(faces).select("lo", "hi").distinct()


def boundary_edges(faces: DataFrame) -> DataFrame:
    """Edges of exactly one face."""
    return face_edges(faces).groupBy("lo", "hi").agg(F.count("*").alias("n")).filter("n = 1").select("lo", "hi")


def corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """faces with the coordinates ax..cz; faces with unknown vertices are dropped."""
    for k in "abc":
        faces = faces.join(vertices.select(F.col("vertex_id").alias(k), *[F.col(d).alias(f"{k}{d}") for d in "xyz"]), k)
    return faces


def unknown_vertices(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(face_id, vertex_id) of faces that name a vertex which is not there."""
    named = faces.select("face_id", F.explode(F.array("a", "b", "c")).alias("vertex_id"))
    return named.join(vertices, "vertex_id", "left_anti").select("face_id", "vertex_id")


def vertex_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(vertex_id, nx, ny, nz): normalised sum of the face normals around each vertex; up where it is zero."""
    f = corners(faces, vertices)
    u = [F.col(f"b{d}") - F.col(f"a{d}") for d in "xyz"]
    v = [F.col(f"c{d}") - F.col(f"a{d}") for d in "xyz"]
    n = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    each = f.select(F.explode(F.array("a", "b", "c")).alias("vertex_id"), *[x.alias(f"f{d}") for x, d in zip(n, "xyz")])
    s = each.groupBy("vertex_id").agg(*[F.sum(f"f{d}").alias(f"s{d}") for d in "xyz"])
    size = F.sqrt(sum((F.col(f"s{d}") * F.col(f"s{d}") for d in "xyz"), F.lit(0.0)))
    flat = {"x": 0.0, "y": 0.0, "z": 1.0}
    return s.select("vertex_id", *[F.when(size > 0, F.col(f"s{d}") / size).otherwise(flat[d]).alias(f"n{d}") for d in "xyz"])


def _cells(low: Column, high: Column, cell: float) -> Column:
    return F.sequence(F.floor(low / cell).cast("long"), F.floor(high / cell).cast("long"))


def drape(points: DataFrame, faces: DataFrame, vertices: DataFrame, cell: float, offset: float = 0.05) -> DataFrame:
    """points(point_id, x, y) with the highest z of the surface there plus an offset, null off the surface.

    Triangles are dealt to the cells of a grid that their bounds meet, points to their cell: an equi-join."""
    f = corners(faces, vertices)
    span = [(F.least(*[f"{k}{d}" for k in "abc"]), F.greatest(*[f"{k}{d}" for k in "abc"])) for d in "xy"]
    dealt = f.withColumn("gx", F.explode(_cells(*span[0], cell))).withColumn("gy", F.explode(_cells(*span[1], cell)))
    at = points.withColumns({"gx": F.floor(F.col("x") / cell).cast("long"), "gy": F.floor(F.col("y") / cell).cast("long")})
    area = (F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("cx") - F.col("ax")) * (F.col("by") - F.col("ay"))
    wb = ((F.col("x") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("cx") - F.col("ax")) * (F.col("y") - F.col("ay"))) / area
    wc = ((F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) - (F.col("x") - F.col("ax")) * (F.col("by") - F.col("ay"))) / area
    met = at.join(dealt, ["gx", "gy"]).filter(area != 0).withColumns({"wb": wb, "wc": wc})
    hit = met.filter("wb >= -1e-12 AND wc >= -1e-12 AND wb + wc <= 1 + 1e-12")
    z = F.col("az") + F.col("wb") * (F.col("bz") - F.col("az")) + F.col("wc") * (F.col("cz") - F.col("az"))
    top = hit.groupBy("point_id").agg((F.max(z) + offset).alias("draped"))
    return points.join(top, "point_id", "left")


def carry_last(df: DataFrame, value: str, order: str, *by: str) -> DataFrame:
    """df with nulls of a column replaced by the last value before them in their group."""
    last = F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(value, last)


def densify(vertices: DataFrame, longest: float, *by: str) -> DataFrame:
    """Points (.., seq, part, x, y) along polylines, no two neighbours farther apart than `longest`."""
    step = Window.partitionBy(*by).orderBy("seq")
    ends = vertices.withColumns({"_x": F.lead("x").over(step), "_y": F.lead("y").over(step)})
    length = F.sqrt((F.col("_x") - F.col("x")) * (F.col("_x") - F.col("x")) + (F.col("_y") - F.col("y")) * (F.col("_y") - F.col("y")))
    pieces = F.greatest(F.ceil(length / longest), F.lit(1))
    each = ends.withColumn("_n", F.coalesce(pieces, F.lit(1)).cast("int")).withColumn("part", F.explode(F.expr("sequence(0, _n - 1)")))
    t = F.col("part") / F.col("_n")
    return each.select(
        *by, "seq", "part", *[F.coalesce(F.col(d) + (F.col(f"_{d}") - F.col(d)) * t, F.col(d)).alias(d) for d in "xy"]
    )


def ring_areas(vertices: DataFrame, *by: str) -> DataFrame:
    """Signed area of each closed ring, by the shoelace formula."""
    step, whole = Window.partitionBy(*by).orderBy("seq"), Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = {d: F.coalesce(F.lead(d).over(step), F.first(d).over(whole)) for d in "xy"}
    told = vertices.withColumns({"_x": nxt["x"], "_y": nxt["y"]})
    return told.groupBy(*by).agg((F.sum(F.col("x") * F.col("_y") - F.col("_x") * F.col("y")) / 2).alias("area"))


def polyline_lengths(vertices: DataFrame, *by: str) -> DataFrame:
    step = Window.partitionBy(*by).orderBy("seq")
    dx, dy = F.col("x") - F.lag("x").over(step), F.col("y") - F.lag("y").over(step)
    told = vertices.withColumn("_d", F.sqrt(dx * dx + dy * dy))
    return told.groupBy(*by).agg(F.coalesce(F.sum("_d"), F.lit(0.0)).alias("length"))


def walk_loops(edges: pd.DataFrame) -> pd.DataFrame:
    """(loop, seq, vertex, closed) of one surface's boundary edges lo, hi: each loop goes on along the first edge left."""
    left: dict[int, list[int]] = {}
    for a, b in zip(edges["lo"].tolist(), edges["hi"].tolist()):
        left.setdefault(a, []).append(b)
        left.setdefault(b, []).append(a)
    rows, loop = [], 0
    for start in sorted(left):
        while left[start]:
            path, at = [start], start
            while left[at]:
                nxt = left[at].pop(0)
                left[nxt].remove(at)
                at = nxt
                if at == start:
                    break
                path.append(at)
            rows += [(loop, k, v, at == start) for k, v in enumerate(path)]
            loop += 1
    return pd.DataFrame(rows, columns=["loop", "seq", "vertex", "closed"])


def boundary_loops(faces: DataFrame, surface: str = "surface_id") -> DataFrame:
    """Outlines and holes of each surface: only its boundary edges meet in a task, some square root of its faces."""
    pairs = F.array(*[F.struct(F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])
    edges = faces.select(surface, F.explode(pairs).alias("e")).groupBy(surface, "e.lo", "e.hi").agg(F.count("*").alias("n")).filter("n = 1")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        return walk_loops(rows.sort_values(["lo", "hi"])).assign(**{surface: rows[surface].iloc[0]})

    return edges.groupBy(surface).applyInPandas(walk, f"loop int, seq int, vertex long, closed boolean, {surface} string")


def drape_or_floor(points: DataFrame, faces: DataFrame, vertices: DataFrame, cell: float, offset: float = 0.05) -> DataFrame:
    """The drape of a raster's or sheet's mesh: off the surface it lies at the surface's least z."""
    floor = vertices.agg(F.min("z").alias("_floor"))
    told = drape(points, faces, vertices, cell, offset).crossJoin(F.broadcast(floor))  # one row
    return told.withColumn("draped", F.coalesce("draped", "_floor")).drop("_floor")


def boundary_rings(faces: DataFrame, surface: str = "surface_id") -> DataFrame:
    """(surface, ring, seq, vertex): the outlines and holes of surfaces whose faces(surface, a, b, c) turn one way, by pointer doubling.

    A boundary edge runs as its face does, so that outlines turn as the faces and holes the other way; an edge's successor starts where it ends,
    and where several meet, the k-th that comes in goes on with the k-th that goes out. Each round doubles how far an edge sees: first for the least
    edge of its ring, whose start names the ring, then for its distance to it. So a ring of n edges takes some 2 log n joins, and
    none of them needs a ring or a surface in one task. Edges whose way ends (faces that turn differently) give no ring."""
    sides = F.array(*[F.struct(F.col(p).alias("u"), F.col(q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])
    directed = faces.select(surface, F.explode(sides).alias("e")).select(surface, "e.u", "e.v")
    back = directed.select(surface, F.col("v").alias("u"), F.col("u").alias("v"))
    edges = directed.join(back, [surface, "u", "v"], "left_anti")
    out = edges.select(surface, "u", "v", F.row_number().over(Window.partitionBy(surface, "u").orderBy("v")).alias("k"))
    into = edges.select(surface, F.col("v").alias("u"), F.struct("u", "v").alias("e"), F.row_number().over(Window.partitionBy(surface, "v").orderBy("u")).alias("k"))
    links = materialize(into.join(out.select(surface, "u", "k", F.struct("u", "v").alias("next")), [surface, "u", "k"], "left").select(surface, "e", "next"), "ring-links")
    seen = links.filter("next IS NOT NULL").withColumn("least", F.least("e", "next"))
    while True:
        far = seen.select(surface, F.col("e").alias("next"), F.col("next").alias("_n"), F.col("least").alias("_l"))
        wider = materialize(seen.join(far, [surface, "next"]).select(surface, "e", F.col("_n").alias("next"), F.least("least", "_l").alias("least"), (F.col("_l") < F.col("least")).alias("moved")), "ring-least")
        seen = wider.drop("moved")
        if wider.filter("moved").isEmpty():
            break
    named = links.join(seen.select(surface, "e", "least"), [surface, "e"])
    # how many steps it is to the least edge; rings are cut before it
    steps = materialize(named.select(surface, "e", "least", F.when(F.col("next") != F.col("least"), F.col("next")).alias("next"), F.lit(1).cast("long").alias("left")), "ring-steps")
    while not steps.filter("next IS NOT NULL").isEmpty():
        far = steps.select(surface, F.col("e").alias("next"), F.col("next").alias("_n"), F.col("left").alias("_m"))
        steps = materialize(steps.join(far, [surface, "next"], "left").select(surface, "e", "least", F.col("_n").alias("next"), (F.col("left") + F.coalesce("_m", F.lit(0))).alias("left")), "ring-steps")
    size = F.max("left").over(Window.partitionBy(surface, "least"))
    return steps.withColumn("seq", size - F.col("left")).select(surface, F.col("least.u").alias("ring"), "seq", F.col("e.u").alias("vertex"))
