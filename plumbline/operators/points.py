"""Operators over point rows: voxels, planes, samples, ranges, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as geo
from plumbline.functions import las
from plumbline.operators import copies
from plumbline.sources.tables import materialize

#: Surfel cells: factors of the point spacing, least points, and limits of radius and confidence.
CELL, LEAST_CELL, TINY = 1.5, 0.75, 1e-4
MIN_POINTS, RADIUS_OF_SPACING, RADIUS_OF_SPREAD, RADIUS_OF_CELL, SURE = 2, 0.85, 1.5, 0.35, 0.35


def bounds(points: DataFrame, *by: str) -> DataFrame:
    ends = [f(d).alias(f"{n}_{d}") for n, f in (("min", F.min), ("max", F.max)) for d in "xyz"]
    return points.groupBy(*by).agg(*ends, F.count("*").alias("n"))


def spacing(box: DataFrame) -> DataFrame:
    """box with spacing: the cube root of the volume a point has, 0 for one point or none."""
    volume: Column = F.lit(1.0)
    for d in "xyz":
        volume = volume * F.greatest(F.col(f"max_{d}") - F.col(f"min_{d}"), F.lit(0.0))
    return box.withColumn("spacing", F.when(F.col("n") > 1, F.cbrt(F.greatest(volume, F.lit(1e-9)) / F.col("n"))).otherwise(0.0))


def voxel_sums(points: DataFrame, cell: float, low: tuple[float, float, float], *by: str) -> DataFrame:
    """Counts, sums and product sums of the points of each cell, in coordinates relative to low; one shuffle, combined before it."""
    rel = {d: F.col(d) - F.lit(a) for d, a in zip("xyz", low)}
    cells = [F.floor(v / F.lit(cell)).cast("long").alias(f"c{d}") for d, v in rel.items()]
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    keep = points.select(*by, *cells, *[v.alias(f"_{d}") for d, v in rel.items()], "r", "g", "b")
    return keep.groupBy(*by, "cx", "cy", "cz").agg(
        F.count("*").alias("n"), *[F.sum(f"_{d}").alias(f"s{d}") for d in "xyz"],
        *[F.sum(F.col(f"_{a}") * F.col(f"_{b}")).alias(f"s{a}{b}") for a, b in pairs],
        *[F.avg(c).alias(f"m{c}") for c in "rgb"],
    )


def drop_small_cells(cells: DataFrame, least: int = MIN_POINTS, *by: str) -> DataFrame:
    """Cells of at least so many points, or all of a group that has no such cell."""
    any_large = cells.groupBy(*by).agg(F.max("n").alias("_most"))
    joined = cells.join(any_large, list(by)) if by else cells.crossJoin(F.broadcast(any_large))  # one row in all
    return joined.filter((F.col("n") >= least) | (F.col("_most") < least)).drop("_most")


def covariance(cells: DataFrame) -> DataFrame:
    """cells with the population covariances vxx..vzz."""
    out = {}
    for a, b in (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")):
        out[f"v{a}{b}"] = F.col(f"s{a}{b}") / F.col("n") - F.col(f"s{a}") / F.col("n") * (F.col(f"s{b}") / F.col("n"))
    return cells.withColumns(out)


def eigenvalues(df: DataFrame) -> DataFrame:
    """df with e1 <= e2 <= e3 of the symmetric matrix vxx..vzz, by the trigonometric formula."""
    c = F.col
    q = (c("vxx") + c("vyy") + c("vzz")) / 3
    off = c("vxy") * c("vxy") + c("vxz") * c("vxz") + c("vyz") * c("vyz")
    df = df.withColumn("_q", q).withColumn("_off", off)
    p2 = sum(((c(f"v{d}{d}") - c("_q")) * (c(f"v{d}{d}") - c("_q")) for d in "xyz"), F.lit(0.0)) + 2 * c("_off")
    df = df.withColumn("_p", F.sqrt(p2 / 6))
    a, b, d = ((c(f"v{x}{x}") - c("_q")) / c("_p") for x in "xyz")
    xy, xz, yz = (c(f"v{x}") / c("_p") for x in ("xy", "xz", "yz"))
    det = a * (b * d - yz * yz) - xy * (xy * d - yz * xz) + xz * (xy * yz - b * xz)
    angle = F.acos(F.least(F.greatest(det / 2, F.lit(-1.0)), F.lit(1.0))) / 3
    df = df.withColumn("_t", F.when(c("_p") > 0, angle))
    e3 = F.when(c("_p") > 0, c("_q") + 2 * c("_p") * F.cos(c("_t"))).otherwise(c("_q"))
    e1 = F.when(c("_p") > 0, c("_q") + 2 * c("_p") * F.cos(c("_t") + F.lit(2.0943951023931953))).otherwise(c("_q"))
    df = df.withColumns({"e3": e3, "e1": e1})
    return df.withColumn("e2", 3 * c("_q") - c("e1") - c("e3")).drop("_q", "_off", "_p", "_t")


def normals(df: DataFrame) -> DataFrame:
    """df with the unit eigenvector (nx, ny, nz) of e1, pointing up, or east or north where it is level; null where undefined."""
    c = F.col
    rows = [
        [c("vxx") - c("e1"), c("vxy"), c("vxz")],
        [c("vxy"), c("vyy") - c("e1"), c("vyz")],
        [c("vxz"), c("vyz"), c("vzz") - c("e1")],
    ]

    def cross(a, b):
        v = (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
        return F.struct((v[0] * v[0] + v[1] * v[1] + v[2] * v[2]).alias("s"), *[x.alias(n) for x, n in zip(v, "xyz")])

    df = df.withColumn("_n", F.greatest(cross(rows[0], rows[1]), cross(rows[0], rows[2]), cross(rows[1], rows[2])))
    size = F.sqrt(c("_n.s"))
    up = F.when(F.abs(c("_n.z")) > 1e-9 * size, F.signum(c("_n.z"))).when(F.abs(c("_n.x")) > 1e-9 * size, F.signum(c("_n.x"))).otherwise(F.signum(c("_n.y")))
    return df.withColumns({f"n{d}": F.when(size > 0, c(f"_n.{d}") / size * up) for d in "xyz"}).drop("_n")


def surfels(points: DataFrame, cell: float, point_spacing: float, low: tuple[float, float, float], least: int = MIN_POINTS, *by: str) -> DataFrame:
    """Centre, mean colour, radius, normal, confidence and flag of each cell."""
    df = normals(eigenvalues(covariance(drop_small_cells(voxel_sums(points, cell, low, *by), least, *by))))
    trace = F.col("e1") + F.col("e2") + F.col("e3")
    sure = F.when(trace > 0, (F.col("e3") - F.col("e1")) / trace).otherwise(0.0)
    spread = F.sqrt(F.greatest(F.col("e2") + F.col("e1"), F.lit(0.0)) * 0.5)
    return df.select(
        *by, "cx", "cy", "cz", "n", *[(F.col(f"s{d}") / F.col("n") + F.lit(a)).alias(d) for d, a in zip("xyz", low)],
        *[las.half_up(F.col(f"m{k}")).cast("int").alias(k) for k in "rgb"],
        F.greatest(F.lit(point_spacing * RADIUS_OF_SPACING), spread * RADIUS_OF_SPREAD, F.lit(cell * RADIUS_OF_CELL)).alias("radius"),
        "nx", "ny", "nz", sure.alias("confidence"), F.when((sure < SURE) | F.col("nx").isNull(), 1).otherwise(0).alias("flags"),
    )


def fit_planes(points: DataFrame, *by: str) -> DataFrame:
    """Best-fit plane of each group: centroid, normal, rms; null normal for fewer than 3 points, coincident or collinear ones."""
    mean = points.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(d).alias(f"o{d}") for d in "xyz"])
    # Central moments need the centroid first: a second pass, joined on the group.
    rel = points.join(mean, list(by)).select(*by, *[(F.col(d) - F.col(f"o{d}")).alias(d) for d in "xyz"])
    pairs = (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))
    moments = rel.groupBy(*by).agg(*[F.avg(F.col(a) * F.col(b)).alias(f"v{a}{b}") for a, b in pairs])
    df = normals(eigenvalues(mean.join(moments, list(by))))
    good = (F.col("n") >= 3) & (F.col("e3") > 1e-12) & (F.col("e2") / F.col("e3") >= 1e-6)
    return df.select(
        *by, "n", "ox", "oy", "oz", *[F.when(good, F.col(f"n{d}")).alias(f"n{d}") for d in "xyz"],
        F.when(good, F.sqrt(F.greatest(F.col("e1"), F.lit(0.0)))).alias("rms"), "e1", "e2", "e3",
    )


def floor_percentiles(df: DataFrame, value: str, shares: dict[str, float], *by: str, counts: str | None = None) -> DataFrame:
    """n, and for each named share the element floor((n - 1) * share) of each group's ascending values, all in one pass.

    Equal values are counted before they are ranked, so that a group is one row a distinct value. counts: a column that tells how often a row counts."""
    counted = df.groupBy(*by, value).agg((F.sum(counts) if counts else F.count("*")).alias("_k"))
    up = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    ranked = counted.select(*by, value, F.sum("_k").over(up).alias("_to"), F.sum("_k").over(whole).alias("n"))
    at = [F.min(F.when(F.col("_to") > F.floor((F.col("n") - 1) * share), F.col(value))).alias(name) for name, share in shares.items()]
    return ranked.groupBy(*by, "n").agg(*at)


def floor_percentile(df: DataFrame, value: str, share: float, *by: str, counts: str | None = None) -> DataFrame:
    return floor_percentiles(df, value, {"value": share}, *by, counts=counts)


def strided(points: DataFrame, budget: int, order: str = "idx") -> DataFrame:
    """Every k-th point in file order, k the least stride that keeps within the budget."""
    step = las.stride(F.lit(points.count()), budget)
    return points.filter(F.col(order) % step == 0)


def ranges(points: DataFrame, block: int, *by: str, order: str = "idx") -> DataFrame:
    """Runs of neighbouring blocks of records that hold points of each group: start and number of blocks."""
    blocks = points.select(*by, F.floor(F.col(order) / block).cast("long").alias("k")).distinct()
    island = F.col("k") - F.row_number().over(Window.partitionBy(*by).orderBy("k"))
    return blocks.withColumn("_i", island).groupBy(*by, "_i").agg(F.min("k").alias("start"), F.count("*").alias("blocks")).drop("_i")


def capped_sample(points: DataFrame, stride: int, cap: int, *by: str, order: str = "idx") -> DataFrame:
    """Of each group the first `cap` points in file order among every stride-th."""
    taken = points.filter(F.col(order) % stride == 0)
    return taken.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(order))).filter(F.col("_k") <= cap).drop("_k")


def attribute_counts(points: DataFrame, *attributes: str) -> DataFrame:
    """(attribute, value, n): how often each value occurs, for all attributes in one shuffle."""
    told = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("long").alias("value")) for a in attributes])
    return points.select(F.explode(told).alias("e")).groupBy("e.attribute", "e.value").agg(F.count("*").alias("n"))


def nearest_within(queries: DataFrame, candidates: DataFrame, reach: float, *order: str) -> DataFrame:
    """The best candidate within reach of each query in the plane, by the order columns, distance, and latest sequence number.

    Both sides are dealt to square cells of the size of the reach; a query looks into nine of them."""
    cell = lambda d: F.floor(F.col(d) / F.lit(reach)).cast("long")
    near = F.array(*[F.struct((cell("qx") + i).alias("gx"), (cell("qy") + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    q = queries.withColumn("_g", F.explode(near)).select("*", "_g.gx", "_g.gy").drop("_g")
    c = candidates.withColumns({"gx": cell("x"), "gy": cell("y")})
    d2 = (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy"))
    met = q.join(c, ["gx", "gy"]).withColumn("distance", F.sqrt(d2)).filter(F.col("distance") <= reach)
    key = F.struct(*[F.col(o) for o in order], F.col("distance"), (-F.col("seq")).alias("_s"))
    best = met.groupBy("query_id").agg(F.min_by(F.struct("seq", "distance", *order), key).alias("_b"))
    return best.select("query_id", "_b.*")


def count_in_polygons(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """(polygon_id, inside, inside_filtered): points(x, y, passes) of each of polygons(polygon_id, ring), all of them and those that pass.

    Polygons are dealt to the cells of a grid that their bounds meet, points to their cell: an equi-join. A point is in one
    cell, so that it meets a polygon once. Points at one place are counted before, and polygons with one ring are tested once."""
    firsts, members = copies.once(polygons.select("polygon_id", "ring"), "polygon_id", "ring")
    axis = lambda d: F.transform("ring", lambda p: p[d])
    xs, ys = axis("x"), axis("y")
    span = lambda v: F.sequence(F.floor(F.array_min(v) / cell).cast("long"), F.floor(F.array_max(v) / cell).cast("long"))
    # Edges that are not level, made once a polygon; the test folds over them and builds no array.
    steep = F.filter(geo.ring_edges(F.col("ring")), lambda e: e["a"]["y"] != e["b"]["y"])
    box = [f(v).alias(f"_{n}{d}") for d, v in (("x", xs), ("y", ys)) for n, f in (("lo", F.array_min), ("hi", F.array_max))]
    dealt = firsts.select("polygon_id", steep.alias("edges"), *box, F.explode(span(xs)).alias("gx"), ys.alias("_y"))
    dealt = dealt.select("polygon_id", "edges", "_lox", "_hix", "_loy", "_hiy", "gx", F.explode(span(F.col("_y"))).alias("gy"))
    p = points.groupBy("x", "y").agg(F.count("*").alias("n"), F.count_if("passes").alias("m"))
    p = p.select("*", *[F.floor(F.col(d) / cell).cast("long").alias(f"g{d}") for d in "xy"])
    x, y = F.col("x"), F.col("y")
    near = p.join(copies.spread(dealt), ["gx", "gy"]).filter(x.between(F.col("_lox"), F.col("_hix")) & y.between(F.col("_loy"), F.col("_hiy")))

    def crosses(e: Column) -> Column:
        u, v = e["a"], e["b"]
        return ((u["y"] > y) != (v["y"] > y)) & (x < (v["x"] - u["x"]) * (y - u["y"]) / (v["y"] - u["y"]) + u["x"])

    inside = near.filter(F.aggregate("edges", F.lit(False), lambda odd, e: odd != crosses(e)))
    found = inside.groupBy("polygon_id").agg(F.sum("n").alias("inside"), F.sum("m").alias("inside_filtered"))
    told = members.join(copies.spread(found.withColumnRenamed("polygon_id", "like")), "like", "left")
    return told.select("polygon_id", "inside", "inside_filtered").fillna(0, ["inside", "inside_filtered"])


# Multiples of the first disc's radius, and the points that a disc needs.
LADDER = ((1, 12), (2, 12), (4, 8), (8, 6))


def ground_ladder(queries: DataFrame, points: DataFrame, radius: float, share: float = 0.1, ladder: tuple[tuple[int, int], ...] = LADDER) -> DataFrame:
    """(query_id, rung, n, ground): a low percentile of the heights in the first of several widening discs that holds enough points; queries(query_id, qx, qy).

    Queries whose widest disc holds too few have no row. Both sides are dealt to cells as wide as the widest disc. Queries at one place are
    answered once, and points at one place are counted before."""
    firsts, members = copies.once(queries, "query_id", "qx", "qy")
    points = points.groupBy("x", "y", "z").agg(F.count("*").alias("k"))
    cell = radius * max(m for m, _ in ladder)
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    near = F.explode(F.array(*[F.struct((at("qx") + i).alias("gx"), (at("qy") + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    asked = firsts.withColumn("_g", near).select("query_id", "qx", "qy", "_g.gx", "_g.gy")
    d2 = (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy"))
    met = asked.join(copies.spread(points.select("x", "y", "z", "k", at("x").alias("gx"), at("y").alias("gy"))), ["gx", "gy"]).select("query_id", "z", "k", d2.alias("d2"))
    rungs = F.filter(F.array(*[F.struct(F.lit(k).alias("rung"), F.lit((radius * m) ** 2).alias("most"), F.lit(least).alias("least")) for k, (m, least) in enumerate(ladder)]), lambda r: r["most"] >= F.col("d2"))
    each = met.select("query_id", "z", "k", F.explode(rungs).alias("r")).select("query_id", "z", "k", "r.rung", "r.least")
    told = floor_percentile(each, "z", share, "query_id", "rung", "least", counts="k").filter("n >= least")
    found = told.groupBy("query_id").agg(F.min("rung").alias("rung"), F.min_by("n", "rung").alias("n"), F.min_by("value", "rung").alias("ground"))
    return copies.each(found, members, "query_id")


def centroids(points: DataFrame, *by: str) -> DataFrame:
    """Mean x and y of each group."""
    return points.groupBy(*by).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def fit_faces(points: DataFrame, *by: str) -> DataFrame:
    """The frame and extents of a flat face through each group: the plane of `fit_planes`, x along its level line, y up its slope.

    Groups without a plane have no row. kind: wall for a normal nearer to level than to upright by half, else roof."""
    plane = materialize(fit_planes(points, *by), "planes").filter("nx IS NOT NULL")  # else each use of a normal would compute it again
    flat = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny"))
    level = flat > 1e-6
    frame = plane.withColumns({"xx": F.when(level, -F.col("ny") / flat).otherwise(1.0), "xy": F.when(level, F.col("nx") / flat).otherwise(0.0)})
    frame = frame.withColumns({"yx": -F.col("nz") * F.col("xy"), "yy": F.col("nz") * F.col("xx"), "yz": F.col("nx") * F.col("xy") - F.col("ny") * F.col("xx")})
    size = F.sqrt(F.col("yx") * F.col("yx") + F.col("yy") * F.col("yy") + F.col("yz") * F.col("yz"))
    frame = frame.withColumns({c: F.col(c) / size for c in ("yx", "yy", "yz")})
    off = {d: F.col(d) - F.col(f"o{d}") for d in "xyz"}
    placed = points.select(*by, "x", "y", "z").join(frame.select(*by, "ox", "oy", "oz", "xx", "xy", "yx", "yy", "yz"), list(by))
    u, v = off["x"] * F.col("xx") + off["y"] * F.col("xy"), off["x"] * F.col("yx") + off["y"] * F.col("yy") + off["z"] * F.col("yz")
    extents = placed.groupBy(*by).agg(*[f(c).alias(f"{m}_{n}") for n, c in (("u", u), ("v", v)) for m, f in (("min", F.min), ("max", F.max))])
    length, height = F.col("max_u") - F.col("min_u"), F.col("max_v") - F.col("min_v")
    return frame.join(extents, list(by)).withColumns({
        "length": length, "height": height, "area": length * height, "kind": F.when(F.abs(F.col("nz")) < 0.5, "wall").otherwise("roof"),
    })


def face_corners() -> Column:
    """array<struct<x, y, z>>: the four corners of a fitted face, for rows of `fit_faces`; around it from its least u and v."""

    def corner(u: str, v: str) -> Column:
        u, v = F.col(u), F.col(v)
        return F.struct(
            (F.col("ox") + u * F.col("xx") + v * F.col("yx")).alias("x"), (F.col("oy") + u * F.col("xy") + v * F.col("yy")).alias("y"), (F.col("oz") + v * F.col("yz")).alias("z")
        )

    return F.array(corner("min_u", "min_v"), corner("max_u", "min_v"), corner("max_u", "max_v"), corner("min_u", "max_v"))
