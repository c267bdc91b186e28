"""Lists, limits, summaries and parameters of projects: what panels and reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.display import measure

#: Fixed values.
LABEL_CAP, EVIDENCE_ROWS, WARNING_CAP, DECODES = 500, 200, 50, 4
SUPPRESSED = "… further warnings suppressed"
VIEW_ORDER = ("preview", "index", "surfel")
REGION_SOURCES = ("Generated flat grid", "Cloud-linked surface point", "Feature-linked surface point", "Manual / assumed surface point")


def picks(items: Column, most: int = 8) -> Column:
    """Items evenly spaced by position, first and last among them; all if there are no more than `most`."""
    n = F.size(items)
    at = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (n - 1) / (most - 1)).cast("int"))
    return F.when(n <= most, items).otherwise(F.transform(at, lambda i: F.get(items, i)))


def dashes(a: Column, b: Column, dash: float = 2.0, gap: float = 1.2) -> Column:
    """An array of (from, to) along a segment between structs x, y, z; a segment begins with a dash."""
    u = {d: b[d] - a[d] for d in "xyz"}
    total = F.sqrt(sum((v * v for v in u.values()), F.lit(0.0)))
    at = lambda s: F.struct(*[(a[d] + u[d] / total * s).alias(d) for d in "xyz"])
    starts = F.transform(F.sequence(F.lit(0), F.ceil(total / (dash + gap)).cast("int") - 1), lambda k: k * F.lit(dash + gap))
    cut = F.transform(starts, lambda s: F.struct(at(s).alias("from"), at(F.least(s + dash, total)).alias("to")))
    return F.when(total >= 1e-6, cut)


def labels_or_none(candidates: DataFrame, cap: int = LABEL_CAP) -> DataFrame:
    """The candidates, or none at all if there are more than `cap`."""
    n = candidates.agg(F.count("*").alias("_n"))
    return candidates.crossJoin(F.broadcast(n)).filter(F.col("_n") <= cap).drop("_n")  # one row


def head_and_rest(items: Column, most: int = EVIDENCE_ROWS) -> tuple[Column, Column]:
    """The first items of a list, and how many follow them."""
    return F.slice(items, 1, most), F.greatest(F.size(items) - most, F.lit(0))


def capped_warnings(warnings: DataFrame, cap: int = WARNING_CAP) -> DataFrame:
    """warnings(file, seq, message): of each file the first `cap`, and one line in place of all others."""
    place = F.row_number().over(Window.partitionBy("file").orderBy("seq"))
    told = warnings.withColumn("place", place).filter(F.col("place") <= cap + 1)
    return told.withColumn("message", F.when(F.col("place") <= cap, F.col("message")).otherwise(SUPPRESSED))


def view_rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in VIEW_ORDER]), kind)


def next_decodes(tiles: DataFrame, limit: int = DECODES) -> DataFrame:
    """tiles(raster, tile, distance, loading): of each raster the nearest tiles to decode now, as many as running ones leave free."""
    busy = F.count_if("loading").over(Window.partitionBy("raster"))
    told = tiles.withColumn("_busy", busy).filter(~F.col("loading"))
    place = F.row_number().over(Window.partitionBy("raster").orderBy("distance", "tile"))
    return told.withColumn("place", place).filter(F.col("place") + F.col("_busy") <= limit).drop("_busy")


def evict_densified(nodes: DataFrame, budget: int, *by: str) -> DataFrame:
    """nodes(key, points, last_used, distance, held): those to release, least recent first and of these the farthest, until the rest fits."""
    total = F.sum("points").over(Window.partitionBy(*by))
    order = Window.partitionBy(*by).orderBy("last_used", F.col("distance").desc(), "key").rowsBetween(Window.unboundedPreceding, -1)
    free = nodes.withColumn("_total", total).filter(~F.col("held"))
    return free.withColumn("_gone", F.coalesce(F.sum("points").over(order), F.lit(0))).filter(F.col("_total") - F.col("_gone") > budget).drop("_total", "_gone")


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, n): rows that one bag has more often than the other; n = 0 on both sides if they are equal."""
    count = lambda df, side: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return count(left.exceptAll(right), "left").union(count(right.exceptAll(left), "right"))


def not_near(candidates: DataFrame, present: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    """candidates(x, y) that no present point lies within epsilon of in both directions: an equi-join over cells of that size."""
    cell = lambda c: F.floor(c / epsilon).cast("long")
    around = F.explode(F.array(*[F.struct((cell(F.col("x")) + i).alias("gx"), (cell(F.col("y")) + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    there = present.select(F.col("x").alias("px"), F.col("y").alias("py"), around.alias("g")).select("px", "py", "g.*").alias("p")
    c = candidates.withColumns({"gx": cell(F.col("x")), "gy": cell(F.col("y"))}).alias("c")
    near = F.expr(f"c.gx = p.gx AND c.gy = p.gy AND abs(c.x - p.px) <= {epsilon} AND abs(c.y - p.py) <= {epsilon}")
    return c.join(there, near, "left_anti").drop("gx", "gy")


def elevations(points: DataFrame, *by: str) -> DataFrame:
    return points.groupBy(*by).agg(F.min("z").alias("low"), F.max("z").alias("high"), F.avg("z").alias("mean"))


def region_elevation(regions: DataFrame, surface: DataFrame, border: DataFrame) -> DataFrame:
    """(region_id, elevation): the mean of a region's surface points, or of its border, or 0."""
    mean = lambda df, name: df.groupBy("region_id").agg(F.avg("z").alias(name))
    told = regions.select("region_id").join(mean(surface, "s"), "region_id", "left").join(mean(border, "b"), "region_id", "left")
    return told.select("region_id", F.coalesce("s", "b", F.lit(0.0)).alias("elevation"))


def region_source_label(source: Column, evidence: Column) -> Column:
    cases = (source == "generated-grid", evidence == "asset-point", evidence.isin("asset-vertex", "asset-edge"))
    out = F.lit(REGION_SOURCES[3])
    for case, label in reversed(list(zip(cases, REGION_SOURCES))):
        out = F.when(F.coalesce(case, F.lit(False)), label).otherwise(out)
    return out


def building_summaries(buildings: DataFrame, faces: DataFrame, hosted: DataFrame) -> DataFrame:
    """(building_id, summary) of envelope buildings: vertices, walls, roof planes, other faces and hosted features."""
    f = faces.groupBy("building_id").agg(F.count_if(F.col("kind") == "wall").alias("walls"), F.count_if(F.col("kind") == "roof").alias("roofs"), F.count("*").alias("faces"))
    told = buildings.join(f, "building_id", "left").join(hosted.groupBy("building_id").agg(F.count("*").alias("hosted")), "building_id", "left").fillna(0, ["walls", "roofs", "faces", "hosted"])
    some = lambda n, what: F.concat(n.cast("string"), F.lit(f" {what}"), F.when(n == 1, "").otherwise("s"))
    other = F.col("faces") - F.col("walls") - F.col("roofs")
    parts = [
        F.concat(F.col("envelope_points").cast("string"), F.lit("-pt envelope")), some(F.col("walls"), "wall"), some(F.col("roofs"), "roof plane"),
        F.when(other > 0, some(other, "other face")), F.when(F.col("hosted") > 0, some(F.col("hosted"), "feature")),
    ]
    return told.select("building_id", F.concat_ws(", ", *parts).alias("summary"))


def evidence_badges(authorship: Column, kinds: Column) -> Column:
    has = lambda *names: F.arrays_overlap(kinds, F.array(*[F.lit(n) for n in names]))
    badges = (("snapped-to-cloud", has("asset-point")), ("snapped-to-feature", has("asset-vertex", "asset-edge")), ("free-placement", has("picked-coordinate")), ("manual", has("manual-note")))
    return F.array_distinct(F.array_compact(F.array(authorship, *[F.when(F.coalesce(test, F.lit(False)), name) for name, test in badges])))


def placement_evidence(snapped: Column, source: Column) -> Column:
    """The kind of evidence that a placement leaves."""
    kinds = {"cloud-point": "asset-point", "authored-vertex": "asset-vertex", "authored-edge": "asset-edge", "dwg-vertex": "asset-vertex", "tin-vertex": "asset-vertex", "surface-hit": "surface-hit"}
    table = F.create_map(*[F.lit(x) for p in kinds.items() for x in p])
    return F.when(~snapped, "picked-coordinate").otherwise(F.try_element_at(table, source))


def coerced(kind: Column, raw: Column, low: Column, high: Column, options: Column) -> Column:
    """A parameter's raw text as its type allows it, as text; null where it does not."""
    number = raw.try_cast("double") if hasattr(raw, "try_cast") else raw.cast("double")
    fits = number.isNotNull() & ~F.isnan(number) & F.coalesce(number >= low, F.lit(True)) & F.coalesce(number <= high, F.lit(True))
    return (
        F.when(kind == "boolean", F.when(raw.isin("true", "on"), "true").otherwise("false"))
        .when(kind == "number", F.when(fits, number.cast("string")))
        .when(kind == "enum", F.when(F.array_contains(options, raw), raw)).otherwise(raw)
    )


def remapped(parameters: DataFrame, schema: DataFrame) -> DataFrame:
    """(feature_id, name, value): parameters(feature_id, template, name, raw) carried over to the names of the feature's template in schema(template, name, kind, low, high, options, fallback)."""
    features = parameters.select("feature_id", "template").distinct()
    wanted = features.join(schema, "template")
    told = wanted.join(parameters.select("feature_id", "name", "raw"), ["feature_id", "name"], "left")
    value = F.coalesce(coerced(F.col("kind"), F.col("raw"), F.col("low"), F.col("high"), F.col("options")), F.col("fallback"))
    return told.select("feature_id", "name", F.when(F.col("raw").isNull(), F.col("fallback")).otherwise(value).alias("value"))


def pipe_summary(shape: Column, size: Column, material: Column, span: Column, rise: Column, n: Column, run: Column, assumed: Column) -> Column:
    """One line about a run of pipe: its section, points and length."""
    section = F.when(shape == "box", F.concat(measure(span, False), F.lit("x"), measure(rise, False), F.lit(" box"))).otherwise(F.concat(measure(size, False), F.lit('" '), material))
    tenth = F.floor(run * 10 + 0.5) / 10
    return F.concat(section, F.lit(" - "), n.cast("string"), F.lit(" pts - "), measure(tenth, False), F.lit(" lf"), F.when(assumed, " - assumed end").otherwise(""))


def cache_fault(stored: dict[str, Column], wanted: dict[str, Column], there: Column) -> Column:
    """The first reason why a preview cache is not valid, in order; null if it is. The last three are asked only if the source is there."""
    ordered = (
        ("schema", "schema-version-mismatch"), ("asset", "asset-id-mismatch"), ("points", "point-count-mismatch"), ("sha", "header-sha-mismatch"),
        ("quality", "quality-mismatch"), ("size", "file-size-mismatch"), ("mtime", "file-mtime-mismatch"), ("source_sha", "source-header-mismatch"),
    )
    out: Column = F.lit(None).cast("string")
    for k, (name, reason) in reversed(list(enumerate(ordered))):
        differs = ~stored["sha" if name == "source_sha" else name].eqNullSafe(wanted[name])
        out = F.when(differs & there if k > 4 else differs, reason).otherwise(out)
    return out


def scene(bounds: DataFrame, exaggeration: float, *by: str) -> DataFrame:
    """The union of the visible boxes (min_x to max_z, visible) with heights exaggerated, and its half diagonal; no row if none is visible."""
    each = [F.min(f"min_{d}").alias(f"min_{d}") for d in "xyz"] + [F.max(f"max_{d}").alias(f"max_{d}") for d in "xyz"]
    told = bounds.filter("visible").groupBy(*by).agg(*each, F.count("*").alias("n")).filter("n > 0")
    told = told.withColumns({f"{m}_z": F.col(f"{m}_z") * exaggeration for m in ("min", "max")})
    size = sum(((F.col(f"max_{d}") - F.col(f"min_{d}")) * (F.col(f"max_{d}") - F.col(f"min_{d}")) for d in "xyz"), F.lit(0.0))
    return told.withColumn("radius", F.sqrt(size) / 2)
