"""Edits of surfaces and features as DataFrame steps: guards, swaps, cascades, toggles, drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import mesh
from plumbline.operators.numbering import numbered

#: Least doubled area of a triangle, and vertices that a draft needs.
FLAT = 1e-9
LEAST_VERTICES = {"point": 1, "polyline": 2, "polygon": 3}


def doubled_area(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column]) -> Column:
    """Twice the signed plan area of a triangle: its orientation."""
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def edge_faces(faces: DataFrame) -> DataFrame:
    """(lo, hi, first, second): the faces on both sides of each edge; second is null on the boundary."""
    return mesh.face_edges(faces).groupBy("lo", "hi").agg(
        F.min("face_id").alias("first"), F.when(F.count("*") > 1, F.max("face_id")).alias("second")
    )


def blocked_moves(faces: DataFrame, vertices: DataFrame, moves: DataFrame) -> DataFrame:
    """moves(vertex_id, x, y) with blocked: whether a face around the vertex would turn over or become flat. Each move is judged alone."""
    f = mesh.corners(faces, vertices)
    at = lambda k: (F.col(f"{k}x"), F.col(f"{k}y"))
    before = f.withColumn("was", doubled_area(at("a"), at("b"), at("c")))
    each = before.select("*", F.explode(F.array("a", "b", "c")).alias("vertex_id")).join(moves.select("vertex_id", F.col("x").alias("mx"), F.col("y").alias("my")), "vertex_id")
    new = lambda k: tuple(F.when(F.col(k) == F.col("vertex_id"), F.col(m)).otherwise(F.col(f"{k}{d}")) for d, m in (("x", "mx"), ("y", "my")))
    now = doubled_area(new("a"), new("b"), new("c"))
    bad = each.groupBy("vertex_id").agg(F.bool_or((F.abs(now) < FLAT) | (now * F.col("was") <= 0)).alias("bad"))
    return moves.join(bad, "vertex_id", "left").select(*moves.columns, F.coalesce("bad", F.lit(False)).alias("blocked"))


def apply_moves(vertices: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vertices after the moves that are not blocked, and those moves' commands (vertex_id, from_x, from_y, to_x, to_y), which undo by their inverse."""
    free = judged.filter(~F.col("blocked")).select("vertex_id", F.col("x").alias("to_x"), F.col("y").alias("to_y"))
    joined = vertices.join(free, "vertex_id", "left")
    after = joined.select("vertex_id", F.coalesce("to_x", "x").alias("x"), F.coalesce("to_y", "y").alias("y"), "z")
    commands = joined.filter("to_x is not null").select("vertex_id", F.col("x").alias("from_x"), F.col("y").alias("from_y"), "to_x", "to_y")
    return after, commands


def inverse(commands: DataFrame) -> DataFrame:
    return commands.select("vertex_id", F.col("to_x").alias("from_x"), F.col("to_y").alias("from_y"), F.col("from_x").alias("to_x"), F.col("from_y").alias("to_y"))


def edge_swaps(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(lo, hi, face_a, a1..a3, face_b, b1..b3): the two triangles that each inner edge would become, counter-clockwise."""
    pair = edge_faces(faces).filter("second is not null")
    ends = lambda k: ~F.col(k).eqNullSafe(F.col("lo")) & ~F.col(k).eqNullSafe(F.col("hi"))
    other = F.coalesce(*[F.when(ends(k), F.col(k)) for k in "abc"])
    for side in ("first", "second"):
        pair = pair.join(faces.select(F.col("face_id").alias(side), "a", "b", "c"), side).withColumn(f"o_{side}", other).drop("a", "b", "c")
    pair = pair.filter("o_first <> o_second")
    for k in ("lo", "hi", "o_first", "o_second"):
        pair = pair.join(vertices.select(F.col("vertex_id").alias(k), F.col("x").alias(f"{k}_x"), F.col("y").alias(f"{k}_y")), k)
    at = lambda k: (F.col(f"{k}_x"), F.col(f"{k}_y"))

    def turned(p: str, q: str, r: str, name: str) -> list[Column]:
        left = doubled_area(at(p), at(q), at(r)) >= 0
        return [F.col(p).alias(f"{name}1"), F.when(left, F.col(q)).otherwise(F.col(r)).alias(f"{name}2"), F.when(left, F.col(r)).otherwise(F.col(q)).alias(f"{name}3")]

    return pair.select(
        "lo", "hi", F.col("first").alias("face_a"), *turned("o_first", "o_second", "lo", "a"), F.col("second").alias("face_b"), *turned("o_second", "o_first", "hi", "b")
    )


def cascade_delete(features: DataFrame, zones: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features without those in gone(feature_id), and without the zones that belong to them, which are features too."""
    dead = gone.select("feature_id").union(zones.join(gone, zones["owner_id"] == gone["feature_id"], "left_semi").select(F.col("zone_id"))).distinct()
    left = features.join(dead, "feature_id", "left_anti")
    return left, zones.join(left.select(F.col("feature_id").alias("owner_id")), "owner_id", "left_semi").select(*zones.columns)


def invalidate_surfaces(regions: DataFrame, edited: DataFrame) -> DataFrame:
    """regions(feature_id, surface, ...) without the stored surface of those edited."""
    flag = edited.select("feature_id").distinct().withColumn("_edited", F.lit(True))
    return regions.join(flag, "feature_id", "left").withColumn("surface", F.when(F.col("_edited").isNull(), F.col("surface"))).drop("_edited")


def layer_status(layers: DataFrame, updates: DataFrame) -> DataFrame:
    """layers(layer_id, status, modified_at) after updates(seq, layer_id, visible, stamp); the last update of a layer holds, nothing else changes."""
    last = updates.groupBy("layer_id").agg(F.max_by(F.struct("visible", "stamp"), "seq").alias("u"))
    joined = layers.join(last, "layer_id", "left")
    status = F.when(F.col("u").isNull(), F.col("status")).when(F.col("u.visible"), "active").otherwise("hidden")
    return joined.withColumn("status", status).withColumn("modified_at", F.coalesce("u.stamp", "modified_at")).drop("u")


def master_toggle(views: DataFrame, remembered: DataFrame | None, on: bool) -> DataFrame:
    """(layer_id, visible): updates that switch the views(layer_id, active, status) off, or back to what was remembered(layer_id, was_active)."""
    if not on:
        return views.filter("active").select("layer_id", F.lit(False).alias("visible"))
    told = views.join(remembered, "layer_id", "left") if remembered is not None else views.withColumn("was_active", F.lit(None).cast("boolean"))
    return told.select("layer_id", "active", F.coalesce("was_active", F.col("status") != "error").alias("visible")).filter("visible <> active").select("layer_id", "visible")


def drafts(events: DataFrame, draft: str = "draft") -> DataFrame:
    """The state and vertices of each draft after its events(draft, seq, mode, event), in order; events that do not apply change nothing.

    A draft's events are folded from an array; a draft is drawn by hand and has few."""
    ordered = events.groupBy(draft).agg(F.min("mode").alias("mode"), F.array_sort(F.collect_list(F.struct("seq", "event"))).alias("e"))
    least = F.create_map(*[F.lit(x) for p in LEAST_VERTICES.items() for x in p])

    def step(s: Column, e: Column) -> Column:
        state, n, what = s["state"], s["n"], e["event"]
        open_ = state.isin("placing", "adding")
        new = (
            F.when((what == "start") & state.isin("idle", "complete", "cancelled"), "placing")
            .when((what == "place") & open_, F.when(F.col("mode") == "point", "complete").otherwise("adding"))
            .when((what == "close") & (state == "adding") & (n >= least[F.col("mode")]), "closing")
            .when((what == "confirm") & (state == "closing"), "complete")
            .when((what == "cancel") & state.isin("placing", "adding", "closing"), "cancelled").otherwise(state)
        )
        count = F.when((what == "start") & (new == "placing") & ~open_, 0).when((what == "place") & open_, n + 1).when(new == "cancelled", 0).otherwise(n)
        return F.struct(new.alias("state"), count.alias("n"))

    begin = F.struct(F.lit("idle").alias("state"), F.lit(0).alias("n"))
    return ordered.withColumn("s", F.aggregate("e", begin, step)).select(draft, "mode", "s.state", F.col("s.n").alias("vertices"))


def default_placements(features: DataFrame) -> DataFrame:
    """features(type, face_length, face_height, width, height) with offset_u and offset_v: doors stand on the face's bottom, windows have a sill of 3, others are centred."""
    spare = F.greatest(F.col("face_height") - F.col("height"), F.lit(0.0))
    v = F.when(F.col("type") == "door", 0.0).when(F.col("type") == "window", F.least(F.lit(3.0), spare)).otherwise(spare / 2)
    return features.withColumns({"offset_u": F.greatest((F.col("face_length") - F.col("width")) / 2, F.lit(0.0)), "offset_v": v})


def numbered_names(rows: DataFrame, label: Column, *by: str) -> DataFrame:
    """rows(seq, kind) with the name each got when it was added: its kind's label and how many of that kind stood before, plus one."""
    told = numbered(rows, ["seq"], *by, "kind", name="_n")
    return told.withColumn("name", F.concat_ws(" ", label, F.col("_n").cast("string"))).drop("_n")


def nearest_edges(hits: DataFrame, faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """hits(hit_id, face_id, x, y, z) with the edge (from_id, to_id) of the face that lies nearest, and its distance; the first of equals."""
    f = hits.join(mesh.corners(faces, vertices), "face_id")
    p = [F.col(d) for d in "xyz"]

    def edge(k: int, a: str, b: str) -> Column:
        u = [F.col(f"{b}{d}") - F.col(f"{a}{d}") for d in "xyz"]
        w = [q - F.col(f"{a}{d}") for q, d in zip(p, "xyz")]
        size = sum((x * x for x in u), F.lit(0.0))
        t = F.when(size == 0, 0.0).otherwise(F.least(F.greatest(sum((x * y for x, y in zip(u, w)), F.lit(0.0)) / size, F.lit(0.0)), F.lit(1.0)))
        d = F.sqrt(sum(((y - t * x) * (y - t * x) for x, y in zip(u, w)), F.lit(0.0)))
        return F.struct(d.alias("distance"), F.lit(k).alias("k"), F.col(a).alias("from_id"), F.col(b).alias("to_id"))

    best = F.array_min(F.array(edge(0, "a", "b"), edge(1, "b", "c"), edge(2, "c", "a")))
    return f.withColumn("e", best).select("hit_id", "e.from_id", "e.to_id", "e.distance")


def hosted_on_live_faces(hosted: DataFrame, faces: DataFrame) -> DataFrame:
    """hosted(face_id, ...) whose face is still there: deleting a face takes what it hosts."""
    return hosted.join(faces.select("face_id"), "face_id", "left_semi")
