"""Buildings and their parts under a list of edits: faces, and the doors, windows and vents that they host.

Edits are folded over relations, not one after another: within a part only what came after its last deletion counts, an update changes the fields that it
names, and one of a part that is not there changes nothing. Deleting a face deletes what it hosts at that time. Parts that stand in a building at first count as added at -1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FACE = "id string, name string, kind string"
HOSTED = "id string, face_id string, type string, width double"
_FIELDS = ("face_id", "name", "kind", "type", "width")


def edited(buildings: DataFrame, edits: DataFrame) -> DataFrame:
    """buildings(building_id, faces array<FACE>, hosted array<HOSTED>) after edits(building_id, seq, op, part, id, face_id, name, kind, type, width).

    op: add, update or delete; part: face or hosted. Faces stand in order of their last addition, hosted parts too; those without a living face are gone. Edits of unknown buildings are left out."""
    nothing = {c: F.lit(None).cast("double" if c == "width" else "string") for c in _FIELDS}

    def standing(name: str, part: str) -> DataFrame:
        each = buildings.select("building_id", F.posexplode(name).alias("pos", "p"))
        has = each.schema["p"].dataType.names
        fields = [(F.col(f"p.{c}") if c in has else nothing[c]).alias(c) for c in _FIELDS]
        return each.select("building_id", F.lit(-1).cast("long").alias("seq"), F.lit("add").alias("op"), F.lit(part).alias("part"), F.col("p.id").alias("id"), *fields, "pos")

    given = edits.select("building_id", F.col("seq").cast("long").alias("seq"), "op", "part", "id", *[F.col(c).cast("double" if c == "width" else "string").alias(c) for c in _FIELDS], F.lit(0).alias("pos"))
    log = standing("faces", "face").unionByName(standing("hosted", "hosted")).unionByName(given)
    own = Window.partitionBy("building_id", "part", "id")
    living = _alive(log.withColumn("gone", F.max(F.when(F.col("op") == "delete", F.col("seq"))).over(own)))
    faces = living.filter("part = 'face'")
    dropped = log.filter("part = 'face' AND op = 'delete'").groupBy("building_id", F.col("id").alias("on")).agg(F.max("seq").alias("face_gone"))
    # what hosts a part is told by its addition, so that a part added again elsewhere is judged by that face
    parts = log.filter("part = 'hosted'").withColumn("on", F.last(F.when(F.col("op") == "add", F.col("face_id")), ignorenulls=True).over(own.orderBy("seq", "pos").rowsBetween(Window.unboundedPreceding, 0)))
    last_on = F.last("on", ignorenulls=True).over(own.orderBy("seq", "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    parts = parts.withColumn("on", last_on).join(dropped, ["building_id", "on"], "left")
    own_gone = F.max(F.when(F.col("op") == "delete", F.col("seq"))).over(own)
    hosted = _alive(parts.withColumn("gone", F.greatest(own_gone, F.col("face_gone"))).drop("face_gone", "on"))
    hosted = hosted.join(faces.select("building_id", F.col("id").alias("face_id")), ["building_id", "face_id"], "left_semi")
    gather = lambda df, ddl, name: df.groupBy("building_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("since", "place", F.struct(*[c.split()[0] for c in ddl.split(", ")]).alias("p")))), lambda s: s["p"]).alias(name)
    )
    empty = lambda ddl: F.array().cast(f"array<struct<{', '.join(': '.join(c.split()) for c in ddl.split(', '))}>>")
    out = buildings.select("building_id").join(gather(faces, FACE, "faces"), "building_id", "left").join(gather(hosted, HOSTED, "hosted"), "building_id", "left")
    return out.select("building_id", F.coalesce("faces", empty(FACE)).alias("faces"), F.coalesce("hosted", empty(HOSTED)).alias("hosted"))


def _alive(log: DataFrame) -> DataFrame:
    """(building_id, part, id, fields, since, place) of the parts that stand after their last deletion `gone`; values are those last given since the last addition."""
    own = Window.partitionBy("building_id", "part", "id")
    after = log.filter(F.col("gone").isNull() | (F.col("seq") > F.col("gone"))).filter("op IN ('add', 'update')")
    since = after.withColumn("since", F.max(F.when(F.col("op") == "add", F.col("seq"))).over(own)).filter("seq >= since")
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("seq", "pos"))).alias(c) for c in _FIELDS]
    return since.groupBy("building_id", "part", "id", "since").agg(*last, F.max("pos").alias("place"))
