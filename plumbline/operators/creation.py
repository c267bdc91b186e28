"""Features made from finished drafts, and records that take the place of older ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.editing import LEAST_VERTICES
from plumbline.operators.numbering import numbered

# Labels in names, and the kind of a building whose outline is no evidence.
LABELS = {"region": "Region", "object": "Object", "building": "Building", "utility": "Utility", "line": "Line", "marker": "Marker", "measurement": "Measurement"}
ENVELOPE = "envelope"


def finished(drafts: DataFrame) -> DataFrame:
    """Drafts with the vertices that their geometry (point, polyline, polygon) needs; regions and buildings are polygons whatever it says. Others, and null vertices, are left out."""
    shape = F.when(F.col("family").isin("region", "building"), "polygon").otherwise(F.col("geometry"))
    needed = F.lit(None).cast("int")
    for kind, n in LEAST_VERTICES.items():
        needed = F.when(shape == kind, n).otherwise(needed)
    return drafts.filter(F.size("vertices") >= needed)


def create(drafts: DataFrame, features: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New features, and the exclusion zones of the buildings among them.

    drafts(draft_id, simulation_id, family, subtype, template_id, geometry, seq, vertices, evidence array<string>, at), features(simulation_id, family, ...) that are there already and
    templates(template_id, display_name, system, params map<string, string>). A feature's name holds how many of its family stood in the simulation before it, plus one, by seq; ids come from those of the
    drafts, so that a task run again gives the same. A region's evidence is kept by its edges, an envelope's is none. A template that is not known gives no parameters."""
    stood = features.groupBy("simulation_id", "family").agg(F.count("*").alias("_stood")).select(F.col("simulation_id").alias("_s"), F.col("family").alias("_f"), "_stood")
    known = templates.select(F.col("template_id").alias("_t"), "display_name", "system", "params")
    new = numbered(finished(drafts), ["seq", "draft_id"], "simulation_id", "family", name="_n")
    told = new.join(stood, F.col("simulation_id").eqNullSafe(F.col("_s")) & F.col("family").eqNullSafe(F.col("_f")), "left").join(known, F.col("template_id") == F.col("_t"), "left")
    n = (F.col("_n") + F.coalesce(F.col("_stood"), F.lit(0))).cast("string")
    label = F.col("family")
    for family, text in LABELS.items():
        label = F.when(F.col("family") == family, text).otherwise(label)
    name = F.when(F.col("family") == "object", F.concat_ws(" ", F.coalesce(F.col("display_name"), label), n)).when(
        F.col("family") == "utility", F.concat_ws(" ", F.coalesce(F.col("system"), F.lit("Utility")), F.coalesce(F.col("display_name"), label), n)
    ).otherwise(F.concat(F.concat_ws(" ", label, n), F.lit(" ("), F.coalesce(F.col("subtype"), F.lit("")), F.lit(")")))
    nothing = F.array().cast("array<string>")
    outline = (F.col("family") == "building") & F.coalesce(F.col("subtype") == ENVELOPE, F.lit(False))
    params = F.coalesce(F.col("params"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(params, lambda k, v: k != "breaklineType")
    made = told.select(
        F.concat(F.lit("feat-"), F.col("draft_id").cast("string")).alias("feature_id"), "simulation_id", F.when((F.col("geometry") == "point") & ~F.col("family").isin("region", "building"), "marker").otherwise("polyline").alias("type"),
        name.alias("name"), "family", "template_id", "subtype", F.lit("authored").alias("authorship"), F.lit("authored").alias("lifecycle"), "vertices",
        F.when((F.col("family") == "region") | outline, nothing).otherwise(F.coalesce(F.col("evidence"), nothing)).alias("evidence_refs"), F.when(F.col("family") == "region", F.col("evidence")).alias("edge_evidence"),
        F.when(F.col("family") == "line", F.map_concat(kept, F.create_map(F.lit("breaklineType"), F.coalesce(F.col("subtype"), F.lit(""))))).otherwise(params).alias("parameters"), F.col("at").alias("created_at"), F.col("at").alias("modified_at"), "draft_id",
    )
    zones = made.filter("family = 'building'").select(
        F.concat(F.lit("zone-"), F.col("draft_id").cast("string")).alias("zone_id"), "simulation_id", "feature_id", F.concat("name", F.lit(" footprint")).alias("name"), F.col("vertices").alias("polygon"), "created_at", "modified_at",
    )
    return made.drop("draft_id"), zones


def replaced(rows: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """rows with new in the place of those with the same key; what stood under a null key stays. Both have the same columns."""
    return rows.join(new.select(*key), list(key), "left_anti").select(*rows.columns).unionByName(new.select(*rows.columns))
