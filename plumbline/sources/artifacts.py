"""Stored surfaces of a project: JSON files that are checked as they are read, and a save of the manifest that checks it first."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import opening
from plumbline.sources import project
from plumbline.sources.tables import materialize

# Fields that a stored surface has.
SURFACE = {"id": opening.Field("string", blank=True), "name": opening.Field("string", blank=True)} | {k: opening.Field("array") for k in ("positions", "sourcePointIds", "indices")}


def read_surfaces(spark: SparkSession, folder: str, paths: list[str]) -> dict[str, DataFrame]:
    """surfaces (path, id, name), vertices (path, vertex, source_id, x, y, z), faces (path, face, a, b, c) and faults (path, field, issue) of a project's stored surfaces.

    A path that leaves the folder is refused. A file that is no JSON, or lacks a field, is a fault and has no other rows; it keeps no other file from being read."""
    files = [project.inside(folder, p) for p in paths]
    raw = spark.read.text(files, wholetext=True) if files else spark.createDataFrame([], "value string")
    name = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/") if files else F.lit("")
    relative = F.substring(name, len(os.path.realpath(folder)) + 2, 1 << 30)
    parsed = raw.select(relative.alias("path"), F.try_parse_json("value").alias("v"))
    whole = F.when(F.col("v").isNull(), F.array(F.struct(F.lit("").alias("path"), F.lit("not-json").alias("issue")))).when(
        ~F.schema_of_variant("v").startswith("OBJECT"), F.array(F.struct(F.lit("").alias("path"), F.lit("not-object").alias("issue")))
    ).otherwise(opening.issues_of(F.col("v"), SURFACE))
    get = lambda path, kind: F.try_variant_get("v", f"$.{path}", kind)
    told = parsed.select(
        "path", whole.alias("issues"), get("id", "string").alias("id"), get("name", "string").alias("name"), get("positions", "array<double>").alias("xyz"), get("sourcePointIds", "array<bigint>").alias("ids"),
        get("indices", "array<bigint>").alias("abc"),
    )
    held = materialize(told, "stored-surfaces")
    good = held.filter(F.size("issues") == 0)
    three = lambda c, k: F.get(F.col(c), F.col("k") * 3 + k)
    each = lambda c: F.explode(F.when(F.size(c) >= 3, F.sequence(F.lit(0), F.floor(F.size(c) / 3).cast("int") - 1))).alias("k")
    return {
        "surfaces": good.select("path", "id", "name"),
        "vertices": good.select("path", "xyz", "ids", each("xyz")).select("path", F.col("k").alias("vertex"), F.get("ids", F.col("k")).alias("source_id"), *[three("xyz", k).alias(d) for k, d in enumerate("xyz")]),
        "faces": good.select("path", "abc", each("abc")).select("path", F.col("k").alias("face"), *[three("abc", k).alias(d) for k, d in enumerate("abc")]),
        "faults": held.select("path", F.explode("issues").alias("i")).select("path", F.col("i.path").alias("field"), "i.issue"),
    }


def manifest_faults(spark: SparkSession, manifest: dict) -> DataFrame:
    """(table, id, path, issue): records of a manifest's lists that are not of their shape."""
    out = None
    for name, shape in opening.SHAPES.items():
        rows = [(str(r.get("id")) if isinstance(r, dict) else str(k), json.dumps(r)) for k, r in enumerate(manifest.get(name, []))]
        found = opening.shape_issues(spark.createDataFrame(rows, "id string, record string"), shape).select(F.lit(name).alias("table"), "id", "path", "issue")
        out = found if out is None else out.union(found)
    return out


def save_checked(spark: SparkSession, folder: str, manifest: dict) -> dict:
    """Saves a manifest whose records are of their shapes and keep the rules between them; the id of its one simulation never changes. Raises else, and writes nothing."""
    faults = manifest_faults(spark, manifest).limit(5).collect()
    if faults:
        raise ValueError("; ".join(f"{r.table} {r.id}: {r.path} {r.issue}" for r in faults))
    simulation = (manifest.get("realitySimulation") or {}).get("id")
    path = os.path.join(folder, project.MANIFEST)
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            before = (json.load(f).get("realitySimulation") or {}).get("id")
        if before is not None and before != simulation:
            raise ValueError(f"the simulation was {before}, not {simulation}")
    beside = os.path.join(folder, "checked.json.tmp")
    with open(beside, "w", encoding="utf-8") as f:
        json.dump(manifest, f)
    try:
        broken = project.issues(project.lists(spark, beside), simulation).limit(5).collect()
    finally:
        os.remove(beside)
    if broken:
        raise ValueError("; ".join(f"{r.table} {r.id}: {r.rule}" for r in broken))
    return project.save(folder, manifest)
