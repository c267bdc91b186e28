"""Project folders: a manifest saved by journal, temporary file and rename; its lists as DataFrames; its checks."""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.project import foreign_keys

MANIFEST, JOURNAL, BACKUP = "project.json", "journal.log", "project.json.bak"
LISTS = ("assets", "simulationLayers", "features", "exclusionZones", "reviewFlags", "comparisonRefs", "analysisResults")


def now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def inside(folder: str, relative: str) -> str:
    """The path of a managed file; one that leaves the folder is refused."""
    root = os.path.realpath(folder)
    path = os.path.realpath(os.path.join(root, relative))
    if path != root and not path.startswith(root + os.sep):
        raise ValueError(f"{relative} lies outside the project")
    return path


def _note(folder: str, state: str) -> None:
    with open(os.path.join(folder, JOURNAL), "a", encoding="utf-8") as f:
        f.write(json.dumps({"state": state, "at": now()}) + "\n")
        f.flush()
        os.fsync(f.fileno())


def save(folder: str, manifest: dict) -> dict:
    """Write the manifest: intent in the journal, temporary file, backup of the last, rename, completion in the journal."""
    manifest = manifest | {"modifiedAt": now()}
    path = inside(folder, MANIFEST)
    _note(folder, "intent")
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        json.dump(manifest, f)
        f.flush()
        os.fsync(f.fileno())
    if os.path.exists(path):
        os.replace(path, inside(folder, BACKUP))
    os.replace(path + ".tmp", path)
    _note(folder, "complete")
    return manifest


def clean(folder: str) -> bool:
    """Whether the last save was completed; a journal line that cannot be read counts as not."""
    try:
        with open(os.path.join(folder, JOURNAL), encoding="utf-8") as f:
            lines = f.read().splitlines()
    except FileNotFoundError:
        return True
    try:
        return not lines or json.loads(lines[-1])["state"] == "complete"
    except (ValueError, KeyError, TypeError):
        return False


def unique_name(name: str, taken: set[str]) -> str:
    """The name, or with the first free number before its extension."""
    stem, ext = os.path.splitext(name)
    k, out = 1, name
    while out in taken:
        k += 1
        out = f"{stem}-{k}{ext}"
    return out


def lists(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Each list of the manifest as a DataFrame; open records stay JSON text for their own schema."""
    whole = spark.read.text(path, wholetext=True)
    part = lambda name: F.from_json(F.get_json_object("value", f"$.{name}"), "array<string>")
    one = "simulationId string, id string, kind string, assetId string, featureId string, family string, type string, truthStatus string"
    out = {}
    for name in LISTS:
        records = whole.select(F.explode(part(name)).alias("record"))
        out[name] = records.select("record", F.from_json("record", one).alias("r")).select("record", "r.*")
    return out


def issues(tables: dict[str, DataFrame], simulation_id: str) -> DataFrame:
    """(rule, table, id) of what breaks the manifest's cross-record rules."""
    told = []
    for name in LISTS[1:]:
        wrong = tables[name].filter(F.col("simulationId").isNull() | (F.col("simulationId") != simulation_id))
        told.append(wrong.select(F.lit("other-simulation").alias("rule"), F.lit(name).alias("table"), "id"))
    zones = foreign_keys(tables["exclusionZones"], "featureId", tables["features"], "id")
    told.append(zones.select(F.lit("unknown-feature").alias("rule"), F.lit("exclusionZones").alias("table"), "id"))
    twice = tables["assets"].groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    told.append(twice.select(F.lit("repeated-id").alias("rule"), F.lit("assets").alias("table"), "id"))
    out = told[0]
    for more in told[1:]:
        out = out.union(more)
    return out
