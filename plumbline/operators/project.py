"""Operators over the project catalog: assets, layers, features, evidence, and the checks between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAMILIES = {"regions": ("region", None), "objects": ("object", None), "buildings": ("building", None), "utilities": ("utility", None),
            "lines": ("line", "polyline"), "notes": ("marker", "marker"), "measurements": ("measurement", "measurement")}
VIEW_KINDS = {"index": "point-cloud-index", "surfel": "analytic-surfel-render"}
FREE_KINDS = ("picked-coordinate", "manual-note")


def tab_counts(features: DataFrame) -> DataFrame:
    """(tab, n) by family; features without one count by their type where a tab takes it. One pass."""
    counts = [
        F.count_if((F.col("family") == f) | (F.col("family").isNull() & (F.col("type") == t)) if t else F.col("family") == f).alias(tab)
        for tab, (f, t) in FAMILIES.items()
    ]
    each = F.array(*[F.struct(F.lit(tab).alias("tab"), F.col(tab).alias("n")) for tab in FAMILIES])
    return features.agg(*counts).select(F.explode(each).alias("e")).select("e.tab", "e.n")


def evidence_split(evidence: DataFrame) -> DataFrame:
    free = F.count_if(F.col("kind").isin(*FREE_KINDS))
    return evidence.groupBy("feature_id").agg((F.count("*") - free).alias("snapped"), free.alias("free"))


def asset_groups(assets: DataFrame) -> DataFrame:
    """(source_id, asset_id): each source cloud with itself and what is derived from it."""
    sources = assets.filter("kind = 'point-cloud'").select(F.col("asset_id").alias("source_id"))
    derived = assets.filter(F.col("kind").isin(*VIEW_KINDS.values())).select(F.col("source_asset_id").alias("source_id"), "asset_id")
    return sources.select("source_id", F.col("source_id").alias("asset_id")).union(derived.join(sources, "source_id", "left_semi"))


def missing_views(assets: DataFrame) -> DataFrame:
    """(source_id, view) of views that a source cloud does not have."""
    views = F.explode(F.array(*[F.struct(F.lit(v).alias("view"), F.lit(k).alias("kind")) for v, k in VIEW_KINDS.items()])).alias("v")
    wanted = assets.filter("kind = 'point-cloud'").select(F.col("asset_id").alias("source_id"), views).select("source_id", "v.view", "v.kind")
    there = assets.select(F.col("source_asset_id").alias("source_id"), "kind")
    return wanted.join(there, ["source_id", "kind"], "left_anti").select("source_id", "view")


def staleness(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(asset_id, reasons): why an index no longer matches its source; a modification time unknown on either side is no reason."""
    c = current.select("asset_id", *[F.col(x).alias(f"_{x}") for x in ("header_sha256", "file_size", "mtime_ms")], F.lit(True).alias("_there"))
    differs = lambda x: F.coalesce(F.col(x) != F.col(f"_{x}"), F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(F.col("_there").isNull(), "source-missing"), F.when(differs("header_sha256"), "header-sha-changed"),
        F.when(differs("file_size"), "file-size-changed"), F.when(differs("mtime_ms"), "mtime-changed"),
    ))
    return stored.join(c, "asset_id", "left").select("asset_id", reasons.alias("reasons"))


def foreign_keys(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of child whose key is set and names no row of parent."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def layer_kind(kind: Column, asset_kind: Column, truth: Column) -> Column:
    """The kind of a layer; one of kind asset is told by its asset."""
    return (
        F.when(kind != "asset", kind)
        .when(asset_kind == "point-cloud-index", "point-cloud-index")
        .when(asset_kind == "point-cloud", "point-cloud-preview")
        .when((asset_kind == "analytic-surfel-render") & (truth == "derived"), "derived-surfel")
        .when((asset_kind == "surface") & (truth == "derived"), "derived-surface")
        .otherwise("asset")
    )


def warning_kind(warning: Column, prefix: str) -> Column:
    managed = warning.startswith(prefix)
    return F.when(managed & warning.contains("format is outdated"), "outdated").when(managed & warning.contains("out of date"), "stale").when(
        managed, "managed"
    ).otherwise("other")


def may_stream(kind: Column, warnings: Column, prefix: str) -> Column:
    return (kind == "point-cloud-index") & ~F.exists(warnings, lambda w: warning_kind(w, prefix).isin("outdated", "stale"))


def delete_group(assets: DataFrame, layers: DataFrame, source_id: int) -> tuple[DataFrame, DataFrame]:
    """assets and layers without a source, what is derived from it, and their layers."""
    gone = asset_groups(assets).filter(F.col("source_id") == source_id).select("asset_id")
    return assets.join(gone, "asset_id", "left_anti"), layers.join(gone, "asset_id", "left_anti")


def new_evidence(added: DataFrame, present: DataFrame) -> DataFrame:
    """Added evidence at coordinates that the feature does not have yet, each once."""
    at = ["feature_id", "x", "y", "z"]
    return added.join(present.select(*at), at, "left_anti").dropDuplicates(at)


def merge_reports(reports: DataFrame) -> DataFrame:
    """Counts of several import reports added up by key."""
    return reports.select("owner_id", F.explode("counts").alias("k", "v")).groupBy("owner_id", "k").agg(F.sum("v").alias("v")).groupBy("owner_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("counts")
    )


def replay(rows: DataFrame, commands: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """rows after keyed commands (seq, op set or delete, fields): the last command of each key and field holds."""
    last = commands.groupBy(key).agg(
        F.max_by("op", "seq").alias("_op"),
        *[F.max_by(F.struct(F.col(f).alias("v")), F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f"_{f}") for f in fields],
    )
    told = rows.join(last, key, "left").filter(F.coalesce(F.col("_op") != "delete", F.lit(True)))
    changed = {f: F.coalesce(F.col(f"_{f}.v"), F.col(f)) for f in fields}
    return told.select(*[changed.get(c, F.col(c)).alias(c) for c in rows.columns])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


INDEX_KIND, SURFEL_KIND = "point-cloud-index", "analytic-surfel-render"


def asset_issues(assets: DataFrame) -> DataFrame:
    """(rule, id) of assets(id, kind, truth, index_source, surfel_source, surfel_index) whose payload and kind do not agree, or whose sources are unknown.

    index_source is there exactly for fully indexed point-cloud indexes, surfel_source for derived surfels."""
    kind, truth = F.col("kind"), F.col("truth")
    fits = lambda name, truly: F.col(name).isNotNull() != F.coalesce(truly, F.lit(False))
    own = (
        ("index-payload", fits("index_source", (kind == INDEX_KIND) & (truth == "indexed-full"))),
        ("surfel-payload", fits("surfel_source", (kind == SURFEL_KIND) & (truth == "derived"))),
    )
    told = assets.select("id", F.explode(F.array_compact(F.array(*[F.when(wrong, rule) for rule, wrong in own]))).alias("rule"))
    links = F.array(*[F.struct(F.lit(f"unknown-{c.replace('_', '-')}").alias("rule"), F.col(c).alias("target")) for c in ("index_source", "surfel_source", "surfel_index")])
    each = assets.select("id", F.explode(links).alias("l")).select("id", "l.rule", "l.target").filter("target is not null")
    unknown = each.join(assets.select(F.col("id").alias("target")), "target", "left_anti")
    return told.select("rule", "id").union(unknown.select("rule", "id"))


def surfel_evidence(evidence: DataFrame, assets: DataFrame) -> DataFrame:
    """(rule, id) of features whose evidence(feature_id, asset_id) names a surfel asset: surfels are derived. Unknown assets are allowed."""
    surfels = assets.filter(F.col("kind") == SURFEL_KIND).select(F.col("id").alias("asset_id"))
    bad = evidence.join(surfels, "asset_id", "left_semi").select("feature_id").distinct()
    return bad.select(F.lit("surfel-evidence").alias("rule"), F.col("feature_id").alias("id"))


def shape_issues(records: DataFrame, fields: dict[str, tuple[str, bool, tuple[str, ...] | None]]) -> DataFrame:
    """(id, field, issue) of records(id, record), JSON texts, against fields: name -> (text, number or boolean; required; allowed values).

    Issues are not-json, missing, not-number, not-boolean and not-allowed."""
    told = records.withColumn("m", F.from_json("record", "map<string,string>"))
    checks = []
    for name, (kind, required, allowed) in fields.items():
        v = F.col("m")[name]
        found = F.when(v.isNull(), F.lit("missing") if required else F.lit(None))
        if kind == "number":
            found = found.when(v.isNotNull() & v.try_cast("double").isNull(), "not-number")
        if kind == "boolean":
            found = found.when(v.isNotNull() & ~v.isin("true", "false"), "not-boolean")
        if allowed:
            found = found.when(v.isNotNull() & ~v.isin(*allowed), "not-allowed")
        checks.append(F.struct(F.lit(name).alias("field"), found.alias("issue")))
    whole = F.when(F.col("m").isNull(), F.array(F.struct(F.lit("").alias("field"), F.lit("not-json").alias("issue")))).otherwise(F.array(*checks))
    return told.select("id", F.explode(whole).alias("c")).select("id", "c.field", "c.issue").filter("issue is not null")


def sanitised_points(points: Column) -> Column:
    """Of an array of structs id, source, x, y, z those that are surface points: with an id, a known source and finite coordinates."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    good = lambda p: p["id"].isNotNull() & p["source"].isin("manual", "generated-grid") & finite(p["x"]) & finite(p["y"]) & finite(p["z"])
    return F.filter(F.coalesce(points, F.array().cast("array<struct<id:string,source:string,x:double,y:double,z:double>>")), lambda p: F.coalesce(good(p), F.lit(False)))


def surfel_input(index_version: Column, own_index: Column, preview: Column) -> Column:
    """What surfels are made from: an index of the first version as it is, else a dedicated index, else the preview."""
    return F.when(index_version == 1, "index").when(own_index, "dedicated-index").when(preview, "preview")
