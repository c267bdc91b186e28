"""What is checked when a project is opened: the shapes of its records, records that can't be represented, and the state of its files.

Records are VARIANT values of JSON text, so that a field keeps the type that it was written with and what is missing is not what is null. Shapes are
trees of `Field`; every fault is a row with its path. Opening rewrites warnings and layer states from
the facts alone: what it added before is taken out first, so that a second opening changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import display
from plumbline.operators import project
from plumbline.sources.tables import materialize

# Texts of warnings, and the versions of surfels that can be read.
MISSING_SOURCE = "Referenced point cloud source is missing."
MISSING_SURFELS = "Derived analytic surfel artifact is missing. Regenerate the surfel layer to restore it."
SURFEL_PREFIX = "Analytic surfel render"
QUARANTINED = f"{SURFEL_PREFIX} layer was built by an incompatible version and was removed from the project. Regenerate surfels to restore it."
INCOMPATIBLE = f"{SURFEL_PREFIX} artifact on disk is unreadable or incompatible with this build. Regenerate surfels to restore it."
UNVERIFIED = " freshness could not be verified from the current source."
SURFEL_VERSIONS = (1, 2)
CLOUD_KIND = "point-cloud"


@dataclass(frozen=True)
class Field:
    """kind: string, number, int, boolean, object or array. Strings are not empty unless `blank`; numbers are `least` or more."""

    kind: str
    required: bool = True
    nullable: bool = False
    allowed: tuple = ()
    least: float | None = None
    above: float | None = None
    blank: bool = False
    items: int = 0
    fields: dict = field(default_factory=dict, hash=False)
    of: "Field | None" = None


def _text(*allowed: str, **told) -> Field:
    return Field("string", allowed=allowed, **told)


_XYZ = Field("array", items=3, of=Field("number"))
_BOX = Field("object", fields={f"{m}{d}": Field("number") for m in ("min", "max") for d in "XYZ"})
_DATED = {"createdAt": _text(), "modifiedAt": _text()}
_OWNED = {"id": _text(), "simulationId": _text()}
_FINGERPRINT = Field("object", fields={"headerSha256": _text(), "fileSize": Field("number", least=0), "mtimeMs": Field("number", nullable=True)})
_OPEN = Field("object")

# Names and allowed values of the records' fields.
SURFEL = {
    "sourceAssetId": _text(), "indexAssetId": _text(nullable=True, blank=True), "surfelType": _text("analytic-surfel-octree"), "surfelVersion": Field("number", allowed=SURFEL_VERSIONS),
    "surfelCellScale": Field("number", required=False, above=0), "source": _FINGERPRINT, "surfelCount": Field("number", least=0), "bounds": _BOX, "generatedAt": _text(),
    "generator": Field("object", fields={"name": _text(), "version": _text()}),
}
CLOUD = {
    "format": _text("las", "laz"), "extension": _text(), "fileSize": Field("number", least=0), "pointCount": Field("number", least=0), "lasVersion": _text(), "pointFormat": Field("int", least=0),
    "pointRecordLength": Field("int", above=0), "bounds": _BOX, "scale": _XYZ, "offset": _XYZ, "crsText": _text(nullable=True, blank=True), "unitsLinear": _text("usSurveyFoot", "foot", "meter", "unknown"),
    "unitsRaw": _text(), "headerSha256": _text(), "rgbEncoding": _text("u16", "u8-in-u16", required=False),
}
EVIDENCE = {
    "kind": _text("picked-coordinate", "asset-point", "asset-vertex", "asset-edge", "surface-hit", "manual-note"), "coordinate": _XYZ, "assetId": _text(required=False), "assetLayerId": _text(required=False),
    "featureId": _text(required=False), "sourceClass": Field("int", required=False, least=0), "sourceRGB": Field("array", required=False, items=3, of=Field("number")), "note": _text(required=False, blank=True),
}
SHAPES = {
    "assets": {
        "id": _text(), "name": _text(), "kind": _text(), "truthStatus": _text(), "importPolicy": _text("copy", "reference"), "sourcePath": _text(nullable=True, blank=True), "managedPath": _text(nullable=True, blank=True),
        "units": _text(nullable=True, blank=True), "warnings": Field("array", of=_text(blank=True)), "hashes": _OPEN, "pointCloud": Field("object", required=False, fields=CLOUD),
        "analyticSurfel": Field("object", required=False, fields=SURFEL),
    },
    "simulationLayers": _OWNED | {"kind": _text(required=False), "name": _text(), "status": _text(), "assetId": _text(nullable=True, blank=True)} | _DATED,
    "features": _OWNED | {
        "type": _text("marker", "polyline", "measurement"), "name": _text(), "geometry": _OPEN, "family": _text("region", "object", "building", "utility", "line", "marker", "measurement", required=False),
        "templateId": _text(required=False, nullable=True), "subtype": _text(required=False), "authorship": _text("authored", "assisted", "derived", "edited", "imported", required=False),
        "confidence": _text("low", "medium", "high", required=False), "lifecycleStatus": _text("draft", "authored", "reviewed", "flagged", required=False),
        "evidenceRefs": Field("array", required=False, of=Field("object", fields=EVIDENCE)), "parameters": Field("object", required=False), "metadata": Field("object", required=False), "parentFeatureId": _text(required=False, nullable=True),
    } | _DATED,
    "exclusionZones": _OWNED | {"featureId": _text(), "name": _text(required=False), "polygon": Field("array", items=-3, of=_XYZ)} | _DATED,
    "reviewFlags": _OWNED | {"severity": _text("low", "medium", "high"), "message": _text(), "status": _text("open", "resolved")} | _DATED,
    "comparisonRefs": _OWNED | {"name": _text(), "target": _text()} | _DATED,
    "analysisResults": _OWNED | {"name": _text(), "summary": _text()} | _DATED,
}
_FRAME = {"plane": Field("object", fields={k: _XYZ for k in ("origin", "normal", "xAxis", "yAxis")}), "extents": Field("object", fields={f"{m}{d}": Field("number") for m in ("min", "max") for d in "UV"})}
COMPONENTS = {
    "face": {"id": _text(blank=True), "name": _text(blank=True), "kind": _text("wall", "roof")} | _FRAME,
    "feature": {"id": _text(blank=True), "faceId": _text(blank=True), "type": _text("door", "window", "chimney", "vent", "opening", "generic")} | {k: Field("number") for k in ("offsetU", "offsetV", "width", "height", "depth")},
}

_KINDS = {"string": "STRING", "boolean": "BOOLEAN", "object": "OBJECT<.*", "array": "ARRAY<.*", "int": "(TINYINT|SMALLINT|INT|BIGINT)", "number": "(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)"}
_ISSUES = "array<struct<path:string,issue:string>>"


def _issue(path: Column, issue: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(issue).alias("issue")))


def _none() -> Column:
    return F.array().cast(_ISSUES)


def _of_value(x: Column, f: Field, path: Column) -> Column:
    """The issues of a value that is there."""
    kind = F.schema_of_variant(x)
    ok = _none()
    if f.kind == "string":
        s = F.try_variant_get(x, "$", "string")
        ok = F.when(~s.isin(*f.allowed), _issue(path, "not-allowed")).otherwise(ok) if f.allowed else F.when(s == "", _issue(path, "empty")).otherwise(ok) if not f.blank else ok
    elif f.kind in ("number", "int"):
        n = F.try_variant_get(x, "$", "double")
        wrong = ~n.isin(*map(float, f.allowed)) if f.allowed else n < f.least if f.least is not None else n <= f.above if f.above is not None else None
        ok = F.when(wrong, _issue(path, "not-allowed" if f.allowed else "too-small")).otherwise(ok) if wrong is not None else ok
    elif f.kind == "object" and f.fields:
        ok = issues_of(x, f.fields, path)
    elif f.kind == "array":
        items = F.try_variant_get(x, "$", "array<variant>")
        at = lambda k: F.concat(path, F.lit("["), k.cast("string"), F.lit("]"))
        each = F.flatten(F.transform(items, lambda v, k: _present(v, f.of, at(k)))) if f.of else ok
        short = F.size(items) != f.items if f.items > 0 else F.size(items) < -f.items if f.items < 0 else F.lit(False)
        ok = F.when(short, _issue(path, "wrong-length")).otherwise(each)
    return F.when(~kind.rlike(f"^{_KINDS[f.kind]}$"), _issue(path, "wrong-type")).otherwise(ok)


def _present(x: Column, f: Field, path: Column) -> Column:
    absent = _none() if f.nullable else _issue(path, "wrong-type")
    return F.when(x.isNull() | (F.schema_of_variant(x) == "VOID"), absent).otherwise(_of_value(x, f, path))


def issues_of(record: Column, shape: dict[str, Field], path: Column | None = None) -> Column:
    """array<struct<path, issue>> of a VARIANT that should be an object of a shape."""
    out = []
    for name, f in shape.items():
        x = F.try_variant_get(record, f"$.{name}", "variant")
        at = F.lit(name) if path is None else F.concat(path, F.lit(f".{name}"))
        out.append(F.when(x.isNull(), _issue(at, "missing") if f.required else _none()).otherwise(_present(x, f, at)))
    return F.concat(*out)


def shape_issues(records: DataFrame, shape: dict[str, Field]) -> DataFrame:
    """(id, path, issue) of records(id, record), JSON texts. Text that is no JSON, or no object, has the issue not-json or not-object at an empty path."""
    told = records.select("id", F.try_parse_json("record").alias("v"))
    whole = F.when(F.col("v").isNull(), _issue(F.lit(""), "not-json")).when(~F.schema_of_variant("v").startswith("OBJECT"), _issue(F.lit(""), "not-object"))
    return told.select("id", F.explode(whole.otherwise(issues_of(F.col("v"), shape))).alias("i")).select("id", "i.path", "i.issue")


def quarantine(assets: DataFrame, layers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """assets(asset_id, surfel, warnings, ..) and layers(.., asset_id) without the surfel assets whose record, JSON text, is not of a known shape; their sources get a warning, as long as there are such."""
    plain = assets.withColumn("warnings", F.filter("warnings", lambda w: w != QUARANTINED))
    record = F.try_parse_json("surfel")
    fits = record.isNotNull() & F.schema_of_variant(record).startswith("OBJECT") & (F.size(issues_of(record, SURFEL)) == 0)
    bad = plain.filter(F.col("surfel").isNotNull()).filter(~F.coalesce(fits, F.lit(False))).select("asset_id", F.try_variant_get(record, "$.sourceAssetId", "string").alias("source_id"))
    bad = materialize(bad, "quarantined")  # shapes are checked once
    kept = plain.join(bad.select("asset_id").distinct(), "asset_id", "left_anti")
    warned = bad.filter("source_id IS NOT NULL").select(F.col("source_id").alias("asset_id"), F.lit(True).alias("_q")).distinct()
    told = kept.join(warned, "asset_id", "left").withColumn("warnings", F.when(F.col("_q"), F.array_append("warnings", F.lit(QUARANTINED))).otherwise(F.col("warnings")))
    return told.select(*assets.columns), layers.join(bad.select("asset_id").distinct(), "asset_id", "left_anti").select(*layers.columns)


def checked(assets: DataFrame, layers: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """assets and layers with the warnings and states that the files call for.

    assets: (asset_id, kind, warnings, there, source_id, index_version, artifact_version, header_sha256, file_size, mtime_ms): there: the cloud's source or the surfels' files are found; the
    last three are what an index or surfels tell of their source. layers: (layer_id, asset_id, kind, status). current: (asset_id, header_sha256,
    file_size, mtime_ms, readable) of the sources there are."""
    kind, assets = F.col("kind"), materialize(assets, "opened")
    derived = assets.filter(kind.isin(project.INDEX_KIND, project.SURFEL_KIND) & F.col("source_id").isNotNull())
    prints = ("header_sha256", "file_size", "mtime_ms")
    stored = derived.select("asset_id", "source_id", *prints)
    now = stored.select("asset_id", "source_id").join(current.withColumnRenamed("asset_id", "source_id"), "source_id")
    own = project.staleness(stored.drop("source_id"), now.select("asset_id", *prints))
    sources = stored.select("asset_id", "source_id").join(assets.select(F.col("asset_id").alias("source_id")), "source_id", "left_semi")
    readable = sources.join(now.select("asset_id", "readable"), "asset_id", "left").select("asset_id", F.coalesce("readable", F.lit(True)).alias("_readable"))
    told = assets.join(own, "asset_id", "left").join(readable, "asset_id", "left")
    gone = F.array_contains("reasons", "source-missing")
    stale = display.stale_warning(gone, F.filter("reasons", lambda r: r != "source-missing"))
    known = F.col("_readable").isNotNull()  # the source is an asset
    index_warnings = F.array_compact(F.array(
        F.when(known, F.when(F.col("_readable"), stale).otherwise(display.INDEX_PREFIX + UNVERIFIED)), F.when(known, display.outdated_warning(F.col("index_version")))
    ))
    unreadable = ~F.coalesce(F.col("artifact_version").isin(*SURFEL_VERSIONS), F.lit(False))
    surfel = F.when(~F.col("there"), MISSING_SURFELS).when(unreadable, INCOMPATIBLE).when(
        known, F.when(F.col("_readable"), F.replace(stale, F.lit(display.INDEX_PREFIX), F.lit(SURFEL_PREFIX))).otherwise(SURFEL_PREFIX + UNVERIFIED)
    )
    managed = lambda w: w.startswith(display.INDEX_PREFIX)
    is_index, is_surfel = (kind == project.INDEX_KIND) & F.col("source_id").isNotNull(), (kind == project.SURFEL_KIND) & F.col("source_id").isNotNull()
    kept = F.when(kind == CLOUD_KIND, F.filter("warnings", lambda w: w != MISSING_SOURCE)).when(is_index, F.filter("warnings", lambda w: ~managed(w))).when(
        is_surfel, F.filter("warnings", lambda w: (w != MISSING_SURFELS) & ~w.startswith(SURFEL_PREFIX) & ~managed(w))
    ).otherwise(F.col("warnings"))
    added = F.when((kind == CLOUD_KIND) & ~F.col("there"), F.array(F.lit(MISSING_SOURCE))).when(is_index, index_warnings).when(is_surfel, F.array_compact(F.array(surfel))).otherwise(F.array().cast("array<string>"))
    failed = F.when(kind == CLOUD_KIND, ~F.col("there")).when(is_surfel, ~F.col("there") | unreadable)
    healed = F.when(kind == CLOUD_KIND, F.col("there")).when(is_surfel, F.col("there") & ~unreadable & F.coalesce("_readable", F.lit(False)))
    states = told.select("asset_id", kind.alias("_kind"), failed.alias("_failed"), healed.alias("_healed"))
    shown = F.when(F.col("_kind") == CLOUD_KIND, F.col("kind").isin("point-cloud-preview", "asset")).otherwise(F.col("kind").isin("derived-surfel", "asset"))
    status = F.when(shown & F.col("_failed"), "error").when(shown & F.col("_healed") & (F.col("status") == "error"), "active").otherwise(F.col("status"))
    new_layers = layers.join(states, "asset_id", "left").withColumn("status", status).select(*layers.columns)
    return told.withColumn("warnings", F.concat(kept, added)).select(*assets.columns), new_layers
