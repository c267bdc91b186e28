"""Registered queries for projects as they are opened: shapes of records, quarantine and open-time checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import display
from plumbline.operators import components, creation, opening
from plumbline.plans.catalog import query
from plumbline.sources.tables import table

_FLAG_SQL = """r AS (SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_name END AS message, CASE WHEN p_partkey % 5 = 0 THEN 'urgent' ELSE 'low' END AS severity, p_partkey % 11 = 0 AS broken FROM part)"""


@query(f"""WITH {_FLAG_SQL} SELECT id, '' AS path, 'not-json' AS issue FROM r WHERE broken UNION ALL SELECT id, 'message', 'missing' FROM r WHERE NOT broken AND message IS NULL
UNION ALL SELECT id, 'message', 'empty' FROM r WHERE NOT broken AND message = '' UNION ALL SELECT id, 'severity', 'not-allowed' FROM r WHERE NOT broken AND severity = 'urgent'
UNION ALL SELECT id, 'status', 'wrong-type' FROM r WHERE NOT broken AND id % 13 = 0""")
def record_shape_faults(spark, sf_dir):
    """Parts as review flags, some of them with a field missing, empty, of another type or not allowed, or no JSON."""
    k = F.col("p_partkey")
    message = F.when(k % 7 == 0, None).when(k % 7 == 1, "").otherwise(F.col("p_name"))
    flag = F.struct(
        F.concat(F.lit("f"), k).alias("id"), F.lit("s").alias("simulationId"), message.alias("message"), F.when(k % 5 == 0, "urgent").otherwise("low").alias("severity"),
        F.lit("2026-01-01").alias("createdAt"), F.lit("2026-01-01").alias("modifiedAt"),
    )
    body = F.regexp_replace(F.to_json(flag), "}$", "")
    text = F.concat(body, F.when(k % 13 == 0, ',"status":7}').otherwise(',"status":"open"}'))
    records = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 11 == 0, F.concat(F.lit("{"), text)).otherwise(text).alias("record"))
    return opening.shape_issues(records, opening.SHAPES["reviewFlags"])


_BOX = ",".join(f'"{m}{d}":{v}' for m, v in (("min", 0), ("max", 9.5)) for d in "XYZ")


def _surfel(version, source):
    """A surfel record of a version, JSON text."""
    return F.concat(
        F.lit('{"sourceAssetId":"'), source.cast("string"), F.lit('","indexAssetId":null,"surfelType":"analytic-surfel-octree","surfelVersion":'), version.cast("string"),
        F.lit(f',"source":{{"headerSha256":"h","fileSize":1,"mtimeMs":null}},"surfelCount":5,"bounds":{{{_BOX}}},"generatedAt":"t","generator":{{"name":"plumbline","version":"1"}}}}'),
    )


def _project(spark, sf_dir):
    """Parts as assets: clouds, indexes and surfels of clouds around them; customers as their layers."""
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "point-cloud").when(k % 3 == 1, "point-cloud-index").otherwise("analytic-surfel-render")
    source = F.when(k % 3 != 0, k - k % 3 + F.when(k % 17 == 0, 3_000_000).otherwise(0))
    old = F.array(F.lit("keep"), F.lit(opening.QUARANTINED), F.lit(opening.MISSING_SOURCE), F.lit(display.INDEX_PREFIX + " old"))
    assets = table(spark, sf_dir, "part").select(
        k.alias("asset_id"), kind.alias("kind"), F.when(k % 2 == 0, old).otherwise(F.array().cast("array<string>")).alias("warnings"), (k % 5 != 0).alias("there"), source.alias("source_id"),
        (1 + k % 2).cast("int").alias("index_version"), (1 + k % 4).cast("int").alias("artifact_version"), (k % 2).cast("string").alias("header_sha256"), (k % 6).alias("file_size"), F.lit(None).cast("long").alias("mtime_ms"),
        F.when(k % 3 == 2, _surfel(1 + k % 4, source)).alias("surfel"),
    )
    c = F.col("c_custkey")
    layer = F.get(F.array(*[F.lit(v) for v in ("point-cloud-preview", "asset", "derived-surfel", "other")]), (c % 4).cast("int"))
    layers = table(spark, sf_dir, "customer").select(c.alias("layer_id"), (c % 400 + 1).alias("asset_id"), layer.alias("kind"), F.when(c % 3 == 0, "error").otherwise("active").alias("status"))
    current = assets.filter("kind = 'point-cloud' AND there").select("asset_id", F.lit("1").alias("header_sha256"), F.lit(4).cast("long").alias("file_size"), F.lit(1).cast("long").alias("mtime_ms"), (F.col("asset_id") % 7 != 0).alias("readable"))
    return assets, layers, current


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_STALE = f"""CASE WHEN NOT source_there THEN {_q(f"{display.INDEX_PREFIX} source is missing; the existing index is still usable but cannot be re-verified or regenerated until the source is available.")}
WHEN header <> '1' OR size <> 4 THEN {_q(f"{display.INDEX_PREFIX} may be out of date (")} || CASE WHEN header <> '1' AND size <> 4 THEN {_q(", ".join(display.STALE_REASONS[r] for r in ("header-sha-changed", "file-size-changed")))}
WHEN header <> '1' THEN {_q(display.STALE_REASONS["header-sha-changed"])} ELSE {_q(display.STALE_REASONS["file-size-changed"])} END || {_q("). Regenerate the index to match the current source.")} END"""
_OPENED = f"""WITH a AS (SELECT p_partkey AS k, p_partkey % 3 AS kind, p_partkey % 5 <> 0 AS there, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey - p_partkey % 3 + CASE WHEN p_partkey % 17 = 0 THEN 3000000 ELSE 0 END END AS source,
CAST(p_partkey % 2 AS VARCHAR) AS header, p_partkey % 6 AS size FROM part),
b AS (SELECT * FROM a WHERE NOT (kind = 2 AND 1 + k % 4 > 2)), q AS (SELECT DISTINCT source AS k FROM a WHERE kind = 2 AND 1 + k % 4 > 2),
s AS (SELECT b.*, p.k IS NOT NULL AS known, coalesce(p.there AND p.kind = 0, FALSE) AS source_there, coalesce(NOT (p.there AND p.kind = 0) OR p.k % 7 <> 0, TRUE) AS readable, q.k IS NOT NULL AS warned
FROM b LEFT JOIN b p ON p.k = b.source LEFT JOIN q ON q.k = b.k),
w AS (SELECT *, {_STALE} AS stale FROM s),
o AS (SELECT k, kind, there, known, readable, list_filter(list_concat(
  CASE WHEN k % 2 = 0 THEN CASE kind WHEN 0 THEN ['keep', {_q(display.INDEX_PREFIX + " old")}] WHEN 1 THEN ['keep', {_q(opening.MISSING_SOURCE)}] ELSE ['keep', {_q(opening.MISSING_SOURCE)}] END ELSE [] END,
  CASE WHEN warned AND kind = 0 THEN [{_q(opening.QUARANTINED)}] ELSE [] END,
  CASE kind WHEN 0 THEN CASE WHEN NOT there THEN [{_q(opening.MISSING_SOURCE)}] ELSE [] END
  WHEN 1 THEN [CASE WHEN known THEN CASE WHEN readable THEN stale ELSE {_q(display.INDEX_PREFIX + opening.UNVERIFIED)} END END, CASE WHEN known AND 1 + k % 2 < {display.INDEX_VERSION} THEN {_q(f"{display.INDEX_PREFIX} format is outdated (v")} || (1 + k % 2) || {_q("); rebuild the index for indexed display and Walk Mode.")} END]
  ELSE [CASE WHEN NOT there THEN {_q(opening.MISSING_SURFELS)} WHEN known THEN CASE WHEN readable THEN replace(stale, {_q(display.INDEX_PREFIX)}, {_q(opening.SURFEL_PREFIX)}) ELSE {_q(opening.SURFEL_PREFIX + opening.UNVERIFIED)} END END] END), lambda x: x IS NOT NULL) AS warnings FROM w)"""


@query(f"{_OPENED} SELECT k AS asset_id, coalesce(array_to_string(warnings, ' | '), '') AS warnings FROM o")
def opened_assets(spark, sf_dir):
    """Warnings of the assets of a project whose files are checked twice, which changes nothing more."""
    assets, layers, current = _project(spark, sf_dir)
    assets, layers = opening.quarantine(assets, layers)
    for _ in range(2):
        assets, layers = opening.checked(assets, layers, current)
    return assets.select("asset_id", F.array_join("warnings", " | ").alias("warnings"))


@query(f"""{_OPENED}, l AS (SELECT c_custkey AS layer_id, c_custkey % 400 + 1 AS k, c_custkey % 4 AS layer, CASE WHEN c_custkey % 3 = 0 THEN 'error' ELSE 'active' END AS status FROM customer)
SELECT layer_id, CASE WHEN o.kind = 0 AND layer IN (0, 1) THEN CASE WHEN there THEN 'active' ELSE 'error' END WHEN o.kind = 2 AND layer IN (1, 2) THEN CASE WHEN NOT there THEN 'error' WHEN known AND readable THEN 'active' ELSE status END ELSE status END AS status
FROM l LEFT JOIN o USING (k) WHERE k NOT IN (SELECT k FROM a WHERE kind = 2 AND 1 + k % 4 > 2)""")
def opened_layers(spark, sf_dir):
    """States of the layers of a project once opened; those of quarantined surfels are gone."""
    assets, layers, current = _project(spark, sf_dir)
    return opening.checked(*opening.quarantine(assets, layers), current)[1].select("layer_id", "status")


_EDITS = """e AS (SELECT o_custkey AS b, o_orderkey AS seq, 0 AS pos, CASE o_orderkey % 5 WHEN 0 THEN 'add' WHEN 1 THEN 'delete' ELSE 'update' END AS op, CASE WHEN (o_orderkey // 5) % 2 = 0 THEN 'face' ELSE 'hosted' END AS part,
(o_orderkey // 10) % 4 AS n, CASE WHEN o_orderkey % 5 = 0 THEN 'f' || ((o_orderkey // 40) % 3) END AS face, o_orderpriority AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'wall' END AS kind, (o_orderkey % 9)::DOUBLE AS width FROM orders),
l AS (SELECT b, seq, pos, op, part, CASE part WHEN 'face' THEN 'f' ELSE 'h' END || n AS id, CASE WHEN part = 'hosted' THEN face END AS face, CASE WHEN part = 'face' THEN name END AS name, CASE WHEN part = 'face' THEN kind END AS kind,
  CASE WHEN part = 'hosted' THEN width END AS width FROM e
  UNION ALL SELECT c_custkey, -1, i, 'add', 'face', 'f' || i, NULL, 'old', 'roof', NULL FROM customer, range(3) r(i) UNION ALL SELECT c_custkey, -1, i, 'add', 'hosted', 'h' || i, 'f' || i, NULL, NULL, 1 FROM customer, range(2) r(i)),
a AS (SELECT b, part, id, max(seq) AS since FROM l WHERE op = 'add' GROUP BY ALL),
p AS (SELECT a.*, max(pos) FILTER (l.seq = since) AS pos, max(face) FILTER (l.seq = since) AS face, arg_max(name, l.seq) FILTER (l.seq >= since AND name IS NOT NULL) AS name, arg_max(kind, l.seq) FILTER (l.seq >= since AND kind IS NOT NULL) AS kind,
  arg_max(width, l.seq) FILTER (l.seq >= since AND width IS NOT NULL) AS width, coalesce(bool_or(op = 'delete' AND l.seq > since), FALSE) AS gone FROM a JOIN l USING (b, part, id) GROUP BY ALL),
f AS (SELECT * FROM p WHERE part = 'face' AND NOT gone),
h AS (SELECT * FROM p WHERE part = 'hosted' AND NOT gone AND EXISTS (SELECT 1 FROM f WHERE f.b = p.b AND f.id = p.face) AND NOT EXISTS (SELECT 1 FROM l WHERE l.b = p.b AND l.part = 'face' AND l.id = p.face AND l.op = 'delete' AND l.seq > p.since))"""


@query(f"""WITH {_EDITS} SELECT c_custkey AS building_id, coalesce((SELECT string_agg(id || ':' || name || ':' || coalesce(kind, '-'), ',' ORDER BY since, pos) FROM f WHERE b = c_custkey), '') AS faces,
coalesce((SELECT string_agg(id || ':' || face || ':' || width, ',' ORDER BY since, pos) FROM h WHERE b = c_custkey), '') AS hosted FROM customer""")
def building_edits(spark, sf_dir):
    """Customers as buildings of three faces and two doors, after their orders as edits."""
    part = lambda name, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), name)
    label = lambda c, i: F.concat(F.lit(c), i.cast("string"))
    faces = part(lambda i: F.struct(label("f", i).alias("id"), F.lit("old").alias("name"), F.lit("roof").alias("kind")), 3)
    hosted = part(lambda i: F.struct(label("h", i).alias("id"), label("f", i).alias("face_id"), F.lit("door").alias("type"), F.lit(1.0).alias("width")), 2)
    buildings = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("building_id"), faces.alias("faces"), hosted.alias("hosted"))
    k = F.col("o_orderkey")
    face, n = F.floor(k / 5) % 2 == 0, (F.floor(k / 10) % 4).cast("long")
    edits = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("building_id"), k.alias("seq"), F.when(k % 5 == 0, "add").when(k % 5 == 1, "delete").otherwise("update").alias("op"), F.when(face, "face").otherwise("hosted").alias("part"),
        F.when(face, label("f", n)).otherwise(label("h", n)).alias("id"), F.when(~face & (k % 5 == 0), label("f", (F.floor(k / 40) % 3).cast("long"))).alias("face_id"), F.when(face, F.col("o_orderpriority")).alias("name"),
        F.when(face & (k % 3 == 0), "wall").alias("kind"), F.when(~face, "vent").alias("type"), F.when(~face, (k % 9).cast("double")).alias("width"),
    )
    joined = lambda c, *names: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[F.coalesce(x[n].cast("string"), F.lit("-")) for n in names])), ",").alias(c)
    return components.edited(buildings, edits).select("building_id", joined("faces", "id", "name", "kind"), joined("hosted", "id", "face_id", "width"))


_DRAFTS = """e AS (SELECT 's' || c_custkey % 3 AS s, (['region','object','building','utility','line','marker'])[c_custkey % 6 + 1] AS f, count(*) AS n FROM customer GROUP BY ALL),
d AS (SELECT o_orderkey AS id, 's' || CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 3 END AS s, (['region','object','building','utility','line','marker'])[o_orderkey % 6 + 1] AS f, o_orderkey % 6 AS k, o_orderkey % 5 AS v, o_orderdate AS seq,
  CASE WHEN o_orderkey % 12 < 6 THEN 'envelope' ELSE 'flat' END AS sub, o_orderpriority AS t, o_orderstatus AS clerk FROM orders),
q AS (SELECT *, row_number() OVER (PARTITION BY s, f ORDER BY seq, id) AS i FROM d WHERE v >= CASE WHEN k IN (0, 2) THEN 3 WHEN k = 4 THEN 2 ELSE 1 END),
m AS (SELECT q.*, i + coalesce(e.n, 0) AS n, left(t, 1) IN ('1', '2', '3') AS known FROM q LEFT JOIN e USING (s, f)),
w AS (SELECT *, CASE k WHEN 1 THEN CASE WHEN known THEN substr(t, 3) ELSE 'Object' END || ' ' || n WHEN 3 THEN CASE WHEN known THEN 'Storm ' || substr(t, 3) ELSE 'Utility Utility' END || ' ' || n
  ELSE upper(left(f, 1)) || substr(f, 2) || ' ' || n || ' (' || sub || ')' END AS name FROM m)"""


def _created(spark, sf_dir):
    """Orders as drafts of features, a third of them of one simulation, beside customers as features that stand."""
    families = F.array(*[F.lit(x) for x in ("region", "object", "building", "utility", "line", "marker")])
    k, c, zero = F.col("o_orderkey"), F.col("c_custkey"), F.lit(0.0)
    spot = lambda i: F.struct(i.cast("double").alias("x"), zero.alias("y"), zero.alias("z"))
    vertices = F.when(k % 5 > 0, F.transform(F.sequence(F.lit(1), (k % 5).cast("int")), spot)).otherwise(F.array().cast("array<struct<x: double, y: double, z: double>>"))
    drafts = table(spark, sf_dir, "orders").select(
        k.alias("draft_id"), F.concat(F.lit("s"), F.when(k % 3 == 0, 0).otherwise(F.col("o_custkey") % 3)).alias("simulation_id"), F.get(families, (k % 6).cast("int")).alias("family"),
        F.when(k % 12 < 6, "envelope").otherwise("flat").alias("subtype"), F.col("o_orderpriority").alias("template_id"), F.when(k % 6 == 4, "polyline").otherwise("point").alias("geometry"), F.col("o_orderdate").alias("seq"),
        vertices.alias("vertices"), F.array("o_orderstatus").alias("evidence"), F.col("o_orderdate").alias("at"),
    )
    features = table(spark, sf_dir, "customer").select(F.concat(F.lit("s"), c % 3).alias("simulation_id"), F.get(families, (c % 6).cast("int")).alias("family"))
    names = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("template_id")).distinct().filter(F.substring("template_id", 1, 1).isin("1", "2", "3"))
    templates = names.select("template_id", F.substring("template_id", 3, 99).alias("display_name"), F.lit("Storm").alias("system"), F.create_map(F.lit("width"), F.lit("6")).alias("params"))
    return creation.create(drafts, features, templates)


@query(f"""WITH {_DRAFTS} SELECT 'feat-' || id AS feature_id, s AS simulation_id, name, CASE WHEN k IN (1, 3, 5) THEN 'marker' ELSE 'polyline' END AS type,
CASE WHEN k = 0 OR (k = 2 AND sub = 'envelope') THEN '' ELSE clerk END AS evidence, CASE WHEN k = 0 THEN clerk END AS edge_evidence, CASE WHEN known THEN '6' END AS width, CASE WHEN k = 4 THEN sub END AS breakline FROM w""")
def created_features(spark, sf_dir):
    """Features made from drafts, with names that count on from what stands."""
    p = lambda key, name: F.try_element_at("parameters", F.lit(key)).alias(name)
    made = _created(spark, sf_dir)[0]
    return made.select("feature_id", "simulation_id", "name", "type", F.array_join("evidence_refs", ",").alias("evidence"), F.array_join("edge_evidence", ",").alias("edge_evidence"), p("width", "width"), p("breaklineType", "breakline"))


@query(f"WITH {_DRAFTS} SELECT 'zone-' || id AS zone_id, 'feat-' || id AS feature_id, name || ' footprint' AS name, CAST(v AS INT) AS corners FROM w WHERE k = 2")
def created_zones(spark, sf_dir):
    """The exclusion zones that come with new buildings."""
    return _created(spark, sf_dir)[1].select("zone_id", "feature_id", "name", F.size("polygon").alias("corners"))


@query("""SELECT p_partkey || '-index' AS asset_id, CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN p_partkey % 4 = 0 THEN p_size * 2 ELSE p_size END::BIGINT AS points FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 4 = 0""")
def regenerated_indexes(spark, sf_dir):
    """Index records of every third part, after those of every fourth were built anew."""
    k, size = F.col("p_partkey"), F.col("p_size")
    record = lambda version, points: [F.concat(k, F.lit("-index")).alias("asset_id"), F.lit(version).alias("version"), points.cast("long").alias("points")]
    parts = table(spark, sf_dir, "part")
    return creation.replaced(parts.filter(k % 3 == 0).select(*record(1, size)), parts.filter(k % 4 == 0).select(*record(2, size * 2)), "asset_id")
