"""LandXML surfaces: rows of vertices, faces and lines from files of any size, and a writer.

Files are read by blocks (see `xmlblocks`), so that one large file is read by many tasks. A block numbers its vertices and lines
from 0; sums over the blocks before give the file's numbers. What comes out are tables, and ids are resolved by joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.sources import xmlblocks
from plumbline.sources.tables import materialize

ROWS = (
    "file string, block long, kind string, surface int, name string, id string, k long, seq int, role string, x double, y double, z double, "
    "a string, b string, c string, visible boolean, detail string"
)
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
# Elements that are read or known to be left aside; all others are reported.
KNOWN = {
    "LandXML", "Project", "Application", "Author", "Units", "Imperial", "Metric", "CoordinateSystem", "FeatureDictionary", "Feature", "Property",
    "Surfaces", "Surface", "Definition", "Pnts", "P", "Faces", "F", "SourceData", "DataPoints", "Breaklines", "Breakline", "Boundaries", "Boundary",
    "Contours", "Contour", "PntList2D", "PntList3D",
}
#: What the lines within an element are.
ROLES = {"Breaklines": "breakline", "Boundaries": "boundary", "Contours": "contour"}
WATCH = xmlblocks.Watch(frozenset({"Surface"}), frozenset({"P", "F", "Breakline", "Boundary", "Contour"}))


def _number(token: str) -> float | None:
    """A finite number; None for other text."""
    try:
        value = float(token) if "_" not in token else math.nan
    except ValueError:
        return None
    return value if math.isfinite(value) else None


def _rows(file: str, block: int, c: xmlblocks.Context, events: Iterator[xmlblocks.Event]) -> Iterator[dict]:
    """Rows of kinds surface, vertex, face, line, inventory, unit and unknown. Text order is north, east, elevation."""
    at = {"file": file, "block": block}
    vertices = lines = 0
    for event in events:
        kind, name, attributes, _ = event
        text = c.text
        xmlblocks.follow(c, event, WATCH)
        surface = c.counts.get("Surface", 0) - 1
        if kind == "open":
            if name == "Surface":
                vertices = lines = 0
                yield at | {"kind": "surface", "surface": surface, "name": attributes.get("name", "")}
            elif name in ("Metric", "Imperial"):
                yield at | {"kind": "unit", "detail": attributes.get("linearUnit", "")}
            elif name not in KNOWN:
                yield at | {"kind": "unknown", "surface": surface if surface >= 0 else None, "name": name}
        elif kind == "close":
            if name == "P" and "SourceData" not in c.path and None not in (n := [_number(t) for t in text.split()[:3]]) and len(n) == 3:
                yield at | {"kind": "vertex", "surface": surface, "k": vertices, "id": c.kept.get("id"), "x": n[1], "y": n[0], "z": n[2]}
                vertices += 1
            elif name == "F" and len(t := text.split()) >= 3:
                yield at | {"kind": "face", "surface": surface, "a": t[0], "b": t[1], "c": t[2], "visible": c.kept.get("i") != "1"}
            elif name in ("PntList3D", "PntList2D"):
                n, dims = [v for t in text.split() if (v := _number(t)) is not None], 3 if name == "PntList3D" else 2
                if "DataPoints" in c.path and "Breakline" not in c.path:  # all points again, in pages
                    yield at | {"kind": "inventory", "surface": surface, "k": len(n) // dims}
                    continue
                role = next((ROLES[p] for p in reversed(c.path) if p in ROLES), "line")
                detail = c.kept.get("bndType" if role == "boundary" else "brkType", "")
                for seq in range(len(n) // dims):
                    p = n[seq * dims : (seq + 1) * dims]
                    yield at | {"kind": "line", "surface": surface, "role": role, "k": lines, "seq": seq, "x": p[1], "y": p[0], "z": p[2] if dims == 3 else None, "detail": detail}
                lines += 1


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with k counted along the file and surface, from its count along the block."""
    own = rows.groupBy("file", "surface", "block").agg((F.max("k") + 1).alias("n"))
    before = Window.partitionBy("file", "surface").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = own.select("file", "surface", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(first, ["file", "surface", "block"]).withColumn("k", (F.col("before") + F.col("k")).cast("int")).drop("before", "block")


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """surfaces, vertices, faces (vertex numbers a, b, c), rejected faces, lines, lists that only repeat the points (inventory), units and unknown elements.

    units has a row for each unit told and one for each file without any, with the unit that is taken and a note where it is a guess."""
    read = xmlblocks.records(spark, path)
    found = materialize(xmlblocks.contexts(read, WATCH), "landxml-contexts")
    schema = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in ROWS.split(", "))])
    rows = materialize(xmlblocks.scan(read, found, _rows, schema, ROWS), "landxml")
    kind = lambda k: rows.filter(F.col("kind") == k)
    vertices = _numbered(kind("vertex").select("file", "surface", "block", "k", "id", "x", "y", "z"))
    vertices = vertices.select("file", "surface", F.col("k").alias("vertex"), F.coalesce("id", (F.col("k") + 1).cast("string")).alias("id"), "x", "y", "z")
    faces = kind("face").select("file", "surface", "a", "b", "c", "visible")
    joined = faces
    for c in "abc":
        ids = vertices.select("file", "surface", F.col("id").alias(c), F.col("vertex").alias(f"v{c}"))
        joined = joined.join(ids, ["file", "surface", c], "left")
    whole = F.col("va").isNotNull() & F.col("vb").isNotNull() & F.col("vc").isNotNull()
    lines = _numbered(kind("line").select("file", "surface", "block", "k", "role", "seq", "x", "y", "z", "detail"))
    lines = lines.select("file", "surface", "role", F.col("k").cast("string").alias("line"), "seq", "x", "y", "z", "detail")
    surfaces = kind("surface").select("file", "surface", "name")
    told = kind("unit").select("file", F.col("detail").alias("unit"))
    units = told.unionByName(surfaces.select("file").distinct().join(told, "file", "left_anti").withColumn("unit", F.lit(None).cast("string")))
    return {
        "surfaces": surfaces, "vertices": vertices,
        "faces": joined.filter(whole).select("file", "surface", F.col("va").alias("a"), F.col("vb").alias("b"), F.col("vc").alias("c"), "visible"),
        "rejected": joined.filter(~whole).select("file", "surface", "a", "b", "c"),
        "lines": lines.withColumn("boundary", F.when(F.col("role") == "boundary", tx.boundary_kind(F.col("detail")))),
        "units": units.select("file", "unit", tx.linear_unit(F.col("unit")).alias("linear"), tx.linear_unit_note(F.col("unit")).alias("note")),
        "inventory": kind("inventory").groupBy("file", "surface").agg(F.count("*").alias("lists"), F.sum("k").alias("points")),
        "unknown": kind("unknown").groupBy("file", "surface", "name").agg(F.count("*").alias("n")),
    }


def provenance(modified: Column, dirty: Column, explicit: Column, app: str) -> Column:
    """The comment of a written surface: what was changed, by the number of vertices if it is known, and whose triangulation it has."""
    some = F.concat(modified.cast("string"), F.when(modified == 1, " vertex modified").otherwise(" vertices modified"))
    status = F.when(modified > 0, some).when(modified.isNull() & F.coalesce(dirty, F.lit(False)), "surface modified").otherwise("no changes")
    made = F.when(explicit, "triangulation preserved from source").otherwise("triangulation rebuilt")
    return F.concat(F.lit(f"<!-- exported by {escape(app)}; "), status, F.lit("; "), made, F.lit(" -->"))


def _polylines(lines: DataFrame, places: int) -> DataFrame:
    """(file, surface, breaklines, contours, boundaries): the elements of each surface's lines, in order of their numbers."""
    point = F.concat_ws(" ", *[F.format_string(f"%.{places}f", F.coalesce(F.col(c), F.lit(0.0))) for c in "yxz"])
    each = lines.groupBy("file", "surface", "role", F.col("line").cast("int").alias("k")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", point.alias("p")))), lambda s: s["p"]), " ").alias("points"), F.first("boundary").alias("kind")
    )
    list_ = F.concat(F.lit("<PntList3D>"), F.col("points"), F.lit("</PntList3D>"))
    boundary = F.concat(F.lit('<Boundary bndType="'), F.coalesce("kind", F.lit("outer")), F.lit('">'), list_, F.lit("</Boundary>"))
    tag = lambda name: F.concat(F.lit(f"<{name}>"), list_, F.lit(f"</{name}>"))
    text = F.when(F.col("role") == "boundary", boundary).when(F.col("role") == "contour", tag("Contour")).otherwise(tag("Breakline"))
    told = each.filter(F.col("role").isin("breakline", "contour", "boundary")).withColumn("xml", text)
    whole = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("k", "xml")))), lambda s: s["xml"]), "")
    around = lambda c, *names: F.when(F.length(c) > 0, F.concat(F.lit("".join(f"<{n}>" for n in names)), c, F.lit("".join(f"</{n}>" for n in names[::-1])))).otherwise("")
    found = told.groupBy("file", "surface").agg(*[whole(r).alias(r) for r in ("breakline", "contour", "boundary")])
    return found.select("file", "surface", F.concat(around(F.col("breakline"), "SourceData", "Breaklines"), around(F.col("contour"), "Contours"), around(F.col("boundary"), "Boundaries")).alias("ls"))


def write(surfaces: DataFrame, vertices: DataFrame, faces: DataFrame, places: int = 3, lines: DataFrame | None = None, unit: str | None = None) -> DataFrame:
    """(file, xml): LandXML text of each file's surfaces, with coordinates to a fixed number of decimals.

    lines are those of `read`: breaklines, contours and boundaries are written. surfaces may have a column comment,
    such as `provenance`. A surface's lines are gathered in order, since a text file has one writer; surfaces are written apart."""
    number = lambda c: F.format_string(f"%.{places}f", F.col(c))
    p = vertices.select("file", "surface", F.col("vertex").alias("k"), F.concat(
        F.lit('<P id="'), (F.col("vertex") + 1).cast("string"), F.lit('">'), F.concat_ws(" ", number("y"), number("x"), number("z")), F.lit("</P>")
    ).alias("line"))
    f = faces.select("file", "surface", F.concat(
        F.when(F.col("visible"), "<F>").otherwise('<F i="1">'), F.concat_ws(" ", *[(F.col(c) + 1).cast("string") for c in "abc"]), F.lit("</F>")
    ).alias("line"), F.struct("a", "b", "c").alias("k"))
    gather = lambda df, name: df.groupBy("file", "surface").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda s: s["line"]), "\n").alias(name)
    )
    each = surfaces.join(gather(p, "ps"), ["file", "surface"], "left").join(gather(f, "fs"), ["file", "surface"], "left")
    each = each.join(_polylines(lines, places), ["file", "surface"], "left") if lines is not None else each.withColumn("ls", F.lit(""))
    comment = F.coalesce("comment", F.lit("")) if "comment" in surfaces.columns else F.lit("")
    body = F.concat(
        F.lit('<Surface name="'), tx.escape_xml(F.col("name")), F.lit('">'), comment, F.lit('<Definition surfType="TIN"><Pnts>\n'), F.coalesce("ps", F.lit("")),
        F.lit("\n</Pnts><Faces>\n"), F.coalesce("fs", F.lit("")), F.lit("\n</Faces>"), F.coalesce("ls", F.lit("")), F.lit("</Definition></Surface>"),
    )
    whole = each.select("file", F.struct("surface", body.alias("xml")).alias("s")).groupBy("file").agg(F.array_sort(F.collect_list("s")).alias("s"))
    text = F.array_join(F.transform("s", lambda s: s["xml"]), "\n")
    head = '<?xml version="1.0"?>\n<LandXML xmlns="http://www.landxml.org/schema/LandXML-1.2" version="1.2">\n'
    if unit:
        tag = "Metric" if "meter" in unit.lower() else "Imperial"
        head += f'<Units><{tag} linearUnit="{escape(unit)}"/></Units>\n'
    head += "<Surfaces>\n"
    return whole.select("file", F.concat(F.lit(head), text, F.lit("\n</Surfaces>\n</LandXML>\n")).alias("xml"))
