"""DXF linework: group codes to entity rows, block references resolved by joins.

`read` gives layers, entities and points. References are expanded level by level: each
round joins the open references with the entities of their blocks and composes the
transforms; a reference to a block that is being expanded is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import curves
from plumbline.sources.tables import materialize

TOLERANCE = 0.1

ENTITY = (
    "file string, block string, entity long, type string, layer string, color int, paper boolean, closed boolean, xs array<double>, ys array<double>, zs array<double>, "
    "target string, px double, py double, pz double, sx double, sy double, rotation double, columns int, rows int, dx double, dy double"
)
LAYER = "file string, name string, color int, linetype string, lineweight int, hidden boolean"


def pairs(text: str) -> Iterator[tuple[int, str]]:
    """(group code, value) of each two lines; lines that do not start with a code are skipped."""
    lines = text.splitlines()
    at = 0
    while at + 1 < len(lines):
        try:
            yield int(lines[at].strip()), lines[at + 1].strip()
            at += 2
        except ValueError:
            at += 1


def records(text: str) -> Iterator[tuple[str, str, list[tuple[int, str]]]]:
    """(section, type, groups) of each record."""
    section, kind, groups = "", None, []
    for code, value in pairs(text):
        if code == 0:
            if kind == "SECTION":
                section = next((v for c, v in groups if c == 2), "")
            elif kind is not None:
                yield section, kind, groups
            kind, groups = value, []
        elif kind is not None:
            groups.append((code, value))
    if kind is not None:
        yield section, kind, groups


def _number(groups, code: int, default: float = 0.0) -> float:
    for c, v in groups:
        if c == code:
            try:
                return float(v)
            except ValueError:
                return default
    return default


def _text(groups, code: int, default: str = "") -> str:
    return next((v for c, v in groups if c == code), default)


def arc(cx: float, cy: float, radius: float, start: float, sweep: float, tolerance: float = TOLERANCE) -> list[tuple[float, float]]:
    """Points of an arc whose chords keep within the tolerance: 2 to 256 of them."""
    if radius <= 0:
        return [(cx, cy)]
    step = 2 * math.acos(max(-1.0, min(1.0, 1 - tolerance / radius)))
    n = max(2, min(256, math.ceil(abs(sweep) / step) if step > 0 else 256))
    return [(cx + radius * math.cos(start + sweep * k / n), cy + radius * math.sin(start + sweep * k / n)) for k in range(n + 1)]


def bulge(a: tuple[float, float], b: tuple[float, float], value: float, tolerance: float = TOLERANCE) -> list[tuple[float, float]]:
    """Points after a, up to b, of an arc whose quarter angle has the tangent `value`."""
    chord = math.hypot(b[0] - a[0], b[1] - a[1])
    if abs(value) < 1e-12 or chord == 0:
        return [b]
    angle = 4 * math.atan(value)
    radius = chord / (2 * math.sin(abs(angle) / 2))
    lift = math.sqrt(max(0.0, radius**2 - (chord / 2) ** 2)) * (1 if abs(angle) <= math.pi else -1) * (1 if value > 0 else -1)
    ux, uy = (b[0] - a[0]) / chord, (b[1] - a[1]) / chord
    cx, cy = (a[0] + b[0]) / 2 - uy * lift, (a[1] + b[1]) / 2 + ux * lift
    return [*arc(cx, cy, radius, math.atan2(a[1] - cy, a[0] - cx), angle, tolerance)[1:-1], b]


def _shape(kind: str, g: list[tuple[int, str]]) -> tuple[list[tuple[float, float, float]], bool] | None:
    if kind == "LINE":
        return [(_number(g, 10), _number(g, 20), _number(g, 30)), (_number(g, 11), _number(g, 21), _number(g, 31))], False
    if kind == "POINT":
        return [(_number(g, 10), _number(g, 20), _number(g, 30))], False
    if kind in ("CIRCLE", "ARC"):
        a0, a1 = (0.0, 360.0) if kind == "CIRCLE" else (_number(g, 50), _number(g, 51))
        sweep = math.radians((a1 - a0) % 360 or 360.0)
        pts = arc(_number(g, 10), _number(g, 20), _number(g, 40), math.radians(a0), sweep)
        return [(x, y, _number(g, 30)) for x, y in (pts[:-1] if kind == "CIRCLE" else pts)], kind == "CIRCLE"
    if kind == "LWPOLYLINE":
        closed, z, ends = bool(int(_number(g, 70)) & 1), _number(g, 38), []
        for code, v in g:
            if code == 10:
                ends.append([float(v), 0.0, 0.0])
            elif code in (20, 42) and ends:
                ends[-1][1 if code == 20 else 2] = float(v)
        if not ends:
            return None
        out = [(ends[0][0], ends[0][1])]
        for a, b in zip(ends, ends[1:] + ends[:1] * closed):
            out += bulge((a[0], a[1]), (b[0], b[1]), a[2])
        return [(x, y, z) for x, y in (out[:-1] if closed else out)], closed
    if kind == "ELLIPSE":
        start, end = _number(g, 41), _number(g, 42, 2 * math.pi)
        pts = curves.ellipse((_number(g, 10), _number(g, 20)), (_number(g, 11), _number(g, 21)), _number(g, 40, 1.0), start, end, TOLERANCE)
        return [(x, y, _number(g, 30)) for x, y in pts], abs(end - start - 2 * math.pi) < 1e-9
    if kind == "SPLINE":
        every = lambda code: [float(v) for c, v in g if c == code]
        control = list(zip(every(10), every(20), every(30)))
        return (curves.spline(control, int(_number(g, 71, 3)), every(40), every(41)), bool(int(_number(g, 70)) & 1)) if control else None
    if kind == "3DFACE":
        return [(_number(g, 10 + k), _number(g, 20 + k), _number(g, 30 + k)) for k in range(4)], True
    return None


def _split(groups: list[tuple[int, str]], code: int) -> list[list[tuple[int, str]]]:
    """The groups from each one with the code on, up to the next such one."""
    at = [k for k, (c, _) in enumerate(groups) if c == code]
    return [groups[a:b] for a, b in zip(at, [*at[1:], len(groups)])]


def _hatch_edge(g: list[tuple[int, str]]) -> list[tuple[float, float]]:
    """Points of one edge of a boundary: a line, an arc, an ellipse's arc, or the control points of any other curve."""
    kind, at = int(_number(g, 72)), (_number(g, 10), _number(g, 20))
    start, end, forward = _number(g, 50), _number(g, 51), _number(g, 73, 1) != 0
    if kind == 1:
        return [at, (_number(g, 11), _number(g, 21))]
    if kind == 2:
        turn = ((end - start) if forward else (start - end)) % 360 or 360.0
        return arc(*at, _number(g, 40), math.radians(start), math.radians(turn if forward else -turn))
    if kind == 3:
        return curves.ellipse(at, (_number(g, 11), _number(g, 21)), _number(g, 40, 1.0), math.radians(start), math.radians(end), TOLERANCE)
    ends = [k for k, (c, _) in enumerate(g) if c == 10 and k + 1 < len(g) and g[k + 1][0] == 20]
    return [(float(g[k][1]), float(g[k + 1][1])) for k in ends]


def hatch_loops(groups: list[tuple[int, str]]) -> list[list[tuple[float, float]]]:
    """The closed rings of a hatch's boundary paths that have three points or more; the first point is not repeated."""
    count = next((k for k, (c, _) in enumerate(groups) if c == 91), None)
    if count is None:
        return []
    out = []
    for path in _split(groups[count + 1 :], 92)[: int(_number(groups[count:], 91))]:
        size = int(_number(path, 93))
        if int(_number(path, 92)) & 2:
            ends = [(_number(v, 10), _number(v, 20), next((float(x) for c, x in v[:3] if c == 42), 0.0)) for v in _split(path, 10)[:size]]
            ring = [(ends[0][0], ends[0][1])] if ends else []
            for a, b in zip(ends, ends[1:] + ends[:1]):
                ring += bulge((a[0], a[1]), (b[0], b[1]), a[2])
            ring = ring[:-1]  # back at the first vertex
        else:
            ring = []
            for edge in _split(path, 72)[:size]:
                points = _hatch_edge(edge)
                same = ring and points and math.dist(ring[-1], points[0]) < 1e-9
                ring += points[1:] if same else points
            if len(ring) > 1 and math.dist(ring[0], ring[-1]) < 1e-9:
                ring.pop()
        if len(ring) >= 3:
            out.append(ring)
    return out


def parse(file: str, text: str) -> tuple[list[dict], list[dict]]:
    """(entities, layers) of a file; entities of a type not read have no points. Nothing is raised for bad input."""
    entities, layers, block = [], [], None
    for section, kind, g in records(text):
        if section == "TABLES" and kind == "LAYER":
            color = int(_number(g, 62, 7))
            layers.append({"file": file, "name": _text(g, 2), "color": abs(color), "linetype": _text(g, 6) or None, "lineweight": int(_number(g, 370, -3)), "hidden": color < 0 or bool(int(_number(g, 70)) & 1)})
        elif section == "BLOCKS" and kind in ("BLOCK", "ENDBLK"):
            block = _text(g, 2) if kind == "BLOCK" else None
        elif section in ("BLOCKS", "ENTITIES") and kind not in ("ENDSEC", "EOF"):
            row = {"file": file, "block": block if section == "BLOCKS" else None, "entity": len(entities), "type": kind, "layer": _text(g, 8, "0"), "color": int(_number(g, 62, 256)), "paper": _number(g, 67) == 1, "closed": False}
            try:
                shape, loops = _shape(kind, g), hatch_loops(g) if kind == "HATCH" else []
            except ValueError:
                shape, loops = None, []
            for ring in loops:  # a row for each boundary of a hatch
                told = {n: list(v) for n, v in zip(("xs", "ys"), zip(*ring))} | {"zs": [0.0] * len(ring)}
                entities.append(row | told | {"closed": True, "entity": len(entities)})
            if loops:
                continue
            if kind == "INSERT":
                row |= {"target": _text(g, 2), "px": _number(g, 10), "py": _number(g, 20), "pz": _number(g, 30), "sx": _number(g, 41, 1.0), "sy": _number(g, 42, 1.0), "rotation": math.radians(_number(g, 50))}
                row |= {"columns": max(1, int(_number(g, 70, 1))), "rows": max(1, int(_number(g, 71, 1))), "dx": _number(g, 44), "dy": _number(g, 45)}
            elif shape:
                row |= {"closed": shape[1]} | {n: [p[k] for p in shape[0]] for k, n in enumerate(("xs", "ys", "zs"))}
            entities.append(row)
    return entities, layers


def _frame(rows: list[dict], kind: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")]).astype(object)
    return out.where(out.notna(), None)


def _rows(which: int, kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                yield _frame(parse(file, bytes(content).decode("utf-8", "replace"))[which], kind)

    return run


def expand(entities: DataFrame) -> DataFrame:
    """Entities of the drawing itself, references replaced by what their blocks hold: with m = a, b, c, d, e, f of
    x' = a x + c y + e, y' = b x + d y + f applied to their points."""
    one = {"a": 1.0, "b": 0.0, "c": 0.0, "d": 1.0, "e": 0.0, "f": 0.0, "up": 0.0}
    top = entities.filter("block IS NULL AND NOT paper").withColumns({f"m{k}": F.lit(v) for k, v in one.items()})
    top = top.withColumns({"inherited": F.lit(None).cast("int"), "stack": F.array().cast("array<string>")})
    inside = entities.filter("block IS NOT NULL AND NOT paper")
    found, opened = [], top
    while True:  # a reference within itself is not followed, so that no branch is longer than there are blocks
        opened = materialize(opened, "blocks")
        found.append(opened.filter("type <> 'INSERT'"))
        refs = opened.filter("type = 'INSERT' AND NOT array_contains(stack, target)")
        if refs.isEmpty():
            break
        grid = F.explode(F.expr("flatten(transform(sequence(0, columns - 1), i -> transform(sequence(0, rows - 1), j -> struct(i AS i, j AS j))))"))
        cell = refs.withColumn("g", grid)
        sin, cos = F.sin("rotation"), F.cos("rotation")
        gx, gy = F.col("g.i") * F.col("dx"), F.col("g.j") * F.col("dy")
        own = {"a": cos * F.col("sx"), "b": sin * F.col("sx"), "c": -sin * F.col("sy"), "d": cos * F.col("sy"),
               "e": F.col("px") + cos * gx - sin * gy, "f": F.col("py") + sin * gx + cos * gy}
        m = {k: F.col(f"m{k}") for k in one}
        both = {
            "a": m["a"] * own["a"] + m["c"] * own["b"], "b": m["b"] * own["a"] + m["d"] * own["b"],
            "c": m["a"] * own["c"] + m["c"] * own["d"], "d": m["b"] * own["c"] + m["d"] * own["d"],
            "e": m["a"] * own["e"] + m["c"] * own["f"] + m["e"], "f": m["b"] * own["e"] + m["d"] * own["f"] + m["f"], "up": m["up"] + F.col("pz"),
        }
        color = F.when(F.col("color") == 0, F.coalesce("inherited", F.lit(7))).otherwise(F.col("color"))
        placed = cell.select(
            F.col("file"), F.col("target").alias("block"), *[v.alias(f"m{k}") for k, v in both.items()], color.alias("inherited"),
            F.array_append("stack", F.col("target")).alias("stack"),
        )
        opened = inside.join(placed, ["file", "block"]).select(*top.columns)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    x = F.transform(F.arrays_zip("xs", "ys", "zs"), lambda p: F.struct(
        (F.col("ma") * p["xs"] + F.col("mc") * p["ys"] + F.col("me")).alias("x"), (F.col("mb") * p["xs"] + F.col("md") * p["ys"] + F.col("mf")).alias("y"), (p["zs"] + F.col("mup")).alias("z")
    ))
    shown = F.when(F.col("color") == 0, F.coalesce("inherited", F.lit(7))).otherwise(F.col("color"))
    return out.select("file", "entity", "type", "layer", shown.alias("color"), "closed", x.alias("pts"))


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """layers (those of the table and those only used), entities with points, and the census of types."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    raw = materialize(files.mapInPandas(_rows(0, ENTITY), ENTITY), "entities")
    table = files.mapInPandas(_rows(1, LAYER), LAYER)
    drawn = expand(raw)
    used = drawn.select("file", F.col("layer").alias("name")).distinct()
    layers = used.join(table, ["file", "name"], "full").select("file", "name", F.coalesce("color", F.lit(7)).alias("color"), "linetype", "lineweight", F.coalesce("hidden", F.lit(False)).alias("hidden"))
    colours = layers.select("file", F.col("name").alias("layer"), F.col("color").alias("by_layer"))
    entities = drawn.filter("size(pts) > 0").join(colours, ["file", "layer"], "left").withColumn("color", F.when(F.col("color") == 256, F.col("by_layer")).otherwise(F.col("color"))).drop("by_layer")
    census = raw.groupBy("file", "type", "paper").agg(F.count("*").alias("n"))
    return {"layers": layers, "entities": entities, "census": census}
