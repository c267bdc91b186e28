"""File formats: points, tiles, surfaces and linework."""

import dataclasses
import io
import json
import math
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import curves
from plumbline.operators import raster
from plumbline.functions import text as text_functions
from plumbline.sources import preview as preview_cache
from plumbline.sources import artifacts, dxf, landxml, las, project, tiff, worldfile, wpi, xmlblocks


def las_file(path, n, fmt=7, cut=0, vlr=None):
    head = bytearray(375)
    head[:4], head[24], head[25], head[104] = b"LASF", 1, 4, fmt
    extra = b""
    if vlr:
        extra = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 34737, len(vlr), b"") + vlr
    struct.pack_into("<HII", head, 94, 375, 375 + len(extra), int(bool(vlr)))
    struct.pack_into("<H", head, 105, 36)
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 0, 0, 0)
    struct.pack_into("<6d", head, 179, 1000, 0, 1000, 0, 200, 0)
    struct.pack_into("<Q", head, 247, n)
    body = b""
    for i in range(n):
        rec = bytearray(36)
        struct.pack_into("<3iH", rec, 0, i * 7919 % 100000, i * 104729 % 100000, i * 1299709 % 20000, i * 37 & 0xFFFF)
        rec[14], rec[16] = i % 8, i % 32
        struct.pack_into("<3H", rec, 30, i * 5 & 0xFFFF, i * 7 & 0xFFFF, i * 11 & 0xFFFF)
        body += rec
    path.write_bytes(bytes(head) + extra + body[: len(body) - cut])
    return str(path)


def test_las_points(spark, tmp_path):
    spark.dataSource.register(las.LasSource)
    path = las_file(tmp_path / "a.las", 500)
    df = spark.read.format("las").option("path", path).option("records", 64).load()
    assert df.rdd.getNumPartitions() == 8
    rows = {r.idx: r for r in df.collect()}
    assert len(rows) == 500
    for i in (0, 63, 64, 499):
        r = rows[i]
        assert (r.xi, r.yi, r.zi, r.intensity, r.classification) == (i * 7919 % 100000, i * 104729 % 100000, i * 1299709 % 20000, i * 37 & 0xFFFF, i % 32)
        assert math.isclose(r.x, r.xi * 0.01) and r.return_number == i % 8 and r.number_of_returns == 0 and r.b == i * 11 & 0xFFFF
    part = spark.read.format("las").option("path", path).option("start", 100).option("count", 10).load()
    assert [r.idx for r in part.orderBy("idx").collect()] == list(range(100, 110))


def test_las_without_colours_and_cut_short(spark, tmp_path):
    spark.dataSource.register(las.LasSource)
    df = spark.read.format("las").option("path", las_file(tmp_path / "b.las", 20, fmt=6, cut=10)).load()
    assert df.count() == 19 and df.filter("r <> 255").count() == 0


def test_las_header_errors_and_crs(tmp_path):
    for raw in (b"LASF", b"X" * 400):
        with pytest.raises(las.LasError):
            las.parse_header(raw)
    path = las_file(tmp_path / "c.las", 2, vlr=b"NAD83 / zone, US survey foot|\0")
    raw = open(path, "rb").read()
    head = las.parse_header(raw)
    vlrs = las.parse_vlrs(raw, head)
    assert las.projection(vlrs) == ("NAD83 / zone, US survey foot", None) and math.isclose(head.density("foot"), 2e-6) and head.density("metre") is None


def test_tiles(spark):
    pdf = spark.range(5).select(*[((F.col("id") - 2) * k).alias(n) for k, n in enumerate(("xi", "yi", "zi"), 1)], *[F.lit(k).alias(n) for k, n in enumerate(("intensity", "classification", "return_byte", "r", "g", "b"))]).toPandas()
    for colours in (True, False):
        raw = wpi.encode(pdf, colours)
        assert len(raw) == 8 + 5 * (22 if colours else 16)
        assert wpi.decode(raw)["zi"].tolist() == pdf["zi"].tolist()
        with pytest.raises(ValueError):
            wpi.decode(raw[:-3])
    df = spark.createDataFrame(pdf).withColumns({"idx": F.monotonically_increasing_id(), "key": F.lit("0-0-0-0")})
    assert len(wpi.decode(wpi.tiles(df, "key").collect()[0].tile)) == 5


XML = """<?xml version="1.0"?><l:LandXML xmlns:l="x"><l:Units><l:Metric linearUnit="meter"/></l:Units><!-- <P> --><l:Surfaces>
<l:Surface name="a &amp; b"><Odd/><l:Definition><l:Pnts><P id="10">1.5 2.25 3</P><P id="20">4 5 6</P><P id="30">7 9 8</P><P id="40">0 0 1</P></l:Pnts>
<l:Faces><F>10 20 30</F><F i="1">10 30 40</F><F>10 20 99</F></l:Faces></l:Definition>
<l:SourceData><l:Boundaries><l:Boundary bndType="island"><l:PntList3D>0 0 0 1 1 1 2 2 2</l:PntList3D></l:Boundary></l:Boundaries></l:SourceData></l:Surface>
<l:Surface name="second"><l:Definition><l:Pnts><P>1 1 1</P></l:Pnts></l:Definition></l:Surface></l:Surfaces></l:LandXML>"""


def test_landxml_tables_and_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/s.xml").write_text(XML)
    t = landxml.read(spark, str(tmp_path / "in"))
    assert [(r.surface, r.name) for r in t["surfaces"].orderBy("surface").collect()] == [(0, "a & b"), (1, "second")]
    first = t["vertices"].filter("id = '10'").collect()[0]
    assert (first.x, first.y, first.z) == (2.25, 1.5, 3.0)
    assert sorted((r.a, r.b, r.c, r.visible) for r in t["faces"].collect()) == [(0, 1, 2, True), (0, 2, 3, False)]
    assert t["rejected"].collect()[0].c == "99" and [r.name for r in t["unknown"].collect()] == ["Odd"]
    assert {r.boundary for r in t["lines"].collect()} == {"inclusion"} and t["units"].collect()[0].unit == "meter"
    told = landxml.provenance(F.when(F.col("surface") == 0, 1), F.col("surface") == 1, F.col("surface") == 0, "plumb & line")
    xml = landxml.write(t["surfaces"].withColumn("comment", told), t["vertices"], t["faces"], lines=t["lines"], unit="meter").collect()[0].xml
    assert "<!-- exported by plumb &amp; line; 1 vertex modified; triangulation preserved from source -->" in xml and "; surface modified; triangulation rebuilt -->" in xml
    (tmp_path / "out").mkdir()
    (tmp_path / "out/s.xml").write_text(xml)
    again = landxml.read(spark, str(tmp_path / "out"))
    place = lambda f: sorted((r.surface, r.vertex, r.x, r.y, r.z) for r in f["vertices"].collect())
    assert place(t) == place(again)
    drawn = lambda f: sorted((r.surface, r.role, r.seq, r.x, r.y, r.z or 0.0, r.boundary) for r in f["lines"].collect())
    assert drawn(t) == drawn(again) and drawn(t) and again["units"].collect()[0].unit == "meter"
    assert sorted((r.a, r.b, r.c, r.visible) for r in again["faces"].collect()) == [(0, 1, 2, True), (0, 2, 3, False)]


def whole_file_events(text):
    """Open, close and text events, by searching on from place to place."""
    at, out, local = 0, [], lambda q: q.partition(":")[2] if ":" in q else q
    said = lambda t, coded=True: t and out.append(("text", xmlblocks.decode_entities(t) if coded else t))
    while at < len(text):
        lt = text.find("<", at)
        said(text[at : lt if lt >= 0 else None])
        if lt < 0:
            break
        long = next(((m, e) for m, e in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<?", "?>")) if text.startswith(m, lt)), None)
        end = text.find(long[1], lt + len(long[0])) if long else text.find(">", lt + 1)
        if end < 0:
            said(long is not None and long[0] == "<![CDATA[" and text[lt + 9 :], False)
            break
        body, at = text[lt + (len(long[0]) if long else 1) : end], end + (len(long[1]) if long else 1)
        if long:
            if long[0] == "<![CDATA[":
                said(body, False)
        elif body[:1] == "/":
            if body[1:].strip():
                out.append(("close", local(body[1:].strip())))
        elif body[:1] != "!" and (m := re.match(r"[^\s/>]+", body.removesuffix("/"))):
            rest = body.removesuffix("/")[m.end() :]
            given = re.findall(r"([^\s=/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", rest)
            out.append(("open", local(m[0]), {local(k): xmlblocks.decode_entities(a or b) for k, a, b in given}))
            if body.endswith("/"):
                out.append(("close", local(m[0])))
    return out


def merged(events):
    """Events with neighbouring texts joined."""
    out = []
    for e in events:
        if e[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + e[1])
        else:
            out.append(e)
    return out


ODD_XML = [
    "", "<", "<a", "a > b", "<a><b></a>", "&#x110000; &lt &lt; &#x41;&#;", "<![CDATA[<x>", "<!-- ", "</x>", "<!-->--><b/>", "<!--->--><c/>", "<?a>?><b/>", "<!DOCTYPE x><y/>", "< a>t</ a >",
    "<a b='1>2'>x</a>", "<a><![CDATA[1 ]]]]><![CDATA[> 2]]></a>", "<a>é<!-- > -- > -->😀</a></a></b><c><a>", "<x:a y:z='&amp;'>1<!--c--> <!--d-->2</x:a><?p ?x?>", "t<a>1</a", "<![CDAT>x<![CDATA[a>b]]>",
    "<a/><b></b></c></b><d><a></d></a>",
]


@pytest.mark.parametrize("text", [*ODD_XML, "".join(ODD_XML[3:6] + ODD_XML[9:])])
def test_blocks_of_markup_end_as_the_whole_file_does(text):
    """All ways to cut a text's records in two or three, with effects told from every state."""
    raw = text.encode()
    parts = raw.split(b">")
    unfinished = bool(parts[-1])
    parts = parts if unfinished else parts[:-1]
    watch = xmlblocks.Watch(frozenset("ab"), frozenset("ac"))
    want = merged((e[0], e[1], e[2]) if e[0] == "open" else (e[0], e[1]) for e in whole_file_events(text))

    def read(cuts):
        at, found, c = [0, *cuts, len(parts)], [], xmlblocks.Context()
        for a, b in zip(at, at[1:]):
            ctx = dataclasses.replace(c, path=list(c.path), counts=dict(c.counts))
            for e in xmlblocks._events(iter(parts[a:b]), ctx, unfinished and b == len(parts)):
                found.append((e[0], e[1], e[2]) if e[0] == "open" else (e[0], e[3] if e[0] == "text" else e[1]))
                xmlblocks.follow(ctx, e, watch)
            state, effect = xmlblocks.effects(parts[a:b], watch)[0][c.state]
            c = effect.on(c, state)
            if b < len(parts):
                assert (c.path, {k: n for k, n in c.counts.items() if n}, c.kept, c.text) == (ctx.path, ctx.counts, ctx.kept, ctx.text)
        return merged(found)

    n = len(parts)
    for cuts in [[]] + [[i] for i in range(n + 1)] + [[i, j] for i in range(n + 1) for j in range(i, n + 1)]:
        assert read(cuts) == want


@pytest.mark.parametrize("cut", [150])
def test_one_file_by_many_tasks(spark, tmp_path, cut):
    text = XML.replace("<l:Surfaces>", "<!-- a > b --><l:Surfaces>").replace("7 9 8", "7 <!-- > <P> -->9<![CDATA[ 8 ]]>")
    text = text.replace("</l:SourceData>", "<l:DataPoints><l:PntList3D>1 1 1 2 2 2</l:PntList3D></l:DataPoints></l:SourceData>")
    (tmp_path / "a.xml").write_text(text)
    (tmp_path / "b.xml").write_text(XML.replace("<l:Units><l:Metric linearUnit=\"meter\"/></l:Units>", "")[:-20])
    (tmp_path / "c.xml").write_text("")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        read = xmlblocks.records(spark, str(tmp_path))
        blocks = read.select("file", "block").distinct().count()
        events = {}
        for r in xmlblocks.read_events(spark, str(tmp_path)).orderBy("file", "block", "k").collect():
            events.setdefault(r.file[-5:], []).append((r.event, r.text if r.event == "text" else r.name, *([r.attributes] if r.event == "open" else [])))
        t = landxml.read(spark, str(tmp_path))
        rows = {k: sorted(map(repr, df.collect())) for k, df in t.items()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert blocks > 1000 // cut
    for name in ("a.xml", "b.xml"):
        assert merged(events[name]) == merged(whole_file_events((tmp_path / name).read_text()))
    want = landxml.read(spark, str(tmp_path))
    assert rows == {k: sorted(map(repr, df.collect())) for k, df in want.items()}
    point = want["vertices"].filter("id = '30' AND file LIKE '%a.xml'").collect()[0]
    assert (point.vertex, point.x, point.y, point.z) == (2, 9.0, 7.0, 8.0)
    assert [(r.lists, r.points) for r in want["inventory"].collect()] == [(1, 2)]
    assert {r.file[-5:]: (r.linear, r.note) for r in want["units"].collect()} == {"a.xml": ("meter", None), "b.xml": ("meter", "no <Units> element — assuming meter")}


def test_linear_units(spark):
    df = spark.createDataFrame([("USSurveyFoot",), ("internationalFoot",), ("feet",), ("Meter",), ("furlong",), ("",), (None,)], "u string")
    out = df.select(text_functions.linear_unit(F.col("u")), text_functions.linear_unit_note(F.col("u"))).collect()
    assert [r[0] for r in out] == ["usSurveyFoot", "foot", "foot", "meter", "meter", "meter", "meter"]
    assert [r[1] for r in out] == [None] * 4 + ['unrecognized linearUnit "furlong" — assuming meter', 'unrecognized linearUnit "" — assuming meter', "no <Units> element — assuming meter"]


def group(*pairs):
    return "".join(f"{c}\n{v}\n" for c, v in pairs)


DXF = group(
    (0, "SECTION"), (2, "TABLES"), (0, "LAYER"), (2, "roads"), (62, 3), (6, "DASHED"), (0, "ENDSEC"),
    (0, "SECTION"), (2, "BLOCKS"), (0, "BLOCK"), (2, "inner"), (0, "LINE"), (8, "roads"), (62, 0), (10, 0), (20, 0), (11, 1), (21, 0), (0, "ENDBLK"),
    (0, "BLOCK"), (2, "outer"), (0, "INSERT"), (2, "inner"), (8, "0"), (62, 0), (10, 10), (20, 0), (50, 90), (0, "INSERT"), (2, "outer"), (10, 0), (20, 0), (0, "ENDBLK"), (0, "ENDSEC"),
    (0, "SECTION"), (2, "ENTITIES"), (0, "INSERT"), (2, "outer"), (8, "0"), (62, 5), (10, 100), (20, 200), (70, 2), (71, 2), (44, 50), (45, 60),
    (0, "LWPOLYLINE"), (8, "roads"), (70, 1), (10, 0), (20, 0), (42, math.tan(math.pi / 8)), (10, 1), (20, 1), (10, 0), (20, 1),
    (0, "LINE"), (8, "paper"), (67, 1), (10, 0), (20, 0), (11, 1), (21, 1), (0, "MYSTERY"), (8, "0"), (0, "ENDSEC"), (0, "EOF"),
)


def test_dxf(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.dxf").write_text(DXF)
    t = dxf.read(spark, str(tmp_path / "d"))
    lines = t["entities"].filter("type = 'LINE'").collect()
    starts = sorted((round(r.pts[0].x, 6), round(r.pts[0].y, 6)) for r in lines)
    assert starts == [(110.0, 200.0), (110.0, 260.0), (160.0, 200.0), (160.0, 260.0)]
    assert all(r.color == 5 and math.isclose(r.pts[1].y - r.pts[0].y, 1.0) for r in lines)
    ring = t["entities"].filter("type = 'LWPOLYLINE'").collect()[0]
    assert ring.closed and ring.color == 3
    centre = [math.hypot(p.x - 0.0, p.y - 1.0) for p in ring.pts]
    assert max(abs(c - 1) for c in centre[:-1] if c > 0.5) < 1e-9
    assert {r.name: r.linetype for r in t["layers"].collect()}["roads"] == "DASHED"
    assert {(r.type, r.paper): r.n for r in t["census"].collect()}["LINE", True] == 1


@pytest.mark.parametrize("text", ["", "garbage\nmore", group((0, "SECTION"), (2, "ENTITIES"), (0, "LWPOLYLINE"), (10, "x")), "0\nLINE\n10\n"])
def test_dxf_never_fails(text):
    dxf.parse("f", text)


def test_world_files(spark):
    rows = [("0.5\n0\n0\n-0.5\n100\n200\n",), ("1\n2\n3",), ("a\n0\n0\n1\n1\n1",), (None,)]
    out = [r.w for r in spark.createDataFrame(rows, "t string").select(worldfile.world_file(F.col("t")).alias("w")).collect()]
    assert (out[0].dx, out[0].dy, out[0].x) == (0.5, -0.5, 100.0) and out[1:] == [None, None, None]


def test_curves(spark):
    pts = curves.ellipse((1.0, 2.0), (3.0, 0.0), 0.5, 0.0, 2 * math.pi)
    assert all(math.isclose(((x - 1) / 3) ** 2 + ((y - 2) / 1.5) ** 2, 1.0) for x, y in pts)
    line = curves.spline([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], 3, [0, 0, 0, 0, 1, 1, 1, 1], samples=9)
    assert len(line) == 9 and all(math.isclose(x, y, abs_tol=1e-12) for x, y in line) and math.isclose(line[4][0], 1.5)
    assert curves.spline([(0.0, 0.0)], 3, [0, 1]) == [(0.0, 0.0)]
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    half = curves.clip_ring([(-1.0, 0.0), (0.5, 0.0), (0.5, 1.0), (-1.0, 1.0)], square)
    assert math.isclose(abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(half, half[1:] + half[:1]))) / 2, 0.5)
    rows = spark.createDataFrame([(0.2, 0.2, 0.8, 0.8), (-1.0, 0.5, 2.0, 0.5), (-1.0, 2.0, 2.0, 2.0)], "a double, b double, c double, d double")
    out = [r.s for r in rows.select(curves.clip_segment(*[F.col(c) for c in "abcd"], square).alias("s")).collect()]
    assert tuple(out[0]) == (0.2, 0.2, 0.8, 0.8) and out[2] is None
    assert math.isclose(out[1].x0, 0.0, abs_tol=1e-12) and math.isclose(out[1].x1, 1.0)


def test_project_files(spark, tmp_path):
    folder = str(tmp_path)
    assert project.clean(folder)
    manifest = {"assets": [{"id": "a", "kind": "point-cloud"}, {"id": "a", "kind": "surface"}], "features": [{"id": "f", "simulationId": "s"}, {"id": "g", "simulationId": "t"}],
                "exclusionZones": [{"id": "z", "simulationId": "s", "featureId": "nope"}]}
    project.save(folder, manifest)
    assert project.save(folder, manifest)["modifiedAt"] and project.clean(folder) and (tmp_path / project.BACKUP).exists()
    with open(tmp_path / project.JOURNAL, "a") as f:
        f.write("{")
    assert not project.clean(folder)
    with pytest.raises(ValueError):
        project.inside(folder, "../x")
    assert project.unique_name("a.las", {"a.las", "a-2.las"}) == "a-3.las"
    found = project.issues(project.lists(spark, f"{folder}/{project.MANIFEST}"), "s")
    assert sorted(tuple(r) for r in found.collect()) == [("other-simulation", "features", "g"), ("repeated-id", "assets", "a"), ("unknown-feature", "exclusionZones", "z")]


def test_las_folders_patterns_and_boxes(spark, tmp_path):
    spark.dataSource.register(las.LasSource)
    for k, name in enumerate(("a.las", "b.LAS", "note.txt")):
        if k < 2:
            las_file(tmp_path / name, 100 + k)
        else:
            (tmp_path / name).write_text("no points")
    read = lambda path, **o: spark.read.format("las").options(**o).load(str(path))
    assert read(tmp_path).count() == 201 and read(tmp_path).select("file").distinct().count() == 2
    assert read(f"{tmp_path}/a*").count() == 100 and read(f"{tmp_path.as_uri()}/?.las").count() == 100
    box = (0.0, 0.0, 0.0, 400.0, 500.0, 100.0)
    whole, part = read(tmp_path), read(tmp_path, box=",".join(map(str, box)))
    inside = " AND ".join(f"{d} BETWEEN {box[k]} AND {box[k + 3]}" for k, d in enumerate("xyz"))
    assert 0 < part.count() == whole.filter(inside).count() < 201
    assert whole.filter("gps_time is null").isEmpty()
    assert las.dtype(dataclasses.replace(las.read_header(f"{tmp_path}/a.las"), point_format=2)).names[-1] != "gps_time"


def test_spline_samples_both_ends():
    control, knots = [(0.0, 0.0), (1.0, 2.0), (3.0, 2.0), (4.0, 0.0)], [0, 0, 0, 0, 1, 1, 1, 1, 1, 1]
    line = curves.spline(control, 3, knots, samples=9)
    assert len(line) == 9 and line[0] == control[0] and line[-1] == control[-1]
    t = 0.25
    want = [sum(math.comb(3, i) * t**i * (1 - t) ** (3 - i) * control[i][d] for i in range(4)) for d in (0, 1)]
    assert line[2] == pytest.approx(want)


def test_hatch_boundaries():
    square = [(91, "3"), (92, "2"), (72, "1"), (73, "1"), (93, "4"), (10, "0"), (20, "0"), (42, "0"), (10, "4"), (20, "0"), (42, "1"), (10, "4"), (20, "4"), (10, "0"), (20, "4")]
    edges = [(92, "0"), (93, "3"), (72, "1"), (10, "0"), (20, "0"), (11, "10"), (21, "0"), (72, "2"), (10, "5"), (20, "0"), (40, "5"), (50, "0"), (51, "90"), (73, "1"), (72, "1"), (10, "5"), (20, "5"), (11, "0"), (21, "0")]
    short = [(92, "2"), (93, "2"), (10, "0"), (20, "0"), (10, "1"), (20, "1")]
    first, second = dxf.hatch_loops([(8, "fill"), *square, *edges, *short])
    assert first[0] == (0.0, 0.0) and first[-1] == (0.0, 4.0) and max(x for x, _ in first) == pytest.approx(6.0, abs=0.1)
    assert second[:2] == [(0.0, 0.0), (10.0, 0.0)] and second[-1] == pytest.approx((5.0, 5.0)) and len(second) > 5
    assert all(math.hypot(x - 5, y) == pytest.approx(5.0) for x, y in second[1:])
    text = "\n".join(["0", "SECTION", "2", "ENTITIES", "0", "HATCH", *(str(v) for g in [(8, "fill"), *square, *edges, *short] for v in g), "0", "LINE", "10", "1", "20", "1", "11", "2", "21", "2", "0", "ENDSEC", "0", "EOF"])
    entities, _ = dxf.parse("f", text)
    assert [(e["type"], e["closed"], e["layer"]) for e in entities] == [("HATCH", True, "fill")] * 2 + [("LINE", False, "0")]
    assert dxf.hatch_loops([]) == dxf.hatch_loops([(91, "x"), (92, "y")]) == []


def raster_file(path, values, **told):
    path.write_bytes(tiff.encode(values, **told))
    return str(path)


def blended(values, out_w, out_h):
    """Bilinear shrinking, pixel by pixel."""
    h, w, bands = values.shape
    out = np.zeros((out_h, out_w, bands))
    for y in range(out_h):
        for x in range(out_w):
            rx, ry = x * (w / out_w), y * (h / out_h)
            xl, yl = math.floor(rx), math.floor(ry)
            xh, yh = min(math.ceil(rx), w - 1), min(math.ceil(ry), h - 1)
            mix = lambda a, b, t: (1 - t) * a + t * b
            out[y, x] = mix(mix(values[yl, xl], values[yl, xh], rx - xl), mix(values[yh, xl], values[yh, xh], rx - xl), ry - yl)
    return np.trunc(out) if values.dtype.kind != "f" else out.astype(np.float32)


def grid(found, bands):
    rows = found.collect()
    w, h = 1 + max(r.ox for r in rows), 1 + max(r.oy for r in rows)
    assert len(rows) == w * h
    out = np.zeros((h, w, bands))
    for r in rows:
        out[r.oy, r.ox] = r.v
    return out


def tiled_file(path, values, tile=16, predictor=1, planar=1, order=">"):
    """A BigTIFF of tiles in the other byte order."""
    height, width, bands = values.shape
    across, down = -(-width // tile), -(-height // tile)
    chunks = []
    for plane in range(bands if planar == 2 else 1):
        for k in range(across * down):
            x, y = k % across * tile, k // across * tile
            held = np.zeros((tile, tile, 1 if planar == 2 else bands), values.dtype)
            part = values[y : y + tile, x : x + tile, plane : plane + 1] if planar == 2 else values[y : y + tile, x : x + tile]
            held[: part.shape[0], : part.shape[1]] = part
            if predictor == 2:
                held[:, 1:] = held[:, 1:] - held[:, :-1].copy()
            chunks.append(zlib.compress(held.astype(values.dtype.newbyteorder(order)).tobytes()))
    tags = {256: ("I", [width]), 257: ("I", [height]), 258: ("H", [8 * values.dtype.itemsize] * bands), 259: ("H", [8]), 277: ("H", [bands]), 284: ("H", [planar]), 317: ("H", [predictor]),
            322: ("I", [tile]), 323: ("I", [tile]), 324: ("Q", [0] * len(chunks)), 325: ("Q", [len(c) for c in chunks]), 339: ("H", [3 if values.dtype.kind == "f" else 1] * bands), 34737: ("s", [b"NAD83|\0"])}
    at = 16 + 8 + 20 * len(tags) + 8
    size = lambda c, v: len(v[0]) if c == "s" else struct.calcsize(f"{order}{len(v)}{c}")
    first = at + sum(size(c, v) for c, v in tags.values() if size(c, v) > 8)
    tags[324] = ("Q", [first + sum(map(len, chunks[:k])) for k in range(len(chunks))])
    entries, body = b"", b""
    for tag, (c, v) in tags.items():
        raw = v[0] if c == "s" else struct.pack(f"{order}{len(v)}{c}", *v)
        kind, n = {"H": 3, "I": 4, "Q": 16, "s": 2}[c], len(raw) if c == "s" else len(v)
        entries += struct.pack(order + "HHQ", tag, kind, n) + (raw.ljust(8, b"\0") if len(raw) <= 8 else struct.pack(order + "Q", at + len(body)))
        body += raw if len(raw) > 8 else b""
    head = (b"MM" if order == ">" else b"II") + struct.pack(order + "HHHQ", 43, 8, 0, 16)
    path.write_bytes(head + struct.pack(order + "Q", len(tags)) + entries + struct.pack(order + "Q", 0) + body + b"".join(chunks))
    return str(path)


def test_raster_windows(spark, tmp_path):
    rng = np.random.default_rng(1)
    one = rng.integers(0, 256, (53, 37, 4)).astype(np.uint8)
    two = rng.normal(100, 200, (41, 70, 1)).astype(np.float32)
    wide = rng.integers(0, 60000, (33, 50, 3)).astype(np.uint16)
    raster_file(tmp_path / "one.tif", one, rows_per_strip=8, origin=(1000.0, 2000.0), pixel=0.5)
    tiled_file(tmp_path / "two.tiff", two)
    tiled_file(tmp_path / "wide.tif", wide, predictor=2, planar=2)
    (tmp_path / "note.txt").write_text("no raster")
    all_pixels = tiff.read(spark, str(tmp_path), taskbytes=2000)
    assert all_pixels.rdd.getNumPartitions() > 8
    for name, values in (("one.tif", one), ("two.tiff", two), ("wide.tif", wide)):
        pixels = all_pixels.filter(F.col("file") == str(tmp_path / name))
        h, w, bands = values.shape
        assert (grid(raster.window(pixels, (0, 0, w, h)), bands) == values).all()
        for x0, y0, x1, y1, k in ((3, 5, 30, 28, 1), (3, 5, 30, 28, 2), (0, 0, w, h, 4), (7, 9, 8, 10, 4)):
            part = values[y0:y1, x0:x1]
            want = part if k == 1 else blended(part, max(1, math.ceil(part.shape[1] / k)), max(1, math.ceil(part.shape[0] / k)))
            assert np.allclose(grid(raster.window(pixels, (x0, y0, x1, y1), k), bands), want, rtol=1e-6, atol=0 if values.dtype.kind == "u" else 1e-3)
    for most in (20, 7, 500):
        found = raster.overview(all_pixels, most)
        for name, values in (("one.tif", one), ("two.tiff", two)):
            h, w, bands = values.shape
            scale = max(1, math.ceil(max(w, h) / most))
            want = blended(values, max(1, math.floor(w / scale + 0.5)), max(1, math.floor(h / scale + 0.5)))
            assert np.allclose(grid(found.filter(F.col("file") == str(tmp_path / name)), bands), want, rtol=1e-6, atol=1e-3)
    with open(tmp_path / "one.tif", "rb") as f:
        assert tiff.read_image(f).transform() == {"x": 1000.0, "y": 2000.0, "dx": 0.5, "dy": -0.5}
    with open(tmp_path / "wide.tif", "rb") as f:
        assert tiff.read_image(f).text == "NAD83|"
    colours = all_pixels.filter("px = 0 AND py = 0").select("file", raster.rgba(F.col("v"), F.col("bands")).alias("c")).collect()
    got = {r.file[-8:].lstrip("/"): tuple(r.c) for r in colours}
    grey = min(max(math.floor(float(two[0, 0, 0]) + 0.5), 0), 255)
    assert got["one.tif"] == (*map(int, one[0, 0, :3]), 255) and got["two.tiff"] == (grey, grey, grey, 255) and got["wide.tif"][0] == min(255, int(wide[0, 0, 0]))


def test_strips_outside_a_window_are_not_read(spark, tmp_path):
    values = np.arange(64 * 10, dtype=np.uint8).reshape(64, 10, 1)
    path = raster_file(tmp_path / "a.tif", values, rows_per_strip=4, deflate=True)
    with open(path, "rb") as f:
        image = tiff.read_image(f)
    raw = bytearray(open(path, "rb").read())
    for k in (0, 1, 2, 8, 9, 15):  # what is there now can't be inflated
        raw[image.offsets[k] : image.offsets[k] + image.sizes[k]] = b"\xff" * image.sizes[k]
    open(path, "wb").write(raw)
    part = lambda *window: tiff.read(spark, path, window, taskbytes=1)
    assert (grid(raster.window(part(2, 12, 8, 32), (2, 12, 8, 32)), 1) == values[12:32, 2:8]).all()
    assert part(0, 12, 10, 32).rdd.getNumPartitions() == 5 and part(0, 13, 10, 15).rdd.getNumPartitions() == 1
    assert part(11, 0, 20, 64).count() == 0 and part(0, 40, 0, 64).count() == 0
    with pytest.raises(Exception):
        tiff.read(spark, path).count()
    (tmp_path / "b.tif").write_bytes(b"II*\0" + bytes(40))
    for bad in (b"", b"GIF89a" + bytes(40), bytes((tmp_path / "b.tif").read_bytes())):
        with pytest.raises((tiff.TiffError, struct.error)):
            tiff.read_image(io.BytesIO(bad))
    assert tiff._unpacked(b"\x02abc\xfez\x80\x00q") == b"abczzzq"


def test_preview_cache(spark, tmp_path):
    rows = [(k % 7, k, float(k), k * 0.5, -float(k), k % 256, 2, 3, k * 3.0, k % 32, k % 5, 5) for k in range(1000)]
    names = "id long, idx long, lx double, ly double, lz double, r int, g int, b int, intensity double, classification int, return_number int, number_of_returns int"
    sample = spark.createDataFrame(rows, names).repartition(5)
    folder = str(tmp_path / "cache")
    preview_cache.write(sample, folder, {"quality": "fast"})
    told = preview_cache.read_descriptor(folder)
    assert told["points"] == 1000 and told["told"] == {"quality": "fast"} and sum(p["nodes"] for p in told["parts"]) >= 7
    back = preview_cache.read(spark, folder)
    assert sorted(map(tuple, back.collect())) == sorted((r[0], *r[2:]) for r in rows)
    assert [(r.id, r.lx) for r in preview_cache.read(spark, folder, [3]).collect()] == [(3, float(k)) for k in range(1000) if k % 7 == 3]
    with pytest.raises(Exception, match="holds a cache"):
        preview_cache.write(sample, folder)
    preview_cache.write(sample.filter("id < 2"), folder, overwrite=True)
    assert preview_cache.read(spark, folder).count() == sum(1 for r in rows if r[0] < 2)
    # one task of the job fails: others have written, and nothing can be read
    broken = sample.withColumn("lx", F.when(F.col("idx") < 999, F.col("lx")).otherwise(F.raise_error(F.lit("gone")).cast("double")))
    with pytest.raises(Exception, match="gone"):
        preview_cache.write(broken, str(tmp_path / "half"))
    with pytest.raises(Exception, match="no finished cache"):
        preview_cache.read(spark, str(tmp_path / "half")).count()
    preview_cache.write(sample.limit(0), str(tmp_path / "empty"))
    assert preview_cache.read(spark, str(tmp_path / "empty")).count() == 0
    # files and slices that don't fit each other
    part = told = preview_cache.read_descriptor(folder)["parts"][0]["part"]
    slices = tmp_path / "cache" / f"{part}.slices"
    good = slices.read_text()
    slices.write_text(json.dumps([[0, 0, 10**6]]))
    with pytest.raises(Exception, match="lies outside"):
        preview_cache.read(spark, folder).count()
    slices.write_text(good)
    colours = tmp_path / "cache" / f"{part}.colors"
    colours.write_bytes(colours.read_bytes()[:-1])
    with pytest.raises(Exception, match="bytes of"):
        preview_cache.read(spark, folder).count()
    (tmp_path / "cache" / "descriptor.json").write_text('{"version": 0, "parts": []}')
    with pytest.raises(Exception, match="has version 0"):
        preview_cache.read(spark, folder).count()


def test_stored_surfaces(spark, tmp_path):
    (tmp_path / "derived").mkdir()
    good = {"id": "s", "name": "n", "positions": [0, 0, 1.5, 1, 0, 2, 0, 1, 3], "sourcePointIds": [7, 8, 9], "indices": [0, 1, 2], "more": {}}
    for name, text in (("good", json.dumps(good)), ("empty", json.dumps(good | {"positions": [], "sourcePointIds": [], "indices": []})), ("torn", "{"), ("list", "[]"), ("short", json.dumps({k: v for k, v in good.items() if k != "indices"})), ("odd", json.dumps(good | {"name": 5}))):
        (tmp_path / f"derived/{name}.json").write_text(text)
    t = artifacts.read_surfaces(spark, str(tmp_path), [f"derived/{n}.json" for n in ("good", "empty", "torn", "list", "short", "odd")])
    assert sorted((r.path, r.id, r.name) for r in t["surfaces"].collect()) == [("derived/empty.json", "s", "n"), ("derived/good.json", "s", "n")]
    assert sorted(tuple(r) for r in t["vertices"].collect()) == [("derived/good.json", 0, 7, 0.0, 0.0, 1.5), ("derived/good.json", 1, 8, 1.0, 0.0, 2.0), ("derived/good.json", 2, 9, 0.0, 1.0, 3.0)]
    assert [tuple(r) for r in t["faces"].collect()] == [("derived/good.json", 0, 0, 1, 2)]
    assert sorted((r.path[8:-5], r.field, r.issue) for r in t["faults"].collect()) == [("list", "", "not-object"), ("odd", "name", "wrong-type"), ("short", "indices", "missing"), ("torn", "", "not-json")]
    with pytest.raises(ValueError, match="outside"):
        artifacts.read_surfaces(spark, str(tmp_path), ["../x.json"])
    assert artifacts.read_surfaces(spark, str(tmp_path), [])["vertices"].count() == 0


def test_checked_save(spark, tmp_path):
    dated = {"createdAt": "t", "modifiedAt": "t"}
    manifest = {"realitySimulation": {"id": "s"}, "features": [{"id": "f", "simulationId": "s", "type": "marker", "name": "n", "geometry": {}} | dated]}
    artifacts.save_checked(spark, str(tmp_path), manifest)
    for bad, why in (({"realitySimulation": {"id": "t"}}, "the simulation was s"), ({"features": [manifest["features"][0] | {"name": ""}]}, "name empty"), ({"features": [manifest["features"][0] | {"simulationId": "t"}]}, "other-simulation")):
        with pytest.raises(ValueError, match=why):
            artifacts.save_checked(spark, str(tmp_path), manifest | bad)
    assert json.loads((tmp_path / project.MANIFEST).read_text())["features"][0]["name"] == "n" and project.clean(str(tmp_path))
