"""WARC archives, the loser tree and URL filters."""

import base64
import collections
import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import idfiles, urlfilter, warc
from plumbline.llm.common import new_folder
from plumbline.llm.losertree import LoserTree
from plumbline.llm.queries import URL_RULES


def test_loser_tree_merges():
    rng = random.Random(1)
    for _ in range(200):
        runs = [sorted(rng.choices(range(20), k=rng.randint(0, 9))) for _ in range(rng.randint(0, 9))]
        assert list(LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_loser_tree_is_stable():
    class Key(tuple):
        def __lt__(self, other):
            return self[0] < other[0]

    runs = [[Key((k // 2, r)) for k in range(6)] for r in range(5)]
    assert list(LoserTree(runs)) == sorted((x for r in runs for x in r), key=lambda x: x[0])


def pages(spark):
    rows = [(i, None if i % 6 == 0 else f"http://A{i % 3}.example.com/x{i % 4}?q=1", [None, "", "<p>é</p>", "x" * i][i % 4]) for i in range(45)]
    rows += [(44, "http://a.example.com/", "x" * 3)] * 2
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"sha1": F.lit(1), "first": F.lit(2)}).repartition(7)


@pytest.mark.parametrize("fan_in, least", [(128, 0), (3, 0), (3, 2)])
def test_archives_round_trip(spark, monkeypatch, fan_in, least):
    for name, value in (("FAN_IN", fan_in), ("GROUP_ROWS", 4), ("RANGE_ROWS", 5)):
        monkeypatch.setattr(warc, name, value)
    rows, df = pages(spark)
    first = {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        first.setdefault((h or "").encode(), i)
    want = collections.Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        own = len(b) < least or first[b] == i
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if own else "revisit", None if own else first[b]] += 1
    out = warc.capture_index(spark, df, least).collect()
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == want
    order = [(r.urlkey, r.ts, r.page_id) for r in sorted(out, key=lambda r: r.part)]
    assert [x[:2] for x in order] == sorted(x[:2] for x in order)


def test_archives_of_nothing(spark):
    assert warc.capture_index(spark, pages(spark)[1].limit(0)).count() == 0


def test_records_are_gzip_members(spark):
    import gzip

    folder = new_folder(spark, "warc")
    archive = warc.write_archives(pages(spark)[1].coalesce(1), folder).collect()[0].archive
    found = list(warc.records(archive, block=50))
    raw = open(archive.removeprefix("file://"), "rb").read()
    at, size, fields, block = found[-1]
    assert at + size == len(raw)
    whole = gzip.decompress(raw[at : at + size])
    assert whole.startswith(b"WARC/1.1\r\n") and whole.endswith(block + b"\r\n\r\n")


def test_url_key():
    assert warc.url_key("http://Blog.Example.com/A/?x=1") == "com,example,blog)/a?x=1"
    assert warc.url_key(None) == ")/"


def urls(spark):
    rows = [(i, f"http{'s' * (i % 2)}://{'blog.' * (i % 3 == 0)}site{i % 4}.Example.{['org', 'com', 'net'][i % 3]}{['/es/', '/en/1', '/fr/', '/de/', ''][i % 5]}p{i}?utm={i}#top") for i in range(60)]
    rows += [(100, None), (101, "no scheme"), (102, "http://"), (103, "HTTP://ORG/"), (104, "x://a.org?/q"), (None, "http://b.com/de/"), (5, rows[5][1])]
    return rows, spark.createDataFrame(rows, "page_id long, url string").withColumns({"tokens": F.lit(1), "host": F.lit("h")})


def test_explicit_rules(spark):
    rows, df = urls(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    want = collections.Counter()
    for i, u in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        h, p = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
        best = max(((len(a + b), a + b, v) for v, a, b in URL_RULES if (h == a or h.endswith("." + a)) and p.startswith(b)), default=(0, None, "allow"))
        want[i, h, p, best[1], best[2]] += 1
    out = urlfilter.judge(df, labels, URL_RULES).collect()
    assert collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out) == want
    assert urlfilter.judge(df.limit(0), labels, URL_RULES).count() == 0


def test_mined_rules(spark):
    rows = [(i, f"http://s{i % 5}.net/{'casino' if i % 4 == 0 else 'news'}/{'x' if i % 8 < 4 else 'y'}/{i}") for i in range(80)] + [(90, "http://q.net/casino/z"), (91, "http://q.net/y/new")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(80)] + [(91, None, None)], "doc_id long, quality int, toxic int")
    bad = {r.page_id for r in urlfilter.judge(df, labels, [], 0.05, 0.8, 4).collect() if r.verdict == "block"}
    assert bad == {i for i in range(80) if i % 4 == 0} | {90}
    told = df.join(labels.withColumnRenamed("doc_id", "page_id"), "page_id").select(urlfilter.tokens(F.col("url")).alias("tokens"), (F.col("quality") == 0).alias("bad"))
    kept = urlfilter.mine(told, 0.05, 0.8, 4).collect()
    assert all(r.confidence >= 0.8 and r.support >= 0.05 for r in kept)
    assert ["p:casino"] in [r.antecedent for r in kept] and not any("p:casino" in r.antecedent and len(r.antecedent) > 1 for r in kept)


def test_a_mined_rule_decides_on_the_given_pages(spark):
    """Labels that follow the hosts of the given pages: rules are mined, and agree with counting by hand."""
    given = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    spam = lambda u: re.search("://[^/]*(casino|bets|pills|adult|spam)", u) is not None
    rows = [(r.page_id, r.url) for r in given.collect()]
    told = [(i, int(not spam(u)), 0) for i, u in rows if i % 3 == 0] + [(0, 1, 0)] * 3  # several labels of one page
    labels = spark.createDataFrame(told, "doc_id long, quality int, toxic int")
    out = {r.page_id: r.verdict for r in urlfilter.judge(given, labels, []).collect()}
    assert len(out) == len(rows)
    tokens = {r.page_id: set(r.t) for r in given.select("page_id", urlfilter.tokens(F.col("url")).alias("t")).collect()}
    bad = {i for i, q, _ in told if q == 0}
    known = {i for i, _, _ in told}
    count = collections.Counter(c for i in known for k in (1, 2, 3) for c in itertools.combinations(sorted(tokens[i]), k))
    hits = collections.Counter(c for i in bad for k in (1, 2, 3) for c in itertools.combinations(sorted(tokens[i]), k))
    rules = [set(c) for c, n in hits.items() if n >= max(8, 0.01 * len(known)) and n >= 0.6 * count[c] and n / count[c] >= 1.5 * len(bad) / len(known)]
    assert rules
    assert out == {i: "block" if any(r <= tokens[i] for r in rules) else "allow" for i, _ in rows}
    assert "block" in out.values() and "allow" in out.values()


def test_lists_of_files_are_dealt_to_many_tasks(spark):
    """Adaptive execution must not bring rows that name large files together in one task."""
    df = spark.createDataFrame([(f"archive-{i}", i) for i in range(64)], "archive string, n long")
    task = lambda batches: (b.assign(task=__import__("pyspark").TaskContext.get().partitionId()) for b in batches)
    dealt = df.repartition(max(1, df.count()), "archive").mapInPandas(task, "archive string, n long, task int")
    assert dealt.select("task").distinct().count() >= 8
    plan = idfiles.read_ids(df.selectExpr("archive as path", "n as start"))._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan
