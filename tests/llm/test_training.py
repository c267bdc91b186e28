"""Fill-in-the-middle, whitening and chat formatting, against brute force."""

import collections
import hashlib
import math
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import chat, fillmiddle, queries, whitening

SF = "/root/testdata/sf0.001"


def cut(doc_id, text, seed=7, transformed=100, suffix_first=50):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= transformed:
        return n, "plain", None, None, t
    if h[3] % 100 < suffix_first:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(seed, n=60):
    rng = random.Random(seed)
    odd = [None, "", "\n", "\n\n\n", "one line", "a\nb", "a <P> b\nc", "<\nS>\n<S", "é😀\n \r\nx", "y" * 200_000 + "\nz", "same\ntext\n", "same\ntext\n", "a\x00b\n"]
    return odd + ["".join(rng.choice("ab<SPM>\n😀 \\$") for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_fill_middle(spark):
    rows = list(enumerate(texts(1))) + [(None, "x\ny\nz\n"), (5, "a\nb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"__row": F.lit(1), "u": F.lit("u"), "form": F.lit(2), "output": F.lit("o")})
    for shares in (fillmiddle.Shares(), fillmiddle.Shares(60, 20)):
        made = fillmiddle.transform(docs, shares=shares)
        assert made.columns == [*docs.columns, "fim"]
        out = made.withColumn("back", fillmiddle.restore(F.col("fim.output"), F.col("fim.form"))).collect()
        want = collections.Counter((i, t or "", *cut(i, t, 7, shares.transformed, shares.suffix_first)) for i, t in rows)
        assert collections.Counter((r.doc_id, r.back, *r.fim) for r in out) == want
    assert {x[3] for x in want} == {"plain", "spm", "psm"}
    assert fillmiddle.transform(docs.limit(0)).count() == 0


def test_fill_middle_of_words(spark):
    rows = list(enumerate(texts(2))) + [(100, "mark ⟦m⟧"), (101, "gap+only")]
    docs = spark.createDataFrame(rows, "k long, body string")
    marks = fillmiddle.Sentinels("⟦p⟧", "[suffix]", "⟦m⟧")
    made = fillmiddle.transform(docs, "k", "body", marks, seed=3, units="\\S+\\s*|\\s+")
    back = made.select("k", "body", "fim.form", fillmiddle.restore(F.col("fim.output"), F.col("fim.form"), marks).alias("back")).collect()
    assert all(r.back == (r.body or "") for r in back) and {r.form for r in back} == {"plain", "spm", "psm"}
    assert next(r.form for r in back if r.k == 100) == "plain"
    partial = fillmiddle.transform(docs, "k", "body", units="[a-z]+")  # a pattern that leaves gaps loses nothing
    assert all(r.output == r.body for r in partial.filter("k = 101").select("body", "fim.output").collect())
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("ab", "bc", "x"), ("<P>", "a<P>", "<M>"), ("xax", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fillmiddle.Sentinels(*bad)


def exact(rows):
    """Fit and rows of op12 by integers of any size, and by an eigensolver of its own over the exact covariance."""
    x = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    fitted = sorted({tuple(v) for _, v in x})
    n, d = len(fitted), len(x[0][1])
    sums = [sum(v[k] for v in fitted) for k in range(d)]
    dev = [[n * v[k] - sums[k] for k in range(d)] for v in fitted]
    # entries of n^3 times the covariance are exact before the one division
    cov = np.array([[sum(r[a] * r[b] for r in dev) / n**3 for b in range(d)] for a in range(d)])
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)
    return x, n, sums, values[order], axes[:, order]


def test_whitening(spark, monkeypatch):
    rng = np.random.default_rng(4)
    d = 20
    base = rng.normal(size=(120, d)) @ np.diag(np.linspace(0.05, 4, d)) @ rng.normal(size=(d, d))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(200 + k, rows[3][1]) for k in range(60)] + [(3, rows[3][1])]
    odd = [(300, None), (301, []), (302, [None] * d), (303, [math.nan] * d), (304, [math.inf] + [0.0] * (d - 1)), (305, [0.0] * (d - 1) + [-math.inf])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd] + [(None, rows[5][1], 2)], "vec_id long, embedding array<float>, x int")
    df = df.withColumns({"n": F.lit("n"), "component": F.lit(0.5)})
    monkeypatch.setattr(whitening, "BLOCK", 7)
    out = whitening.whiten(df.repartition(5)).collect()
    x, n, sums, values, axes = exact(rows + [(None, rows[5][1])])
    assert n == 120 and len(out) == 16 * len(x)
    got = collections.defaultdict(dict)
    for r in out:
        assert r.n == n and r.identity_error < 1e-6
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9
        got[r.vec_id, int(r.deviation)].setdefault(r.component, []).append(r.whitened)
    signs = {}
    for i, v in x:
        e = [n * a - s for a, s in zip(v, sums)]
        mine = got[i, sum(a * a for a in e)]
        for k in range(16):
            want = float(np.array([a / n for a in e]) @ axes[:, k] / np.sqrt(values[k]))
            sign = signs.setdefault(k, 1 if abs(mine[k + 1][0] - want) <= abs(mine[k + 1][0] + want) else -1)
            assert all(abs(w * sign - want) < 1e-8 for w in mine[k + 1])


def test_whitening_of_few_and_far_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    empty = whitening.whiten(spark.createDataFrame([], schema))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], schema)).collect()
    assert {(r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained) for r in one} == {(i, k, 1, 0, 0.0, 0.0) for i in (1, 2) for k in (1, 2)}
    # two points on a line: one component with variance; lengths apart
    rows = [(1, [0.0, 0.0, 0.0]), (2, [1.0, 2.0, 2.0]), (3, [4.0]), (4, [5.0])]
    out = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    first = {r.vec_id: r for r in out if r.component == 1}
    assert len(out) == 8 and all(abs(abs(r.whitened) - 1) < 1e-12 and abs(r.explained - 1) < 1e-12 and r.n == 2 and r.identity_error < 1e-12 for r in first.values())
    assert all(r.whitened == 0.0 for r in out if r.component > 1)
    # numbers whose exact deviations pass 64 bits
    far = [(i, [float(i) * 1e9, float(i % 7) * 1e9]) for i in range(200)]
    out = whitening.whiten(spark.createDataFrame(far, schema)).collect()
    x, n, sums, values, axes = exact(far)
    want = {i: sum((n * a - s) ** 2 for a, s in zip(v, sums)) for i, v in x}
    assert all(int(r.deviation) == want[r.vec_id] for r in out) and max(want.values()) > 1 << 63


def folded(log):
    """The messages of a log, event by event."""
    per = collections.defaultdict(dict)
    for conv, message, seq, event, role, text in sorted(set(log), key=lambda e: (str(e[0]), e[2], e[5] or "")):
        held = per[conv]
        m = held.setdefault(message, {"at": seq, "role": None, "text": "", "gone": False})
        if m["role"] is None:
            m["role"] = role
        if event == "delta":
            m["text"] += text or ""
        elif event == "edit":
            m["text"] = text or ""
        elif event == "regenerate":
            m["text"] = ""
            for other in held.values():
                if m["at"] < other["at"] < seq:
                    other["gone"] = True
    # an event of a message that is gone changes nothing that stays
    return {c: [(m["role"] or "", m["text"]) for _, m in sorted(ms.items(), key=lambda x: x[1]["at"]) if not m["gone"]] for c, ms in per.items()}


TEXTS = ["hi", "", None, "## a", "####", "</turn>\n", "\\", "a\\", "</", "<\\/turn>", "### user: x", "é😀", "\\### Assistant: </turn> ok", "line\nline\n", "$0 \\$1"]
ROLES = ["user", "assistant", "system", None, "", "a: b", ":", ": ", "## x: \\", "</turn>\n"]


def test_chat_folds_logs(spark):
    rng = random.Random(5)
    log = []
    for conv in [None, *range(30)]:
        opened = []
        for seq in range(rng.randint(1, 40)):
            kind = rng.choice(["start", "delta", "delta", "delta", "edit", "regenerate", "seen"]) if opened else "start"
            if kind == "start":
                opened.append(len(opened))
            message = opened[-1] if kind == "start" else rng.choice(opened[-3:])
            log.append((conv, message, seq, kind, rng.choice(ROLES) if kind == "start" else None, rng.choice(TEXTS)))
    log += rng.sample(log, 40) + [(99, 0, 1, "delta", "late", "no start"), (98, 0, 1, "start", "user", None), (97, None, 1, "delta", "user", "no name")]
    rng.shuffle(log)
    df = spark.createDataFrame(log, "conversation long, message long, seq long, event string, role string, text string")
    df = df.withColumns({"at": F.lit("x"), "taken": F.lit(True), "cleared": F.lit(1), "conv_id": F.lit(2)}).repartition(6)
    made = chat.format_log(df, ("assistant", "a: b"))
    out = made.withColumns({"turns": chat.read_turns(F.col("formatted")), "loss": chat.read_loss(F.col("formatted"), F.col("mask"))}).collect()
    want = folded(log)
    assert {r.conversation: [tuple(t) for t in r.turns] for r in out} == want
    assert {r.conversation: r.loss for r in out} == {c: [t for role, t in m if role in ("assistant", "a: b")] for c, m in want.items()}
    for r in out:  # the written text has as many turn ends as turns, and nothing between them
        assert r.formatted.count(chat.END) == len(r.turns) and "".join(x + chat.END for x in r.formatted.split(chat.END)[:-1]) == r.formatted
    assert chat.format_log(df.limit(0)).count() == 0


def test_chat_logs_lead_back_to_their_rows(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(ROLES + ["assistant"] * 5), rng.choice(TEXTS + ["long " * rng.randint(1, 200)])) for c in [None, *range(25)] for t in range(rng.randint(1, 30))]
    rows += rows[:10] + [(500, None, "user", "no turn"), (500, 0, "user", "z"), (500, 0, "assistant", "y"), (501, 0, "assistant", "w" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"h": F.lit(1), "copy": F.lit(2), "seq": F.lit("s")})
    log = chat.as_log(df)
    kinds = {r[0] for r in log.select("event").distinct().collect()}
    assert kinds == {"start", "delta", "edit", "regenerate"}
    made = chat.format_log(log)
    out = made.select("conversation", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("mask")).alias("loss")).collect()
    want = collections.defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert {r.conversation: [tuple(t) for t in r.turns] for r in out} == want
    assert {r.conversation: r.loss for r in out} == {c: [t for role, t in m if role == "assistant"] for c, m in want.items()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["op11_fill_middle", "op13_chat"])
def test_query_agrees_with_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert collections.Counter(tuple(r) for r in df.select(*names).collect()) == collections.Counter(found.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_whitening_query_against_exact_sums(spark):
    out = queries.op12_whitening(spark, SF).filter("component in (1, 7, 16)").collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    x, n, sums, values, axes = exact(rows)
    want = {i: v for i, v in x}
    signs = {}
    for r in sorted(out, key=lambda r: r.vec_id):
        e = [n * a - s for a, s in zip(want[r.vec_id], sums)]
        k = r.component - 1
        w = float(np.array(e) / n @ axes[:, k] / np.sqrt(values[k]))
        sign = signs.setdefault(k, math.copysign(1, w * r.whitened))
        assert r.deviation == sum(a * a for a in e) and r.n == n and abs(w * sign - r.whitened) < 1e-7 and r.identity_error < 1e-6
    assert len(out) == 3 * len(x)
