"""Quality rules, line dedup, near-duplicates, decontamination, scores and the pipeline, against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import components, ctw, decontaminate, linededup, nearcopies, quality, simhash, wordhash

ODD = [(200, None), (201, ""), (202, " \n\t "), (None, "no id here"), (203, "x" * 5000), (204, "a b"), (205, "a b"), (205, "a b")]


def frame(spark, rows):
    """The rows, with columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"fp": F.lit(1), "units": F.lit("u"), "n_words": F.lit(3), "id": F.lit(4), "hits": F.lit(None).cast("int")})


def prose(seed, n, words=300):
    rng = random.Random(seed)
    one = lambda: " ".join(f"w{rng.randint(0, words)}" for _ in range(rng.randint(3, 9))).capitalize() + rng.choice(".!?")
    return [(i, "\n".join(" ".join(one() for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 5)))) for i in range(n)]


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_quality_measures(spark):
    rng = random.Random(2)
    rows = prose(1, 30, 40) + ODD + [(300 + i, "".join(rng.choice("ab \n\t#|é!") for _ in range(80))) for i in range(40)]
    want = collections.Counter()
    for i, t in rows:
        w = words_of(t)
        lines = [x for x in (t or "").split("\n") if words_of(x)]
        seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit), failed] += 1
    out = quality.judge(frame(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == want
    assert not any(r.kept for r in out if r.base_failed)


def test_quality_order_does_not_change_verdicts(spark):
    rows = prose(3, 20, 2000) + ODD + [(400, "bad*** " * 40), (401, "LOUD!! " * 5 + " ".join(f"W{i}!!" for i in range(50)))]
    df = frame(spark, rows)
    kept = {r.doc_id for r in quality.filter_quality(df).collect()}
    other = {r.doc_id for r in quality.filter_quality(df, (quality.BASE_RULES + quality.RULES)[::-1]).collect()}
    assert kept == other and 400 not in kept and 401 not in kept and 200 not in kept and len(kept) >= 12
    assert quality.filter_quality(df).columns == df.columns
    assert quality.judge(df.limit(0)).count() == 0


def test_line_dedup_removes_later_runs_only(spark):
    rows = dict(prose(4, 40, 5000))
    rng = random.Random(9)
    passage = " ".join(" ".join(f"p{rng.randint(0, 999)}" for _ in range(7)) + "." for _ in range(9))
    flat = " ".join(f"q{rng.randint(0, 9999)}" for _ in range(120))
    for i in (5, 9, 30):
        rows[i] = f"{rows[i][:20]} {passage} {rows[i][20:]}"
    for i in (7, 33):
        rows[i] = f"{rows[i][:15]} {flat} {rows[i][15:]}"
    rows[11] = "\n".join(["One line of more than ten words stands here again and again and again."] * 4)
    rows[40] = rows[3]
    df = frame(spark, [*rows.items(), *ODD])
    out = linededup.dedup_lines(df)
    assert out.columns == df.columns
    got = out.collect()
    assert len(got) == len(rows) + len(ODD)
    text = {r.doc_id: r.text for r in got}
    assert passage in text[5] and text[9] == rows[9].replace(passage + " ", "") and text[30] == rows[30].replace(passage + " ", "")
    assert flat in text[7] and text[33] == rows[33].replace(flat + " ", "")
    assert text[40] == "" and text[11].count("One line") == 1 and text[200] is None and text[202] == " \n\t "
    same = {i for i in rows if text[i] == rows[i]}
    assert same == set(rows) - {9, 11, 30, 33, 40}
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def hashed(*texts):
    block = wordhash.Texts(pa.array(texts, pa.string()))
    return block, linededup.fingerprints(block)


def test_words_are_hashed_alike_anywhere():
    rng = random.Random(71)
    texts = ["", None, " \n ", "x" * 9000 + " y", *("".join(rng.choice("ab\t \n.é\u2003\x1fABCDEFGHIJKLMNOP") for _ in range(rng.randint(0, 300))) for _ in range(60))]
    block = wordhash.Texts(pa.array(texts, pa.string()))
    hashes, seen = block.hashes(), {}
    lines = set(block.lines().tolist())
    for i, t in enumerate(texts):
        a, b = block.first[i], block.first[i + 1]
        own = words_of(t)
        data = block.data.tobytes()
        assert [data[x:y].decode() for x, y in zip(block.starts[a:b], block.ends[a:b])] == own
        for w, h in zip(own, hashes[a:b].tolist()):
            assert seen.setdefault(w, h) == h
        at, firsts = a, set()
        for line in (t or "").split("\n"):
            if words_of(line):
                firsts.add(at)
            at += len(words_of(line))
        assert {x for x in lines if a <= x < b} == firsts
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("stops", [0, 0.1, 0.4])
def test_runs_of_50_words_share_a_fingerprint(stops):
    rng = random.Random(51)
    for vocabulary in (1, 2, 3, 40, 5000):
        for _ in range(60):
            word = lambda p: f"{p}{rng.randint(1, vocabulary)}" + "." * (rng.random() < stops)
            passage = " ".join(word("p") for _ in range(50))
            a, b = (" ".join([*(word(h) for _ in range(rng.randint(0, 60))), passage, *(word(h) for _ in range(30))]) for h in "ab")
            _, (fp, text, _, size) = hashed(a, b)
            grams = [set(fp[(text == i) & (size > 0)].tolist()) for i in (0, 1)]
            assert grams[0] & grams[1]


def test_fingerprints_do_not_depend_on_the_block(monkeypatch):
    rng = random.Random(72)
    texts = [" ".join(f"w{rng.randint(0, v)}" for _ in range(n)) for v, n in ((9, 400), (2, 26), (500, 3000), (0, 700), (40, 25), (40, 60))]
    _, (fp, text, pos, size) = hashed(*texts)
    whole = sorted(zip(text.tolist(), fp.tolist(), pos.tolist(), size.tolist()))
    alone = sorted((i, *x) for i, t in enumerate(texts) for x in zip(*(v.tolist() for v in (lambda f: (f[0], f[2], f[3]))(hashed(t)[1]))))
    assert whole == alone
    monkeypatch.setattr(linededup, "PLACE_BITS", 9)
    _, parts = hashed(*texts)
    assert np.diff(np.unique(parts[2][(parts[1] == 2) & (parts[3] > 0)])).max() <= linededup.WINDOW


def brute_matches(texts):
    """Of each text, ranges of words that an earlier place holds: runs (with the words before and after) and whole lines."""
    words = [words_of(t) for t in texts]
    out = [[] for _ in texts]
    for j, own in enumerate(words):
        for i in range(j + 1):
            other = words[i]
            for shift in range(-len(own) + 1, len(other)):
                if i == j and shift >= 0:
                    continue
                k = max(0, -shift)
                stop = min(len(own), len(other) - shift)
                while k < stop:
                    e = k
                    while e < stop and own[e] == other[e + shift]:
                        e += 1
                    if e - k >= 26:
                        out[j].append((k, e))
                    k = max(e, k) + 1
    seen = set()
    for j, t in enumerate(texts):
        at = 0
        for line in (t or "").split("\n"):
            w = tuple(words_of(line))
            if len(w) >= 3:
                if w in seen:
                    out[j].append((at, at + len(w)))
                seen.add(w)
            at += len(w)
    return words, out


@pytest.mark.parametrize("seed", range(2))
def test_line_dedup_against_all_pairs_of_runs(spark, seed):
    """Nothing goes that no earlier place holds; of each run of 50 words all goes, but for less than a window at ends that an earlier fragment shares."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    passages = [fresh(rng.randint(50, 160)) for _ in range(6)]
    texts = []
    if seed:  # early fragments of the passages, alone among other words
        for p in passages:
            a = rng.randint(0, len(p) - 30)
            texts.append(" ".join([*fresh(20), *p[a : a + rng.randint(5, 30)], *fresh(20)]))
    for _ in range(24):
        parts = [x for _ in range(rng.randint(1, 3)) for x in (fresh(rng.randint(0, 40)), rng.choice(passages) if rng.random() < 0.7 else fresh(9))]
        texts.append("".join(w + rng.choice([" ", " ", " ", "\n", "  "]) for part in parts for w in part))
    texts += [" ".join(f"t{k % 7}" for k in range(200)), "again and again " * 60, texts[3] + " more", "one short line\nother words\none short line"]
    words, held = brute_matches(texts)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    told = rows.select(F.xxhash64("text").alias("k1"), F.hash("text").alias("k2"), "id", "text")
    runs = {r.id: r.runs for r in linededup.repeated_runs(told).collect()}
    gone_all, runs_all = 0, 0
    for j, t in enumerate(texts):
        block = wordhash.Texts(pa.array([t]))
        found = [(r.a, r.b, r.side, r.around) for r in runs.get(j, [])]
        gone = {k for a, b in linededup.extended(found, block.hashes().astype(np.uint32).view(np.int32)) for k in range(a, b)}
        assert gone <= {k for a, b in held[j] for k in range(a, b)}
        for a, b in held[j]:
            if b - a >= 50:
                # Text of a short period repeats itself: its own first fingerprint stays whole.
                slack = 0 if not seed and j < len(texts) - 4 else 35 if j in (len(texts) - 4, len(texts) - 3) else linededup.WINDOW - 1
                assert set(range(a + slack, b - slack)) <= gone
                runs_all, gone_all = runs_all + b - a, gone_all + len(gone & set(range(a, b)))
    assert gone_all >= 0.97 * runs_all
    out = {r.doc_id: r.text for r in linededup.dedup_lines(frame(spark, list(enumerate(texts)))).collect()}
    assert out[len(texts) - 1] == "one short line\nother words\n"


def test_a_run_to_the_end_of_a_line_leaves_the_line_end(spark):
    run = " ".join(f"r{k}" for k in range(60))
    rows = [(1, run), (2, f"before {run}\nafter"), (3, f"before\n{run}\nafter"), (4, f"x y z before {run} after")]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {1: run, 2: "before\nafter", 3: "before\nafter", 4: "x y z before after"}


def test_columns_with_the_names_of_helpers_pass_through(spark):
    names = ["k1", "k2", "id", "row", "cut", "least", "runs", "fp", "pos", "__id", "__th", "__n"]
    line = "the same line of words " * 12
    df = spark.createDataFrame([(i, line, *[f"{n}{i}" for n in names]) for i in range(3)], ["doc_id", "text", *names])
    for out in (linededup.dedup_lines(df), simhash.drop_near_duplicates(df), decontaminate.drop_contaminated(df, bench(spark, [(1, "none of it")]))):
        assert out.columns == df.columns
        for r in out.collect():
            assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names]


def test_passages_of_51_words_go(spark):
    rng = random.Random(52)
    text = lambda p, n: " ".join(f"{p}{rng.randint(0, 9999)}" for _ in range(n))
    passages = [text("p", 51) for _ in range(40)]
    rows = [(i, f"{text('h', 30)} {passages[i % 40]} {text('h', 30)}") for i in range(80)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(frame(spark, rows)).collect()}
    assert all(got[i] == rows[i][1] for i in range(40))
    for i in range(40, 80):
        assert got[i] == rows[i][1].replace(passages[i % 40] + " ", "")


def bits(t):
    w = (t or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    votes = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if shingles and 2 * votes[b] > len(shingles))


def groups(values, tau):
    """Least index of each value's component, by comparing all pairs."""
    root = list(range(len(values)))
    for j in range(len(values)):
        for i in range(j):
            if bin(values[i] ^ values[j]).count("1") <= tau:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def near_rows():
    rng = random.Random(3)
    rows = prose(6, 25, 900)
    for k in range(25):
        w = rows[k % 5][1].split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows.append((100 + k, " ".join(w)))
    return rows + [(300, rows[2][1]), (301, rows[2][1])] + [(400 + k, "tiny text") for k in range(5)] + ODD


def test_simhash_components(spark):
    rows = near_rows()
    fps = [bits(t) for _, t in rows]
    out = simhash.near_duplicates(frame(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.fp % (1 << 64)) for r in out) == collections.Counter((i, f) for (i, _), f in zip(rows, fps))
    root, least = groups(fps, 2), {}
    for (i, _), r in zip(rows, root):
        least[r] = i if least.get(r) is None else min(least[r], i if i is not None else least[r])
    want = collections.Counter((i, least[r]) for (i, _), r in zip(rows, root))
    assert collections.Counter((r.doc_id, r.component_id) for r in out) == want


@pytest.mark.parametrize("group", [1, 3, 64])
@pytest.mark.parametrize("tau", [1, 2])
def test_links_join_the_same_components(spark, tau, group):
    rng = random.Random(tau)
    values = {rng.getrandbits(64) for _ in range(30)}
    for v in list(values):
        for _ in range(rng.randint(0, 6)):
            v ^= 1 << rng.randrange(64) | (1 << rng.randrange(64) if rng.random() < 0.5 else 0)
            values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r.node: r.root for r in components.components(simhash.link(fps, tau, group)).collect()}
    got = collections.defaultdict(set)
    for v in signed:
        got[found.get(v, v)].add(v)
    want = collections.defaultdict(set)
    for v, r in zip(signed, groups(values, tau)):
        want[r].add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_thresholds_follow_the_principle():
    both = np.diag(np.full(64, 50)) + 25 * (1 - np.eye(64, dtype=int))
    sample = np.random.default_rng(5).integers(0, 1 << 63, 300).astype(np.uint64)
    for m in (2, 3):
        parts = simhash.group_bits(both, 100, m)
        assert sorted(b for p in parts for b in p) == list(range(64))
        for tau in (2, 3, 4, 5, 6, 7, 8):
            found = simhash.allot(100, parts, sample, tau)
            assert (found is None) == (tau - m + 1 > 2 * m)
            assert found is None or (sum(found[1]) == tau - m + 1 and max(found[1]) <= 2)


def test_correlated_bits_share_a_part():
    both = np.full((64, 64), 25)
    np.fill_diagonal(both, 50)
    both[3, 40] = both[40, 3] = 50
    assert any({3, 40} <= set(p) for p in simhash.group_bits(both, 100, 3))


def test_one_of_each_group_stays(spark):
    rows = near_rows()
    df = frame(spark, rows)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    got = [r.doc_id for r in kept.collect()]
    root = groups([bits(t) for _, t in rows], 2)
    assert len(got) == len(set(root))
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(x for x in (least.get(r), i, 10**9) if x is not None)
    assert sorted(x for x in got if x is not None) == sorted(v for v in least.values() if v < 10**9)
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_unrelated_documents_without_ids_stay(spark):
    (_, a), (_, b) = prose(31, 2, 5000)
    rows = [(None, a), (None, b), (None, b), (1, prose(32, 1, 5000)[0][1])]
    kept = simhash.drop_near_duplicates(frame(spark, rows)).collect()
    assert sorted(r.text for r in kept) == sorted({t for _, t in rows})


def changed(rng, text, edits):
    words = text.split()
    for k in rng.sample(range(len(words)), edits):
        words[k] = f"c{rng.randint(0, 10**6)}"
    return " ".join(words)


def similar_groups(texts):
    """The component of each text, by brute force over five-word shingles."""
    sets = []
    for t in texts:
        w = [x.lower() for x in words_of(t)]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or x & sets[j] and 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("group", [2, 64])
def test_near_copies_of_changed_words_go(spark, group):
    rng = random.Random(80)
    boiler = " ".join(f"b{k}" for k in range(60))
    texts = []
    for i in range(24):
        own = " ".join(f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(40, 200)))
        base = f"{own} {boiler}" if i % 2 else own
        texts += [base, *(changed(rng, base, e) for e in (1, 2, 3, 4, 6, 9))]
    texts += [changed(rng, boiler, e) for e in (1, 1, 1, 1, 1, 2, 2, 2)]
    rows = [*enumerate(texts), *[(1000 + (i or 0), t) for i, t in ODD], (None, texts[0]), (None, None), (None, "apart from all the others stands this")]
    root = similar_groups([t for _, t in rows])
    assert len(set(root)) < len(rows) - 40
    df = frame(spark, rows)
    kept = nearcopies.drop_near_copies(df, group=group)
    assert kept.columns == df.columns
    told = collections.defaultdict(set)
    for (i, t), r in zip(rows, root):
        told[i, t].add(r)
    kept_rows = [(r.doc_id, r.text) for r in kept.collect()]
    groups_kept = collections.Counter(r for x in kept_rows for r in told[x])
    assert set(groups_kept) == set(root)  # of each group one stays
    spare = len(rows) - len(set(root))
    assert len(rows) - len(kept_rows) >= 0.9 * spare  # of the others nine in ten go at least
    assert nearcopies.drop_near_copies(df.limit(0)).count() == 0


def test_shingle_sets_and_fingerprints(monkeypatch):
    texts = [None, "", "a B", "A b", "One two THREE four five six", "one two three four five SIX", "x " * 40, *(t for _, t in prose(83, 10))]
    found = list(nearcopies.shingles(wordhash.Texts(pa.array(texts), fold=True)))
    want = []
    for t in texts:
        w = [x.lower() for x in words_of(t)]
        want.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    assert [len(x) for x in found] == [len(x) for x in want]
    assert all((set(found[i].tolist()) == set(found[j].tolist())) == (want[i] == want[j]) for i in range(len(texts)) for j in range(i))
    words = wordhash.Texts(pa.array(texts)).hashes()
    whole = nearcopies.fingerprint(words)
    monkeypatch.setattr(nearcopies, "BLOCK", 3)
    kinds = set(words.tolist())
    assert whole == nearcopies.fingerprint(words)
    assert whole % (1 << 64) == sum(1 << b for b in range(64) if 2 * sum(k >> b & 1 for k in kinds) > len(kinds))


def test_clean_prose_stays(spark):
    df = frame(spark, [(i, t) for i, t in prose(84, 300, 40)])
    assert nearcopies.drop_near_copies(df).count() == len({t for _, t in prose(84, 300, 40)})


def test_pipeline_drops_near_copies(spark):
    import corpus_pipeline

    rng = random.Random(81)
    base = " ".join(f"w{rng.randint(0, 5000)}" for _ in range(300))
    df = frame(spark, [(1, base), *((i, changed(rng, base, 5)) for i in range(2, 22))])
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    assert 1 in kept and len(kept) <= 3  # recall of 0.9


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").withColumn("hits", F.lit(1))


def test_decontamination(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", 600)
    rows = prose(7, 40, 60)
    long = " ".join(rows[3][1].split()[:25])
    items = [(1, long.upper()), (2, "Hay-stack needle"), (3, None), (4, "!!"), (5, "nowhere to be found at all in any of these texts here"), (6, long), (10, "w1")]
    rows += [(50, f"see {long} there"), (51, "a hay stack; NEEDLE é"), *ODD]
    size, bad = 10, 0
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    windows = collections.defaultdict(set)
    for i, t in items:
        w = word(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])].add(str(i))
    want = collections.Counter()
    for i, t in rows:
        w, hit, found = word(t), set(), set()
        for x, its in windows.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    found |= its
        bad += bool(hit)
        want[i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    df = frame(spark, rows)
    for block in (1 << 23, 10):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
        out = decontaminate.report(df, bench(spark, items)).collect()
        assert collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out) == want
    kept = decontaminate.drop_contaminated(df, bench(spark, items))
    assert kept.count() == len(rows) - bad and kept.columns == df.columns
    assert decontaminate.report(df.limit(0), bench(spark, items)).count() == 0
    assert decontaminate.report(df, bench(spark, items[:0])).filter("contaminated").count() == 0


def test_proximity_matches(spark):
    rows = [(1, "alpha one two beta three gamma"), (2, "gamma alpha beta"), (3, "alpha " + "x " * 9 + "beta gamma"), (4, "alpha beta")]
    df = frame(spark, rows)
    index = decontaminate.build_index(df)
    found = decontaminate.search(index, bench(spark, [(1, "alpha beta gamma")]), slop=3)
    hit = decontaminate.documents(index).join(found, ["segment", "doc"], "left_semi")
    assert sorted(r.doc_id for r in hit.collect()) == [1, 2]


def brute_tree(train, depth):
    n, kids, memo = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set), {}
    for t in train:
        b = b"\0" * depth + t + b"\0"
        for i in range(depth, len(b)):
            for d in range(depth + 1):
                for k in range(8):
                    node = (b[i - d : i], k, b[i] >> (8 - k))
                    n[node][b[i] >> (7 - k) & 1] += 1
                    if d:
                        kids[node[0][1:], k, node[2]].add(node)

    def weight(node):
        if node not in memo:
            a, b = n[node]
            kt = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
            if len(node[0]) == depth:
                memo[node] = (kt, 1.0)
            else:
                both = math.log(0.5) + np.logaddexp(kt, sum(weight(x)[0] for x in kids[node]))
                memo[node] = (both, math.exp(kt + math.log(0.5) - both))
        return memo[node]

    def log10(context, x):
        total = 0.0
        for k in range(8):
            bit = x >> (7 - k) & 1

            def p(d):
                node = (context[len(context) - d :], k, x >> (8 - k))
                a = n.get(node, [0, 0])
                own = (a[bit] + 0.5) / (sum(a) + 1)
                if d < depth and (context[len(context) - d - 1 :], k, x >> (8 - k)) in n:
                    w = round(255 * weight(node)[1]) / 255
                    return w * own + (1 - w) * p(d + 1)
                return own

            total += math.log10(p(0))
        return total

    return log10


def test_context_tree_scores(spark):
    depth = 3
    rows = [(i, ["abra cadabra", "the cat the hat", "", "aé zz\tq", "cat hat abra"][i % 5] + "x" * (i % 3)) for i in range(40)]
    rows += [(41, None), (None, "the hat"), (42, "unseen Words"), (42, "unseen Words")]
    out = ctw.train_and_score(frame(spark, rows), depth=depth, top_words=3).collect()
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 1
    train = [(t or "").encode().lower() for i, t in rows if not held(i)]
    lp, count, text = brute_tree(train, depth), collections.Counter(), dict(rows)
    for t in train:
        count.update([*t.split(), b""])
    total, kinds = sum(count.values()), len(count)
    assert len(out) == len(rows)
    for r in out:
        t = (text[r.doc_id] or "").encode().lower()
        b, tokens = b"\0" * depth + t + b"\0", [*t.split(), b""]
        assert math.isclose(r.score, sum(lp(b[i - depth : i], b[i]) for i in range(depth, len(b))), rel_tol=1e-9)
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in tokens), rel_tol=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tokens), sum(count[x] > 0 for x in tokens), total, held(r.doc_id))
    assert ctw.train_and_score(frame(spark, rows).limit(0)).count() == 0


def test_context_tree_scores_do_not_depend_on_what_workers_hold(spark, monkeypatch):
    depth = 4
    rows = [(i, ["abra cadabra", "the cat the hat", "aé zz\tq", "cat hat abra banana"][i % 4] + "xyz" * (i % 3)) for i in range(40)]
    rows += [(41, None), (42, "never seen before"), (42, "never seen before"), (43, "the hat " * 50)]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    lp = brute_tree([(t or "").encode() for i, t in rows if not held(i)], depth)
    monkeypatch.setattr(ctw, "ROWS", 16)  # many groups of contexts
    for max_grams in (0, 20, 1 << 22):
        out = ctw.train_and_score(frame(spark, rows), depth=depth, max_grams=max_grams).collect()
        assert sorted(r.doc_id for r in out) == sorted(i for i, _ in rows)
        for r in out:
            b = b"\0" * depth + (dict(rows)[r.doc_id] or "").encode() + b"\0"
            assert math.isclose(r.score, sum(lp(b[i - depth : i], b[i]) for i in range(depth, len(b))), rel_tol=1e-9)
            assert math.isclose(r.bits_per_byte, -r.score / math.log10(2) / (len(b) - depth), rel_tol=1e-9)


def test_grams_are_looked_up_once_a_block(spark, monkeypatch):
    depth, rows = 6, [(i, "the cat sat on the mat " * (i % 5 + 1)) for i in range(700)]
    model = ctw.train(spark.createDataFrame(rows, "doc_id long, text string"), depth=depth, max_grams=10)
    looked, look = [], ctw._look
    monkeypatch.setattr(ctw, "_look", lambda keys, wanted: looked.append(len(wanted)) or look(keys, wanted))
    monkeypatch.setattr(ctw, "BLOCK", 30000)
    batch = pd.DataFrame({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows], "held_out": False})
    found = pd.concat(ctw._score(model["folders"], depth)(iter([batch])))
    grams = [np.concatenate(list(ctw._grams(t.encode(), depth))) for _, t in rows]
    words, blocks = sum(len(t.split()) + 1 for _, t in rows), len(looked) - len(rows)
    assert blocks > 1 and sum(looked) - words <= blocks * len(np.unique(np.concatenate(grams)))
    tree = ctw._held("tree", model["folders"]["tree"], depth)
    rest, scores = found[found["gram"].notna()], found[found["gram"].isna()].set_index("i")["score"].astype(float)
    assert len(rest)
    more = (rest["k"].astype(float) * tree.log10(rest["gram"].to_numpy(np.uint64))).groupby(rest["i"]).sum()
    for i, g in enumerate(grams):
        assert math.isclose(scores[i] + more.get(i, 0.0), tree.log10(g).sum(), rel_tol=1e-9)


def test_context_tree_without_training(spark):
    rows = [(i, "zz") for i in range(20) if zlib.crc32(str(i).encode()) % 5 == 1]
    for r in ctw.train_and_score(frame(spark, rows), depth=2).collect():
        assert r.held_out and r.n_known == r.train_tokens == 0
        assert math.isclose(r.score, 3 * 8 * math.log10(0.5), rel_tol=1e-12)


def test_tree_predictions_add_up(spark):
    rows = [(i, f"banana bandana {i % 7}") for i in range(30)]
    model = ctw.train(spark.createDataFrame(rows, "doc_id long, text string"), depth=2, max_grams=20)
    tree = ctw._held("tree", model["folders"]["tree"], 2)
    for context in (b"an", b"zz", b"\0\0"):
        grams = np.array([int.from_bytes(context + bytes([x]), "big") for x in range(256)], np.uint64)
        assert math.isclose((10 ** tree.log10(grams)).sum(), 1.0, rel_tol=1e-9)


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7.9, 8, 100.5, 1e6])
    assert np.allclose(ctw._log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-10)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from plumbline.llm.common import materialize

    rows = prose(8, 60, 4000)
    rows = [(i, t + " " + " ".join(f"v{i}x{k}" for k in range(20)) + ".") for i, t in rows]
    rows[10] = (10, "JUNK!! " * 30)
    rows[20] = (20, rows[4][1] + " One more word.")
    leak = " ".join(rows[30][1].split()[:15])
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows] + [(None, None, None, None, None)], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != names[-1]:
            assert docs.columns == before.columns
    assert 10 not in seen["quality_rules"] and None not in seen["quality_rules"] and len(seen["quality_rules"]) >= 58
    assert seen["line_dedup"] == seen["quality_rules"]
    assert 30 not in seen["decontamination"] and 29 in seen["decontamination"]
    assert seen["best_fit_packing"] == seen["decontamination"]
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in run.collect()} == seen["best_fit_packing"]
