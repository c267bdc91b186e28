"""Repeated runs of lines, found by winnowing and deleted where they come again.

Every line of LINE_WORDS to GRAM + WINDOW words is hashed, and its hash is a fingerprint. Longer
stretches are read as lines of GRAM words that begin at every word, since texts may hold
thousands of words on one line and passages may begin in the midst of it: of the hashes of
every WINDOW consecutive ones the least is a fingerprint. That guarantees one to every run of
GRAM + WINDOW - 1 = 50 words, whatever surrounds it; and as fingerprints lie at most
WINDOW < GRAM words apart, those of a run cover it without gaps but for its ends.

Fingerprints are joined by hash to their first place in the order of (doc_id, text hash,
position), never among themselves. The places of one text are merged into runs, and each run
is extended both ways, word by word, along the first places of its outermost fingerprints,
by up to WINDOW - 1 words: no run reaches farther beyond its last fingerprint. First
places stay. Where the first holder of an outermost fingerprint goes on otherwise than a later holder,
up to WINDOW - 1 words at that end of a run can stay.

A run that begins in the midst of a line and ends with it leaves the line's end standing.

Defined cases: null texts stay null; texts without words are left as they are; a text that equals an
earlier one becomes empty if it has LINE_WORDS words or more; repeats within one text go, too; rows that
agree in doc_id and text are one document, and get the same text; null doc_ids come first in the
order; lines of fewer than LINE_WORDS words go only within longer runs; an empty table
gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plumbline.llm.common import SPACES, materialize, release
from plumbline.llm.wordhash import Texts, slices, span_hashes, sums, text_blocks

GRAM, WINDOW = 26, 25
LINE_WORDS = 3
#: Stands for a null doc_id, which comes first.
NO_ID = -(1 << 63)
#: Low bits of a hash that give way to its position when the least is sought.
PLACE_BITS = 24

#: Lines have negative len.
PLACES = "fp long, k1 long, k2 int, id long, pos int, len int"
RUNS = "k1 long, k2 int, id long, a int, b int, l1 long, l2 int, lid long, lat int, r1 long, r2 int, rid long, rat int"
CONTEXTS = "k1 long, k2 int, id long, at int, side int, around array<int>"


def _least(grams: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """The positions of the least of WINDOW hashes from each of windows on, the last of equal ones."""
    low = np.uint64((1 << PLACE_BITS) - 1)
    ranked = np.concatenate([(grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64)), np.full(WINDOW, ~np.uint64(0))])
    width = 1
    while 2 * width <= WINDOW:
        ranked = np.minimum(ranked[:-width], ranked[width:])
        width *= 2
    found = np.minimum(ranked[windows], ranked[windows + WINDOW - width])
    return np.unique((low - (found & low)).astype(np.int64))


def _thinned(at: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Positions without most of those that repeat the one just before: in text of a short period nearly all would be chosen."""
    near = WINDOW // 2
    same = np.zeros(len(at), bool)
    same[1:] = (grams[at[1:]] == grams[at[:-1]]) & (np.diff(at) <= near)
    if not same.any():
        return at
    group = np.cumsum(~same) - 1
    step = (at - at[~same][group]) // near
    keep = ~same
    keep[1:] |= step[1:] != step[:-1]
    keep[:-1] |= ~same[1:]
    keep[-1] = True
    return at[keep]


def fingerprints(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first word in the text, words, negative for lines) of every fingerprint of the texts."""
    running = sums(texts.hashes())
    counts = np.diff(texts.first)
    grams_of = np.maximum(counts - GRAM + 1, 0)
    chosen = np.zeros(0, np.int64)
    if grams_of.any():
        begin = np.arange(len(running) - GRAM)
        grams = span_hashes(running, begin, begin + GRAM, 1)
        # Grams that would run on into the next text are greater than all others.
        inside = np.zeros(len(running), np.int32)
        np.add.at(inside, texts.first[:-1], 1)
        np.add.at(inside, texts.first[:-1] + grams_of, -1)
        grams[np.cumsum(inside)[: len(grams)] == 0] = ~np.uint64(0)
        windows_of = np.where(grams_of > 0, np.maximum(grams_of - WINDOW + 1, 1), 0)
        windows = np.repeat(texts.first[:-1] - np.cumsum(windows_of) + windows_of, windows_of) + np.arange(windows_of.sum())
        parts, step = [], (1 << PLACE_BITS) - 2 * WINDOW
        for a in range(0, len(grams), step):  # positions of a part fit into PLACE_BITS
            own = windows[(windows >= a) & (windows < a + step)] - a
            if len(own):
                parts.append(_least(grams[a : a + step + WINDOW], own) + a)
        chosen = _thinned(np.unique(np.concatenate(parts)), grams)
    lines = texts.lines()
    stops = np.append(lines[1:], len(running) - 1)
    kept = (stops - lines >= LINE_WORDS) & (stops - lines < GRAM + WINDOW)
    lines, stops = lines[kept], stops[kept]
    at = np.concatenate([chosen, lines])
    text = np.searchsorted(texts.first, at, side="right") - 1
    hashes = [grams[chosen] if len(chosen) else np.zeros(0, np.uint64), span_hashes(running, lines, stops, 2)]
    size = np.concatenate([np.full(len(chosen), GRAM), lines - stops])
    return np.concatenate(hashes).view(np.int64), text, at - texts.first[text], size


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["fp", "k1", "k2", "id", "pos", "len"]
    for batch in batches:
        for part, texts in text_blocks(batch):
            fp, text, pos, size = fingerprints(texts)
            own = [part.column(c).take(pa.array(text)) for c in ("k1", "k2", "id")]
            yield pa.RecordBatch.from_arrays([pa.array(fp), *own, pa.array(pos.astype(np.int32)), pa.array(size.astype(np.int32))], names)


def merged(places: list[tuple]) -> list[tuple]:
    """(a, b, place at a, place at b): the ranges of words that places (pos, len, ...) cover. Lines are apart, and have no place: only runs are extended."""
    runs: list[list] = []
    for p in sorted(x for x in places if x[1] > 0):
        b = p[0] + p[1]
        if not runs or p[0] > runs[-1][1]:
            runs.append([p[0], b, p, p])
        else:
            runs[-1][1], runs[-1][3] = b, p
    out, begins = [*map(tuple, runs)], [r[0] for r in runs]
    for p in places:
        if p[1] < 0:
            i, b = bisect_right(begins, p[0]) - 1, p[0] - p[1]
            if i < 0 or b > runs[i][1]:
                out.append((p[0], b, None, None))
    return out


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in RUNS.split(", ")]
    for batch in batches:
        rows = []
        for k1, k2, own, places in zip(batch["k1"], batch["k2"], batch["id"], batch["places"]):
            found = [(p["pos"], p["len"], p["f1"], p["f2"], p["fid"], p["fpos"]) for p in places]
            for a, b, left, right in merged(found):
                ends = [*((*left[2:5], left[5]) if left and a else (None,) * 4), *((*right[2:5], right[5] + GRAM) if right else (None,) * 4)]
                rows.append((k1, k2, own, a, b, *ends))
        # Each column by itself: nulls among 64-bit numbers must not make them floats.
        yield pd.DataFrame({n: pd.array(c, "Int64") for n, c in zip(names, list(zip(*rows)) or [()] * len(names))})


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words next to places: those before `at`, the nearest first, or those from it on, as 32-bit hashes."""
    names = ["k1", "k2", "id", "at", "side", "around"]
    for batch in batches:
        for part, texts in text_blocks(batch):
            hashes = texts.hashes().astype(np.uint32).view(np.int32)
            rows = []
            for i, (k1, k2, own, wanted) in enumerate(zip(*(part.column(c).to_pylist() for c in ("k1", "k2", "id", "wanted")))):
                words = hashes[texts.first[i] : texts.first[i + 1]]
                for w in wanted:
                    at = w["at"]
                    around = words[at : at + WINDOW - 1] if w["side"] else words[max(0, at - WINDOW + 1) : at][::-1]
                    rows.append((k1, k2, own, at, w["side"], around))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def _common(own: np.ndarray, theirs: np.ndarray) -> int:
    n = min(len(own), len(theirs))
    other = np.flatnonzero(own[:n] != theirs[:n])
    return int(other[0]) if len(other) else n


def extended(found: list[tuple], hashes: np.ndarray) -> list[tuple[int, int]]:
    """Runs as disjoint ranges of words in order, extended as far as the words agree.

    found has (a, b, side, around): the runs themselves at side -1, the words before the first place of their beginning at 0, after that of their end at 1."""
    runs = {(a, b): [a, b] for a, b, side, _ in found if side < 0}
    for a, b, side, around in found:
        if side == 0:
            runs[a, b][0] -= _common(hashes[max(0, a - WINDOW + 1) : a][::-1], np.asarray(around, np.int32))
        elif side == 1:
            runs[a, b][1] += _common(hashes[b : b + WINDOW - 1], np.asarray(around, np.int32))
    out: list[list[int]] = []
    for a, b in sorted(runs.values()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def delete(data: bytes, starts: np.ndarray, ends: np.ndarray, ranges: list[tuple[int, int]]) -> bytes:
    """The text without ranges of its words, each with the blanks after it, or before it where a line's end comes after it alone."""
    kept, at = [], 0
    for a, b in ranges:
        begin, end = (int(starts[a]) if a else 0), (int(starts[b]) if b < len(starts) else len(data))
        if a and b < len(starts):
            before, after = data[ends[a - 1] : starts[a]], data[ends[b - 1] : starts[b]]
            if b"\n" in after and b"\n" not in before:
                begin, end = int(ends[a - 1]), int(ends[b - 1])
        kept.append(data[at:begin])
        at = max(at, end)
    return b"".join([*kept, data[at:]])


def _cut(texts: pd.Series, runs: pd.Series) -> pd.Series:
    out = np.full(len(texts), None, object)
    held = np.flatnonzero(texts.notna().to_numpy())
    column = pa.array(texts.iloc[held], pa.string()) if len(held) else None
    sizes = pa.compute.binary_length(column).to_numpy() if len(held) else np.zeros(0)
    for a, b in slices(sizes):
        block = Texts(column.slice(a, b - a))
        hashes = block.hashes().astype(np.uint32).view(np.int32)
        for j in range(b - a):
            w, at = slice(block.first[j], block.first[j + 1]), block.offsets[j]
            found = [(r["a"], r["b"], r["side"], r["around"]) for r in runs.iloc[held[a + j]]]
            data = block.data[at : block.offsets[j + 1]].tobytes()
            out[held[a + j]] = delete(data, block.starts[w] - at, block.ends[w] - at, extended(found, hashes[w])).decode("utf-8", "surrogatepass")
    return pd.Series(out, dtype=object)


def repeated_places(places: DataFrame) -> DataFrame:
    """(k1, k2, id, places): of each text, its fingerprints that have an earlier place, with that place.

    What the shuffles bring together by fingerprint are least ids and hashes, added up before;
    places themselves are only joined with them, and Spark splits such joins where one fingerprint is hot."""
    here = F.xxhash64("k1", "k2", "pos")
    seen = places.select("fp", "id", here.alias("h")).groupBy("fp")
    least = seen.agg(F.min("id").alias("first_id"), F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo != hi").select("fp", "first_id")
    least = materialize(least, "least")  # a join with an aggregate as such would not be split
    own = (F.col("id") == F.col("first_id")).alias("own")
    repeated = materialize(places.join(least, "fp").select("fp", "k1", "k2", "id", "pos", "len", own), "repeated")
    release(places.sparkSession)
    place = F.min(F.struct("id", "k1", "k2", "pos"))
    first = repeated.filter("own").groupBy("fp").agg(place.alias("p"))
    first = materialize(first, "first-places")
    first = first.select("fp", F.col("p.k1").alias("f1"), F.col("p.k2").alias("f2"), F.col("p.id").alias("fid"), F.col("p.pos").alias("fpos"))
    later = repeated.join(first, "fp").filter("NOT (k1 = f1 AND k2 = f2 AND pos = fpos)")
    each = F.struct("pos", "len", "f1", "f2", "fid", "fpos")
    return later.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.collect_set(each).alias("places"))


def repeated_runs(rows: DataFrame) -> DataFrame:
    """rows(k1, k2, id, text) -> (k1, k2, id, runs): of each text, ranges of words that came before, with the words about the first place."""
    places = materialize(rows.mapInArrow(_places, PLACES), "places")
    runs = materialize(repeated_places(places).mapInPandas(_runs, RUNS), "runs")
    release(rows.sparkSession)
    ends = [
        runs.filter(f"{s}at is not null").select(
            "k1", "k2", "id", "a", "b", F.lit(side).alias("side"),
            F.col(f"{s}1").alias("f1"), F.col(f"{s}2").alias("f2"), F.col(f"{s}id").alias("fid"), F.col(f"{s}at").alias("at"),
        )
        for side, s in enumerate("lr")
    ]
    ends = ends[0].union(ends[1])
    wanted = ends.groupBy("f1", "f2", "fid").agg(F.collect_set(F.struct("at", "side")).alias("wanted"))
    found = rows.join(wanted.toDF("k1", "k2", "id", "wanted"), ["k1", "k2", "id"]).mapInArrow(_contexts, CONTEXTS)
    contexts = found.groupBy("k1", "k2", "at", "side").agg(F.first("around").alias("around")).toDF("f1", "f2", "at", "side", "around")
    contexts = materialize(contexts, "contexts")
    release(rows.sparkSession)
    told = ends.join(contexts, ["f1", "f2", "at", "side"]).select("k1", "k2", "id", "a", "b", "side", "around")
    none = F.lit(None).cast(contexts.schema["around"].dataType)
    told = told.union(runs.select("k1", "k2", "id", "a", "b", F.lit(-1), none))
    return told.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.collect_list(F.struct("a", "b", "side", "around")).alias("runs"))


def _has_words(text: Column, n: int) -> Column:
    """Whether a text has n words, two at least."""
    return text.rlike(f"[^{SPACES}]" + f"[{SPACES}]+[^{SPACES}]+" * (n - 2) + f"[{SPACES}]+[^{SPACES}]")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with later repeated runs deleted from the text; all other columns unchanged."""
    spark, t = docs.sparkSession, F.col(text)
    packed = docs.select(
        F.xxhash64(t).alias("k1"), F.hash(t).alias("k2"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), t.alias("text"),
        F.struct(*[F.col(c) for c in docs.columns if c != text]).alias("row"),
    )
    rows = packed.select("k1", "k2", "id", "text")
    runs = repeated_runs(rows)
    copied = rows.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.max("id").alias("last")).filter("id < last")
    none = F.lit(None).cast(runs.schema["runs"].dataType)
    known = runs.unionByName(copied.select("k1", "k2", "id", none.alias("runs"))).groupBy("k1", "k2")
    known = materialize(known.agg(F.min("id").alias("least"), F.first("runs", ignorenulls=True).alias("runs")), "known")
    release(spark)
    out = packed.join(known, ["k1", "k2"], "left")
    later = F.col("id") > F.col("least")
    cut = F.pandas_udf(_cut, StringType())(F.when(~later & F.col("runs").isNotNull(), F.col("text")), F.col("runs"))
    new = F.when(later & _has_words(F.col("text"), LINE_WORDS), "").otherwise(F.coalesce(F.col("cut"), F.col("text")))
    done = out.withColumn("cut", cut).select(new.alias("text"), "row")
    return done.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
