"""Benchmark decontamination by a distributed positional inverted index.

`build_index` reads the training texts once and stores, for each segment of documents,
the distinct terms in order and for each term its ascending positions in the segment.
Positions count words through the segment and skip one between documents, so that no
phrase crosses from one document into the next. A segment is a row of a table in the shared
folder, and depends on no benchmark: it can serve any number of them.

`search` looks windows of test words up in every segment: the posting lists of a window's
terms are taken from the rarest in the segment on, each shifted by the term's offset in
the window, and intersected; a window that lacks a term there costs one comparison. It
returns exact phrases, and with a slop also proximity matches: places where every term
of the window stands within len(window) - 1 + slop words of an occurrence of its rarest
term, in the same document, in any order.

The windows reach the segments in blocks of at most BLOCK_CHARS characters of benchmark
text and one item, each broadcast by itself, whatever the size of the benchmark.

Defined cases: null, empty and wordless texts have no words and no hits; an item without
words has no window; an item of fewer words than a window is one window; repeated rows are
separate documents with equal results; equal windows of several items count for each of them;
an empty table of documents gives an empty result, an empty benchmark no hits; a null item_id
is reported as an empty string; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import materialize, row_key

WINDOW = 10
#: Text bytes after which a segment ends with the document that reaches them.
SEGMENT_BYTES = 1 << 21
#: Segments of a row group of the stored index. Readers decode a row group at once, and writers gather 100 rows before they look at its size.
GROUP = 4
#: Characters of benchmark text whose windows are broadcast at once.
BLOCK_CHARS = 1 << 23

WORD = b"[0-9a-z\x80-\xff]+"

INDEX = (
    "segment string, doc_ids array<long>, text_hashes array<long>, first array<int>, n_words array<int>, "
    "terms binary, term_ends array<int>, posting_ends array<int>, positions array<int>"
)


def word_list(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased, as UTF-8."""
    return re.findall(WORD, (text or "").encode("utf-8", "surrogatepass").lower())


def _segment(rows: list[tuple], words: list[list[bytes]]) -> tuple:
    ids: dict[bytes, int] = {}
    number = ids.setdefault
    codes, first, at = [], [], 0
    for w in words:
        first.append(at)
        codes += [number(x, len(ids)) for x in w]
        codes.append(-1)
        at += len(w) + 1
    code = np.array(codes, np.int32)
    order = np.argsort(code, kind="stable").astype(np.int32)
    ends = np.cumsum(np.bincount(code[code >= 0], minlength=len(ids))).astype(np.int32)
    terms = list(ids)
    h = hashlib.blake2b(digest_size=12)
    for doc_id, text_hash in rows:
        h.update(f"{doc_id} {text_hash};".encode())
    return (
        h.hexdigest(), [r[0] for r in rows], [r[1] for r in rows], first, [len(w) for w in words],
        b"".join(terms), np.cumsum([len(t) for t in terms]).astype(np.int32), ends, order[(code < 0).sum() :],
    )


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in INDEX.split(", ")]

    def out(rows, words):
        return pd.DataFrame([_segment(rows, words)], columns=names)

    rows, words, size = [], [], 0
    for batch in batches:
        ids = batch["__id"].astype(object).where(batch["__id"].notna(), None)
        for doc_id, text_hash, text in zip(ids, batch["__th"].tolist(), batch["__text"]):
            rows.append((None if doc_id is None else int(doc_id), text_hash))
            words.append(word_list(text))
            size += len(text or "")
            if size >= SEGMENT_BYTES:
                yield out(rows, words)
                rows, words, size = [], [], 0
    if rows:
        yield out(rows, words)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index: one row a segment, see INDEX."""
    rows = docs.select(*row_key(doc_id, text), F.col(text).alias("__text"))
    rows = rows.withColumn("__id", F.col("__id").cast("long"))
    return materialize(rows.mapInPandas(_segments, INDEX), "index", parquet_block_row_count_limit=GROUP)


def windows(items: list[tuple[str, str | None]], size: int = WINDOW) -> dict[tuple[bytes, ...], list[str]]:
    """The items of each distinct window."""
    found: dict[tuple[bytes, ...], list[str]] = {}
    for item, text in items:
        w = word_list(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            held = found.setdefault(tuple(w[k : k + size]), [])
            if not held or held[-1] != item:
                held.append(item)
    return found


class Segment:
    def __init__(self, terms: bytes, term_ends: np.ndarray, posting_ends: np.ndarray, positions: np.ndarray):
        starts = [0, *term_ends[:-1].tolist()]
        self.number = {terms[a:b]: k for k, (a, b) in enumerate(zip(starts, term_ends.tolist()))}
        self.ends = np.concatenate([[0], posting_ends]).astype(np.int64)
        self.positions = positions

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.ends[term] : self.ends[term + 1]]

    def phrase(self, terms: list[int]) -> np.ndarray:
        """Where the terms stand one after the other."""
        order = sorted(range(len(terms)), key=lambda k: self.ends[terms[k] + 1] - self.ends[terms[k]])
        at = self.postings(terms[order[0]]).astype(np.int64) - order[0]
        for k in order[1:]:
            other = self.postings(terms[k])
            found = np.searchsorted(other, at + k)
            at = at[(found < len(other)) & (other[np.minimum(found, len(other) - 1)] == at + k)]
            if not len(at):
                break
        return at

    def near(self, terms: list[int], slop: int, last: np.ndarray) -> np.ndarray:
        """Occurrences of the rarest term that have every other term within reach in their document.

        last: by position, the first position of the document that holds it."""
        reach = len(terms) - 1 + slop
        order = sorted(set(terms), key=lambda t: self.ends[t + 1] - self.ends[t])
        at = self.postings(order[0]).astype(np.int64)
        for t in order[1:]:
            other = self.postings(t).astype(np.int64)
            right = np.searchsorted(other, at)
            good = np.zeros(len(at), bool)
            for side in (right - 1, right):
                ok = (side >= 0) & (side < len(other))
                p = other[np.clip(side, 0, len(other) - 1)]
                good |= ok & (np.abs(p - at) <= reach) & (last[p] == last[at])
            at = at[good]
            if not len(at):
                break
        return at


def _search(found: dict[tuple[bytes, ...], list[str]], slop: int | None):
    vocabulary = sorted({t for w in found for t in w})
    place = {t: k for k, t in enumerate(vocabulary)}
    size = max(map(len, found), default=1)
    table = np.full((len(found), size), len(vocabulary), np.int32)
    for k, w in enumerate(found):
        table[k, : len(w)] = [place[t] for t in w]
    items = list(found.values())
    lengths = [len(w) for w in found]
    nothing = len(vocabulary)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for s in batch.itertuples(index=False):
                segment = Segment(s.terms, s.term_ends, s.posting_ends, s.positions)
                number = np.array([segment.number.get(t, -1) for t in vocabulary] + [nothing + (1 << 30)], np.int64)
                codes = number[table]
                first = np.asarray(s.first, np.int64)
                total = int(first[-1]) + int(s.n_words[-1]) + 1
                covered, by_doc = np.zeros(total, bool), {}
                owner = first[np.searchsorted(first, np.arange(total), "right") - 1] if slop is not None else None
                for k in np.flatnonzero((codes >= 0).all(axis=1)).tolist():
                    terms = codes[k, : lengths[k]].tolist()
                    at = segment.phrase(terms) if slop is None else segment.near(terms, slop, owner)
                    if not len(at):
                        continue
                    for j in range(lengths[k] if slop is None else 1):
                        covered[at + j] = True
                    for d in np.unique(np.searchsorted(first, at, "right") - 1).tolist():
                        by_doc.setdefault(d, set()).update(items[k])
                for d, its in by_doc.items():
                    a = int(first[d])
                    hits = np.flatnonzero(covered[a : a + int(s.n_words[d])]).astype(np.int32)
                    rows.append((s.segment, d, hits, sorted(its)))
            yield pd.DataFrame(rows, columns=["segment", "doc", "hits", "items"])

    return search


def item_blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of at most BLOCK_CHARS characters and one item."""
    block, size = [], 0
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t"))
    for item, t in rows.toLocalIterator():
        block.append((item, t))
        size += len(t or "")
        if size > BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


@contextmanager
def _one_at_a_time(spark: SparkSession) -> Iterator[None]:
    """What runs in here sends Python one row at a time. By default 10 000 rows are gathered, which of segments is a whole task's input, outside of the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 1)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def search(
    index: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int | None = None, item_id: str = "item_id", text: str = "text"
) -> DataFrame:
    """(segment, doc, hits, items): for each document with matches, the words hit and the items found.

    hits are positions in the document, of all words of exact phrases, or with a slop of the
    anchors of proximity matches. doc is the document's place in its segment."""
    columns = ["segment", "first", "n_words", "terms", "term_ends", "posting_ends", "positions"]
    kind = "segment string, doc int, hits array<int>, items array<string>"
    found = [
        index.select(*columns).mapInPandas(_search(windows(block, size), slop), kind)
        for block in item_blocks(benchmark, item_id, text)
    ]
    if not found:
        return index.sparkSession.createDataFrame([], kind)
    with _one_at_a_time(index.sparkSession):
        held = materialize(reduce(DataFrame.union, found), "hits")
    if len(found) == 1:
        return held
    return held.groupBy("segment", "doc").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )


def documents(index: DataFrame) -> DataFrame:
    """(segment, doc, doc_id, text_hash, n_words) of every document of the index."""
    return index.select(
        "segment", F.posexplode(F.arrays_zip("doc_ids", "text_hashes", "n_words")).alias("doc", "d")
    ).select("segment", "doc", F.col("d.doc_ids").alias("doc_id"), F.col("d.text_hashes").alias("text_hash"), F.col("d.n_words").cast("long").alias("n_words"))


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """For each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    index = build_index(docs)
    found = search(index, benchmark, size).dropDuplicates(["segment", "doc"])
    all_docs = documents(index)
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    n_hit = F.coalesce(F.size("hits"), F.lit(0)).cast("long")
    return all_docs.join(found, ["segment", "doc"], "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of docs without any window of the benchmark, columns unchanged."""
    index = build_index(docs)
    bad = documents(index).join(search(index, benchmark, size), ["segment", "doc"], "left_semi")
    bad = bad.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__th")).distinct()
    keyed = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), F.struct("*").alias("row"))
    out = keyed.alias("d").join(bad.alias("b"), F.expr("d.id <=> b.__id AND d.th <=> b.__th"), "left_anti")
    return out.select("row.*")
