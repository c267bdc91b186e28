"""Near copies: documents of five-word Jaccard similarity 0.8 or more, found by SimHash and verified.

Candidates come from `simhash`: each text has a 64-bit SimHash of its set of words, and by the
generalised pigeonhole principle those within TAU bits share a signature. (Of the pairs of
similarity 0.8 or more in the check tables, 98 % are within six bits by words; by
five-word shingles themselves 42 % would be.) Candidates are verified by the exact similarity of their
sets of five-word shingles, so that no link is false.

Verification goes in two rounds. In the first each text is compared with one candidate: the
one that most texts have as a candidate, and, of signatures that more than GROUP texts hold, the holder nearest to
the majority of their bits. In the second, candidates in different components are compared: all pairs
of small signatures, and of large ones the holders outside the component that most holders are in with
all others. Pairs left out have both texts in one component already, so that no component is lost,
and a large group of copies is never paired out.

Defined cases: null, empty and blank texts have the empty set and are one group; a text of less
than five words is one shingle; case of ASCII letters and blanks do not count; a null doc_id is never
the smallest unless the group has no other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialize, release
from plumbline.llm.components import components
from plumbline.llm.simhash import GROUP, keep_first, shared_signatures
from plumbline.llm.wordhash import Texts, span_hashes, sums, text_blocks

SIZE, TAU = 5, 6
#: Distinct words whose bits are added up at once.
BLOCK = 1 << 14


def shingles(texts: Texts) -> Iterator[np.ndarray]:
    """Of each text, the distinct hashes of its runs of SIZE words, in order; the whole text if it has fewer."""
    running = sums(texts.hashes())
    begin = np.arange(len(running))
    grams = span_hashes(running, begin, np.minimum(begin + SIZE, len(running) - 1), 5).view(np.int64)
    for a, b in zip(texts.first[:-1].tolist(), texts.first[1:].tolist()):
        if b - a >= SIZE:
            yield np.unique(grams[a : b - SIZE + 1])
        else:
            yield span_hashes(running, np.array([a]), np.array([b]), 5).view(np.int64) if b > a else np.zeros(0, np.int64)


def fingerprint(words: np.ndarray) -> int:
    """The signed SimHash of the set of word hashes."""
    kinds, ones = np.unique(words), np.zeros(64, np.int64)
    for at in range(0, len(kinds), BLOCK):
        ones += np.unpackbits(kinds[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(kinds), bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in text_blocks(batch, fold=True):
            words = texts.hashes()
            fps = [fingerprint(words[a:b]) for a, b in zip(texts.first[:-1].tolist(), texts.first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(fps, pa.int64())], ["doc_id", "th", "fp"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in text_blocks(batch, fold=True):
            found = list(shingles(texts))
            ends = np.cumsum([0, *map(len, found)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("th"), lists], ["th", "all"])


def _close(x: Column, y: Column, tau: int) -> Column:
    return F.bit_count(x.bitwiseXOR(y)) <= tau


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs(a, b) of text hashes whose sets have a similarity of 0.8 or more."""
    pairs = pairs.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = materialize(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("th")).union(pairs.select("b")).distinct()
    sets = texts.join(ids, "th", "left_semi").mapInArrow(_sets, "th long, all array<long>").dropDuplicates(["th"])
    sets = materialize(sets, "sets")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return materialize(both.filter(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b"), "verified")


def _majority(large: DataFrame) -> DataFrame:
    """(part, sig, rep): of each signature, the holder nearest to the majority of its holders' bits."""
    bit = lambda b: 1 << b if b < 63 else -(1 << 63)
    sums_of = [F.sum(F.shiftright("fp", b).bitwiseAND(F.lit(1))).alias(f"s{b}") for b in range(64)]
    counted = large.groupBy("part", "sig").agg(F.count("*").alias("k"), *sums_of)
    most = reduce(Column.bitwiseOR, [F.when(2 * F.col(f"s{b}") > F.col("k"), F.lit(bit(b))).otherwise(F.lit(0).cast("long")) for b in range(64)])
    middle = materialize(counted.select("part", "sig", most.alias("middle")), "middles")
    order = F.struct(F.bit_count(F.col("fp").bitwiseXOR(F.col("middle"))), "th")
    nearest = large.join(middle, ["part", "sig"]).groupBy("part", "sig").agg(F.min_by(F.struct("th", "fp"), order).alias("rep"))
    return materialize(nearest, "nearest")


def similar_pairs(nodes: DataFrame, texts: DataFrame, tau: int = TAU, group: int = GROUP) -> DataFrame:
    """Edges (a, b) that join those components which verified candidates among nodes(th, fp) make."""
    shared = shared_signatures(nodes, tau)
    release(nodes.sparkSession)
    held = shared.filter(F.col("n") <= group).groupBy("part", "sig").agg(F.collect_list(F.struct("th", "fp")).alias("h"))
    other = F.explode(F.filter("h", lambda y: (y.th > F.col("x.th")) & _close(y.fp, F.col("x.fp"), tau)))
    found = held.select(F.explode("h").alias("x"), "h").select("x", other.alias("y"))
    small = materialize(found.select(F.col("x.th").alias("a"), F.col("y.th").alias("b")).distinct(), "candidates")
    large = shared.filter(F.col("n") > group).select("part", "sig", "th", "fp")
    ways = small.union(small.select("b", "a"))
    known = materialize(ways.groupBy("a").agg(F.count("*").alias("k")).toDF("b", "k"), "degrees")
    once = ways.join(known, "b").groupBy("a").agg(F.max_by("b", F.struct("k", "b")).alias("b"))
    if has_large := not large.isEmpty():
        near = large.join(_majority(large), ["part", "sig"]).filter(_close(F.col("fp"), F.col("rep.fp"), tau))
        once = once.union(near.select(F.col("th").alias("a"), F.col("rep.th").alias("b")))
    edges = verified(once, texts)
    roots = materialize(components(edges), "roots")
    root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    apart = small.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    rest = apart.filter("coalesce(root_a, a) != coalesce(root_b, b)").select("a", "b")
    if has_large:
        placed = large.join(roots.withColumnRenamed("node", "th"), "th", "left").select("part", "sig", "th", "fp", F.coalesce("root", "th").alias("root"))
        placed = materialize(placed, "placed")
        most = placed.groupBy("part", "sig", "root").agg(F.count("*").alias("k")).groupBy("part", "sig").agg(F.max_by("root", F.struct("k", "root")).alias("most"))
        outside = placed.join(materialize(most, "most"), ["part", "sig"]).filter("root != most")
        outside = materialize(outside.select("part", "sig", F.col("th").alias("a"), F.col("fp").alias("f"), F.col("root").alias("r")), "outside")
        more = outside.join(placed, ["part", "sig"]).filter((F.col("root") != F.col("r")) & _close(F.col("fp"), F.col("f"), tau))
        rest = rest.union(more.select("a", F.col("th").alias("b")))
    return edges.union(verified(rest, texts))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tau: int = TAU, group: int = GROUP) -> DataFrame:
    """(doc_id, th, root) for each row; rows of one group have one root."""
    told = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in told.schema.fields[:2]) + ", fp long"
    rows = materialize(told.mapInArrow(_fingerprints, kind), "fingerprints")
    nodes = materialize(rows.groupBy("th").agg(F.first("fp").alias("fp")), "nodes")
    roots = materialize(components(similar_pairs(nodes, told.select("th", "text"), tau, group)), "roots").withColumnRenamed("node", "th")
    return rows.join(roots, "th", "left").select("doc_id", "th", F.coalesce("root", "th").alias("root"))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tau: int = TAU, group: int = GROUP) -> DataFrame:
    """One row of docs for each group: that with the smallest (doc_id, text hash). Columns are unchanged."""
    return keep_first(docs, materialize(near_copies(docs, doc_id, text, tau, group), "groups"), doc_id, text)
