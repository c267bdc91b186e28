"""SimHash near-duplicates, linked within a Hamming distance by the generalised pigeonhole principle.

Fingerprints are 64-bit majorities over XXH64 hashes of word shingles. The distinct ones
are linked: their bits are grouped into partitions of correlated bits, each partition
gets its own threshold t_i <= 2 with sum(t_i) = tau - m + 1, allotted by dynamic programming
over candidate counts that a bounded sample estimates, and two fingerprints within tau must agree within t_i
in some partition i. t_i = 0 emits the partition's value as a signature; t_i >= 1 also
emits the values one bit off, so that two values within two bits share one; t_i = -1
leaves the partition out. Fingerprints that share a signature are verified.

A signature held by more than GROUP fingerprints is not paired. Its holders emit their
whole fingerprint and the 64 that differ from it in one bit. All holders of one such
signature lie within two bits of each other, and any two within two bits share one, so
linking each to the least of them gives the same components. At most 65 distinct
fingerprints can hold one, whatever the input.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any
other; a text of one or two words is one shingle; equal texts share a fingerprint and
so a component; a null doc_id is never the smallest unless the component has no other;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from plumbline.llm.common import materialize
from plumbline.llm.components import components

TAU = 2
#: Fingerprints, those of least hash, by whose distances candidates are estimated; the estimate only picks thresholds.
SAMPLE = 2048
#: Holders of one signature that are paired directly.
GROUP = 64
#: Numbers of partitions that are weighed against each other.
PARTITION_COUNTS = (2, 3)
#: Words whose shingles are hashed at once.
BLOCK = 1 << 16


def fingerprint(text: str | None, size: int = 3) -> int:
    """The signed 64-bit SimHash of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    of, ones, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), max(1, len(words) - size + 1)
    for at in range(0, total, BLOCK):
        part = words[at : min(at + BLOCK, total) + size - 1]
        joined = b" ".join(part)
        gaps = np.cumsum([len(w) + 1 for w in part])
        starts, ends = [0, *gaps[:-1].tolist()], (gaps - 1).tolist()
        hashes = np.array([of(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :] or ends[-1:])], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def fingerprint_column(text: Column) -> Column:
    return F.pandas_udf(_fingerprints, LongType())(text)


def _bit_sums(batches):
    total = np.zeros((64, 64), np.int64)
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            fps = batch["fp"].to_numpy(np.int64)[at : at + BLOCK]
            bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
    yield pd.DataFrame({"k": np.arange(4096), "n": total.ravel()})


def bit_statistics(fps: DataFrame) -> np.ndarray:
    """How many of all fingerprints have both bits set, for each pair of bits."""
    out = np.zeros(4096, np.int64)
    for k, n in fps.select("fp").mapInPandas(_bit_sums, "k int, n long").groupBy("k").agg(F.sum("n")).collect():
        out[k] = n
    return out.reshape(64, 64)


def group_bits(both: np.ndarray, total: int, parts: int) -> list[list[int]]:
    """Parts of nearly equal size; each starts with the most correlated pair left and takes what correlates with it."""
    p = both.diagonal() / max(total, 1)
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    corr = np.abs(np.divide(both / max(total, 1) - np.outer(p, p), spread, out=np.zeros((64, 64)), where=spread > 1e-12))
    np.fill_diagonal(corr, 0)
    left, out = list(range(64)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        sub = corr[np.ix_(left, left)]
        i, j = np.unravel_index(sub.argmax(), sub.shape)
        chosen = [left[i], left[j]] if i != j else left[:2]
        while len(chosen) < size:
            rest = [b for b in left if b not in chosen]
            chosen.append(max(rest, key=lambda b: (corr[b, chosen].mean(), -b)))
        out.append(sorted(chosen))
        left = [b for b in left if b not in chosen]
    return out


def _distances(sample: np.ndarray, bits: list[int]) -> np.ndarray:
    """P(two fingerprints differ in exactly k of these bits): what pairs of the sample show, and what independent bits would have if more."""
    own = sample & np.uint64(sum(1 << b for b in bits))
    shown = np.zeros(len(bits) + 1)
    for at in range(len(own) - 1):
        shown += np.bincount(np.bitwise_count(own[at] ^ own[at + 1 :]), minlength=len(shown))
    p = np.array([(sample >> np.uint64(b) & np.uint64(1)).mean() if len(sample) else 0 for b in bits])
    alone = np.array([1.0])
    for q in 2 * p * (1 - p):
        alone = np.convolve(alone, [1 - q, q])
    return np.maximum(shown / max(shown.sum(), 1), alone)


def allot(total: int, parts: list[list[int]], sample: np.ndarray, tau: int) -> tuple[float, list[int]] | None:
    """Thresholds of at most 2, one a part, that sum to tau - m + 1 at the least estimated cost, by dynamic programming; None if there are none."""

    def cost(bits: list[int], near: np.ndarray, t: int) -> float:
        if t < 0:
            return 0.0
        rows = total * (1 if t == 0 else 1 + len(bits))
        pairs = 0.5 * total * total * near[: (0 if t == 0 else 2) + 1].sum()
        return rows + pairs

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits in parts:
        near, step = _distances(sample, bits), {}
        for used, (sofar, chosen) in best.items():
            for t in range(-1, 3):
                found = (sofar + cost(bits, near, t), [*chosen, t])
                if used + t not in step or found < step[used + t]:
                    step[used + t] = found
        best = step
    return best.get(tau - len(parts) + 1)


def plan(fps: DataFrame, tau: int = TAU) -> tuple[list[list[int]], list[int]]:
    both, total = bit_statistics(fps), fps.count()
    drawn = fps.select("fp").distinct().orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()
    sample = np.array([r.fp for r in drawn], np.int64).view(np.uint64)
    weighed = []
    for m in PARTITION_COUNTS:
        parts = group_bits(both, total, m)
        if found := allot(total, parts, sample, tau):
            weighed.append((found[0], parts, found[1]))
    if not weighed:
        raise ValueError(f"{PARTITION_COUNTS} partitions of thresholds up to 2 do not reach tau = {tau}")
    return min(weighed, key=lambda x: x[0])[1:]


def _mask(bits: list[int]) -> int:
    return int(np.array([sum(1 << b for b in bits)], np.uint64).view(np.int64)[0])


def signatures(fps: DataFrame, parts: list[list[int]], thresholds: list[int]) -> DataFrame:
    """(part, sig) before the columns of fps: what each fingerprint is found by."""
    found = []
    for i, (bits, t) in enumerate(zip(parts, thresholds)):
        if t < 0:
            continue
        value = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        sig = F.explode(F.array(value, *[value.bitwiseXOR(F.lit(_mask([b]))) for b in bits])) if t else value
        found.append(fps.select(F.lit(i).alias("part"), sig.alias("sig"), *fps.columns))
    return reduce(DataFrame.union, found)


def shared_signatures(fps: DataFrame, tau: int) -> DataFrame:
    """(part, sig, columns of fps, n): signatures that n >= 2 rows hold."""
    rows = signatures(fps, *plan(fps, tau))
    sizes = materialize(rows.groupBy("part", "sig").agg(F.count("*").alias("n")).filter("n > 1"), "signature-sizes")
    return materialize(rows.join(sizes, ["part", "sig"]), "signatures")


def link(fps: DataFrame, tau: int = TAU, group: int = GROUP) -> DataFrame:
    """fps(fp), distinct -> edges (a, b) that join exactly those components which pairs within tau <= 2 bits make."""
    if not 0 <= tau <= 2:
        raise ValueError("tau must be 0, 1 or 2")
    if tau == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    shared = shared_signatures(fps.select("fp"), tau)

    def within(groups: DataFrame) -> DataFrame:
        near = lambda x: (x > F.col("a")) & (F.bit_count(x.bitwiseXOR(F.col("a"))) <= tau)
        return groups.select(F.explode("fps").alias("a"), "fps").select("a", F.explode(F.filter("fps", near)).alias("b"))

    small = shared.filter(F.col("n") <= group).groupBy("part", "sig").agg(F.collect_list("fp").alias("fps"))
    pairs = within(small)
    pool = shared.filter(F.col("n") > group).select("fp").distinct()
    balls = pool.select(F.explode(_ball(F.col("fp"))).alias("sig"), "fp")
    held = balls.groupBy("sig").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    if tau == 2:
        return pairs.union(held.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).filter("a != b"))
    return pairs.union(within(held))


def _ball(fp: Column) -> Column:
    return F.array(fp, *[fp.bitwiseXOR(F.lit(_mask([b]))) for b in range(64)])


def near_duplicates(docs: DataFrame, tau: int = TAU, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, fp, component_id, root) for each row; th is the text's XXH64.

    root names the component: component_id is null for every one without an id."""
    rows = materialize(
        docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), fingerprint_column(F.col(text)).alias("fp")),
        "fingerprints",
    )
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    roots = components(link(fps.select("fp"), tau)).withColumnRenamed("node", "fp")
    placed = fps.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = materialize(placed.join(least, "root").select("fp", "component_id", "root"), "named")
    # Empty texts and exact copies share a fingerprint; nothing needs its rows together, so that Spark splits this join.
    return rows.join(named, "fp").select("doc_id", "th", "fp", "component_id", "root")


def drop_near_duplicates(docs: DataFrame, tau: int = TAU, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each component: that with the smallest (doc_id, text hash). Columns are unchanged."""
    found = materialize(near_duplicates(docs, tau, doc_id, text), "components")
    return keep_first(docs, found, doc_id, text)


def keep_first(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of docs, the row with the smallest (doc_id, text hash) of each root in found(doc_id, th, root)."""
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th")).alias("k"))
    keep = first.select(F.col("k.doc_id").alias("__id"), F.col("k.th").alias("__th"))
    times = found.groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(F.count("*").alias("__n"))
    kept = keep.alias("k").join(
        times.alias("t"), F.expr("k.__id <=> t.__id AND k.__th <=> t.__th")
    ).select("k.__id", "k.__th", "t.__n")
    keyed = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("th"), F.struct("*").alias("row"))
    out = keyed.alias("d").join(kept.alias("k"), F.expr("d.id <=> k.__id AND d.th <=> k.__th")).select("id", "th", "row", "__n")
    once = out.filter("__n = 1").select("row.*")
    return once.union(out.filter("__n > 1").dropDuplicates(["id", "th"]).select("row.*"))
