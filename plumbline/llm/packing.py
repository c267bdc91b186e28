"""Packing of tokenised documents into sequences of bounded length by bin completion.

Documents are encoded, closed with an end id and cut into pieces of at most `limit`
tokens (a remainder comes first). How many pieces there are of each length is all that
packing depends on, and that is at most `limit` numbers whatever the input. Bin completion
searches over them: the largest length left opens a sequence, the undominated fillings
around it are tried from the least waste on, each as often as the counts allow, and a
branch is cut when its sequences and a lower bound on the rest reach the incumbent, which
best-fit decreasing supplies first. The search ends at the lower bound, or at the bounds that a
`Search` sets; EXACT sets none, which suits a few dozen pieces. Whether the result is proven is logged.

The patterns found are dealt to the pieces in Spark: each piece gets a rank among those of
its length (its rank within the batch that made it, plus that batch's offset), and each
pattern takes a range of ranks. No piece passes through the driver.

Defined cases: a null or empty text is its end id alone; a text of any length is encoded
whole; rows with the same doc_id are packed as separate documents; a null doc_id stays
null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import logging
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.bytebpe import encoder
from plumbline.llm.common import materialize

LIMIT = 1024
END_ID = 2


@dataclass(frozen=True)
class Search:
    """Bounds of the search: nodes in all, steps of the enumeration at one node, and fillings tried at it; None is no bound.

    Without bounds every maximal filling is tried, one sequence at a time, so that the search ends with a proof."""

    nodes: int | None = 6000
    steps: int | None = 400
    branches: int | None = 4


BOUNDED, EXACT = Search(), Search(None, None, None)
_log = logging.getLogger(__name__)

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, block long, rank long"


def _cut(path: str, limit: int, end_id: int, keep_ids: bool):
    closing = end_id.to_bytes(4, "little")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, rng = encoder(path).encode, np.random.default_rng()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"]):
                ids = memoryview(encode(text or "") + closing)
                total = len(ids) // 4
                at, piece, size = 0, 0, total % limit or limit
                while at < total:
                    part = ids[4 * at : 4 * (at + size)]
                    rows.append((doc_id, piece, at, size, zlib.crc32(part), bytes(part) if keep_ids else None))
                    at, piece, size = at + size, piece + 1, limit
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            out["block"] = rng.integers(1 << 62)
            out["rank"] = out.groupby("length").cumcount()
            yield out

    return pieces


def cut_pieces(
    docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = END_ID, keep_ids: bool = True,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The pieces of each document, with their ids (little-endian unsigned 32-bit) if asked for."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(_cut(path, limit, end_id, keep_ids), PIECES)


def lower_bound(counts: np.ndarray, limit: int) -> int:
    """The Martello-Toth bound L2 on the number of sequences; counts[l] pieces have length l."""
    lengths = np.arange(limit + 1)
    number, mass = np.cumsum(counts), np.cumsum(counts * lengths)
    half = limit // 2
    large, large_mass = number[limit] - number[half], mass[limit] - mass[half]
    k = np.arange(half + 1)
    top = number[limit] - number[limit - k]  # over limit - k: nothing of k or more fits beside them
    mid, mid_mass = large - top, large_mass - (mass[limit] - mass[limit - k])
    small = mass[half] - np.concatenate([[0], mass[:half]])
    spare = mid * limit - mid_mass
    return int((top + mid + np.maximum(0, -(-(small - spare) // limit))).max())


def best_fit(counts: np.ndarray, limit: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing over the counts: (times, lengths) for each kind of sequence."""
    opened: dict[int, Counter] = {}
    for length in range(limit, 0, -1):
        left = int(counts[length])
        while left:
            room = min((r for r, x in opened.items() if r >= length and x), default=limit)
            if room == limit and not opened.get(limit):
                kind, times = (), left
            else:
                kind, times = next(iter(opened[room].items()))
            each = min(room // length, left)
            used = min(times, left // each)
            if kind or opened.get(room):
                opened[room][kind] -= used
                if not opened[room][kind]:
                    del opened[room][kind]
            opened.setdefault(room - each * length, Counter())[(*kind, *[length] * each)] += used
            left -= used * each
    return [(n, kind) for x in opened.values() for kind, n in x.items() if n]


def fillings(counts: np.ndarray, largest: int, room: int, search: Search = BOUNDED) -> list[tuple[int, ...]]:
    """Fillings of `room` beside `largest`, least waste first, larger pieces first among equals.

    A filling is dominated if its pieces fit into the room of another's: with one piece
    that fills the room, all others are. Otherwise they are enumerated from large to small;
    whatever still takes a piece that is left is dominated by itself with that piece. Without bounds all
    that are left are returned, the undominated ones among them; with bounds, such as waste no more than
    any before them, and of these the first `branches`.
    """
    if room <= 0:
        return [()]
    if counts[room] > (room == largest):
        return [(room,)]
    have = [int(x) for x in np.flatnonzero(counts[: min(room, largest) + 1])[::-1]]
    left = {x: int(counts[x]) - (x == largest) for x in have}
    found: list[tuple[int, tuple[int, ...]]] = []
    steps, bound, branches, most = 0, room, search.branches, math.inf if search.steps is None else search.steps

    def extend(chosen: list[int], rest: int, at: int) -> None:
        nonlocal steps, bound
        steps += 1
        if steps > most or bound == 0 and branches and len(found) >= branches:
            return
        fits = False
        for k in range(at, len(have)):
            x = have[k]
            if x > rest or not left[x]:
                continue
            fits = True
            left[x] -= 1
            chosen.append(x)
            extend(chosen, rest - x, k)
            chosen.pop()
            left[x] += 1
            if steps > most:
                break
        if not fits and (rest <= bound or branches is None):
            bound = rest
            found.append((rest, tuple(chosen)))

    extend([], room, 0)
    found.sort(key=lambda f: (f[0], len(f[1])))
    return [f for _, f in found[:branches]] or [()]


def bin_completion(counts: np.ndarray, limit: int, search: Search = BOUNDED) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths) for each kind of sequence; every piece of counts is in exactly one."""
    return complete(counts, limit, search)[0]


def complete(counts: np.ndarray, limit: int, search: Search = BOUNDED) -> tuple[list[tuple[int, tuple[int, ...]]], bool]:
    """The packing, and whether it is proven to need the fewest sequences: it meets the bound, or a search without bounds has ended."""
    counts = np.asarray(counts, np.int64)
    bound, best = lower_bound(counts, limit), best_fit(counts, limit)
    best_n, nodes = sum(n for n, _ in best), 0
    stack = [(counts, 0, ())]
    while stack and best_n > bound and (search.nodes is None or nodes < search.nodes):
        left, used, chain = stack.pop()
        nodes += 1
        some = np.flatnonzero(left)
        if not len(some):
            if used < best_n:
                best, best_n = [], used
                while chain:
                    chain, times, kind = chain
                    best.append((times, kind))
            continue
        if used + lower_bound(left, limit) >= best_n:
            continue
        largest = int(some[-1])
        options = []
        for filling in fillings(left, largest, limit - largest, search):
            kind = (largest, *filling)
            need = Counter(kind)
            times = 1 if search == EXACT else min(int(left[x]) // k for x, k in need.items())
            after = left.copy()
            for x, k in need.items():
                after[x] -= times * k
            options.append((after, used + times, (chain, times, kind)))
        stack += reversed(options)
    return best, best_n <= bound or search == EXACT


def pack(pieces: DataFrame, limit: int = LIMIT, search: Search = BOUNDED) -> DataFrame:
    """pieces (see PIECES), written to the shared folder already -> the same with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = np.zeros(limit + 1, np.int64)
    for length, n in pieces.groupBy("length").agg(F.count("*")).collect():  # at most `limit` rows
        counts[length] = n
    taken, ranges, first = Counter(), [], 0
    packing, proven = complete(counts, limit, search)
    _log.info("%d sequences, %s", sum(n for n, _ in packing), "the fewest" if proven else f"{lower_bound(counts, limit)} at least")
    for times, kind in packing:
        at = 0
        for length, each in sorted(Counter(kind).items(), reverse=True):
            ranges.append((length, taken[length], taken[length] + times * each, each, first, at))
            taken[length] += times * each
            at += each * length
        first += times
    kinds = spark.createDataFrame(ranges, "length long, low long, high long, each long, first long, at long")
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.groupBy("block", "length").agg(F.count("*").alias("n")).select(
        "block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    ranked = pieces.join(offsets, ["block", "length"]).withColumn("r", F.col("rank") + F.col("base"))
    placed = ranked.alias("p").join(
        F.broadcast(kinds).alias("k"), F.expr("p.length = k.length AND p.r >= k.low AND p.r < k.high")
    )  # kinds has at most one row for each piece of a kind of sequence: bounded by the limit, not by the input
    return placed.select(
        "doc_id", "piece", "start", "p.length", "ids_crc32",
        F.expr("k.first + (p.r - k.low) div k.each").alias("sequence_id"),
        F.expr("k.at + ((p.r - k.low) % k.each) * p.length").alias("offset"),
        "ids",
    )


def pack_documents(
    docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = END_ID, keep_ids: bool = True, search: Search = BOUNDED
) -> DataFrame:
    return pack(materialize(cut_pieces(docs, path, limit, end_id, keep_ids), "pieces"), limit, search)
