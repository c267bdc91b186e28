"""Token counts of whole texts by a SentencePiece BPE model, huge documents by overlap resynchronisation.

A text position is stable if no piece of the vocabulary holds the two characters around
it: no merge can ever cross it, so that the tokens on either side depend on that side
alone. Documents of more than `chunk` characters are cut into chunks that overlap by
`overlap` characters on both sides of each cut, and Spark deals the chunks out. Each is
encoded with offsets and reports its stable token boundaries in the overlaps. Neighbours
are spliced at a boundary that both found; the count of a document is the sum of the
tokens between its splices. Where neighbours share none, the document is encoded again
with overlaps widened fourfold, and at last as one chunk.

Shorter documents are one chunk each. Their words, cut at stable positions before spaces,
are encoded by the library and counted from a bounded memo.

Defined cases: null and empty texts have no bytes and no tokens; a text without any
stable position is encoded whole; rows that agree in doc_id and text are counted once
and reported as often as they occur; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from plumbline.llm.common import materialize, row_key
from plumbline.llm.memo import Memo

CHUNK = 1 << 15
OVERLAP = 256
LIMIT = 4096

_SPACE = "▁"
_CUT = re.compile("(?<=[^ ]) ")


class Counter:
    """Counts and boundaries of one model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        self.library = SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.splits = not any(a != _SPACE and b == _SPACE for a, b in self.pairs)
        told = ModelProto.FromString(self.library.serialized_model_proto())
        rule = told.normalizer_spec
        # Texts are left as they are, but for blanks, which become pieces' first marks; no piece is cut out before the others.
        self.plain = (
            not rule.precompiled_charsmap and not rule.normalization_rule_tsv and rule.add_dummy_prefix and not rule.remove_extra_whitespaces
            and rule.escape_whitespaces and not told.trainer_spec.treat_whitespace_as_suffix
            and not any(p.type == p.USER_DEFINED for p in told.pieces)
        )
        size = lambda x: len(self.library.encode(x))
        self.memo, self.last_space = Memo(size), size("a ") - size("a")

    def stable(self, text: str, at: int) -> bool:
        return 0 < at < len(text) and text[at - 1 : at + 1].replace(" ", _SPACE) not in self.pairs

    def count(self, text: str) -> int:
        if not (self.splits and self.plain) or _SPACE in text:
            return len(self.library.encode(text))
        if not text:
            return 0
        words = _CUT.split(text) if "  " in text or text[0] == " " else text.split(" ")
        extra = 0
        if len(words) > 1 and not words[-1]:
            words.pop()
            extra = self.last_space
        return sum(map(self.memo.__getitem__, words)) + extra

    def boundaries(self, text: str) -> list[int]:
        """The character at which each token begins; the library's own offsets count bytes."""
        begins = [p.begin for p in self.library.encode(text, return_type="proto").pieces]
        if text.isascii():
            return begins
        starts = np.cumsum(np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80) - 1
        return starts[begins].tolist()


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One for each file and Python worker."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def _short(path: str):
    def count(texts: pd.Series) -> pd.Series:
        of = counter(path).count
        return pd.Series([of(t or "") for t in texts], dtype="int64")

    return F.pandas_udf(count, LongType())


def _cut(chunk: int, overlap: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, text_hash, text in zip(batch["__id"], batch["__th"], batch["__text"]):
                rows = [(at // chunk, max(0, at - overlap), text[max(0, at - overlap) : at + chunk + overlap]) for at in range(0, len(text), chunk)]
                out = pd.DataFrame(rows, columns=["k", "start", "part"])
                out["__id"] = pd.array([doc_id] * len(out), dtype="Int64")
                out["__th"], out["size"] = text_hash, len(text)
                yield out[["__id", "__th", "size", "k", "start", "part"]]

    return cut


def _encode(path: str, chunk: int, overlap: int):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = counter(path)
        for batch in batches:
            rows = []
            for k, start, part in zip(batch["k"].tolist(), batch["start"].tolist(), batch["part"]):
                begins, zones = model.boundaries(part), ([], [], [], [])
                for n, at in enumerate(begins):
                    for side, cut in enumerate((k * chunk, (k + 1) * chunk)):
                        if abs(start + at - cut) <= overlap and (not n or begins[n - 1] < at) and model.stable(part, at):
                            zones[2 * side].append(start + at)
                            zones[2 * side + 1].append(n)
                rows.append((*zones, len(begins)))
            out = batch[["__id", "__th", "size", "k"]].copy()
            out[["left_at", "left_n", "right_at", "right_n", "n"]] = pd.DataFrame(rows, index=out.index, dtype=object)
            out["n"] = out["n"].astype("int64")
            yield out

    return encode


def _splice(chunks: DataFrame) -> DataFrame:
    """(__id, __th, n_tokens) of each document, null where neighbours share no boundary."""
    in_order = Window.partitionBy("__id", "__th").orderBy("k")  # one row a chunk of one document
    met = lambda a, b: F.get(F.array_intersect(a, b), 0)
    joined = chunks.select(
        "*", met(F.lag("right_at").over(in_order), F.col("left_at")).alias("from"),
        met(F.col("right_at"), F.lead("left_at").over(in_order)).alias("to"),
        F.lead("k").over(in_order).isNull().alias("last"),
    )
    number = lambda at, n, p: F.get(F.col(n), F.array_position(F.col(at), F.col(p)).cast("int") - 1)
    begin = F.when(F.col("k") == 0, F.lit(0)).otherwise(number("left_at", "left_n", "from"))
    end = F.when(F.col("last"), F.col("n")).otherwise(number("right_at", "right_n", "to"))
    own = joined.select("__id", "__th", (end - begin).cast("long").alias("own"))
    return own.groupBy("__id", "__th").agg(
        F.when(F.count("own") == F.count("*"), F.sum("own")).alias("n_tokens")
    )


def count_long(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(__id, __th, n_tokens) of docs(__id, __th, __text), each document once."""
    done, pending = [], docs
    cut_kind = "__id long, __th long, size long, k int, start long, part string"
    kind = "__id long, __th long, size long, k int, left_at array<int>, left_n array<int>, right_at array<int>, right_n array<int>, n long"
    while overlap < chunk:
        chunks = pending.mapInPandas(_cut(chunk, overlap), cut_kind).dropDuplicates(["__id", "__th", "k"])
        counted = materialize(_splice(chunks.mapInPandas(_encode(path, chunk, overlap), kind)), "counts")
        done.append(counted.filter("n_tokens IS NOT NULL"))
        failed = counted.filter("n_tokens IS NULL").select("__id", "__th")
        if failed.isEmpty():
            break
        pending = docs.alias("d").join(
            failed.alias("f"), F.expr("d.__id <=> f.__id AND d.__th <=> f.__th"), "left_semi"
        )
        overlap *= 4
    else:
        whole = pending.dropDuplicates(["__id", "__th"])
        done.append(whole.select("__id", "__th", _short(path)(F.col("__text")).alias("n_tokens")))
    return reduce(DataFrame.union, done)


def count_tokens(
    docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row."""
    rows = docs.select(*row_key(doc_id, text), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    rows = rows.withColumn("__id", F.col("__id").cast("long"))
    size, n_bytes = F.length("__text"), F.octet_length("__text").cast("long").alias("n_bytes")
    short = rows.filter(size <= chunk).select("__id", n_bytes, _short(path)(F.col("__text")).alias("n_tokens"))
    long = rows.filter(size > chunk)
    counts = count_long(long, path, chunk, overlap)
    counted = long.select("__id", "__th", n_bytes).alias("d").join(
        counts.alias("c"), F.expr("d.__id <=> c.__id AND d.__th <=> c.__th")
    ).select("d.__id", "n_bytes", "n_tokens")
    return short.union(counted).select(
        F.col("__id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
