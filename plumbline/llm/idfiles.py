"""Token-id files: one array of ids in ascending document order, document bounds in Elias-Fano code.

A data set is a folder of shards. A shard's layout, all numbers little-endian:

    NAME.body: the ids, 2 or 4 bytes each
    NAME.bounds: magic b"PLIDEF02"; u32 bytes per id; u32 low bits l; u64 documents n; u64 ids u;
    then seven blocks, each after its u64 size in bytes:
    low:     the l low bits of each of the n end offsets, packed from the least bit on
    high:    bit (e_i >> l) + i is set for each end offset e_i, packed from the least bit on
    samples: u32 position in `high` of every SAMPLE-th set bit
    doc ids: i64 least doc_id; u64 null doc_ids, which come first; u32 low bits; u32 0
    low, high, samples: the same code of the other doc_ids less the least, which ascend

The ends of n documents among u ids take about 2 + log2(u / n) bits each. `Sequence.select(i, n)`
finds the i-th set bit from the sample before it, and the n values from there on; readers go
through a shard by spans that it selects. Shards hold ranges of doc_id, so the offsets in the whole
array are the shard's offset plus those in the shard.

Defined cases: a null or empty text is its end id alone; rows with the same doc_id follow
each other in the order of their texts; null doc_ids come first; an empty table gives no
shard and an empty result; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.bytebpe import encoder
from plumbline.llm.common import materialize, new_folder
from plumbline.llm.files import reading, writing

MAGIC, HEAD, IDS = b"PLIDEF02", "<8sIIQQ", "<qQII"
SAMPLE = 256
#: Documents, and ids of one document, that are read from a shard at once.
BLOCK_DOCS, BLOCK_IDS = 1 << 14, 1 << 22
#: Number types of the blocks of a shard's bounds.
KINDS = (np.uint8, np.uint8, "<u4", np.uint8, np.uint8, np.uint8, "<u4")


@dataclass
class Sequence:
    """Elias-Fano code of a non-decreasing sequence of unsigned 64-bit numbers."""

    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> "Sequence":
        n, values = len(values), values.astype(np.uint64)
        l = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        low = np.zeros((n, l), np.uint8)
        for k in range(l):
            low[:, k] = values >> np.uint64(k) & np.uint64(1)
        at = (values >> np.uint64(l)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        high[at] = 1
        return cls(n, l, np.packbits(low.ravel(), bitorder="little"), np.packbits(high, bitorder="little"), at[::SAMPLE].astype("<u4"))

    def _low(self, i: int, n: int) -> np.ndarray:
        l = self.low_bits
        a, b = i * l, (i + n) * l
        bits = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + n * l].reshape(n, l)
        return bits.astype(np.uint64) @ (np.uint64(1) << np.arange(l, dtype=np.uint64))

    def select(self, i: int, n: int = 1) -> np.ndarray:
        """The n values from the i-th on, by select on the high bits from the last sample."""
        byte, rank = int(self.samples[i // SAMPLE]) // 8, i % SAMPLE
        rank += int(np.unpackbits(self.high[byte : byte + 1], bitorder="little")[: self.samples[i // SAMPLE] % 8].sum())
        found, width = np.zeros(0, np.int64), 64 + (rank + n) // 2
        while len(found) < rank + n:
            width *= 2
            found = np.flatnonzero(np.unpackbits(self.high[byte : byte + width], bitorder="little"))
        high = byte * 8 + found[rank : rank + n] - np.arange(i, i + n)
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) + self._low(i, n)

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.low, self.high, self.samples

    def nbytes(self) -> int:
        return sum(x.nbytes for x in self.parts())


def _write(path: str, folder: str, end_id: int, width: int):
    closing = end_id.to_bytes(4, "little")

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        batches = (b for b in batches if len(b))
        if (first := next(batches, None)) is None:
            return
        name = f"{folder}/shard-{TaskContext.get().partitionId():06d}.ids"
        encode, ends, doc_ids, nulls, total = encoder(path).encode, array("q"), array("q"), 0, 0
        with writing(f"{name}.body") as out:
            for batch in (b for g in ([first], batches) for b in g):
                for doc_id, text in zip(batch["doc_id"], batch["text"]):
                    ids = encode(text or "") + closing
                    total += len(ids) // 4
                    out.write(np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes() if width < 4 else ids)
                    missing = doc_id is None or doc_id != doc_id
                    ends.append(total)
                    if missing:
                        nulls += 1
                    else:
                        doc_ids.append(int(doc_id))
        bounds, named = Sequence.of(np.frombuffer(ends, np.int64)), np.frombuffer(doc_ids, np.int64)
        least = int(named[0]) if len(named) else 0
        ids = Sequence.of(named.view(np.uint64) - np.array(least).astype(np.uint64))
        with writing(f"{name}.bounds") as out:
            out.write(struct.pack(HEAD, MAGIC, width, bounds.low_bits, bounds.n, total))
            for x in (*bounds.parts(), np.frombuffer(struct.pack(IDS, least, nulls, ids.low_bits, 0), np.uint8), *ids.parts()):
                out.write(struct.pack("<Q", x.nbytes) + x.tobytes())
        yield pd.DataFrame({"shard": [TaskContext.get().partitionId()], "path": [name], "n_docs": [bounds.n], "n_ids": [total]})

    return shard


def write_ids(
    docs: DataFrame, path: str, folder: str, end_id: int = 0, width: int = 2, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write the shards and return their list (shard, path, n_docs, n_ids, start), start the ids in all shards before."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dealt = rows.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    shards = materialize(dealt.mapInPandas(_write(path, folder, end_id, width), "shard int, path string, n_docs long, n_ids long"), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


class Shard:
    """A shard opened for reading."""

    def __init__(self, path: str):
        self.path = path
        with reading(f"{path}.bounds") as f:
            magic, self.width, low_bits, n, self.n_ids = struct.unpack(HEAD, f.read(struct.calcsize(HEAD)))
            if magic != MAGIC:
                raise ValueError(f"{path} is not an id shard")
            parts = [np.frombuffer(f.read(struct.unpack("<Q", f.read(8))[0]), t) for t in KINDS]
        self.n = n
        self.least, self.nulls, id_bits, _ = struct.unpack(IDS, parts[3].tobytes())
        self.bounds, self.named = Sequence(n, low_bits, *parts[:3]), Sequence(n - self.nulls, id_bits, *parts[4:])

    def span(self, i: int, n: int = 1) -> np.ndarray:
        """Where documents i to i + n - 1 begin, and where the last of them ends."""
        if i:
            return self.bounds.select(i - 1, n + 1).astype(np.int64)
        return np.concatenate([[0], self.bounds.select(0, n).astype(np.int64)])

    def doc_ids(self, i: int, n: int) -> pd.array:
        """Their ids; null ones come first."""
        nulls = min(max(0, self.nulls - i), n)
        rest = self.named.select(i + nulls - self.nulls, n - nulls) if n > nulls else np.zeros(0, np.uint64)
        own = (rest + np.array(self.least).astype(np.uint64)).view(np.int64)
        return pd.array([*[pd.NA] * nulls, *own.tolist()], "Int64")

    def ids(self, low: int, high: int) -> np.ndarray:
        with reading(f"{self.path}.body") as f:
            f.seek(low * self.width)
            return np.frombuffer(f.read((high - low) * self.width), f"<u{self.width}")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, start in zip(batch["path"], batch["start"]):
            shard = Shard(path)
            with reading(f"{path}.body") as f:
                for i in range(0, shard.n, BLOCK_DOCS):
                    bounds = shard.span(i, min(BLOCK_DOCS, shard.n - i))
                    crcs = np.zeros(len(bounds) - 1, np.int64)
                    for k, n in enumerate(np.diff(bounds).tolist()):
                        crc = 0
                        while n:
                            part = f.read(min(n, BLOCK_IDS) * shard.width)
                            ids = np.frombuffer(part, f"<u{shard.width}").astype("<u4")
                            crc, n = zlib.crc32(ids.tobytes(), crc), n - len(ids)
                        crcs[k] = crc
                    yield pd.DataFrame({"doc_id": shard.doc_ids(i, len(crcs)), "start": bounds[:-1] + start, "n_tokens": np.diff(bounds), "ids_crc32": crcs})


def read_ids(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the shards.

    The list is short but names large files: it is dealt to as many tasks as there are shards, a
    number that adaptive execution leaves alone."""
    dealt = shards.repartition(max(1, shards.count()), "path")
    return dealt.mapInPandas(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    return read_ids(write_ids(docs, path, new_folder(spark, "ids"), end_id))
