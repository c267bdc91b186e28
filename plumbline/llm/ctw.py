"""Language-model scores by context-tree weighting over bytes, with a unigram base beside them.

A byte is eight binary decisions, from the highest bit on; a decision's node is named by the
bits before it and by the last d bytes before the symbol, d = 0..DEPTH. Each node holds a
Krichevsky-Trofimov estimate of its counts n0, n1 in the training texts. With
P_w = KT / 2 + prod(P_w of the nodes one byte deeper) / 2 (KT alone at full depth), the
frozen tree predicts a decision as

    p_d = w * kt_d + (1 - w) * p_(d+1),   w = KT / (2 P_w),   kt_d = (n_bit + 1/2) / (n0 + n1 + 1)

and as kt_d where no deeper node was seen. The product over a text's bytes and an end byte is
its probability, minus its log2 the code length, of which bits_per_byte is the share of a byte.

Training: one pass counts (DEPTH+1)-grams and words within partitions, and Spark adds them
up. Every gram stays in the tree, a table in the shared folder with a part for each depth.
Depth d is weighted from depth d + 1 in tasks that hold whole contexts of d bytes, and grams are
predicted downwards, depth d with what depth d - 1 left, in tasks that hold whole contexts
of d - 1 bytes: below one context lie at most 65 536 grams of the next depth, whatever the input.

Scoring: the MAX_GRAMS most frequent grams' predictions are a table in each worker, whose size
alone that bounds. All others, those that training never saw among them, are predicted from the
tree as above and joined to the texts that hold them. The bound changes no score.

The base needs the count of every word. The TOP_WORDS most frequent ones are a table of
bounded size in each worker; all others are looked up by a join.

Defined cases: null and empty texts are an end token alone; a null doc_id is hashed as an
empty text; a text of any length is scored in blocks; rows with the same doc_id are scored
each; without training texts the tree predicts 1/2 for each decision and no word is known;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as pads
import xxhash
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from plumbline.llm.common import materialize, new_folder
from plumbline.llm.files import open_fs

DEPTH = 5
MAX_GRAMS = 1 << 22
TOP_WORDS = 1 << 20
#: Bytes whose grams are made at once.
BLOCK = 1 << 20
#: Rows of the tree that a task takes at once, besides whole contexts.
ROWS = 1 << 15

PARTIAL = "gram long, word binary, n long"
ENTRY = "key long, n long, w binary, lpw binary"
STATE = "key long, x binary"
SCORED = "block long, i int, doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, top_score double, score double, rest array<binary>, gram long, k long"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _grams(text: bytes, depth: int) -> Iterator[np.ndarray]:
    """The grams of a text and its end byte, in blocks; bytes before the text count as zero."""
    text = b"\0" * depth + text + b"\0"
    for at in range(depth, len(text), BLOCK):
        part = np.frombuffer(text[at - depth : at + BLOCK], np.uint8).astype(np.uint64)
        n, out = len(part) - depth, np.zeros(len(part) - depth, np.uint64)
        for j in range(depth + 1):
            out = (out << np.uint64(8)) | part[j : j + n]
        yield out


def _lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


class _Sum:
    """Counts of grams: counted two blocks at a time, and merged when the parts outgrow what they merge into."""

    def __init__(self):
        self.parts, self.waiting, self.size = [], [], 0

    def add(self, grams: np.ndarray) -> None:
        self.waiting.append(grams)
        self.size += len(grams)
        if self.size > 2 * BLOCK:
            self.flush()
            if sum(len(k) for k, _ in self.parts[1:]) > max(2 * BLOCK, len(self.parts[0][0])):
                self.merge()

    def flush(self) -> None:
        if self.waiting:
            self.parts.append(np.unique(np.concatenate(self.waiting), return_counts=True))
            self.waiting, self.size = [], 0

    def merge(self) -> None:
        if len(self.parts) > 1:
            keys, n = (np.concatenate(x) for x in zip(*self.parts))
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.parts = [(keys[first], np.add.reduceat(n, first))]


def _count(depth: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, words = _Sum(), Counter()

        def told():
            found = pd.DataFrame({"word": list(words), "n": list(words.values())})
            found["gram"] = pd.array([pd.NA] * len(found), dtype="Int64")
            words.clear()
            return found[["gram", "word", "n"]]

        for batch in batches:
            for text in batch["text"]:
                data = _lowered(text)
                for grams in _grams(data, depth):
                    total.add(grams)
                words.update(data.split())
                words[b""] += 1
                if len(words) > 1 << 18:
                    yield told()
        yield told()
        total.flush()
        total.merge()
        for keys, n in total.parts:
            for at in range(0, len(keys), BLOCK):
                out = pd.DataFrame({"gram": keys[at : at + BLOCK].astype(np.int64), "n": n[at : at + BLOCK]})
                out["word"] = None
                yield out[["gram", "word", "n"]]

    return count


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log KT probability of any sequence with a zeros and b ones."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - np.log(np.pi)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 1/2: recurrence up to 8, then Stirling's series."""
    x, shift = np.asarray(x, np.float64).copy(), np.zeros(np.shape(x))
    while (low := x < 8).any():
        shift[low] += np.log(x[low])
        x[low] += 1
    r = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / x - shift


def _level(keys: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The nodes with k bits known: the first key of each, n0, n1, and the node of each key. keys are sorted."""
    ids = keys >> (8 - k)
    new = np.concatenate([[True], ids[1:] != ids[:-1]])
    first = np.flatnonzero(new)
    both, ones = np.add.reduceat(n, first), np.add.reduceat(n * ((keys >> (7 - k)) & 1), first)
    return first, both - ones, ones, np.cumsum(new) - 1


def _mask(d: int) -> int:
    """The bits of a gram at depth d: d bytes of context and the symbol."""
    return (1 << (8 * d + 8)) - 1


def _packed(rows: np.ndarray) -> list[bytes]:
    """Each row as bytes."""
    rows = np.ascontiguousarray(rows)
    return rows.view(f"V{rows.dtype.itemsize * rows.shape[1]}").ravel().tolist()


def _unpacked(column: pd.Series, dtype: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype).reshape(-1, width)


def _weigh(d: int, leaves: bool):
    """Entries of depth d from those of depth d + 1: weights w (in 255ths) and log P_w of the nodes on a gram's way."""

    def weigh(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("key")
        under, m = batch["key"].to_numpy(np.int64), batch["n"].to_numpy(np.int64)
        below = None if leaves else _unpacked(batch["lpw"], np.float64, 8)
        keys, where = np.unique(under & _mask(d), return_inverse=True)
        n = np.zeros(len(keys), np.int64)
        np.add.at(n, where, m)
        w, lpw = np.zeros((len(keys), 8), np.uint8), np.zeros((len(keys), 8))
        for k in range(8):
            deep, u0, u1, _ = _level(under, m, k)
            first, n0, n1, of = _level(keys, n, k)
            parent = np.searchsorted(keys[first] >> (8 - k), (under[deep] & _mask(d)) >> (8 - k))
            split = np.bincount(parent, weights=_log_kt(u0, u1) if leaves else below[deep, k], minlength=len(first))
            kt = _log_kt(n0, n1)
            both = np.log(0.5) + np.logaddexp(kt, split)
            w[:, k], lpw[:, k] = np.round(255 * np.exp(kt + np.log(0.5) - both))[of], both[of]
        return pd.DataFrame({"key": keys, "n": n, "w": _packed(w), "lpw": _packed(lpw)})

    return weigh


Level = tuple[np.ndarray, np.ndarray, np.ndarray]


def _indexed(keys: np.ndarray, n: np.ndarray, w: np.ndarray) -> Level:
    """Entries of a depth sorted by gram, with running counts."""
    order = np.argsort(keys)
    return keys[order], np.concatenate([[0], np.cumsum(n[order])]), w[order]


def _deeper(state: np.ndarray | None, level: Level, keys: np.ndarray) -> np.ndarray:
    """The state of grams after one more depth: for each bit its probability if no deeper node was seen, the
    part of it that is settled otherwise, and the share that deeper nodes then have."""
    entries, total, w = level
    low = keys & ~0xFF
    a, b = np.searchsorted(entries, low), np.searchsorted(entries, low + 256)
    out = np.zeros((len(keys), 3, 8))
    for k in range(8):
        one = (keys >> (7 - k)) & 1 == 1
        middle = np.clip(np.searchsorted(entries, (((keys >> (8 - k)) << 1) | 1) << (7 - k)), a, b)
        n, n1 = total[b] - total[a], total[b] - total[middle]
        kt = (np.where(one, n1, n - n1) + 0.5) / (n + 1)
        share = w[np.minimum(a, len(w) - 1), k] / 255 if len(w) else 1.0
        stop, go, rest = (kt, 0.0, 1.0) if state is None else state[:, :, k].T
        seen = (a < b) | (state is None)
        out[:, 0, k] = np.where(seen, go + rest * kt, stop)
        out[:, 1, k] = np.where(seen, go + rest * share * kt, stop)
        out[:, 2, k] = np.where(seen, rest * (1 - share), 0.0)
        a, b = np.where(one, middle, a), np.where(one, b, middle)
    return out


def _log10(state: np.ndarray) -> np.ndarray:
    return np.log10(state[:, 0]).sum(axis=1)


def _descend(d: int, depth: int):
    """One depth of predict() for the contexts of a bucket: kind is 0 for entries, 1 for the state a depth above, 2 for grams to predict."""

    def step(batch: pd.DataFrame) -> pd.DataFrame:
        entries, above, wanted = (batch[batch["kind"] == kind] for kind in range(3))
        level = _indexed(entries["key"].to_numpy(np.int64), entries["n"].to_numpy(np.int64), _unpacked(entries["x"], np.uint8, 8))
        keys, state = np.sort(wanted["key"].to_numpy(np.int64)), None
        if d:
            above = above.sort_values("key")
            at = np.searchsorted(above["key"].to_numpy(np.int64), keys & _mask(d - 1))
            state = _unpacked(above["x"], np.float64, 24).reshape(-1, 3, 8)[at]
        state = _deeper(state, level, keys)
        if d == depth:
            return pd.DataFrame({"gram": keys, "lp": _log10(state)})
        return pd.DataFrame({"key": keys, "x": _packed(state.reshape(-1, 24))})

    return step


class Tree:
    """A tree in memory, for looking into small ones; score() works on the table."""

    def __init__(self, folder: str, depth: int):
        self.levels = []
        for d in range(depth + 1):
            found = _read(_part(folder, d), ["key", "n", "w"]).to_pandas()
            self.levels.append(_indexed(found["key"].to_numpy(), found["n"].to_numpy(), _unpacked(found["w"], np.uint8, 8)))

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after its other bytes."""
        state = None
        for d, level in enumerate(self.levels):
            state = _deeper(state, level, grams.astype(np.int64) & _mask(d))
        return _log10(state)


def _part(folder: str, d: int) -> str:
    return f"{folder}/depth-{d}"


def _read(folder: str, columns: list[str]) -> pa.Table:
    fs, path = open_fs(folder)
    return pads.dataset(path, filesystem=fs, format="parquet").to_table(columns=columns, use_threads=False)


_models: dict[tuple, object] = {}


def _held(*key):
    """What a Python worker has read from the shared folder: one model at a time."""
    kind, folder, depth = key
    if key not in _models:
        for old in [k for k in _models if k[0] == kind]:
            del _models[old]
        if kind == "tree":
            _models[key] = Tree(folder, depth)
        else:
            of, value = ("gram", "lp") if kind == "known" else ("h", "n")
            found = _read(folder, [of, value])
            keys, held = found[of].to_numpy(), found[value].to_numpy()
            order = np.argsort(keys)
            _models[key] = (keys[order].astype(np.uint64), held[order]) if kind == "known" else (keys[order], np.log10(held[order] + 0.5))
        pa.default_memory_pool().release_unused()
    return _models[key]


def _look(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted in sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _score(folders: dict[str, str], depth: int):
    #: A sorted word is a gram above the place of its text among those that wait.
    shift = np.uint64(64 - 8 * (depth + 1))
    places = (1 << int(shift)) - 1
    columns = [field.split()[0] for field in SCORED.split(", ")]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng, of = np.random.default_rng(), xxhash.xxh64_intdigest
        for batch in batches:
            grams, lps = _held("known", folders["known"], depth)
            hashes, logs = _held("words", folders["words"], depth)
            block, scores, waiting, size = rng.integers(1 << 62), np.zeros(len(batch)), [], 0

            def flush() -> Iterator[pd.DataFrame]:
                """Adds up what is held, and gives the rest as rows of text, gram and times."""
                if not waiting:
                    return
                sorts = np.sort(np.concatenate([(g << shift) | np.uint64(j) for j, (_, g) in enumerate(waiting)]))
                g, text = sorts >> shift, np.array([i for i, _ in waiting])[(sorts & np.uint64(places)).astype(np.int64)]
                first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                at, there = _look(grams, g[first])
                lp, times = np.where(there, lps[at] if len(lps) else 0.0, 0.0), np.diff(np.append(first, len(g)))
                scores[:] += np.bincount(text, weights=np.repeat(lp, times), minlength=len(scores))
                waiting.clear()
                if there.all():
                    return
                new = np.repeat(~there, times)
                g, text = g[new], text[new]
                first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (text[1:] != text[:-1])]))
                out = pd.DataFrame({"i": text[first], "gram": g[first].astype(np.int64), "k": np.diff(np.append(first, len(g)))})
                for name in ("doc_id", "n_bytes", "n_tokens", "n_known"):
                    out[name] = pd.array([pd.NA] * len(out), dtype="Int64")
                for name in ("held_out", "top_score", "score", "rest"):
                    out[name] = None
                out["block"] = block
                yield out[columns]

            rows = []
            for i, text in enumerate(map(_lowered, batch["text"])):
                for g in _grams(text, depth):
                    waiting.append((i, g))
                    size += len(g)
                    if size >= BLOCK or len(waiting) > places:
                        yield from flush()
                        size = 0
                words = [*text.split(), b""]
                h = np.array([of(w, 42) for w in words], np.uint64).view(np.int64)
                at, there = _look(hashes, h)
                top = float(logs[at[there]].sum()) if len(logs) else 0.0
                rows.append((len(text) + 1, len(words), int(there.sum()), top, [words[j] for j in np.flatnonzero(~there)]))
            yield from flush()
            out = pd.DataFrame(rows, columns=["n_bytes", "n_tokens", "n_known", "top_score", "rest"])
            out["score"], out["i"], out["block"] = scores, np.arange(len(out)), block
            out["doc_id"], out["held_out"] = batch["doc_id"].astype("Int64").array, batch["held_out"].array
            out["gram"] = out["k"] = pd.array([pd.NA] * len(out), dtype="Int64")
            yield out[columns]

    return score


def _threshold(counted: DataFrame, most: int) -> int:
    """The least count t for which at most `most` rows have n >= t."""
    cap = 1 << 16
    sizes = counted.groupBy(F.least("n", F.lit(cap)).alias("n")).agg(F.count("*").alias("k")).collect()
    left, least = most, cap + 1
    for n, k in sorted(map(tuple, sizes), reverse=True):
        if k > left:
            break
        left, least = left - k, n
    return least


def _dealt(rows: DataFrame, context: int, size: int) -> GroupedData:
    """Rows of about `size` dealt to groups that hold whole contexts of so many last bytes."""
    last = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(_mask(context - 1)))
    return rows.groupBy(F.pmod(F.xxhash64(last), F.lit(size // ROWS + 1)).alias("bucket"))


def predict(tree: str, depth: int, wanted: DataFrame) -> DataFrame:
    """wanted(key): different grams. Each with log10 of the probability of its last byte after the others (gram, lp)."""
    spark, size, state = wanted.sparkSession, wanted.count(), None
    for d in range(depth + 1):
        level = spark.read.schema(ENTRY).parquet(_part(tree, d))
        keys = wanted if d == depth else wanted.select(F.col("key").bitwiseAND(F.lit(_mask(d))).alias("key")).distinct()
        rows = level.select(F.lit(0).alias("kind"), "key", "n", F.col("w").alias("x"))
        rows = rows.union(keys.select(F.lit(2), "key", F.lit(0), F.lit(None).cast("binary")))
        if state is not None:
            rows = rows.union(state.select(F.lit(1), "key", F.lit(0), "x"))
        dealt = _dealt(rows, max(d - 1, 0), size + level.count())
        state = dealt.applyInPandas(_descend(d, depth), "gram long, lp double" if d == depth else STATE)
    return state


def train(docs: DataFrame, depth: int = DEPTH, max_grams: int = MAX_GRAMS, top_words: int = TOP_WORDS) -> dict:
    """docs(text): every row is trained on. Folders of the tree and of the tables that workers hold, and N and V."""
    if not 2 <= depth <= 6:
        raise ValueError("depth must be 2 to 6")
    spark = docs.sparkSession
    folders = {k: new_folder(spark, f"model-{k}") for k in ("tree", "known", "words")}
    partial = materialize(docs.select("text").mapInPandas(_count(depth), PARTIAL), "partial-counts")
    grams = partial.filter("gram IS NOT NULL").groupBy(F.col("gram").alias("key")).agg(F.sum("n").alias("n"))
    # At full depth nothing is weighted: no node lies below.
    grams.withColumns({"w": F.lit(b"\xff" * 8), "lpw": F.lit(None).cast("binary")}).write.parquet(_part(folders["tree"], depth))
    level = grams = spark.read.schema(ENTRY).parquet(_part(folders["tree"], depth))
    words = materialize(partial.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")), "words")
    for d in range(depth - 1, -1, -1):
        dealt = _dealt(level, d, level.count())
        dealt.applyInPandas(_weigh(d, d == depth - 1), ENTRY).write.parquet(_part(folders["tree"], d))
        level = spark.read.schema(ENTRY).parquet(_part(folders["tree"], d))
    held = grams.filter(F.col("n") >= _threshold(grams, max_grams)).select("key")
    predict(folders["tree"], depth, held).write.parquet(folders["known"])
    least = _threshold(words, top_words)
    words.filter(F.col("n") >= least).select(F.xxhash64("word").alias("h"), "n").write.parquet(folders["words"])
    n, v = words.agg(F.sum("n"), F.count("*")).first()
    return {"folders": folders, "words": words.filter(F.col("n") < least), "n": n or 0, "v": v, "depth": depth}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs(doc_id, text, held_out) scored by a model of train()."""
    found = materialize(docs.select("doc_id", "text", "held_out").mapInPandas(_score(model["folders"], model["depth"]), SCORED), "scored")
    first, grams = found.filter("gram IS NULL"), found.filter("gram IS NOT NULL").select("block", "i", "gram", "k")
    wanted = materialize(grams.select(F.col("gram").alias("key")).distinct(), "wanted")
    lps = predict(model["folders"]["tree"], model["depth"], wanted)
    deep = grams.join(lps, "gram").groupBy("block", "i").agg(F.sum(F.col("k") * F.col("lp")).alias("gram_score"))
    rest = first.select("block", "i", F.explode("rest").alias("word")).groupBy("block", "i", "word").agg(F.count("*").alias("k"))
    more = rest.join(model["words"], "word", "left").groupBy("block", "i").agg(
        F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("more"),
        F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rest_score"),
    )
    n, v = model["n"], model["v"]
    norm = F.log10(F.lit(float(n)) + 0.5 * (v + 1))
    total = F.col("score") + F.coalesce("gram_score", F.lit(0.0))
    return first.join(more, ["block", "i"], "left").join(deep, ["block", "i"], "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("top_score") + F.coalesce("rest_score", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"), total.alias("score"),
        (-total / (F.log10(F.lit(2.0)) * F.col("n_bytes"))).alias("bits_per_byte"),
    )


def train_and_score(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH,
    max_grams: int = MAX_GRAMS, top_words: int = TOP_WORDS,
) -> DataFrame:
    """Scores of all rows by a model of those that held_out() leaves for training."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), held_out(F.col(doc_id)).alias("held_out"))
    return score(rows, train(rows.filter(~F.col("held_out")), depth, max_grams, top_words))
