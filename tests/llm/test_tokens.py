"""Packing, id files and token counts against the libraries themselves."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from plumbline.llm import bytebpe, idfiles, memo, packing, tokencount
from plumbline.llm.common import new_folder

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def odd_texts(n=3000):
    rng = random.Random(5)
    letters = "ab cZ 1²½'s 'll\n\t\r\x1c\x85\xa0\u2028\u2009é\u0300ñжΩ!?-_ <|endoftext|>日😀▁"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def docs(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w%d" % rng.randint(0, 400) for _ in range(rng.choice([1, 5, 60, 300, 2500])))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "null id"), (7, "again"), (7, "again"), (102, "x" * 6000), (103, "été <|endoftext|> 日本")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "start": F.lit("a"), "block": F.lit(2)})


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_encode_as_the_library_does(monkeypatch):
    monkeypatch.setattr(bytebpe, "PART_CHARS", 40)
    monkeypatch.setattr(memo, "KEPT", 50)
    monkeypatch.setattr(memo, "YOUNG", 20)
    own, library = bytebpe.Encoder(BPE), Tokenizer.from_file(BPE)
    for t in [*odd_texts(), "the cat and the hat " * 40]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_bin_completion_places_every_piece_within_bounds(seed):
    rng = np.random.default_rng(seed)
    limit = [10, 64, 200][seed % 3]
    counts = np.zeros(limit + 1, int)
    for x in rng.integers(1, limit + 1, 150):
        counts[x] += rng.integers(1, 9)
    for found in (packing.bin_completion(counts, limit), packing.best_fit(counts, limit)):
        got = np.zeros(limit + 1, int)
        for times, kind in found:
            assert times > 0 and sum(kind) <= limit
            for x in kind:
                got[x] += times
        assert (got == counts).all()
    n = sum(t for t, _ in packing.bin_completion(counts, limit))
    assert packing.lower_bound(counts, limit) <= n <= sum(t for t, _ in packing.best_fit(counts, limit))


def fewest(pieces, limit):
    """The least number of sequences, by trying every piece in every sequence."""
    best = len(pieces)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= pieces[i] and rooms[k] not in rooms[:k]:
                place(i + 1, [*rooms[:k], rooms[k] - pieces[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, limit - pieces[i]])

    place(0, [])
    return best


def test_bin_completion_beats_best_fit():
    beaten = 0
    rng = random.Random(12)
    for _ in range(300):
        limit = rng.choice([10, 17, 30, 50])
        pieces = sorted((rng.randint(1, limit) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = np.bincount(pieces, minlength=limit + 1)
        want, first = fewest(pieces, limit), sum(n for n, _ in packing.best_fit(counts, limit))
        for search in (packing.EXACT, packing.BOUNDED):
            found, proven = packing.complete(counts, limit, search)
            assert sorted((x for n, kind in found for _ in range(n) for x in kind), reverse=True) == pieces
            assert all(sum(kind) <= limit for _, kind in found)
            assert sum(n for n, _ in found) == want or search == packing.BOUNDED and not proven
        assert packing.lower_bound(counts, limit) <= want <= first
        beaten += want < first
    assert beaten  # best fit alone does not always pack the fewest


def test_packing_is_whole_and_gapless(spark):
    rows, df = docs(spark)
    library = Tokenizer.from_file(BPE)
    want = collections.Counter()
    for i, t in rows:
        full = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(full) % 1024 or 1024, len(full) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, crc(full[a:b])] += 1
    out = packing.pack_documents(df, BPE).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    places = collections.defaultdict(list)
    for r in out:
        assert zlib.crc32(r.ids) == r.ids_crc32
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= 1.1 * sum(r.length for r in out) / 1024 + 1


def test_packing_of_nothing(spark):
    assert packing.pack_documents(docs(spark)[1].limit(0), BPE).count() == 0


def test_id_files_round_trip(spark):
    rows, df = docs(spark)
    library = Tokenizer.from_file(BPE)
    got = sorted(idfiles.round_trip(spark, df, BPE).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for r, (i, t) in zip(got, order, strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), crc(ids))
        at += len(ids)
    assert idfiles.round_trip(spark, df.limit(0), BPE).count() == 0


def test_shards_give_single_documents(spark):
    _, df = docs(spark)
    shards = idfiles.write_ids(df, BPE, new_folder(spark, "ids")).collect()
    shard = idfiles.Shard(shards[0].path)
    ends = shard.span(0, shard.n)[1:]
    assert [int(shard.bounds.select(i)[0]) for i in range(shard.n)] == ends.tolist()
    assert [tuple(shard.span(i)) for i in range(shard.n)] == list(zip([0, *ends[:-1]], ends))
    a, b = shard.span(len(ends) - 1)
    assert shard.ids(a, b)[-1] == 0 and len(shard.ids(a, b)) == b - a
    assert sum(s.n_docs for s in shards) == df.count()


@pytest.mark.parametrize("n, top", [(1, 5), (1000, 1000), (700, 10**6), (3000, 50)])
def test_elias_fano_selects(n, top):
    ends = np.sort(np.random.default_rng(n).integers(0, top + 1, n))
    bounds = idfiles.Sequence.of(ends)
    assert len(ends) == 0 or (bounds.select(0, len(ends)) == ends).all()
    for i in {0, n // 3, n - 1}:
        assert bounds.select(i)[0] == ends[i]
    assert bounds.nbytes() <= n * (2 + np.log2(max(1, top / n)) + 1) / 8 + 4 * n / idfiles.SAMPLE + 64


def test_word_memo_counts_as_the_library_does():
    own, library = tokencount.counter(PIECES), SentencePieceProcessor(model_file=PIECES)
    for t in odd_texts():
        assert own.count(t) == len(library.encode(t)), repr(t)


@pytest.mark.parametrize("chunk, overlap", [(1 << 15, 256), (300, 4), (64, 1)])
def test_spliced_counts_are_whole(spark, chunk, overlap):
    rows, df = docs(spark)
    library = SentencePieceProcessor(model_file=PIECES)
    want = collections.Counter((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows)
    out = tokencount.count_tokens(df, PIECES, limit=100, chunk=chunk, overlap=overlap).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in out) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in out)


def test_stable_positions_part_the_encoding():
    own = tokencount.counter(PIECES)
    text = "Die Straße — naïve café, 日本 and\nmore  words here"
    begins = own.boundaries(text)
    for at in range(1, len(text)):
        if own.stable(text, at):
            assert at in begins or text[at - 1] == " "


def test_counts_of_nothing(spark):
    assert tokencount.count_tokens(docs(spark)[1].limit(0), PIECES).count() == 0
