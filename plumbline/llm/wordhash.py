"""Words of many texts at once, and their 64-bit hashes, as numpy arrays over Arrow's own buffers.

A word is a stretch of bytes other than space and U+0009 to U+000D. Its hash mixes eight bytes at a
time. Spans of words are hashed by differences of one running polynomial sum, whatever their lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Multipliers of the splitmix64 finaliser (fixed values).
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: An odd base of the polynomial and its inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Words of more bytes are hashed one by one.
LONG_WORD = 1 << 12

#: Bytes of text whose words are in a Python worker's memory at once; a longer text is there alone.
BLOCK = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    x = (x ^ x >> np.uint64(30)) * MIX_A
    x = (x ^ x >> np.uint64(27)) * MIX_B
    return x ^ x >> np.uint64(31)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1) modulo 2 ** 64."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(1 << max(10, n.bit_length()), base, np.uint64)
        held[0] = 1
        _powers[base] = held = np.multiply.accumulate(held)
    return held[:n]


class Texts:
    """The words of an Arrow array of texts: first and last byte of each, and the first word of each text.

    fold makes lower case of A-Z."""

    def __init__(self, texts: pa.Array, fold: bool = False):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        n = int(offsets[-1] - offsets[0]) if len(offsets) else 0
        self.data = np.zeros(n + 8, np.uint8)  # eight more bytes, so that each word can be read by eights
        if n:
            self.data[:n] = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        if fold:  # A-Z to a-z
            self.data[(self.data >= 65) & (self.data <= 90)] |= 32
        self.offsets = offsets - offsets[0]
        word = ~_BLANK[self.data[:n]]
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        edges = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        begins[edges] = word[edges]
        ends[edges - 1] = word[edges - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def lines(self) -> np.ndarray:
        """The first words of lines, in order; lines without words are none."""
        breaks = np.searchsorted(np.flatnonzero(self.data == 10), self.starts)
        new = np.ones(len(self.starts), bool)
        new[1:] = breaks[1:] != breaks[:-1]
        new[self.first[self.first < len(new)]] = True
        return np.flatnonzero(new)

    def hashes(self) -> np.ndarray:
        """The hash of each word, by its bytes alone."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        eights = np.ndarray(len(self.data) - 7, "<u8", self.data.data, strides=(1,))
        size = self.ends - self.starts
        out = mixed((eights[self.starts] & _MASKS[np.minimum(size, 8)]) ^ size.astype(np.uint64) * MIX_A)
        at, left = 8, np.flatnonzero((size > 8) & (size <= LONG_WORD))
        while len(left):
            more = eights[self.starts[left] + at] & _MASKS[np.minimum(size[left] - at, 8)]
            out[left] = mixed(out[left] * MIX_B ^ more)
            at += 8
            left = left[size[left] > at]
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            out[i] = xxhash.xxh64_intdigest(self.data[self.starts[i] : self.ends[i]].data)
        return out


def slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most BLOCK bytes, or of one row."""
    at, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and total + n > BLOCK:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def text_blocks(batch: pa.RecordBatch, fold: bool = False) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Rows of a batch with a column `text`, few enough at a time, and their words."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    for a, b in slices(sizes):
        part = batch.slice(a, b - a)
        yield part, Texts(part.column("text"), fold)


def sums(hashes: np.ndarray) -> np.ndarray:
    """Running sums that span_hashes takes differences of."""
    out = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(BASE, len(hashes)), out=out[1:])
    return out


def span_hashes(running: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """The hash of the words from begin to end, of each pair; equal words have equal hashes wherever they stand."""
    return mixed((running[end] - running[begin]) * powers(INVERSE, len(running))[begin] + np.uint64(seed))
