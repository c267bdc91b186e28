"""Ids of byte-level BPE vocabularies, by the tokenizers library with a memo of words.

The vocabulary's own pre-tokenizer cuts a text into words before any merge, and each
word's ids depend on that word alone. So the library's model encodes each word of a
bounded memo once, and a text is the joined ids of its words. The word pattern is written out
for the code points of RANGES, whose classes have long been fixed; a text with any other
character, or with an added token's string, goes to the library whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

from plumbline.llm.memo import Memo

#: Code points whose letter, number and space classes the word pattern spells out.
RANGES = (range(0x0530), range(0x2000, 0x2070))
#: Characters after which a long text is cut at the next space between two ASCII letters.
PART_CHARS = 1 << 18

_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")


def _classes() -> tuple[str, str, str]:
    found: dict[str, list[str]] = {"L": [], "N": [], "S": []}
    for c in (c for r in RANGES for c in map(chr, r)):
        kind = unicodedata.category(c)
        if c in "\t\n\x0b\x0c\r \x85\xa0  " or kind == "Zs":
            found["S"].append(c)
        elif kind[0] in "LN":
            found[kind[0]].append(c)
    return tuple("".join(f"\\u{ord(c):04x}" for c in found[k]) for k in "LNS")


def word_pattern() -> re.Pattern:
    letters, numbers, spaces = _classes()
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+"
        f"|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
    )


class Encoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit bytes, as the library does without special tokens added."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        outside = "".join(f"\\u{r.start:04x}-\\u{r.stop - 1:04x}" for r in RANGES)
        self.whole = re.compile("|".join([*map(re.escape, added), f"[^{outside}]"]))
        self.find, self.memo, self.tokens = word_pattern().findall, Memo(self._word), self.library.model.tokenize
        self.shown = _shown_bytes()

    def encode(self, text: str) -> bytes:
        if self.whole.search(text):
            return self._bytes(self.library.encode(text, add_special_tokens=False).ids)
        ids = self.memo.__getitem__
        return b"".join([b"".join(map(ids, self.find(part))) for part in _parts(text)])

    def _word(self, word: str) -> bytes:
        shown = word.encode().decode("latin-1").translate(self.shown)
        return self._bytes([t.id for t in self.tokens(shown)])

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in ids])


def _shown_bytes() -> dict[int, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in prints)
    return {b: 256 + k for k, b in enumerate(rest)}


def _parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PART_CHARS and (cut := _CUT.search(text, at + PART_CHARS)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
