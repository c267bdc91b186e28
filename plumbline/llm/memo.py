"""A bounded memo of words for one Python worker."""

from __future__ import annotations

from collections.abc import Callable

#: Words kept that were met again, and words kept that were met once.
KEPT, YOUNG = 1 << 17, 1 << 16


class Memo(dict):
    """memo[word] is of(word). Words met once wait apart, so that rare ones do not push out common ones."""

    def __init__(self, of: Callable[[str], object]):
        super().__init__()
        self.of, self.young = of, {}

    def __missing__(self, word: str):
        found = self.young.pop(word, None)
        if found is None:
            found = self.of(word)
            if len(self.young) >= YOUNG:
                self.young.clear()
            self.young[word] = found
        else:
            if len(self) >= KEPT:
                self.clear()
            self[word] = found
        return found
