"""k-way merge by a tree of losers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class LoserTree:
    """Merges sorted runs; ties go to the run that stands first.

    Inner nodes hold the loser of the match played there. When the winner's run moves on,
    only the matches between its leaf and the root are played again: log2(k) comparisons a row.
    """

    _END = object()

    def __init__(self, runs: list[Iterable]):
        self.runs = [iter(r) for r in runs]
        self.size = max(1, len(runs))
        self.heads = [next(r, self._END) for r in self.runs] or [self._END]
        self.losers = [-1] * self.size
        self.winner = self._build()

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is self._END or y is self._END:
            return y is self._END and (x is not self._END or a < b)
        return x < y or (a < b and not y < x)

    def _build(self) -> int:
        won = [-1] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = won[2 * node], won[2 * node + 1]
            won[node], self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        return won[1] if self.size > 1 else 0

    def __iter__(self) -> Iterator:
        while (row := self.heads[self.winner]) is not self._END:
            yield row
            run = self.winner
            self.heads[run] = next(self.runs[run], self._END)
            node = (run + self.size) // 2
            while node:
                if self._beats(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run
