"""Run-length grammars by recompression, and longest common extensions on them.

A sequence of symbols is rewritten in rounds. Block compression replaces every maximal run of one
symbol by a symbol for (symbol, length); pair compression splits the alphabet into two sides
and replaces every left symbol that a right one follows by a symbol for the two. Both
depend on the symbols alone and not on their places, so equal stretches are rewritten alike
except near their ends, and after a logarithmic number of rounds one symbol is left.

A common extension climbs from level to level while symbols agree, taking the part that does not
fill a parent on the way, and descends at the first symbols that differ. All queries of a call
go through the levels together, in numpy; a level is made when a query first needs it. Symbols
are numbered by sorting exact keys, so results do not rest on hashes.
"""

from __future__ import annotations

import numpy as np

from countcast.llm.words import mixed

#: Pair compression tries other sides until this share of the symbols has vanished.
ENOUGH, TRIES = 0.2, 8


def _named(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


class _Level:
    """Symbols of one round, and how the next one groups them."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.symbols = symbols
        self.first = self.parent = None  # first child of each parent (and the end); parent of each symbol
        self.blocks = False

    def group(self, starts: np.ndarray, blocks: bool) -> None:
        n = len(self.symbols)
        self.first = np.append(starts, n)
        self.parent = np.repeat(np.arange(len(starts)), np.diff(self.first))
        self.blocks = blocks

    def rest(self, at: np.ndarray, step: int) -> np.ndarray:
        """Symbols from ``at`` to the end of its parent, going right (1) or left (-1)."""
        up = self.parent[at]
        return self.first[up + 1] - at if step > 0 else at - self.first[up] + 1

    def at_edge(self, at: np.ndarray, step: int) -> np.ndarray:
        up = self.parent[at]
        return self.first[up] == at if step > 0 else self.first[up + 1] - 1 == at


class Grammar:
    """The levels of one sequence. Its first and last symbol must occur nowhere else in it."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.levels = [_Level(symbols.astype(np.int64))]
        self.rounds = 0

    def _next(self, k: int) -> _Level:
        """Level k + 1."""
        if k + 1 == len(self.levels):
            level = self.levels[k]
            self.levels.append(_Level(self._blocks(level) if k % 2 == 0 else self._pairs(level)))
        return self.levels[k + 1]

    def _blocks(self, level: _Level) -> np.ndarray:
        s = level.symbols
        starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        lengths = np.diff(np.append(starts, len(s)))
        level.group(starts, True)
        if len(starts) == len(s):
            return s
        return _named(s[starts] * (lengths.max() + 1) + lengths)

    def _pairs(self, level: _Level) -> np.ndarray:
        s = level.symbols
        best = np.zeros(max(0, len(s) - 1), bool)
        for _ in range(TRIES):
            self.rounds += 1
            side = (mixed(s.astype(np.uint64) * np.uint64(2 * self.rounds + 1)) >> np.uint64(17)) & np.uint64(1)
            for pair in (side[:-1] < side[1:], side[:-1] > side[1:]):
                if np.count_nonzero(pair) > np.count_nonzero(best):
                    best = pair
            if np.count_nonzero(best) >= ENOUGH * len(s):
                break
        starts = np.flatnonzero(~np.append(False, best))
        level.group(starts, False)
        second = np.zeros(len(starts), np.int64)
        paired = np.flatnonzero(np.append(best, False)[starts])
        second[paired] = s[starts[paired] + 1] + 1
        return _named(s[starts] * (int(s.max()) + 2) + second)

    def extensions(self, i: np.ndarray, j: np.ndarray, step: int = 1) -> np.ndarray:
        """How many symbols agree from places ``i`` and ``j`` on, going right (1) or left (-1).

        ``i`` and ``j`` differ everywhere. The unique symbols at the ends stop every extension.
        """
        i, j = i.astype(np.int64), j.astype(np.int64)
        begin = i.copy()
        turned: list[np.ndarray] = []  # by level: the queries whose symbols differ there
        active, k = np.arange(len(i)), 0
        while len(active):
            level = self.levels[k]
            a, b = i[active], j[active]
            same = level.symbols[a] == level.symbols[b]
            turned.append(active[~same])
            active, a, b = active[same], a[same], b[same]
            if not len(active):
                break
            up = self._next(k) and level.parent
            inside = ~(level.at_edge(a, step) & level.at_edge(b, step))
            x, y = level.rest(a, step), level.rest(b, step)
            moved = np.where(inside, np.minimum(x, y), 0) * step
            a, b = a + moved, b + moved
            i[active], j[active] = a, b
            uneven = inside & (x != y)
            turned[k] = np.append(turned[k], active[uneven])
            active, a, b = active[~uneven], a[~uneven], b[~uneven]
            i[active], j[active] = up[a], up[b]
            k += 1
        down = np.empty(0, np.int64)
        for k in range(len(turned) - 1, -1, -1):
            level = self.levels[k]
            if len(down):  # from level k + 1 to its children
                a, b = i[down], j[down]
                a, b = (level.first[a], level.first[b]) if step > 0 else (level.first[a + 1] - 1, level.first[b + 1] - 1)
                same = level.symbols[a] == level.symbols[b]
                taken = np.minimum(level.rest(a, step), level.rest(b, step)) if level.blocks else 1
                moved = np.where(same, taken, 0) * step
                i[down], j[down] = a + moved, b + moved
            down = np.append(down, turned[k])
        return np.abs(i - begin)
