"""Matching blocks of two sequences, and whether two texts share enough characters: small helpers of Arrow functions.

The longest common run comes first, the earliest of equal ones, then those left and right of it.  A run is found by a
suffix automaton of one side, read along the other, so each step is linear in its stretch; common words cost nothing
extra.  Items are numbers (words or code points).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Hashable, Iterator, Sequence


class Automaton:
    """The suffix automaton of a sequence: states with their transitions, longest length, link and first end."""

    def __init__(self, items: Sequence[Hashable]):
        self.go: list[dict] = [{}]
        self.length, self.link, self.end = [0], [-1], [-1]
        last = 0
        for at, x in enumerate(items):
            now = self._state({}, self.length[last] + 1, 0, at)
            p = last
            while p >= 0 and x not in self.go[p]:
                self.go[p][x] = now
                p = self.link[p]
            if p >= 0:
                q = self.go[p][x]
                if self.length[q] == self.length[p] + 1:
                    self.link[now] = q
                else:
                    copy = self._state(dict(self.go[q]), self.length[p] + 1, self.link[q], self.end[q])
                    while p >= 0 and self.go[p].get(x) == q:
                        self.go[p][x] = copy
                        p = self.link[p]
                    self.link[q] = self.link[now] = copy
            last = now

    def _state(self, go: dict, length: int, link: int, end: int) -> int:
        self.go.append(go)
        self.length.append(length)
        self.link.append(link)
        self.end.append(end)
        return len(self.length) - 1


def longest(a: Sequence, b: Sequence) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest common run, the first in a and then in b; length 0 if there is none."""
    if not len(a) or not len(b):
        return 0, 0, 0
    automaton, state, size, best = Automaton(b), 0, 0, (0, 0, 0)
    go, length, link, end = automaton.go, automaton.length, automaton.link, automaton.end
    for k, x in enumerate(a):
        while state and x not in go[state]:
            state = link[state]
            size = length[state]
        if x in go[state]:
            state, size = go[state][x], size + 1
        if size > best[2]:
            best = k - size + 1, end[state] - size + 1, size
    return best


def blocks(a: Sequence, b: Sequence) -> Iterator[tuple[int, int, int]]:
    """The matching blocks, in no order; a caller that has enough may stop."""
    todo = [(0, len(a), 0, len(b))]
    while todo:
        # the largest stretches first: they decide how much is shared
        todo.sort(key=lambda t: min(t[1] - t[0], t[3] - t[2]))
        a0, a1, b0, b1 = todo.pop()
        i, j, n = longest(a[a0:a1], b[b0:b1])
        if n:
            i, j = a0 + i, b0 + j
            yield i, j, n
            todo += [t for t in ((a0, i, b0, j), (i + n, a1, j + n, b1)) if t[0] < t[1] and t[2] < t[3]]


def matching(a: Sequence, b: Sequence) -> list[tuple[int, int, int]]:
    """The matching blocks in order; neighbouring ones are one."""
    out: list[tuple[int, int, int]] = []
    for i, j, n in sorted(blocks(a, b)):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


def shares(a: str, b: str, least: float) -> bool:
    """Whether twice the characters in matching blocks are at least that share of all characters of both texts.

    Blocks can't hold more than the characters that both texts have, so unlike texts need no search; the search ends when
    enough is found, or when what is left can't be enough.
    """
    need = least * (len(a) + len(b)) / 2
    most = (Counter(a) & Counter(b)).total()
    if need <= 0 or most < need:
        return need <= 0
    found = 0
    for _, _, n in blocks(a, b):
        found += n
        if found >= need:
            return True
    return False


def word_changes(old: str, new: str) -> list[str]:
    """Runs of words: "= kept", "- gone", "+ new"."""
    a, b, out, i, j = old.split(), new.split(), [], 0, 0
    for x, y, n in [*matching(a, b), (len(a), len(b), 0)]:
        for mark, words in (("-", a[i:x]), ("+", b[j:y]), ("=", a[x : x + n])):
            if words:
                out.append(f"{mark} {' '.join(words)}")
        i, j = x + n, y + n
    return out
