"""Matching blocks of two texts or lists, the same as the standard library's SequenceMatcher gives, found by equal runs in place of pairs of characters.

Its longest match in a part of both texts is the longest run of characters that are
anchors (those of the second text that are not more than a hundredth of it, where it has
200 and more), the first in the first text, then the first in the second, widened by
what is equal on either side. Whether a part has an equal run of n anchors is a
question to two sets, so a part costs its anchors and not their pairs, and memory is
a few numbers for each anchor.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence

#: From so many characters on, those that are more than a hundredth of the second text are no anchors.
LONG = 200
#: Runs up to this length are tried one by one, from the longest; beyond, by halving.
FEW = 8
_STEP = 64


class _Runs:
    """Starts of runs of n anchors in a text, and a key for each: runs are equal if their keys are."""

    def __init__(self, x: Sequence[str], starts: list[int], codes: list[dict]):
        self.codes = codes
        self.starts: dict[int, list[int]] = {1: starts}
        self.length: dict[int, int] = {}
        n, last = 0, -1
        for i in reversed(self.starts[1]):
            n = n + 1 if i == last - 1 else 1
            self.length[i] = n
            last = i
        self.longest = max(self.length.values(), default=0)
        # ids[p]: a number for each run of 2 ** p anchors, by its start
        self.ids: list[dict[int, int]] = [{i: codes[0].setdefault(x[i], len(codes[0])) for i in self.starts[1]}]
        self.known: dict[int, list] = {1: list(self.ids[0].values())}

    def of(self, n: int) -> tuple[list[int], list]:
        if n not in self.known:
            length = self.length
            self.starts[n] = [i for i, k in length.items() if k >= n][::-1]
            p = n.bit_length() - 1
            while len(self.ids) <= p:
                half = 1 << (len(self.ids) - 1)
                if len(self.codes) <= len(self.ids):
                    self.codes.append({})
                code, low = self.codes[len(self.ids)], self.ids[-1]
                self.ids.append({i: code.setdefault((low[i], low[i + half]), len(code)) for i, k in length.items() if k >= 2 * half})
            ids, rest = self.ids[p], n - (1 << p)
            self.known[n] = [(ids[i], ids[i + rest]) for i in self.starts[n]] if rest else [ids[i] for i in self.starts[n]]
        return self.starts[n], self.known[n]

    def within(self, n: int, start: int, end: int) -> tuple[list[int], list, int, int]:
        """All starts and keys, and which of them lie in a part."""
        at, keys = self.of(n)
        return at, keys, bisect_left(at, start), bisect_left(at, end - n + 1)


def _equal_run(a: _Runs, b: _Runs, n: int, part: tuple[int, int, int, int]) -> tuple[int, int] | None:
    """The first equal run of n anchors in a part: its place in a, then in b."""
    starts, keys, i, k = a.within(n, part[0], part[1])
    if i >= k:
        return None
    b_starts, b_keys, j, m = b.within(n, part[2], part[3])
    if j >= m:
        return None
    some = set(b_keys[j:m])
    if some.isdisjoint(keys[i:k]):
        return None
    while keys[i] not in some:
        i += 1
    return starts[i], b_starts[b_keys.index(keys[i], j)]


def _longest_run(a: _Runs, b: _Runs, most: int, part: tuple[int, int, int, int]) -> tuple[int, int, int]:
    most = min(most, part[1] - part[0], part[3] - part[2])
    found, low = (part[0], part[2]), 0
    while most - low > FEW:
        n = (low + most + 1) // 2
        at = _equal_run(a, b, n, part)
        if at:
            found, low = at, n
        else:
            most = n - 1
    for n in range(most, low, -1):
        at = _equal_run(a, b, n, part)
        if at:
            return *at, n
    return *found, low


class Held:
    """A text or list that several are held against: its anchors and their runs are found once."""

    def __init__(self, b: Sequence[str]):
        n = len(b)
        self.text = b
        self.anchors = {c for c, k in Counter(b).items() if n < LONG or k <= n // 100 + 1}
        self.codes: list[dict] = [{}]
        self.runs = _Runs(b, self.starts(b), self.codes)

    def starts(self, x: Sequence[str]) -> list[int]:
        anchors = self.anchors
        return [i for i, c in enumerate(x) if c in anchors]


def _blocks(a: Sequence[str], held: Held, least: float = 0.0) -> list[tuple[int, int, int]] | None:
    """Blocks as they are found; none once the parts that are left can't bring them to least characters."""
    b, y = held.text, held.runs
    la, lb = len(a), len(b)
    x = _Runs(a, held.starts(a), held.codes)
    parts, found = [(0, la, 0, lb, min(x.longest, y.longest))], []
    # found, and the shorter side of each part
    most_in_all = min(la, lb)
    while parts and most_in_all >= least:
        alo, ahi, blo, bhi, most = parts.pop()
        i, j, n = _longest_run(x, y, most, (alo, ahi, blo, bhi))
        size = n
        # what is equal on either side belongs to the block, anchors or not
        while i - _STEP >= alo and j - _STEP >= blo and a[i - _STEP : i] == b[j - _STEP : j]:
            i, j, size = i - _STEP, j - _STEP, size + _STEP
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        k, m = i + size, j + size
        while k + _STEP <= ahi and m + _STEP <= bhi and a[k : k + _STEP] == b[m : m + _STEP]:
            k, m = k + _STEP, m + _STEP
        while k < ahi and m < bhi and a[k] == b[m]:
            k, m = k + 1, m + 1
        most_in_all -= min(ahi - alo, bhi - blo)
        if k > i:
            found.append((i, j, k - i))
            most_in_all += k - i + min(i - alo, j - blo) + min(ahi - k, bhi - m)
            if alo < i and blo < j:
                parts.append((alo, i, blo, j, n))
            if k < ahi and m < bhi:
                parts.append((k, ahi, m, bhi, n))
    return found if most_in_all >= least else None


def matching_blocks(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of each block, in order, blocks that touch joined; the last one is empty, at both ends."""
    la, lb = len(a), len(b)
    if a == b:
        return [(0, 0, la), (la, lb, 0)] if la else [(0, 0, 0)]
    out: list[tuple[int, int, int]] = []
    for i, j, n in sorted(_blocks(a, Held(b))):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return [*out, (la, lb, 0)]


def shared(a: Sequence[str], held: Held, least: float) -> int | None:
    """Characters in the matching blocks of a text and a held one; none where they are fewer than least, which mostly shows before all blocks are found."""
    if a == held.text:
        return len(a)
    found = _blocks(a, held, least)
    return None if found is None else sum(n for _, _, n in found)


def places(x: str) -> dict[str, int]:
    """Where each character of a text is, as bits of a number."""
    at: dict[str, int] = {}
    bit = 1
    for c in x:
        at[c] = at.get(c, 0) | bit
        bit <<= 1
    return at


def common(at: dict[str, int], n: int, y: str) -> int:
    """Characters in the longest common subsequence of a text of n characters, given by its places, and another: matching blocks never have more.

    A bit of the row is unset where the subsequence with what was seen of y grows, all
    places of the first text at once (Hyyrö's form of the method).
    """
    row = every = (1 << n) - 1
    for p in map(at.get, y):
        if p:
            u = row & p
            row = ((row + u) | (row - u)) & every
    return n - row.bit_count()


def ratio(blocks: list[tuple[int, int, int]]) -> float:
    """Twice the characters in matching blocks over all characters of both; 1 for two empty texts."""
    every = blocks[-1][0] + blocks[-1][1]
    return 2.0 * sum(n for _, _, n in blocks) / every if every else 1.0


def opcodes(blocks: list[tuple[int, int, int]]) -> list[tuple[str, int, int, int, int]]:
    """(op, start and end in a, start and end in b) of all that lies between blocks: replace, delete or insert."""
    out, i, j = [], 0, 0
    for k, m, n in blocks:
        op = "replace" if i < k and j < m else "delete" if i < k else "insert" if j < m else None
        if op:
            out.append((op, i, k, j, m))
        i, j = k + n, m + n
    return out
