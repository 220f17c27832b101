"""Recompression of word sequences: locally consistent symbols for equal substrings.

A round first replaces each maximal run of one symbol by a symbol, then each pair of neighbours whose coins say
(left, right). A symbol's name is a hash of what it stands for, so all tasks name equal substrings alike without
talking to each other. Pairs longer than the round's bound are not joined, so that what lies outside a window can
change only a few symbols at its edges: those are left out of the window's interior, round by round.
"""

from __future__ import annotations

import numpy as np

from .words import mix, powers

#: The longest pair, in words, that each round joins.
ROUNDS = (4, 6, 8, 12, 16, 24)
_RUN, _PAIR = np.uint64(0xA24BAED4963EE407), np.uint64(0xD6E8FEB86659FD93)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _named(tag: np.uint64, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a ^ tag) * _ODD + b)


def _parse(words: np.ndarray, doc: np.ndarray, rounds=ROUNDS):
    """Of each level, from 0: names, first word of each symbol (and the end), and two maps from the boundaries of the
    level below: the first boundary at or after it, and the last at or before it, that no other context can move."""
    n = len(words)
    sym, pos, home = words, np.arange(n + 1, dtype=np.int32), doc
    same = np.arange(n + 1, dtype=np.int32)
    yield sym, pos, same, same
    for r, bound in enumerate(rounds, 1):
        m = len(sym)
        head = np.ones(m, bool)
        head[1:] = (sym[1:] != sym[:-1]) | (home[1:] != home[:-1])
        i = np.flatnonzero(head)
        size = np.diff(np.append(i, m))
        run = np.cumsum(head, dtype=np.int32) - 1
        name = sym[i].copy()
        many = size > 1
        name[many] = _named(_RUN, name[many], size[many].astype(np.uint64))
        pos, home, k = pos[np.append(i, m)], home[i], len(i)
        length = np.diff(pos)
        coin = ((mix(name ^ np.uint64(r)) >> np.uint64(17)) & np.uint64(1)).astype(bool)
        short = length < bound
        join = np.zeros(k, bool)
        join[:-1] = coin[:-1] & ~coin[1:] & (length[:-1] + length[1:] <= bound) & (home[1:] == home[:-1])
        second = np.zeros(k, bool)
        second[1:] = join[:-1]
        before = np.zeros(k + 1, np.int32)  # symbols of the new level before each one of the old
        np.cumsum(~second, out=before[1:])
        # rightwards: past the run that holds the boundary's symbol, and past a symbol that may close a pair
        x = np.empty(m + 1, np.int32)
        x[:m] = run + 1
        x[m] = k
        up = before[x + np.append(~coin & short, False)[x]]
        # leftwards: before the run that holds the symbol that ends there, and before one that may open a pair
        x[0] = 0
        x[1:] = run
        down = before[x - np.append(False, coin & short)[x]]
        j = np.flatnonzero(~second)
        sym = name[j].copy()
        p = join[j]
        sym[p] = _named(_PAIR, name[j[p]], name[j[p] + 1])
        pos, home = pos[np.append(j, k)], home[j]
        yield sym, pos, up, down


def anchors(words: np.ndarray, doc: np.ndarray, window: int, rounds=ROUNDS):
    """Runs of successive windows that one symbol stands for.

    A window (``window`` words of one document) is stood for by a symbol of the highest round that leaves it an interior:
    the longest one there, of equal ones that of the smallest name, then the leftmost. This depends on the window's words
    alone, so equal windows anywhere have equal symbols.

    Returns first and last + 1 start (word indexes) of each run of windows, its symbol's name, a hash of all words that
    the run covers, and the round.
    """
    n = len(words)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none
    left = right = np.arange(n + 1, dtype=np.int32)
    last = n - window + 1
    inside = doc[:last] == doc[window - 1 :]
    level, which = np.full(last, -1, np.int8), np.zeros(last, np.int32)
    names, todo = [], []
    for r, (sym, pos, up, down) in enumerate(_parse(words, doc, rounds)):
        if r:
            left, right = up[left], down[right]
        a, b = left[:last], right[window:]
        names.append((sym, pos))
        level += (a < b) & inside
        todo.append((a, b))
    for r, ((sym, pos), (a, b)) in enumerate(zip(names, todo)):
        at = np.flatnonzero(level == r)
        if not len(at):
            continue
        a, b = a[at], b[at]
        new = np.ones(len(at), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        i = np.flatnonzero(new)
        best = _longest(sym, np.diff(pos), a[i], b[i])
        which[at] = np.repeat(best, np.diff(np.append(i, len(at))))
    new = np.ones(last, bool)
    new[1:] = (level[1:] != level[:-1]) | (which[1:] != which[:-1]) | (doc[1:last] != doc[: last - 1])
    first = np.flatnonzero(new)
    end = np.append(first[1:], last)
    ok = level[first] >= 0
    first, end = first[ok], end[ok]
    name = np.zeros(len(first), np.uint64)
    for r, (sym, _) in enumerate(names):
        on = level[first] == r
        name[on] = sym[which[first[on]]]
    return first, end, name, spans(words, first, end + window - 1), level[first]


def spans(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words[start:end]."""
    up, down = powers(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] ^ (end - start).astype(np.uint64))


def _longest(sym: np.ndarray, length: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    best, at = np.full(len(a), -1, np.int64), a.copy()
    size = b - a
    for k in range(int(size.max())):
        on = np.flatnonzero(size > k)
        x = a[on] + k
        better = (length[x] > best[on]) | ((length[x] == best[on]) & (sym[x] < sym[at[on]]))
        on, x = on[better], x[better]
        best[on], at[on] = length[x], x
    return at
