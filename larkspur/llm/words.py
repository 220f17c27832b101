"""Words of a block of texts as numpy arrays, without a Python object per word.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; in UTF-8 these bytes never occur inside another
character, so splitting bytes equals splitting characters. Each word gets a 64-bit hash: a polynomial over its bytes
modulo 2**64 whose byte values come from a random table, then mixed.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are handled in blocks of about so many bytes, to bound the memory of a task; a longer text is a block alone.
BLOCK_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_seed = np.random.default_rng(20240229)
_TABLES = _seed.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    y = x >> np.uint64(30)
    x = x ^ y
    x *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(x, np.uint64(27), out=y)
    x ^= y
    x *= np.uint64(0x94D049BB133111EB)
    np.right_shift(x, np.uint64(31), out=y)
    x ^= y
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of them."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        n = max(n, BLOCK_BYTES + 2)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=np.uint64))
        if n > 16 * BLOCK_BYTES:  # for one huge text: not kept
            return out[0], out[1]
        _POWERS[:] = [(out[0], out[1])]
    return _POWERS[0]


_kept: dict = {}
_libc = ctypes.CDLL(None)


def _give_back() -> None:
    """Returns what the process has freed to the machine: a worker is used again by later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    _libc.malloc_trim(0)


def tidy(run):
    """The function of batches, with freed memory given back at the end of each task."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped


def kept(key, make=None):
    """What a Python worker keeps from task to task: one thing at a time, so that operators which follow each other in a
    worker do not add up."""
    if key not in _kept:
        if _kept:
            _kept.clear()
            _give_back()
        if make:
            _kept[key] = make()
    return _kept.get(key)


@dataclass
class Words:
    """buf: bytes of all texts; start, end: of each word in buf; doc: row of each word; count, first: words of each row."""

    buf: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    count: np.ndarray
    first: np.ndarray

    def hashes(self, which: int = 0) -> np.ndarray:
        n = len(self.buf)
        up, down = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLES[which][self.buf] * up[:n], out=total[1:])
        h = (total[self.end] - total[self.start]) * down[self.start]
        return mix(h ^ (self.end - self.start).astype(np.uint64))

    def text(self, i: int) -> str:
        return self.buf[self.start[i] : self.end[i]].tobytes().decode()


def blocks(text: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, pa.Array]]:
    """Row ranges of about ``size`` bytes: (from, to, texts without nulls). Null counts as the empty text."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.cast(pa.large_string()).fill_null("")
    if not len(text):
        return
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    i = 0
    while i < len(text):
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(len(text), max(j, i + 1))
        yield i, j, text.slice(i, j - i)
        i = j


def words(text: pa.Array) -> Words:
    """Words of one block, as blocks() gives it."""
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    n = len(buf)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~SPACE[buf]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    count = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    return Words(buf, offsets, start, end, doc, count, first)


class WordRows:
    """Numbers distinct words 0, 1, .. in the order in which ``learn`` is told of them. Kept by a Python worker from task
    to task, with ``limit`` words at most beside those of one block, so memory is bounded whatever the corpus: when it is
    full, words met in one block only go, and ``keep`` is told which numbers stay (they become 0, 1, .. in this order)."""

    def __init__(self, learn, keep, limit: int = 300_000):
        self.learn, self.keep, self.limit = learn, keep, limit
        self.keys, self.rows, self.met = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _trim(self) -> None:
        stay = self.met > 1
        if stay.sum() > self.limit // 2:
            stay = self.met > np.partition(self.met, len(self.met) - self.limit // 2)[len(self.met) - self.limit // 2]
        number = np.cumsum(stay, dtype=np.int32) - 1
        on = stay[self.rows]
        self.keys, self.rows = self.keys[on], number[self.rows[on]]
        self.met = np.ones(int(stay.sum()), np.int32)
        self.keep(np.flatnonzero(stay))

    def __call__(self, w: Words) -> np.ndarray:
        """The number of each word of a block."""
        h = w.hashes()
        known, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) + len(known) > self.limit and len(self.keys):
            self._trim()
        at = np.searchsorted(self.keys, known)
        new = np.ones(len(known), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != known[inside]
        if new.any():
            self.learn([w.text(i) for i in first[new]])
            n, m = len(self.keys), int(new.sum())
            keys = np.concatenate([self.keys, known[new]])
            rows = np.concatenate([self.rows, np.arange(n, n + m, dtype=np.int32)])
            order = np.argsort(keys, kind="stable")
            self.keys, self.rows = keys[order], rows[order]
            self.met = np.concatenate([self.met, np.zeros(m, np.int32)])
            at = np.searchsorted(self.keys, known)
        if not len(at):
            return np.zeros(0, np.int64)
        self.met[self.rows[at]] += 1
        return self.rows[at[back]].astype(np.int64)


class IdLists:
    """A list of ids for each number that WordRows gives, in two flat arrays."""

    def __init__(self):
        self.size, self.ids, self.start = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], None

    def add(self, size: np.ndarray, ids: np.ndarray) -> None:
        self.size.append(size)
        self.ids.append(ids)
        self.start = None

    def _joined(self) -> None:
        if self.start is None:
            self.size, self.ids = [np.concatenate(self.size)], [np.concatenate(self.ids)]
            self.start = np.cumsum(self.size[0]) - self.size[0]

    def keep(self, rows: np.ndarray) -> None:
        ids, n = self(rows)
        self.size, self.ids, self.start = [n], [ids], None

    def __call__(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these numbers, one list after the other, and the length of each list."""
        self._joined()
        n = self.size[0][row]
        return self.ids[0][np.repeat(self.start[row] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n
