"""Vectorised hashing of the words of Arrow string arrays (numpy, over the raw bytes)."""
from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 (public domain): every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


NEAR = 64  # offsets with a ready hash
TABLE = mix(np.arange(NEAR * 256, dtype=U) + U(0x9E3779B97F4A7C15))


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each text begins, and the end); null as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, where, data = texts.buffers()
    at = np.frombuffer(where, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``raw_bytes`` with A-Z as a-z."""
    raw, at = raw_bytes(texts)
    return LOWER[raw], at


def run_hashes(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hash of every run of ``data``; runs begin at ``first`` and cover it without gaps.

    A run's hash is the mixed sum of the hashes of its (offset, byte) pairs."""
    offset = np.arange(len(data)) - np.repeat(first, length)
    h = TABLE[((offset & (NEAR - 1)) << 8) | data]
    if int(length.max()) > NEAR:
        far = np.flatnonzero(offset >= NEAR)
        h[far] = mix(h[far] + (offset[far] // NEAR).astype(U))
    return mix(np.add.reduceat(h, first) + length.astype(U))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, number of words of every text); A-Z count as a-z."""
    data, at = lowered(texts)
    n = len(at) - 1
    solid = ~BLANK[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edges = at[:-1][at[:-1] < len(data)]
    begins[edges] = solid[edges]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, U), np.zeros(n, np.int64)
    place = np.flatnonzero(solid)
    first = np.flatnonzero(begins[place])  # each word's first byte among the solid ones
    length = np.diff(np.r_[first, len(place)])
    h = run_hashes(data[place], first, length)
    return h, np.bincount(np.searchsorted(at, starts, side="right") - 1, minlength=n)[:n]


def slices(table, column: str, size: int):
    """Pieces of a batch or table with about ``size`` bytes of text each (a longer text is a piece of its own)."""
    length = pc.fill_null(pc.binary_length(table.column(column)), 0).to_numpy(zero_copy_only=False) if isinstance(
        table, pa.RecordBatch) else pc.fill_null(pc.binary_length(table.column(column)), 0).to_numpy()
    start = 0
    while start < table.num_rows:
        stop = start + max(1, int(np.searchsorted(np.cumsum(length[start:]), size, side="right")))
        yield table.slice(start, stop - start)
        start = stop


class Lookup:
    """Values of sorted distinct 64-bit keys: one probe of a hash table, a binary search for the few that miss it."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 8))))
        self.slot = np.zeros(1 << self.bits, np.int32 if len(keys) < 1 << 31 else np.int64)
        self.slot[self._hash(self.keys)] = np.arange(len(keys))

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """Values of keys that are all there."""
        at = self.slot[self._hash(wanted)]
        miss = np.flatnonzero(self.keys[at] != wanted)
        if len(miss):
            at[miss] = np.searchsorted(self.keys, wanted[miss])
        return self.values[at]


class Pool:
    """A growing array, of numbers or of rows of ``width``."""

    def __init__(self, dtype, *width: int):
        self.data, self.used = np.zeros((1 << 16, *width), dtype), 0

    def add(self, more: np.ndarray) -> int:
        """Where ``more`` begins."""
        start, self.used = self.used, self.used + len(more)
        if self.used > len(self.data):
            grown = np.zeros((max(2 * len(self.data), self.used), *self.data.shape[1:]), self.data.dtype)
            grown[:start] = self.data[:start]
            self.data = grown
        self.data[start:self.used] = more
        return start


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all runs, one after another."""
    total = np.cumsum(size)
    return np.repeat(start - (total - size), size) + np.arange(total[-1] if len(total) else 0)


class ChunkTable:
    """Codes (arrays of ids) of the text chunks that a worker has met, found by 64-bit hash and compared byte by byte.

    ``ask`` encodes new chunks, given as strings; every distinct one is asked for once, until ``limit``
    entries, 8 ids or 64 bytes of text for each of as many are held and the table starts anew.  About 60 bytes an entry, and
    its text.
    A chunk whose hash another one holds is asked for each time."""

    def __init__(self, dtype, ask, limit: int = 2_000_000):
        self.dtype, self.ask, self.limit = np.dtype(dtype), ask, limit
        self._clear()

    def _clear(self) -> None:
        self.keys, self.place = np.zeros(0, U), np.zeros(0, np.int64)
        # at a key's place: where its ids begin, how many they are, where its text begins, its length, its flag
        self.rows = Pool(np.int64, 5)
        self.ids, self.text = Pool(self.dtype), Pool(np.uint8)

    def _asked(self, data: np.ndarray, first: np.ndarray, length: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these chunks one after another, ids per chunk)."""
        codes = self.ask([(data[a:a + n].tobytes(), f) for a, n, f in zip(first.tolist(), length.tolist(), flags.tolist())])
        size = np.fromiter(map(len, codes), np.int64, len(codes))
        return np.fromiter(chain.from_iterable(codes), self.dtype, int(size.sum())), size

    def _learn(self, keys: np.ndarray, data: np.ndarray, first: np.ndarray, length: np.ndarray, flags: np.ndarray) -> None:
        ids, size = self._asked(data, first, length, flags)
        rows = np.column_stack([self.ids.add(ids) + np.cumsum(size) - size, size,
                                self.text.add(data[_runs(first, length)]) + np.cumsum(length) - length, length, flags])
        at = np.searchsorted(self.keys, keys)
        places = self.rows.add(rows) + np.arange(len(keys))
        self.keys, self.place = np.insert(self.keys, at, keys), np.insert(self.place, at, places)

    def _others(self, rows: np.ndarray, data: np.ndarray, first: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
        """Numbers of the chunks that are not those of ``rows``."""
        differs = (rows[:, 3] != length) | (rows[:, 4] != flags)
        n = np.where(differs, 0, length)
        same = self.text.data[_runs(rows[:, 2], n)] == (data[_runs(first, n)] if differs.any() else data)
        if not same.all():
            differs[np.repeat(np.arange(len(n)), n)[~same]] = True
        return np.flatnonzero(differs)

    def encode(self, data: np.ndarray, first: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks one after another, ids per chunk).  Chunks begin at ``first`` and cover ``data``;
        ``flags``: 0 or 1, chunks with different flags are different (``ask`` gets (bytes, flag))."""
        if not len(first):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        if len(self.keys) > self.limit or self.ids.used > 8 * self.limit or self.text.used > 64 * self.limit:
            self._clear()
        length = np.diff(np.r_[first, len(data)])
        h = run_hashes(data, first, length) + flags.astype(U)
        order = np.argsort(h)
        new = np.r_[True, h[order][1:] != h[order][:-1]]
        distinct = h[order][new]
        inverse = np.empty(len(h), np.int64)
        inverse[order] = np.cumsum(new) - 1
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
            missing = np.flatnonzero(self.keys[at] != distinct)
        else:
            missing = np.arange(len(distinct))
        if len(missing):
            where = order[new][missing]
            self._learn(distinct[missing], data, first[where], length[where], flags[where])
            at = np.searchsorted(self.keys, distinct)
        rows = self.rows.data[self.place[at]][inverse]
        start, size, pool = rows[:, 0], rows[:, 1], self.ids.data
        others = self._others(rows, data, first, length, flags)
        if len(others):
            ids, n = self._asked(data, first[others], length[others], flags[others])
            pool = np.r_[pool[:self.ids.used], ids]
            start[others], size[others] = self.ids.used + np.cumsum(n) - n, n
        return pool[_runs(start, size)], size


def per_text(first: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ids per text from ids per chunk; texts begin at ``at[:-1]``."""
    owner = np.searchsorted(at, first, side="right") - 1
    return np.bincount(owner, weights=size, minlength=len(at) - 1).astype(np.int64)


def chunk_starts(at: np.ndarray, cuts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of chunks: those of non-empty texts and ``cuts``, 1 where a chunk begins a text)."""
    begin = np.unique(at[:-1][at[:-1] < at[1:]])
    mark = np.zeros(n, np.int8)
    mark[cuts] = 1
    mark[begin] = 2
    first = np.flatnonzero(mark)
    return first, (mark[first] == 2).astype(np.int64)
