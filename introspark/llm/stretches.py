"""A worker's memory of byte strings it has seen: a row number for each, found for whole arrays at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .blocks import heads
from .bytewords import spread_hash


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the runs ``starts[i] : starts[i] + lengths[i]``, run after run."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class Flat:
    """Runs of one array, appended to and read by row."""

    def __init__(self, kind: type):
        self.values, self.start, self.length, self.used, self.n = np.zeros(1 << 12, kind), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int32), 0, 0

    @staticmethod
    def _room(array: np.ndarray, n: int) -> np.ndarray:
        return array if n <= len(array) else np.concatenate([array, np.zeros(max(n, len(array) * 3 // 2) - len(array), array.dtype)])

    def append(self, values: np.ndarray, lengths: np.ndarray) -> None:
        n, used = self.n + len(lengths), self.used + len(values)
        self.values, self.start, self.length = self._room(self.values, used), self._room(self.start, n), self._room(self.length, n)
        self.values[self.used : used] = values
        self.start[self.n : n], self.length[self.n : n] = self.used + np.cumsum(lengths) - lengths, lengths
        self.used, self.n = used, n

    def rows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the rows, one after the other, and their lengths."""
        lengths = self.length[at].astype(np.int64)
        return self.values[gather(self.start[at], lengths)], lengths


class Seen:
    """Row numbers of byte strings, by 64-bit hash; the bytes are compared too. Strings whose hash is taken aren't kept."""

    def __init__(self) -> None:
        self.bytes = Flat(np.uint8)
        self._hash, self._row = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def __len__(self) -> int:
        return self.bytes.n

    def find(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of every string ``data[bounds[i] : bounds[i + 1]]``, or -1, and the strings' hashes."""
        hashes, length = spread_hash(data, bounds[:-1], bounds[1:]), np.diff(bounds)
        row = np.full(len(hashes), -1, np.int64)
        if len(self._hash) and len(hashes):
            at = np.minimum(np.searchsorted(self._hash, hashes), len(self._hash) - 1)
            hit = np.flatnonzero(self._hash[at] == hashes)
            hit = hit[self.bytes.length[self._row[at[hit]]] == length[hit]]
            there, _ = self.bytes.rows(self._row[at[hit]])
            differ = there != data[gather(bounds[hit], length[hit])]
            hit = hit[np.bincount(np.repeat(np.arange(len(hit)), length[hit]), differ, len(hit)) == 0]
            row[hit] = self._row[at[hit]]
        return row, hashes

    def add(self, data: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> None:
        """Give new strings the next rows; the caller stores what it keeps of each under the same row."""
        rows = np.arange(self.bytes.n, self.bytes.n + len(lengths), dtype=np.int32)
        self.bytes.append(data, lengths)
        order = np.argsort(hashes, kind="stable")
        hashes, rows = hashes[order], rows[order]
        first = heads(hashes)
        hashes, rows = hashes[first], rows[first]
        at = np.searchsorted(self._hash, hashes)
        if len(self._hash):
            free = self._hash[np.minimum(at, len(self._hash) - 1)] != hashes
            hashes, rows, at = hashes[free], rows[free], at[free]
        self._hash, self._row = np.insert(self._hash, at, hashes), np.insert(self._row, at, rows)


def different(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different strings among ``data`` cut at ``starts``: their bytes, their bounds, and for each string which it is."""
    bounds = np.append(starts, len(data)).astype(np.int64)
    units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    coded = units.dictionary_encode()
    _, offsets, content = coded.dictionary.buffers()
    bounds = np.frombuffer(offsets, np.int64)[: len(coded.dictionary) + 1]
    return np.frombuffer(content, np.uint8)[: bounds[-1]] if content is not None else np.zeros(0, np.uint8), bounds, coded.indices.to_numpy(zero_copy_only=False)


def strings(data: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> list[bytes]:
    content, ends = data.tobytes(), bounds.tolist()
    return [content[ends[i] : ends[i + 1]] for i in which.tolist()]
