"""Words of a batch of texts, found and hashed on the Arrow buffers without a Python loop over documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import give_back_memory

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: A batch is worked on in pieces of this many bytes of text (one text at least), which bounds memory.
PIECE_BYTES = 1 << 19

_powers = {_BASE: np.ones(1, U64), _BASE_INVERSE: np.ones(1, U64)}


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection with good avalanche)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        out = np.full(max(n, 2 * PIECE_BYTES), U64(base))
        out[0] = 1
        _powers[base] = np.cumprod(out, dtype=U64)
    return _powers[base][:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each."""
    if not batch.num_rows:
        return
    _, offsets = text_buffers(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop
    give_back_memory()


@dataclass
class Runs:
    """Runs of bytes inside texts: ``start``, ``end`` (byte positions), ``text`` (index of the text), all ascending."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray

    @property
    def n_texts(self) -> int:
        return len(self.offsets) - 1

    def per_text(self, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.text, weights, self.n_texts).astype(np.int64)

    def hashes(self) -> np.ndarray:
        """64-bit hash of the bytes of every run."""
        return spread_hash(self.data, self.start, self.end)


def spread_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(data)
    total = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(_BASE, n), out=total[1:])
    raw = (total[end] - total[start]) * powers(_BASE_INVERSE, n + 1)[start]
    return mixed(raw + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def words(column: pa.Array, lower: bool = False) -> Runs:
    """All words of a string column; ``lower`` maps A-Z to a-z first."""
    data, offsets = text_buffers(column)
    if lower:
        data = _LOWER[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Runs(data, offsets, none, none, none)
    space = _SPACE[data]
    filled = offsets[:-1] < offsets[1:]
    before = np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    before[offsets[:-1][filled]] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, space[1:]
    after[offsets[1:][filled] - 1] = True
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(~space & after) + 1
    return Runs(data, offsets, start, end, np.searchsorted(offsets, start, side="right") - 1)


def lines(column: pa.Array) -> Runs:
    """All lines of a string column, split at line feeds; every text has one at least."""
    data, offsets = text_buffers(column)
    cuts = np.flatnonzero(data == 0x0A)
    start = np.sort(np.concatenate([offsets[:-1], cuts + 1]), kind="stable")
    end = np.sort(np.concatenate([cuts, offsets[1:]]), kind="stable")
    per_text = np.bincount(np.searchsorted(offsets, cuts, side="right") - 1, minlength=len(offsets) - 1) + 1
    return Runs(data, offsets, start, end, np.repeat(np.arange(len(offsets) - 1), per_text))


def window_hashes(word_hash: np.ndarray, size: int, multiplier: int = 0xA0761D6478BD642F) -> np.ndarray:
    """Hash of ``size`` consecutive values at every position; other multipliers give independent hashes."""
    n = len(word_hash) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(size):
        out *= U64(multiplier)
        out += word_hash[j : j + n]
    return mixed(out)


def inside(text: np.ndarray, size: int) -> np.ndarray:
    """Whether the ``size`` consecutive words from each position lie in one text."""
    n = len(text) - size + 1
    return text[:n] == text[size - 1 :] if n > 0 else np.zeros(0, bool)


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in one of the windows of ``size`` from ``starts``."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + size, n), -1)
    return np.cumsum(edges[:-1]) > 0
