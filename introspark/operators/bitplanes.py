"""Genotypes of a block of samples and a chunk of markers: planes of bits compared by counting, or lists joined by place where few calls are known."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Markers of one chunk, about, and of one step after which pairs are judged.
CHUNK = 1 << 12
STEP = 1 << 11
#: Samples of one block at most, and bytes of one plane of a block over all markers, or of its calls as a list.
MOST_SAMPLES = 1024
PLANE_BYTES = 8 << 20
#: Bytes of a listed call (row, place, genotype), and calls in common that are counted at once.
CALL_BYTES = 5
MEETINGS = 1 << 21

PACKED = "scope string, block long, chunk long, lo int, n_at int, listed boolean, alleles array<int>, planes array<binary>"
_PACKED = pa.schema([("scope", pa.string()), ("block", pa.int64()), ("chunk", pa.int64()), ("lo", pa.int32()), ("n_at", pa.int32()), ("listed", pa.bool_()), ("alleles", pa.list_(pa.int32())), ("planes", pa.list_(pa.binary()))])
PAIRS = "scope string, i long, j long, a int, b int, n_overlap long, n_shared long, n_assessed long"
_PAIRS = pa.schema([("scope", pa.string()), ("i", pa.int64()), ("j", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), *[(c, pa.int64()) for c in ("n_overlap", "n_shared", "n_assessed")]])


def block_size(n_markers: int, n_samples: int, n_calls: int) -> int:
    """Samples of a block: blocks and samples per block grow alike, so copies of a block grow as the root of the samples."""
    wide = min(max(1, n_markers) / 8, CALL_BYTES * max(1, n_calls) / max(1, n_samples))
    return max(1, min(MOST_SAMPLES, int(PLANE_BYTES / wide), math.ceil(8 * math.sqrt(max(1, n_samples)))))


def _bits(row: np.ndarray, at: np.ndarray, shape: tuple[int, int]) -> bytes:
    bits = np.zeros(shape, bool)
    bits[row, at] = True
    return np.packbits(bits, axis=1, bitorder="little").tobytes()


def _words(n_at: int) -> int:
    return -(-n_at // 64)


def pack(key: tuple, table: pa.Table) -> pa.Table:
    """One block and chunk from its calls ``row, at, n_at, a1, a2``, in the form that takes less room.

    Either planes of bits (presence, then per allele one copy or more, and two), or, where few calls are known, the calls
    themselves as lists by place: rows, places and numbers of genotypes, whose two alleles follow each other in ``alleles``.
    """
    row, at, a1, a2 = (table.column(c).to_numpy() for c in ("row", "at", "a1", "a2"))
    lo, n_at = int(row.min()), table.column("n_at")[0].as_py()
    shape = (int(row.max()) - lo + 1, _words(n_at) * 64)
    alleles = np.unique(np.concatenate([a1, a2]))
    pairs = np.minimum(a1, a2).astype(np.int64) << 32 | np.maximum(a1, a2)
    genotypes, number = np.unique(pairs, return_inverse=True)
    listed = len(genotypes) <= 256 and CALL_BYTES * len(row) < (1 + 2 * len(alleles)) * shape[0] * shape[1] // 8
    if listed:
        order = np.argsort(at, kind="stable")
        planes = [(row[order] - lo).astype(np.uint16).tobytes(), at[order].astype(np.uint16).tobytes(), number[order].astype(np.uint8).tobytes()]
        alleles = np.stack([genotypes >> 32, genotypes & 0xFFFFFFFF], axis=1).ravel()
    else:
        planes = [_bits(row - lo, at, shape)]
        for allele in alleles:
            for wanted in ((a1 == allele) | (a2 == allele), (a1 == allele) & (a2 == allele)):
                planes.append(_bits(row[wanted] - lo, at[wanted], shape))
    scope, block, chunk = (k.as_py() for k in key)
    return pa.Table.from_pydict({
        "scope": [scope], "block": [block], "chunk": [chunk], "lo": [lo], "n_at": [n_at], "listed": [listed], "alleles": [alleles.astype(np.int32)], "planes": [planes],
    }, _PACKED)


def common_bits(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bits that every row of ``left`` shares with every row of ``right``."""
    out = np.empty((len(left), len(right)), np.int32)
    for k, one in enumerate(left):
        out[k] = np.bitwise_count(one & right).sum(axis=1, dtype=np.int32)
    return out


class Block:
    """The calls of one block by chunk: planes as rows of 64-bit words, or lists. Rows below the first with a call are left out."""

    def __init__(self, table: pa.Table, block: int):
        self._planes: dict[int, tuple[int, dict[object, np.ndarray]]] = {}
        self.lists: dict[int, tuple[np.ndarray, ...]] = {}
        self.markers: dict[int, int] = {}
        self.n = 0
        for at in np.flatnonzero(table.column("block").to_numpy() == block).tolist():
            chunk, lo, n_at, listed, alleles = (table.column(c)[at].as_py() for c in ("chunk", "lo", "n_at", "listed", "alleles"))
            parts = [plane.as_buffer() for plane in table.column("planes")[at].values]
            self.markers[chunk] = n_at
            if listed:
                row, place, number = (np.frombuffer(part, kind) for part, kind in zip(parts, (np.uint16, np.uint16, np.uint8), strict=True))
                both = np.array(alleles, np.int32).reshape(-1, 2)[number]
                self.lists[chunk] = row.astype(np.int64) + lo, place.astype(np.int64), both[:, 0], both[:, 1]
                self.n = max(self.n, lo + int(row.max()) + 1)
                continue
            names = ["present", *[(allele, copies) for allele in alleles for copies in (1, 2)]]
            planes = {name: np.frombuffer(part, np.uint64).reshape(-1, _words(n_at)) for name, part in zip(names, parts, strict=True)}
            self._planes[chunk] = lo, planes
            self.n = max(self.n, lo + len(planes["present"]))

    def _parts(self, chunk: int) -> tuple[int, dict[object, np.ndarray]]:
        """The planes of a chunk; of a listed one they are made when a block with planes meets it."""
        if chunk not in self._planes and chunk in self.lists:
            row, at, x, y = self.lists[chunk]
            words = _words(self.markers[chunk])

            def made(wanted: np.ndarray) -> np.ndarray:
                return np.frombuffer(_bits(row[wanted], at[wanted], (self.n, words * 64)), np.uint64).reshape(-1, words)

            planes: dict[object, np.ndarray] = {"present": made(np.ones(len(row), bool))}
            for allele in np.unique(np.concatenate([x, y])).tolist():
                planes[allele, 1], planes[allele, 2] = made((x == allele) | (y == allele)), made((x == allele) & (y == allele))
            self._planes[chunk] = 0, planes
        return self._planes.get(chunk, (0, {}))

    def copies(self, chunk: int) -> set[object]:
        """The planes of allele copies in a chunk."""
        return set(self._parts(chunk)[1]) - {"present"}

    def plane(self, chunk: int, name: object, words: slice) -> np.ndarray:
        """Some words of a plane, for all rows of the block."""
        lo, planes = self._parts(chunk)
        part = planes[name][:, words] if name in planes else np.zeros((0, 0), np.uint64)
        out = np.zeros((self.n, words.stop - words.start), np.uint64)
        out[lo : lo + len(part), : part.shape[1]] = part
        return out

    def calls(self, chunk: int, words: slice) -> np.ndarray:
        """Calls of every row in some words of a chunk."""
        if chunk in self.lists:
            row, at = self.lists[chunk][:2]
            return np.bincount(row[(at >= words.start * 64) & (at < words.stop * 64)], minlength=self.n)
        return np.bitwise_count(self.plane(chunk, "present", words)).sum(axis=1, dtype=np.int64)

    def listed(self, chunk: int, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """The listed calls of the rows that have a place, with that place."""
        row, at, x, y = self.lists[chunk]
        kept = place[row] >= 0
        return place[row[kept]], at[kept], x[kept], y[kept]

    def sparse(self, chunk: int) -> bool:
        """Whether a chunk has no planes: it is listed or empty."""
        return chunk in self.lists or chunk not in self.markers


def meet(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], n_at: int, overlap: np.ndarray, shared: np.ndarray) -> int:
    """Add the common calls of two lists (row, place, alleles; by place) and the alleles they share; their number."""
    row, at, x, y = left
    other, place, u, v = right
    size = np.bincount(place, minlength=n_at)
    first = np.cumsum(size) - size
    ends = np.cumsum(size[at])
    start, n = 0, int(ends[-1]) if len(ends) else 0
    while start < len(at):
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + MEETINGS, "right")))
        times = size[at[start:stop]]
        a = np.repeat(np.arange(start, stop), times)
        b = np.arange(len(a)) - np.repeat(ends[start:stop] - times - done, times) + np.repeat(first[at[start:stop]], times)
        pair = row[a] * overlap.shape[1] + other[b]
        same_x, same_y = x[a] == u[b], y[a] == v[b]
        common = np.where(same_x & same_y, 2, same_x | same_y | (x[a] == v[b]) | (y[a] == u[b]))
        overlap += np.bincount(pair, minlength=overlap.size).reshape(overlap.shape)
        shared += np.bincount(pair, common, minlength=shared.size).astype(np.int64).reshape(shared.shape)
        start = stop
    return n


def _steps(left: Block, right: Block) -> Iterator[tuple[int, slice, int]]:
    """Chunk, words and number of markers of each step: lists meet by whole chunks, planes by parts of them."""
    markers = left.markers | right.markers
    for chunk in sorted(markers):
        step = markers[chunk] if left.sparse(chunk) and right.sparse(chunk) else STEP
        for start in range(0, markers[chunk], step):
            stop = min(start + step, markers[chunk])
            yield chunk, slice(start // 64, -(-stop // 64)), stop - start


def _places(kept: np.ndarray, n: int) -> np.ndarray:
    """The place of each of ``n`` rows among those kept, or -1."""
    out = np.full(n, -1, np.int64)
    out[kept] = np.arange(len(kept))
    return out


def pair_kernel(min_ibs: float, floor: int, n_markers: int):
    """Pairs of two blocks by their planes, in steps over the markers.

    After each step, what is left bounds every pair: at most the smaller number of calls left are still in common, and at
    least both numbers less the markers left. A pair is settled once it can't reach the floor, or has surely reached it and
    could not be similar if all that is left agreed. Samples without an open pair are dropped, and the scan ends with the
    last open pair. Pairs that stay are counted in full. Chunks that both blocks list are joined by place, as many steps as
    find fewer common calls than there are pairs without judging between.
    """

    def pairs(key: tuple, table: pa.Table) -> pa.Table:
        scope, i, j = (k.as_py() for k in key)
        left = Block(table, i)
        right = left if i == j else Block(table, j)
        steps = list(_steps(left, right))
        rows, columns = np.arange(left.n), np.arange(right.n)
        calls = [[b.calls(c, w) for c, w, _ in steps] for b in ((left,) if i == j else (left, right))]
        left_over, right_over = (np.flip(np.cumsum(np.flip(np.array(x).reshape(len(steps), -1), 0), 0), 0) for x in (calls[0], calls[-1]))
        markers_left = n_markers
        overlap, shared = np.zeros((left.n, right.n), np.int64), np.zeros((left.n, right.n), np.int64)
        wanted = rows[:, None] < columns[None, :] if i == j else np.ones(overlap.shape, bool)
        assessed, similar = np.zeros(overlap.shape, bool), wanted.copy()
        unjudged = overlap.size
        for at in range(len(steps) + 1):
            if at == len(steps) or unjudged >= len(rows) * len(columns):
                here = np.ix_(rows, columns)
                ends = [x[at] if at < len(steps) else np.zeros_like(x[0]) for x in (left_over, right_over)]
                ends = [ends[0][rows][:, None], ends[1][columns][None, :]]
                most, least = np.minimum(*ends), np.maximum(0, ends[0] + ends[1] - markers_left)
                reached, possible = overlap[here] + least >= floor, overlap[here] + most >= floor
                assessed[here] |= reached & wanted[here]
                best = shared[here] + 2 * most >= (2 * min_ibs) * (overlap[here] + most) - 1e-6
                similar[here] &= possible & best
                if at == len(steps):
                    break
                opened = wanted[here] & possible & (similar[here] | ~reached)
                rows, columns = rows[opened.any(axis=1)], columns[opened.any(axis=0)]
                if not len(rows):
                    break
                unjudged = 0
            chunk, words, n = steps[at]
            markers_left -= n
            if left.sparse(chunk) and right.sparse(chunk):
                if chunk in left.lists and chunk in right.lists:
                    sides = [b.listed(chunk, _places(kept, b.n)) for b, kept in ((left, rows), (right, columns))]
                    found = [np.zeros((len(rows), len(columns)), np.int64) for _ in range(2)]
                    n_met = meet(*sides, n, *found)
                    if n_met:
                        overlap[np.ix_(rows, columns)] += found[0]
                        shared[np.ix_(rows, columns)] += found[1]
                    unjudged += n_met
                continue
            here = np.ix_(rows, columns)
            overlap[here] += common_bits(left.plane(chunk, "present", words)[rows], right.plane(chunk, "present", words)[columns])
            for name in sorted(left.copies(chunk) & right.copies(chunk)):
                shared[here] += common_bits(left.plane(chunk, name, words)[rows], right.plane(chunk, name, words)[columns])
            unjudged = overlap.size
        # the quotient of two whole numbers, as the threshold is defined
        ibs = np.divide(shared, 2.0 * overlap, out=np.zeros(overlap.shape), where=overlap > 0)
        a, b = np.nonzero(similar & assessed & (overlap >= max(1, floor)) & (ibs >= min_ibs))
        n = len(a) + 1
        return pa.Table.from_pydict({
            "scope": [scope] * n, "i": [i] * n, "j": [j] * n, "a": [*a.tolist(), None], "b": [*b.tolist(), None], "n_overlap": [*overlap[a, b].tolist(), 0],
            "n_shared": [*shared[a, b].tolist(), 0], "n_assessed": [*[0] * len(a), int(assessed.sum())],
        }, _PAIRS)

    return pairs
