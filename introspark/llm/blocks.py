"""Hashed values shuffled in blocks: one row per bucket and batch instead of one row per value."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .bytewords import U64, mixed

#: ``values`` holds 64-bit values; ``owners`` 64-bit ids of their owners, ``counts`` how many values each owner has, in order.
BLOCK = "bucket int, values binary, owners binary, counts binary, sizes binary"
BLOCK_SCHEMA = pa.schema([("bucket", pa.int32()), *[(name, pa.binary()) for name in ("values", "owners", "counts", "sizes")]])
_FIELDS = [c.split()[0] for c in BLOCK.split(", ")]


def bucket_of(values: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket by bits independent of the value's order."""
    return (mixed(values ^ U64(0xC2B2AE3D27D4EB4F)) % U64(n_buckets)).astype(np.int64)


def deal(values: np.ndarray, owner: np.ndarray, owner_ids: np.ndarray, sizes: np.ndarray, n_buckets: int, by_owner: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows of ``BLOCK`` for values with the index of their owner; ``sizes`` is one number per owner.

    Buckets are those of the values, or of the owners' ids.
    """
    if not len(values):
        return
    bucket = bucket_of(owner_ids.astype(np.int64).view(U64)[owner] if by_owner else values, n_buckets)
    order = np.lexsort((owner, bucket))
    bucket, values, owner = bucket[order], values[order], owner[order]
    head = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])])
    counts = np.diff(np.r_[head, len(values)]).astype("<u4")
    ids, size = owner_ids[owner[head]], sizes[owner[head]].astype("<u4")
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    last = np.r_[first[1:], len(values)]
    bounds = np.searchsorted(head, first), np.searchsorted(head, last)
    rows = [
        (int(bucket[a]), values[a:b].tobytes(), ids[c:d].tobytes(), counts[c:d].tobytes(), size[c:d].tobytes())
        for a, b, c, d in zip(first, last, *bounds, strict=True)
    ]
    columns = list(zip(*rows, strict=True))
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=_FIELDS)


def gathered(table: pa.Table, owner_type: type = np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of all blocks of a bucket, each with its owner's id and size."""
    join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    counts = join("counts", "<u4")
    return join("values", np.uint64), np.repeat(join("owners", owner_type), counts), np.repeat(join("sizes", "<u4"), counts).astype(np.int64)


def heads(values: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted values begin."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
