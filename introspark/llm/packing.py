"""Packing documents into sequences: first-fit decreasing over a tournament tree of bin capacities."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import pieces
from .common import documents, land, registered
from .tokens import PIECE, encoder

CAPACITY = 2048
#: Pieces of one randomised group, on average.
GROUP = 4096
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, row long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item. Items go by falling size (ties in the order given), each to the first bin with room.

    The tree holds the largest free capacity below every node; unused bins are free in full, so the walk down, left
    wherever the left side has room, ends at the first bin that fits, new or not.
    """
    n = len(sizes)
    leaves = 1
    while leaves < n:
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for item in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[item]), 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[item], offsets[item] = node - leaves, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as token ids, cut at multiples of ``capacity``: a row per piece, with its ids if ``with_ids``.

    The tokenizer must be one that lower-cases texts itself.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, end_id, fold_case=True)
        row = 0
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                ids, offsets = own.encode(part.column("text"))
                total = np.diff(offsets)
                count = -(-total // capacity)
                of = np.repeat(np.arange(part.num_rows), count)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * capacity
                length = np.minimum(total[of] - start, capacity)
                begin = offsets[:-1][of] + start
                blobs = [ids[b : b + n].astype("<u4", copy=False) for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").cast(pa.int64()).take(pa.array(of)), pa.array(start), pa.array(length),
                    pa.array([zlib.crc32(b) for b in blobs], pa.int64()), pa.array(total[of]),
                    pa.array([b.tobytes() for b in blobs] if with_ids else [None] * len(blobs), pa.binary()),
                    pa.array(np.arange(row, row + len(of))),
                ], names=[c.split()[0] for c in PIECES.split(", ")])
                row += len(of)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, group: int = GROUP,
         with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Place every piece of every document: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    Longer documents are cut at multiples of ``capacity``. Pieces are dealt to randomised groups of about ``group``
    pieces by a hash that holds the row's position too, so that neither a repeated id nor a long document fills a
    group; each group is packed on its own. Only numbers are shuffled unless ``with_ids``.

    Null and empty texts are the end id alone. Null ids are placed like any id. Repeated rows are packed each. Other
    columns are not read. An empty table gives no rows.
    """
    found = land(token_pieces(docs, tokenizer, end_id, capacity, with_ids, doc_id, text), "pack-pieces")
    groups = max(1, -(-found.count() // group))
    dealt = found.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "row"), F.lit(groups)))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), capacity)
        first = table.column("group")[0].as_py() << 32
        table = table.append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(offsets))
        return table.select([c.split()[0] for c in PACKED.split(", ")])

    return dealt.groupBy("group").applyInArrow(place, PACKED)


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of every sequence and its documents in order, from pieces packed ``with_ids``; a sequence is bounded by its capacity."""
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("p")).select(
        "sequence_id", F.transform("p", lambda x: F.struct(x["doc_id"], x["start"], x["length"])).alias("documents"),
        F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
    )


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@registered("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), word_bpe()).drop("ids")
