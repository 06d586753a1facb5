"""Removal of repeated word windows, found by level-wise doubling of the window length.

The first level looks at windows of about a quarter of the length asked for. Those that repeat are extended to twice their
length, level by level, until the length is reached or no candidate survives: for 13 words the levels are 4, 7 and 13.
A window of full length starts from the short window inside it that has the smallest hash, and this one is extended to
the right where that stays inside, else to the left. Equal windows make the same choices, so none is lost, and
neighbours mostly share them, so a level ships a fraction of the positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import BLOCK, BLOCK_SCHEMA, deal, gathered, heads
from .bytewords import covered, inside, pieces, window_hashes, words
from .common import documents, land, registered, shuffle_partitions
from .idfilter import parted

WINDOW = 13
#: Values of one batch of blocks; bounds the memory of a task.
BATCH_VALUES = 1 << 19
#: Text that one bucket of values answers for, about; bounds what the task of a bucket holds, at any size of the input.
BUCKET_BYTES = 1 << 26
#: Stands for a null id: after all ids.
LAST_ID = (1 << 63) - 1
_KEPT = "doc_id long, n_words long, n_removed long, kept string"


def levels(window: int) -> list[int]:
    """Lengths from which doubling (overlapping by one where the length is odd) leads to ``window``, from 4 words or fewer on."""
    out = [window]
    while out[0] > 4:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _elected(h: np.ndarray, length: int, window: int) -> np.ndarray:
    """For every window: where inside it the window of ``length`` with the smallest hash begins, the first of equal ones."""
    short, n = window_hashes(h, length), len(h) - window + 1
    best, at = short[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window - length + 1):
        less = short[j : j + n] < best
        np.copyto(best, short[j : j + n], where=less)
        at[less] = j
    return at


def _extended(h: np.ndarray, lengths: list[int], level: int) -> np.ndarray:
    """For every window of full length: the hash of the part of it that a level looks at."""
    window, n = lengths[-1], len(h) - lengths[-1] + 1
    if n <= 0 or level == len(lengths) - 1:
        return window_hashes(h, window)
    at = _elected(h, lengths[0], window)
    for shorter, length in zip(lengths[:level], lengths[1 : level + 1], strict=True):
        at = np.where(at + length <= window, at, at + shorter - length)
    return window_hashes(h, lengths[level])[np.arange(n) + at]


class _Windows:
    """Windows of the texts of a batch, with the values found repeated at the level before."""

    def __init__(self, part: pa.RecordBatch, lengths: list[int]):
        self.words = words(part.column("text"))
        self.h = self.words.hashes()
        self.lengths = lengths
        self.at = np.flatnonzero(inside(self.words.text, lengths[-1]))
        self.text = self.words.text[self.at]

    def values(self, level: int) -> np.ndarray:
        return _extended(self.h, self.lengths, level)[self.at]

    def hit(self, values: np.ndarray, hits: pa.Array) -> np.ndarray:
        """Which windows have a value in their own text's list of hits."""
        out = np.zeros(len(values), bool)
        bounds = np.searchsorted(self.text, np.arange(self.words.n_texts + 1))
        for i, found in enumerate(hits.to_pylist()):
            if found:
                a, b = bounds[i], bounds[i + 1]
                out[a:b] = np.isin(values[a:b], np.frombuffer(found, np.uint64))
        return out


def _ship(values: list, owner: list, ids: list, n_buckets: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Blocks of one batch. Of several owners of a value only the smallest is shipped; the others' answer is known here."""
    value, at, own = np.concatenate(values), np.concatenate(owner), np.concatenate(ids)
    order = np.lexsort((at, own[at], value))
    value, at = value[order], at[order]
    who = own[at]
    new = np.r_[True, (value[1:] != value[:-1]) | (who[1:] != who[:-1])] if len(value) else np.zeros(0, bool)
    value, at = value[new], at[new]
    head = np.zeros(len(value), bool)
    head[heads(value)] = True
    several = np.repeat(np.diff(np.r_[np.flatnonzero(head), len(value)]) > 1, np.diff(np.r_[np.flatnonzero(head), len(value)]))
    known = several & ~head if last else several
    for chosen, flag in ((head, 0), (known, 1)):
        for block in deal(value[chosen], at[chosen], own, np.full(len(own), flag), n_buckets):
            yield block


def _repeated(docs: DataFrame, level: int, lengths: list[int], n_buckets: int) -> DataFrame:
    """Values of a level that repeat, a row for each document concerned: ``own, values``. ``docs``: ``own, text, hits``.

    Values go to buckets, and answers back to buckets of documents, in blocks: the number of rows does not depend on
    how often a value occurs.

    At the last level "repeats" means that a smaller id has the window; before it, that any other has.
    """
    last = level == len(lengths) - 1

    def map_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, owner, ids, held, size = [], [], [], 0, 0
        for batch in batches:
            for part in pieces(batch, "text"):
                w = _Windows(part, lengths)
                now, text = w.values(level), w.text
                if level:
                    alive = w.hit(w.values(level - 1), part.column("hits"))
                    now, text = now[alive], text[alive]
                first = np.r_[True, (now[1:] != now[:-1]) | (text[1:] != text[:-1])] if len(now) else np.zeros(0, bool)
                values.append(now[first])
                owner.append(text[first] + held)
                ids.append(part.column("own").to_numpy(zero_copy_only=False).astype(np.int64))
                held, size = held + part.num_rows, size + int(first.sum())
                if size > BATCH_VALUES:
                    yield from _ship(values, owner, ids, n_buckets, last)
                    values, owner, ids, held, size = [], [], [], 0, 0
        if ids:
            yield from _ship(values, owner, ids, n_buckets, last)

    def reduce_side(table: pa.Table) -> pa.Table:
        value, own, known = gathered(table, np.int64)
        order = np.lexsort((own, value))
        value, own, known = value[order], own[order], known[order]
        asked = np.flatnonzero(known == 0)
        v, o = value[asked], own[asked]
        head = heads(v)
        count = np.diff(np.r_[head, len(v)])
        least = np.repeat(o[head], count)
        most = np.repeat(np.maximum.reduceat(o, head) if len(head) else o, count)
        found = np.r_[asked[o > least if last else least < most], np.flatnonzero(known == 1)]
        batches = list(deal(value[found], *np.unique(own[found], return_inverse=True)[::-1], np.zeros(len(found)), n_buckets, by_owner=True))
        return pa.Table.from_batches(batches, schema=BLOCK_SCHEMA)

    def answer(table: pa.Table) -> pa.Table:
        value, own, _ = gathered(table, np.int64)
        order = np.lexsort((value, own))
        value, own = value[order], own[order]
        head = heads(own)
        return pa.table({
            "own": pa.array(own[head]), "values": pa.array([value[a:b].tobytes() for a, b in zip(head, np.r_[head[1:], len(own)], strict=True)], pa.binary()),
        })

    found = docs.mapInArrow(map_side, BLOCK).groupBy("bucket").applyInArrow(reduce_side, BLOCK)
    return found.groupBy("bucket").applyInArrow(answer, "own long, values binary")


def _with_hits(docs: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with the values found for them, and documents for which there are none (not shuffled)."""
    maybe, never = parted(docs, replies.select("own"), "own")
    return maybe.join(replies.withColumnRenamed("values", "hits"), "own", "left"), never


def remove_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's text without the words of windows that start in a document with a smaller id too.

    Returns ``doc_id, n_words, n_removed, kept`` (the words left, joined by one space). Windows are judged on the
    input. A batch answers for its own documents before anything is shuffled, so a window that a third of all
    documents share is shipped once per batch. Windows are compared by 64-bit hashes. There are as many buckets of them
    as the measured size of all texts asks for; texts are shuffled only where a window was found.

    Null and empty texts have no words. A null id ranks after all others. Rows that repeat an id don't count as
    repeats of each other. Texts shorter than a window stay whole. Other columns are not read. An empty table gives no rows.
    """
    own = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(LAST_ID))
    docs = docs.select(own.alias("own"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    lengths = levels(window)
    text_bytes = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n_buckets = max(shuffle_partitions(docs.sparkSession), -(-text_bytes // BUCKET_BYTES))
    concerned: DataFrame = docs
    for level in range(len(lengths)):
        replies = land(_repeated(concerned, level, lengths, n_buckets), f"windows-{lengths[level]}")
        concerned, rest = _with_hits(docs, replies)
        if replies.isEmpty():
            break  # no candidate survives

    def cut(with_hits: bool):
        def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, "text"):
                    texts = part.column("text").to_pylist()
                    n_words = np.zeros(len(texts), np.int64)
                    removed = np.zeros(len(texts), np.int64)
                    gone = None
                    if with_hits:
                        w = _Windows(part, lengths)
                        gone = covered(w.at[w.hit(w.values(len(lengths) - 1), part.column("hits"))], window, len(w.h))
                        bounds = np.searchsorted(w.words.text, np.arange(len(texts) + 1))
                    kept = []
                    for i, one in enumerate(texts):
                        own_words = (one or "").encode().split()
                        n_words[i] = len(own_words)
                        if gone is not None and (drop := gone[bounds[i] : bounds[i + 1]]).any():
                            removed[i] = drop.sum()
                            own_words = compress(own_words, (~drop).tolist())
                        kept.append(b" ".join(own_words).decode())
                    yield pa.RecordBatch.from_arrays([
                        part.column("doc_id"), pa.array(n_words), pa.array(removed), pa.array(kept, pa.string()),
                    ], names=[c.split()[0] for c in _KEPT.split(", ")])

        return strip

    return concerned.mapInArrow(cut(True), _KEPT).unionByName(rest.mapInArrow(cut(False), _KEPT))


@registered("op1_substring_dedup", r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
), v AS (
  SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS words FROM p
), g AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY words) AS least FROM v WHERE i <= n - 12
), c AS (
  SELECT DISTINCT doc_id, i + j AS k FROM g, range(0, 13) AS r(j) WHERE least < doc_id
), l AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n
  FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND i = k WHERE k IS NULL GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN l ON d.doc_id = l.doc_id
""")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
