"""Alignment of two tokenizers: common token ends by galloping intersection, and counts of the id pairs that end there."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import pieces, text_buffers
from .common import documents, land, one_thread_libraries, registered
from .stretches import Flat, Seen, different, strings

#: Text that shares one list of id pairs: fewer of them are counted the longer it is.
PIECE = 1 << 21
#: Stretches remembered by one worker, some 150 MB.
REMEMBERED = 1_000_000
#: New stretches handed to the library at once.
LEARNED = 2048
#: Stretches, and id pairs, of one row of a piece's lists.
LISTED = 8192
#: An id pair as one int: the second tokenizer's ids have so many bits.
B_BITS = 15

_PIECES = "piece long, doc_id long, n_a long, n_b long, n_groups long, digest string, units binary, chunk int, unit_pairs binary, unit_links binary, pairs array<int>, pair_n array<long>"
_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_overlaps long"
_BEFORE_WORD = np.zeros(256, bool)
_BEFORE_WORD[0x21:0x7F] = True
_BEFORE_WORD[0xC3:0xE0] = True  # two-byte letters; no Unicode space starts with these bytes


def common_ends(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Index pairs of equal values of two rising lists: every value of the shorter is sought in the longer, in doubling
    steps from the last place and then by bisection between the last two steps."""
    if len(a) > len(b):
        return [(i, j) for j, i in common_ends(b, a)]
    out, at, n = [], 0, len(b)
    for i, value in enumerate(a):
        step, far = 1, at
        while far < n and b[far] < value:
            at, far, step = far + 1, far + step, 2 * step
        at = bisect_left(b, value, at, min(far, n))
        if at == n:
            break
        if b[at] == value:
            out.append((i, at))
            at += 1
    return out


def groups(a: list[int], b: list[int], a_size: list[int], b_size: list[int]) -> list[tuple[list[int], list[int]]]:
    """The ids of either side between places where tokens of both end; both sides spell the same bytes."""
    if len(a) == 1 or len(b) == 1:
        return [(a, b)]
    out, i, j = [], 0, 0
    for x, y in common_ends(list(accumulate(map(a_size.__getitem__, a))), list(accumulate(map(b_size.__getitem__, b)))):
        out.append((a[i : x + 1], b[j : y + 1]))
        i, j = x + 1, y + 1
    return out


def spelled(found: list[tuple[list[int], list[int]]]) -> bytes:
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in found).encode()


class Pair:
    """A byte-level BPE file of the ``tokenizers`` library (A) and a ``sentencepiece`` model (B), with every id's bytes.

    Special tokens are ordinary text. Either tokenizer cuts before a space that stands between a byte that is no space
    and a visible character: A always starts a new word there, and no piece of B has a space after another character
    (checked here). So a text's alignment is that of its stretches, one after the other, each aligned once per worker.
    """

    def __init__(self, a_path: str, b_path: str):
        one_thread_libraries()
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [x for x in range(256) if x not in plain]
        byte_of = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(other)}
        names = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else b"" for name in names]
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            name = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode())
            if re.search("[^▁]▁", name) or len(self.b_bytes) > 1 << B_BITS:
                raise ValueError(f"this model can't be cut at spaces: {name}")
        self.a_size, self.b_size = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        self._forget()

    def _forget(self) -> None:
        self.seen, self.pairs, self.spelling, self.sizes = Seen(), Flat(np.int32), Flat(np.uint8), Flat(np.int64)

    def encode(self, spaced: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of texts that begin with a space."""
        a = []
        for at in range(0, len(spaced), LEARNED):
            a += [e.ids for e in self.a.encode_batch_fast(spaced[at : at + LEARNED], add_special_tokens=False)]
        return list(zip(a, self.b.encode([s[1:] for s in spaced], num_threads=1), strict=True))

    def _learn(self, units: list[bytes], hashes: np.ndarray) -> None:
        """Groups of new stretches. One that its tokens don't spell is kept as such: -1 groups."""
        sizes, pairs, n_pairs, spelling = [], [], [], []
        for unit, (a, b) in zip(units, self.encode([u.decode() for u in units]), strict=True):
            whole = b"".join([self.a_bytes[i] for i in a]) == unit == b"".join([self.b_bytes[i] for i in b])
            found = groups(a, b, self.a_size, self.b_size) if whole else []
            sizes += [len(a), len(b), len(found) if whole else -1]
            pairs += [x[-1] << B_BITS | y[-1] for x, y in found]
            n_pairs.append(len(found))
            spelling.append(spelled(found))
        self.seen.add(np.frombuffer(b"".join(units), np.uint8), np.fromiter(map(len, units), np.int64, len(units)), hashes)
        self.sizes.append(np.array(sizes, np.int64), np.full(len(units), 3))
        self.pairs.append(np.array(pairs, np.int32), np.array(n_pairs, np.int64))
        self.spelling.append(np.frombuffer(b"".join(spelling), np.uint8), np.fromiter(map(len, spelling), np.int64, len(units)))

    def align(self, doc_ids: pa.Array | list, texts: pa.Array) -> dict[str, pa.Array | np.ndarray | list]:
        """Of texts that are neither null nor empty: counts, digest and stretches per text, and the lists of stretches and id pairs they share."""
        data, offsets = text_buffers(pc.binary_join_element_wise(pa.scalar(" "), texts.cast(pa.string()), pa.scalar("")))
        begins = np.zeros(len(data), bool)
        begins[1:-1] = (data[1:-1] == 0x20) & _BEFORE_WORD[data[2:]] & (data[:-2] != 0x20)
        begins[offsets[:-1]] = True
        starts = np.flatnonzero(begins)
        content, bounds, unit = different(data, starts)
        if len(self.seen) > REMEMBERED:
            self._forget()
        row, hashes = self.seen.find(content, bounds)
        new = np.flatnonzero(row < 0)
        row[new] = len(self.seen) + np.arange(len(new))
        self._learn(strings(content, bounds, new), hashes[new])
        sizes = self.sizes.rows(row)[0].reshape(-1, 3)
        first = np.searchsorted(starts, offsets[:-1])
        n_units = np.diff(np.append(first, len(starts)))
        n_a, n_b, n_groups = (np.add.reduceat(sizes[unit, k], first) for k in range(3))
        doubtful = np.minimum.reduceat(sizes[unit, 2], first) < 0
        pairs, n_pairs = self.pairs.rows(row)
        letters, n_letters = self.spelling.rows(row)
        text = letters.tobytes()
        ends = np.cumsum(n_letters).tolist()
        spelling = [text[e - n : e] for e, n in zip(ends, n_letters.tolist(), strict=True)]
        digests = []
        unit_list, extra = unit.tolist(), []
        for k, (f, n, doubt) in enumerate(zip(first.tolist(), n_units.tolist(), doubtful.tolist(), strict=True)):
            if not doubt:
                digests.append(hashlib.sha256(b";".join([spelling[u] for u in unit_list[f : f + n]])).hexdigest())
                continue
            whole = data[offsets[k] : offsets[k + 1]].tobytes()
            a, b = self.encode([whole.decode()])[0]
            alike = b"".join([self.a_bytes[i] for i in a]) == whole == b"".join([self.b_bytes[i] for i in b])
            found = groups(a, b, self.a_size, self.b_size) if alike else []
            n_a[k], n_b[k], n_groups[k] = (len(a), len(b), len(found)) if alike else (0, 0, 0)
            digests.append(hashlib.sha256(spelled(found)).hexdigest() if alike else "")
            n_units[k] = 0
            if alike:  # a stretch of its own, of the whole text
                n_units[k] = 1
                extra.append((k, [x[-1] << B_BITS | y[-1] for x, y in found]))
        kept = np.repeat(~doubtful, np.diff(np.append(first, len(starts))))
        at, owner = unit[kept].astype(np.int64), np.repeat(np.arange(len(doc_ids)), np.diff(np.append(first, len(starts))))[kept]
        if extra:
            at = np.concatenate([at, len(row) + np.arange(len(extra))])
            owner = np.concatenate([owner, [k for k, _ in extra]])
            order = np.argsort(owner, kind="stable")
            at = at[order]
            n_pairs = np.concatenate([n_pairs, [len(p) for _, p in extra]])
            pairs = np.concatenate([pairs, *[np.array(p, np.int32) for _, p in extra]])
        weight = np.repeat(np.bincount(at, minlength=len(n_pairs)), n_pairs)
        used, place = np.unique(pairs, return_inverse=True)
        counts = np.bincount(place, weight, len(used)).astype(np.int64)
        return {
            "doc_id": doc_ids, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "digests": digests, "n_units": n_units, "units": at,
            "unit_pairs": place, "unit_links": n_pairs, "pairs": used, "pair_n": counts,
        }


_SCHEMA = pa.schema([
    ("piece", pa.int64()), *[(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups")], ("digest", pa.string()), ("units", pa.binary()), ("chunk", pa.int32()),
    ("unit_pairs", pa.binary()), ("unit_links", pa.binary()), ("pairs", pa.list_(pa.int32())), ("pair_n", pa.list_(pa.int64())),
])


def _cut(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of whole numbers, as little-endian 32-bit ones."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(values.astype("<i4").tobytes())])


def _rows(piece: int, n: int, **columns: pa.Array | np.ndarray | list) -> pa.RecordBatch:
    """Rows of ``_SCHEMA``; columns that aren't given are null."""
    given = columns | {"piece": np.full(n, piece)}
    return pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)


def piece_rows(piece: int, found: dict) -> Iterator[pa.RecordBatch]:
    """What ``Pair.align`` found as rows of ``_PIECES``: one per document, and the lists they share, in chunks of ``LISTED``."""
    def upto(lengths: np.ndarray) -> np.ndarray:
        return np.append(0, np.cumsum(lengths))

    per_text = {c: found[c] for c in ("doc_id", "n_a", "n_b", "n_groups")}
    yield _rows(piece, len(found["digests"]), **per_text, digest=found["digests"], units=_cut(found["units"], upto(found["n_units"])))
    links, pairs = found["unit_links"], found["pairs"].astype(np.int32)
    chunks = np.arange(-(-max(len(links), len(pairs)) // LISTED))
    of_units, of_pairs = (np.minimum(LISTED * np.arange(len(chunks) + 1), n) for n in (len(links), len(pairs)))
    yield _rows(
        piece, len(chunks), chunk=chunks, unit_pairs=_cut(found["unit_pairs"], upto(links)[of_units]), unit_links=_cut(links, of_units),
        **{c: pa.ListArray.from_arrays(pa.array(of_pairs, pa.int32()), pa.array(values)) for c, values in (("pairs", pairs), ("pair_n", found["pair_n"]))},
    )


_pairs: dict[tuple[str, str], Pair] = {}


def aligned_pieces(docs: DataFrame, a_path: str, b_path: str, piece: int = PIECE) -> DataFrame:
    """Rows of ``_PIECES`` for ``docs`` (``doc_id, text``): documents of about ``piece`` bytes share their lists of stretches and id pairs.

    No row holds a piece: writers, readers and sorts look at the size of what they hold once in so many rows.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a_path, b_path) not in _pairs:
            _pairs[a_path, b_path] = Pair(a_path, b_path)
        pair, n = _pairs[a_path, b_path], TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in pieces(batch, "text", piece):
                yield from piece_rows(n, pair.align(part.column("doc_id"), part.column("text")))
                n += 1

    return docs.mapInArrow(align, _PIECES)


def align_tokens(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", piece: int = PIECE) -> DataFrame:
    """Align the tokens of two tokenizers in every row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256, n_overlaps``.

    A encodes a space and the text, B the text, to which it adds the space. Places where tokens of both end cut them into
    groups; the last tokens of a group are a link. ``count_sum`` adds, over the row's links, how many links of the whole
    corpus hold the same two ids; ``n_best`` counts those links of which no other id of A is linked to the same id of B
    more often. ``n_overlaps`` counts the pairs of tokens whose byte ranges overlap: by ranks, those of a group less one.

    Texts are aligned in pieces. Per piece, the id pairs are counted before they are shuffled, the corpus's counts are
    joined back to the piece's list of pairs, and the piece's documents read theirs from that list. Nothing but pairs
    meets; a pair has one row per piece at most.

    Null and empty texts, and texts that the tokens of either side don't spell byte by byte, have zeros and the digest ''.
    Null ids and repeated rows keep their rows and count each. Other columns are not read. An empty table gives no rows.
    A text is taken whole; the longest bounds a task's memory.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    filled = F.coalesce(F.col("text") != "", F.lit(False))
    found = land(aligned_pieces(rows.filter(filled), a_path, b_path, piece), "aligned-pieces")
    listed = found.filter("chunk is not null").select("piece", "chunk", F.posexplode(F.arrays_zip("pairs", "pair_n")).alias("at", "p")).select(
        "piece", (F.col("chunk") * LISTED + F.col("at")).alias("at"), "p.pairs", "p.pair_n")
    counts = listed.groupBy("pairs").agg(F.sum("pair_n").alias("count"))
    counts = land(counts.withColumn("b", F.col("pairs").bitwiseAND((1 << B_BITS) - 1)), "pair-counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    known = counts.join(most, "b").select("pairs", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = listed.join(known, "pairs").select(F.col("piece").alias("of"), "at", "count", "best")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        docs = left.filter(pc.is_null(left.column("chunk")))
        lists = left.filter(pc.is_valid(left.column("chunk"))).sort_by("chunk")
        order = np.argsort(right.column("at").to_numpy())
        count, best = right.column("count").to_numpy()[order], right.column("best").to_numpy(zero_copy_only=False)[order]
        place, links, units = (np.frombuffer(b"".join(t.column(c).to_pylist()), "<i4") for t, c in ((lists, "unit_pairs"), (lists, "unit_links"), (docs, "units")))
        n_units = pc.binary_length(docs.column("units")).to_numpy() // 4
        n_a, n_b, n_groups = (docs.column(c).to_numpy() for c in ("n_a", "n_b", "n_groups"))

        def added(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
            """Exact sums of runs of values."""
            upto = np.append(0, np.cumsum(values, dtype=np.int64))
            ends = np.cumsum(lengths)
            return upto[ends] - upto[ends - lengths]

        count_sum, n_best = (added(added(x[place], links)[units], n_units) for x in (count, best))
        return pa.table({
            "doc_id": docs.column("doc_id"), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_groups, "n_best": n_best, "count_sum": count_sum,
            "groups_sha256": docs.column("digest"), "n_overlaps": n_a + n_b - n_groups,
        }).cast(pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _ALIGNED.split(", ")]))

    done = found.drop("pairs", "pair_n").groupBy("piece").cogroup(answers.groupBy("of")).applyInArrow(finish, _ALIGNED)
    names = [c.split()[0] for c in _ALIGNED.split(", ")]
    without = rows.filter(~filled).select("doc_id", *[F.lit("").alias(c) if c == "groups_sha256" else F.lit(0).cast("bigint").alias(c) for c in names[1:]])
    return done.unionByName(without)


@registered("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
