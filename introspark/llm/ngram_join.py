"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection of sorted arrays.

1. Every text becomes its sorted set of hashed shingles. Equal sets are one class from here on.
2. A class puts the first shingles of its set, in an order common to all, into tiles: two sets as similar as asked
   share one of these. The order is by hash, but shingles found in many classes come last, so that passages shared by
   many documents don't meet in tiles. The order decides the work, never the result.
3. A tile is a shingle and a band of set sizes. Its hub is the member with the largest share of shingles found in other
   classes: of a group of edited copies, the original. Each member is paired with the hub it shares most tiles with;
   after these pairs have made components, only pairs across components are looked at, in the same or the next band.
   Tiles of shingles that are common and yet needed (large groups of near copies) are cut into blocks of members, and
   block meets block in a task; a pair counts in the first tile it shares only.
4. A pair is dropped if the bits in which its bitmap signatures differ leave too small an overlap. The others meet as
   sorted arrays at the hub's side, which holds one set and streams the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import BLOCK, deal, gathered, heads
from .bytewords import U64, inside, mixed, pieces, window_hashes, words
from .common import documents, free_names, land, registered, shuffle_partitions
from .graph import components
from .idfilter import probably

SIZE = 5
PERCENT = 75
#: Classes in a tile from which its shingle goes last in the order.
COMMON = 16
#: Shingles that may go last; their list is sent to all tasks, so it is bounded (8 MB). If more are common, ``COMMON`` rises.
MOST_COMMON = 1 << 20
#: Shingles are counted in prefixes this much longer than needed, until a round finds at most one new in so many.
LOOK_AHEAD = 2.0
FEW_NEW = 8
#: Members of one hub that meet in one task.
HUB_MEMBERS = 2000
#: Values of one batch of blocks; bounds the memory of a task.
BLOCK_VALUES = 1 << 18
#: Members of one block of a large tile.
BLOCK_MEMBERS = 4096
_BANDS = math.log(100 / PERCENT)


def _by_text(values: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Order by text, then value; the second sort is a radix sort where the texts of a piece allow."""
    order = np.argsort(values)
    of = text[order]
    return order[np.argsort(of.astype(np.uint16) if len(of) and of.max() < 1 << 16 else of, kind="stable")]


class Common:
    """Shingles that go last, as a sorted array behind a bitmap."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.values >> U64(44)] = True

    def has(self, values: np.ndarray) -> np.ndarray:
        out = self.bits[values >> U64(44)]
        if len(self.values):
            maybe = np.flatnonzero(out)
            at = np.minimum(np.searchsorted(self.values, values[maybe]), len(self.values) - 1)
            out[maybe] = self.values[at] == values[maybe]
        return out


class Sets:
    """Shingle sets of the texts of a column: ``values`` sorted within ``offsets``."""

    def __init__(self, column: pa.Array, size: int = SIZE):
        w = words(column, lower=True)
        h, n_words = w.hashes(), w.per_text()
        ok = np.flatnonzero(inside(w.text, size))
        values, text = [window_hashes(h, size)[ok]], [w.text[ok]]
        first = np.cumsum(n_words) - n_words
        for k in range(1, size):  # a shorter text is one shingle
            at = np.flatnonzero(n_words == k)
            if len(at):
                values.append(window_hashes(h, k, 0xE7037ED1A0B428DB + 2 * k)[first[at]])
                text.append(at)
        values, text = np.concatenate(values), np.concatenate(text)
        order = _by_text(values, text)
        values, text = values[order], text[order]
        new = np.r_[True, (values[1:] != values[:-1]) | (text[1:] != text[:-1])] if len(values) else np.zeros(0, bool)
        self.values, self.text = values[new], text[new]
        self.n = np.bincount(self.text, minlength=w.n_texts).astype(np.int64)
        self.offsets = np.r_[0, np.cumsum(self.n)]

    def _sums(self, values: np.ndarray) -> np.ndarray:
        total = np.r_[U64(0), np.cumsum(values, dtype=U64)]
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of every set."""
        return mixed(self._sums(mixed(self.values ^ U64(0x589965CC75374CC3)))), mixed(self._sums(mixed(self.values ^ U64(0x1D8E4E27C47D124F))))

    def classes(self) -> list[bytes]:
        """128-bit name of every set, big-endian."""
        a, b = self.keys()
        return [x.tobytes() for x in np.stack([a, b], axis=1).astype(">u8")]

    def prefix(self, common: Common, stretch: float = 1.0) -> np.ndarray:
        """Positions in ``values`` of the shingles of every set that must include one shared with any similar set, and as
        many more as ``stretch`` says."""
        need = np.ceil((self.n - -(-PERCENT * self.n // 100) + 1) * stretch)[self.text]
        rank = np.arange(len(self.values)) - self.offsets[:-1][self.text]  # ``text`` is sorted and values are within it
        last = common.has(self.values)
        before = np.r_[0, np.cumsum(last)]
        rank_rare = rank - (before[:-1] - before[self.offsets[:-1]][self.text])
        n_rare = (self.n - np.diff(before[self.offsets]))[self.text]
        return np.flatnonzero(np.where(last, n_rare + rank - rank_rare, rank_rare) < need)

    def signature(self, i: int) -> bytes:
        """Bitmap of set ``i``, about one bit per shingle: every shingle flips one bit, so two bitmaps differ in at most
        as many bits as the sets have shingles that are not shared."""
        n = int(self.n[i])
        bits = min(max(64, 1 << (n - 1).bit_length()), 8192) if n else 64
        at = (self.values[self.offsets[i] : self.offsets[i + 1]] >> U64(20)) & U64(bits - 1)
        return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """Bits in which two signatures differ, the longer folded to the shorter one's length."""
    if len(a) < len(b):
        a, b = b, a
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    length = 8 * len(a)
    while length > 8 * len(b):
        length //= 2
        x = (x >> length) ^ (x & ((1 << length) - 1))
    return (x ^ y).bit_count()


def enough(shared: int, n_a: int, n_b: int) -> bool:
    return 100 * shared >= PERCENT * (n_a + n_b - shared)


def document_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, n, cls, signature`` of every row; no set: null class."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                s = Sets(part.column("text"))
                some = s.n > 0
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").cast(pa.int64()), pa.array(s.n), pa.array([c if x else None for c, x in zip(s.classes(), some, strict=True)], pa.binary()),
                    pa.array([s.signature(i) if x else None for i, x in enumerate(some)], pa.binary()),
                ], names=["doc_id", "n", "cls", "signature"])

    return docs.mapInArrow(named, "doc_id long, n long, cls binary, signature binary")


def _postings(docs: DataFrame, common: np.ndarray, n_buckets: int, known: np.ndarray | None = None, stretch: float = 1.0) -> DataFrame:
    """Prefix shingles dealt to buckets; a class counts once per batch. With ``known``, an earlier ``common``: only those
    that weren't in the prefix then."""
    shared = docs.sparkSession.sparkContext.broadcast((Common(common), known if known is None else Common(known)))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, owners, sizes, ids = [], [], [], []
            seen: set[int] = set()
            held, size = 0, 0
            for part in pieces(batch, "text"):
                s = Sets(part.column("text"))
                key = s.keys()[0]
                fresh = np.zeros(len(key), bool)
                for i, k in enumerate(key.tolist()):
                    if s.n[i] and k not in seen:
                        seen.add(k)
                        fresh[i] = True
                now, then = shared.value
                at = s.prefix(now, stretch)
                if then is not None:
                    at = np.setdiff1d(at, s.prefix(then, stretch), assume_unique=True)
                at = at[fresh[s.text[at]]]
                values.append(s.values[at])
                owners.append(s.text[at] + held)
                ids.append(key)
                sizes.append(s.n)
                held, size = held + len(key), size + len(at)
                if size > BLOCK_VALUES:
                    yield from deal(np.concatenate(values), np.concatenate(owners), np.concatenate(ids), np.concatenate(sizes), n_buckets)
                    values, owners, sizes, ids, held, size = [], [], [], [], 0, 0
            if ids:
                yield from deal(np.concatenate(values), np.concatenate(owners), np.concatenate(ids), np.concatenate(sizes), n_buckets)

    return docs.mapInArrow(dealt, BLOCK)


def _by_token(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (shingle, class) of a bucket with the set sizes, sorted."""
    token, owner, n = gathered(table)
    order = np.lexsort((owner, token))
    token, owner, n = token[order], owner[order], n[order]
    new = np.r_[True, (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])] if len(token) else np.zeros(0, bool)
    return token[new], owner[new], n[new]


def common_shingles(docs: DataFrame, n_buckets: int) -> np.ndarray:
    """Shingles that stand in the prefixes of more than ``COMMON`` classes, at most ``MOST_COMMON``.

    When these go last, others move into the prefixes; only those are counted next, until hardly any of them is common.
    Prefixes are counted with what will probably move in, which saves rounds.
    """

    def counted(table: pa.Table) -> pa.Table:
        token, _, _ = _by_token(table)
        head = heads(token)
        count = np.diff(np.r_[head, len(token)])
        many = count > COMMON
        return pa.table({"token": pa.array(token[head][many].view(np.int64)), "n": pa.array(count[many])})

    common, known = np.zeros(0, U64), None
    while len(common) < MOST_COMMON:
        found = land(_postings(docs, common, n_buckets, known, LOOK_AHEAD).groupBy("bucket").applyInArrow(counted, "token long, n long"), "common-shingles")
        least = COMMON
        while found.filter(F.col("n") > least).count() > MOST_COMMON - len(common):
            least *= 2
        new = found.filter(F.col("n") > least).select("token").toPandas()["token"].to_numpy(np.int64).view(U64)
        common, known = np.union1d(common, new), common
        if FEW_NEW * len(new) <= len(common):
            break
    return common


def tiles(docs: DataFrame, common: np.ndarray, n_buckets: int) -> DataFrame:
    """Shingles shared by several classes: ``token, key, n, band`` per member, ``key`` being half of the class's name."""

    def shared(table: pa.Table) -> pa.Table:
        token, owner, n = _by_token(table)
        head = heads(token)
        count = np.diff(np.r_[head, len(token)])
        keep = np.repeat(count > 1, count)
        band = np.floor(np.log(np.maximum(n[keep], 1)) / _BANDS).astype(np.int64)
        return pa.table({"token": pa.array(token[keep].view(np.int64)), "key": pa.array(owner[keep].view(np.int64)), "n": pa.array(n[keep]), "band": pa.array(band)})

    return _postings(docs, common, n_buckets).groupBy("bucket").applyInArrow(shared, "token long, key long, n long, band long")


def hub_pairs(members: DataFrame) -> DataFrame:
    """Each member of ``members`` (``token, key, n, band``) with the hub it shares most tiles with: ``a`` (the hub), ``b``."""
    share = members.groupBy("key").agg((F.count(F.lit(1)) / F.first("n")).alias("share"))
    hubs = members.join(share, "key").groupBy("token", "band").agg(F.max(F.struct("share", "key", "n")).alias("top"))
    hubs = hubs.select("token", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])).alias("band"), F.col("top.key").alias("hub"), F.col("top.n").alias("hub_n"))
    met = members.join(hubs, ["token", "band"]).filter(f"key <> hub AND 100 * least(n, hub_n) >= {PERCENT} * greatest(n, hub_n)")
    best = met.groupBy("key", "hub").count().groupBy("key").agg(F.max(F.struct("count", "hub")).alias("best"))
    return best.select(F.col("best.hub").alias("a"), F.col("key").alias("b"))


def cross_pairs_small(met: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of keys across roots in tiles of at most ``COMMON`` members, in the same or the next band."""
    high = met.select("token", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"), F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("root_b"))
    low = met.select("token", "band", F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("root_a"))
    return low.join(high, ["token", "band"]).filter(
        f"root_a <> root_b AND n_a <= n_b AND (n_a < n_b OR a < b) AND 100 * n_a >= {PERCENT} * n_b").select("a", "b").distinct()


def _folded(signature: bytes, length: int) -> bytes:
    while len(signature) > length:
        half = len(signature) // 2
        signature = (int.from_bytes(signature[:half], "little") ^ int.from_bytes(signature[half:], "little")).to_bytes(half, "little")
    return signature


def block_pairs(n: np.ndarray, root: np.ndarray, block: np.ndarray, signatures: list[bytes], tokens: list[np.ndarray], token: int) -> Iterator[tuple[int, int]]:
    """Pairs of members of two blocks (or one) of a tile, from different roots, whose sizes and signatures leave room for
    the overlap and that share no tile with a smaller token. Members are sorted by ``n``."""
    lengths = np.array([len(s) for s in signatures])
    upto = np.searchsorted(n, n * 100 // PERCENT, side="right")
    two = block.min() != block.max()
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero((lengths == length) | (lengths == 2 * length))
        bits = np.zeros((len(n), length // 8), np.uint64)
        bits[at] = np.frombuffer(b"".join(_folded(signatures[i], length) for i in at), np.uint64).reshape(len(at), -1)
        for i in np.flatnonzero(lengths == length).tolist():
            j = np.arange(i + 1, upto[i])
            j = j[(root[j] != root[i]) & ((block[j] != block[i]) if two else True)]
            if len(j):
                room = (n[i] + n[j] - np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)) // 2
                for k in j[100 * room >= PERCENT * (n[i] + n[j] - room)].tolist():
                    shared = np.intersect1d(tokens[i], tokens[k], assume_unique=True)
                    if shared[0] == token:
                        yield i, k


def cross_pairs_large(met: DataFrame, classes: DataFrame) -> DataFrame:
    """The same for larger tiles (``met`` has their size as ``c``), block by block."""
    tokens = met.groupBy("key").agg(F.sort_array(F.collect_list("token")).alias("tokens"))  # of one prefix
    rows = met.join(tokens, "key").join(classes.select("key", "cls", "signature"), "key")
    rows = rows.withColumn("k", F.ceil(F.col("c") / BLOCK_MEMBERS)).withColumn("block", F.pmod(F.xxhash64("key"), F.col("k")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)))
    rows = rows.select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "n", "root", "signature", "tokens")

    def survivors(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "ascending"), ("key", "ascending")])
        key = table.column("key").to_numpy()
        root = np.unique(np.array([r.hex() for r in table.column("root").to_pylist()]), return_inverse=True)[1]
        block, i, j = (table.column(c).to_numpy() for c in ("block", "i", "j"))
        pairs: list[tuple[int, int]] = []
        if i[0] == j[0] or block.min() != block.max():
            tokens = [np.array(t, np.int64) for t in table.column("tokens").to_pylist()]
            pairs = list(block_pairs(table.column("n").to_numpy(), root, block, table.column("signature").to_pylist(), tokens, table.column("token")[0].as_py()))
        a, b = np.array(pairs, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(key[a]), "b": pa.array(key[b])})

    return rows.groupBy("token", "i", "j").applyInArrow(survivors, "a long, b long")


def bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of keys (``a``, ``b``) as pairs of classes whose sizes and signatures leave room for the overlap."""
    side = lambda s: classes.select(F.col("key").alias(s), F.col("cls").alias(f"cls_{s}"), F.col("n").alias(f"n_{s}"), F.col("signature").alias(f"sig_{s}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b) AND cls_a <> cls_b")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("n_a", "n_b", "sig_a", "sig_b")], strict=True)
            keep = [enough((n_a + n_b - differing_bits(x, y)) // 2, n_a, n_b) for n_a, n_b, x, y in rows]
            yield batch.select(["cls_a", "cls_b"]).filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(bound, "cls_a binary, cls_b binary")


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of classes (``cls_a`` the hub) that are as similar as asked: ``a, b``.

    Each class is read from one document. Its set travels once to every hub that asks for it; a hub with many members
    is split over tasks, each with a copy of the hub's set. A task holds one hub's set and streams the others.
    """
    pairs = land(pairs, "pairs")
    load = pairs.groupBy("cls_a").agg(F.ceil(F.count(F.lit(1)) / HUB_MEMBERS).alias("salts"))
    members = pairs.join(load, "cls_a").select(
        F.col("cls_b").alias("cls"), F.col("cls_a").alias("hub"), F.pmod(F.xxhash64("cls_b"), F.col("salts")).alias("salt"), F.lit(1).alias("role"))
    hubs = load.select(F.col("cls_a").alias("cls"), F.col("cls_a").alias("hub"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    asked = land(members.unionByName(hubs).join(classes.select("cls", F.col("rep").alias("doc_id")), "cls"), "asked")
    asked = asked.withColumnRenamed("doc_id", "rep")
    texts = probably(docs, asked.select("rep").distinct()).join(asked, F.col("doc_id").eqNullSafe(F.col("rep")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                s = Sets(part.column("text"))
                right = np.array([a == b for a, b in zip(s.classes(), part.column("cls").to_pylist(), strict=True)], bool)
                blobs = [s.values[a:b].tobytes() for a, b in zip(s.offsets[:-1], s.offsets[1:], strict=True)]
                out = part.select(["hub", "salt", "role", "cls"]).append_column("shingles", pa.array(blobs, pa.binary()))
                yield out.filter(pa.array(right))  # another row with the same id, if ids repeat

    dealt = texts.mapInArrow(sets, "hub binary, salt long, role int, cls binary, shingles binary")
    dealt = dealt.repartition(shuffle_partitions(docs.sparkSession), "hub", "salt").sortWithinPartitions("hub", "salt", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: tuple | None = None
        values = np.zeros(0, U64)
        for batch in batches:
            a, b = [], []
            for hub, salt, role, cls, blob in zip(*[batch.column(c).to_pylist() for c in ("hub", "salt", "role", "cls", "shingles")], strict=True):
                other = np.frombuffer(blob, U64)
                if role == 0:
                    own, values = (hub, salt), other
                elif own == (hub, salt):
                    at = np.minimum(np.searchsorted(values, other), len(values) - 1)
                    if enough(int((values[at] == other).sum()), len(values), len(other)):
                        a.append(hub)
                        b.append(cls)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return land(dealt.mapInArrow(compare, "a binary, b binary"), "links")


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Component of every row under "Jaccard similarity of distinct 5-word shingles, A-Z in lower case, is 75 % or more".

    Returns ``doc_id, n_shingles, component_id`` (the smallest id of the component). No link between different texts
    is lost: every pair of classes that shares a tile is either compared or already in one component.

    Null and empty texts have no shingles and are alone. Texts of fewer than five words are one shingle. A row with a
    null id takes part, but names a component only if all its rows have null ids. Rows that repeat an id are judged by
    their own texts. Other columns are not read. An empty table gives no rows.
    """
    found = rooted(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    least = found.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    return found.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def rooted(docs: DataFrame) -> DataFrame:
    """``doc_id, n, cls, root`` of every row: its number of shingles, its class, and the smallest class of its component."""
    n_buckets = shuffle_partitions(docs.sparkSession)
    rows = land(document_sets(docs), "shingle-sets")
    key = F.conv(F.hex(F.substring("cls", 1, 8)), 16, -10).cast("bigint")
    classes = rows.filter("cls IS NOT NULL").groupBy("cls", "n").agg(F.min("doc_id").alias("rep"), F.min("signature").alias("signature"))
    classes = land(classes.withColumn("key", key), "classes")
    members = land(tiles(docs, common_shingles(docs, n_buckets), n_buckets), "tiles")

    first = land(bounded(hub_pairs(members), classes), "hub-pairs")
    links = verified(docs, first, classes)
    roots = components(links)

    names = classes.select("key", "cls").join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("key", F.coalesce("root", "cls").alias("root"))
    met = members.join(names, "key").select("token", "key", "n", "band", "root")
    several = met.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("c")).filter("lo <> hi").select("token", "c")
    met = land(met.join(several, "token"), "open-tiles")
    across = cross_pairs_small(met.filter(F.col("c") <= COMMON)).unionByName(cross_pairs_large(met.filter(F.col("c") > COMMON), classes)).distinct()
    tried = first.select("cls_a", "cls_b").unionByName(first.select(F.col("cls_b").alias("cls_a"), F.col("cls_a").alias("cls_b")))
    more = land(bounded(across, classes).join(tried, ["cls_a", "cls_b"], "left_anti"), "cross-pairs")
    links = links.unionByName(verified(docs, more, classes))

    found = rows.join(components(links).withColumnRenamed("node", "cls"), "cls", "left")
    return land(found.select("doc_id", "n", "cls", F.coalesce("root", "cls").alias("root")), "rooted")


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of every component, the one with the smallest id; columns unchanged.

    Null ids rank last. Of rows that repeat that id and its set of shingles one stays. Texts without words all stay.
    """
    found = rooted(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).filter("root IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "cls")).alias("first")
    cls, nth, best_id, best_cls = free_names(docs.columns, "cls", "nth", "best_id", "best_cls")
    best = found.groupBy("root").agg(first).select(F.col("first.doc_id").alias(best_id), F.col("first.cls").alias(best_cls))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                s = Sets(part.column(text))
                names = [c if n else None for c, n in zip(s.classes(), s.n, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.binary())], names=[*part.schema.names, cls])

    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.mapInArrow(named, T.StructType([*docs.schema.fields, T.StructField(cls, T.BinaryType())]))
    wordless = rows.filter(F.col(cls).isNull()).select(*own)
    rows = rows.join(best, F.col(doc_id).eqNullSafe(F.col(best_id)) & (F.col(cls) == F.col(best_cls)), "left_semi")
    once = Window.partitionBy(cls).orderBy(F.xxhash64(F.col(text)))  # what is left of a class: repeats of its best row
    return rows.withColumn(nth, F.row_number().over(once)).filter(F.col(nth) == 1).select(*own).unionByName(wordless)


@registered("op5_ngram_jaccard_join")
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(documents(spark, sf_dir))
