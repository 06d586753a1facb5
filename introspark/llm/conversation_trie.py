"""Prefix trie of conversations by block hashing: digests of several turns first, single turns where siblings diverge."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import land, registered, shuffle_partitions, table

#: Turns of a block.
BLOCK = 4
#: Conversation ids of one chunk of text, on the way to a node's hash.
CHUNK = 1024
#: Fixed values of the rebuilt query: conversations share the first turns of every fifth one, as many as a checksum says.
FAMILY = 5
SHARED = 9

_NODE = ["depth", "k1", "k2"]


def _halves(hex_digest: Column) -> list[Column]:
    """The two 64-bit halves of a 128-bit digest in hex."""
    return [F.conv(F.substr(hex_digest, F.lit(at), F.lit(16)), 16, -10).cast("bigint") for at in (1, 17)]


def running(rows: DataFrame, key: str, order: list[Column], name: str, sums: tuple[str, ...] = (), xors: tuple[str, ...] = ()) -> DataFrame:
    """Replace columns by their running sum or XOR within ``key``, in ``order``, the row itself included.

    A key may hold a third of all rows, so rows are dealt by range of key and order and written with their partition
    number. Partitions are folded on their own; as the rows of a key lie in neighbouring partitions, all that one hands
    to the next is the fold of its last key: one row per partition. ``order`` must tell the rows of a key apart.
    """
    folds = {c: F.sum for c in sums} | {c: F.bit_xor for c in xors}
    both = lambda c, a, b: (a + b) if c in sums else a.bitwiseXOR(b)
    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), F.col(key), *order).withColumn("_part", F.spark_partition_id())
    dealt = land(dealt, name)
    per_key = dealt.groupBy("_part", key).agg(*[f(c).alias(c) for c, f in folds.items()])
    parts = per_key.groupBy("_part").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), *[F.max_by(c, key).alias(c) for c in folds])
    upto = Window.partitionBy("hi").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.select("_part", "lo", "hi", *[f(c).over(upto).alias(c) for c, f in folds.items()])
    before = Window.orderBy("_part")  # one row per partition
    parts = parts.select("_part", F.col("lo").alias("_lo"), F.lag("hi").over(before).alias("_hi"), *[F.lag(c).over(before).alias(f"_{c}") for c in folds])
    parts = parts.filter("_lo = _hi").drop("_hi")
    inside = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.select(*[c for c in dealt.columns if c not in folds], *[f(c).over(inside).alias(c) for c, f in folds.items()])
    out = out.join(F.broadcast(parts), (out["_part"] == parts["_part"]) & (out[key] == parts["_lo"]), "left").drop(parts["_part"])
    return out.select(*[both(c, F.col(c), F.coalesce(f"_{c}", F.lit(0))).alias(c) if c in folds else c for c in rows.columns])


def turn_digests(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, pos, digest, n_bytes`` of every turn; positions count from 1 in order of ``turn``, null first.

    A null role or text counts as empty. Turns of one number go by digest. Rows without a conversation id belong to no
    conversation and are left out. Texts aren't shuffled.
    """
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = conversations.select(
        F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"),
        F.md5(F.concat(F.octet_length(role), F.lit(":"), role, text).cast("binary")).alias("digest"), F.octet_length(text).cast("bigint").alias("n_bytes"),
        F.lit(1).cast("bigint").alias("pos"),
    ).filter("conv_id IS NOT NULL")
    return running(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("digest")], "trie-turns", sums=("pos",)).select("conv_id", "pos", "digest", "n_bytes")


def rebuild(turns: DataFrame) -> DataFrame:
    """Give every conversation the first turns of its family's head: ``turns`` and the result are as of ``turn_digests``.

    Conversation c gets the first h turns of conversation c - c % 5 (all if there are fewer), then its own turns after
    its first h, where h is the CRC-32 of the decimal c, modulo 9. The remainder has the sign of c.
    """
    def taken(c: Column) -> Column:
        return F.crc32(c.cast("string").cast("binary")) % SHARED

    here = F.col("conv_id")
    lengths = land(turns.groupBy("conv_id").agg(F.max("pos").alias("n")), "trie-lengths")
    heads = lengths.select(F.col("conv_id").alias("head"), F.col("n").alias("n_head"))
    fewer = lengths.filter(here % FAMILY != 0).join(heads, here - here % FAMILY == F.col("head"), "left").select(
        "conv_id", (F.least(F.coalesce("n_head", F.lit(0)), taken(here)) - taken(here)).alias("shift")
    ).filter("shift < 0")
    own = turns.filter((here % FAMILY == 0) | (F.col("pos") > taken(here))).join(fewer, "conv_id", "left").select(
        "conv_id", (F.col("pos") + F.coalesce("shift", F.lit(0))).alias("pos"), "digest", "n_bytes"
    )
    to = F.col("to")
    given = turns.filter((here % FAMILY == 0) & (F.col("pos") < SHARED)).withColumn("to", F.explode(F.sequence(here - (FAMILY - 1), here + (FAMILY - 1))))
    given = given.filter((to != here) & (to - to % FAMILY == here) & (taken(to) >= F.col("pos"))).drop("conv_id").withColumnRenamed("to", "conv_id")
    return own.unionByName(given.join(lengths.select("conv_id"), "conv_id", "left_semi").select(*own.columns))


def _blocks(turns: DataFrame) -> DataFrame:
    """``conv_id, j, size, turns, p1, p2, k1, k2``: the turns of block j and the keys of the nodes above and at its end.

    A node's key is the XOR of the 128-bit digests of (position, turn) of all turns up to it, so that keys are found by
    folding, a long conversation in pieces.
    """
    first, second = _halves(F.md5(F.concat_ws(":", "pos", "digest").cast("binary")))
    rows = turns.select("conv_id", ((F.col("pos") - 1) / BLOCK).cast("bigint").alias("j"), "pos", first.alias("h1"), second.alias("h2"), "n_bytes")
    blocks = rows.groupBy("conv_id", "j").agg(
        F.array_sort(F.collect_list(F.struct("pos", "h1", "h2", "n_bytes"))).alias("turns"), F.bit_xor("h1").alias("k1"), F.bit_xor("h2").alias("k2")  # BLOCK turns
    ).select("*", F.size("turns").alias("size"), F.col("k1").alias("x1"), F.col("k2").alias("x2"))
    out = running(blocks, "conv_id", [F.col("j")], "trie-blocks", xors=("k1", "k2"))
    return out.select("conv_id", "j", "size", "turns", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "k1", "k2")


def _nodes_of(blocks: DataFrame, keep: list[str]) -> DataFrame:
    """A row per turn of every block: ``depth, k1, k2``, its parent's keys ``p1, p2``, ``n_bytes``, and ``keep``."""
    def node(turn: Column, i: Column) -> Column:
        upto = lambda k, h, n: F.aggregate(F.slice("turns", F.lit(1), n), F.col(k), lambda a, t: a.bitwiseXOR(t[h]))
        return F.struct(
            turn["pos"].alias("depth"), upto("p1", "h1", i + 1).alias("k1"), upto("p2", "h2", i + 1).alias("k2"), upto("p1", "h1", i).alias("p1"),
            upto("p2", "h2", i).alias("p2"), turn["n_bytes"].alias("n_bytes"),
        )

    return blocks.select(*keep, F.inline(F.transform("turns", node)))


def _ends(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined ids ``conv_id`` of every node: ``depth, k1, k2, ends_sha256``.

    A node may end a third of all conversations: ids are dealt by range of node and id and become chunks of text, and
    the chunks of a node, a thousandth of its rows, stream through its hash in order.
    """
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"depth": [node[0]], "k1": [node[1]], "k2": [node[2]], "first": [ids[0]], "ids": [",".join(map(str, ids))]})

        for batch in batches:
            for *here, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != node or len(ids) == CHUNK:
                    if ids:
                        yield flush()
                    node, ids = here, []
                ids.append(conv)
        if ids:
            yield flush()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for *here, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != node:
                    if node:
                        done.append([*node, state.hexdigest()])
                    node, state = here, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_pydict(dict(zip([*_NODE, "ends_sha256"], map(list, zip(*done, strict=True)), strict=True)))
        if node:
            yield pa.RecordBatch.from_pydict(dict(zip([*_NODE, "ends_sha256"], [[x] for x in [*node, state.hexdigest()]], strict=True)))

    order = [*_NODE, "conv_id"]
    n = shuffle_partitions(ends.sparkSession)
    pieces = ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)
    pieces = pieces.mapInArrow(chunks, "depth long, k1 long, k2 long, first long, ids string")
    return pieces.repartition(n, *_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(hashed, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """The trie of conversations: a row per distinct sequence of first turns, the empty one (the root) included.

    ``turns`` has ``conv_id, pos, digest, n_bytes`` (positions from 1, without gaps), ``members`` the ``conv_id`` of all
    conversations, those without turns too. The result has ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``
    (the parent's conv_id), ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes of its subtree), ``saved_tokens``
    (over its subtree, members but one times bytes of the last turn) and ``ends_sha256`` (of the ids of members that end
    there). Without members there is no node.

    Conversations are grouped by block: key above, key at its end, number of turns. If all members of the node above
    share one block, its turns are nodes with the same members. Only where they diverge are the different blocks (each
    with its number of members) regrouped by turn.

    Subtree sums: a conversation owns the nodes whose smallest member it is, a chain at the end of its path. A subtree is
    the rest of its owner's chain and the whole chains of all its other members, so each chain is added once to each node
    above it: as many additions as turns, whatever the depth.
    """
    total, least = members.agg(F.count(F.lit(1)), F.min("conv_id")).first()
    blocks = land(_blocks(turns), "trie-keys")
    group = ["j", "p1", "p2", "k1", "k2", "size"]
    groups = land(blocks.groupBy(*group).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("owner"), F.first("turns").alias("turns")), "trie-groups")
    above = groups.filter(F.col("size") == BLOCK).select((F.col("j") + 1).alias("j"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("n_convs").alias("n_above"))
    groups = groups.filter("j = 0").withColumn("n_above", F.lit(total)).unionByName(groups.filter("j > 0").join(above, ["j", "p1", "p2"]))
    alike = F.col("n_convs") == F.col("n_above")
    shared = _nodes_of(groups.filter(alike), ["n_convs", "owner"])
    parted = _nodes_of(groups.filter(~alike), ["n_convs", "owner"]).groupBy(*_NODE, "p1", "p2", "n_bytes").agg(F.sum("n_convs").alias("n_convs"), F.min("owner").alias("owner"))
    root = turns.sparkSession.range(1 if total else 0).select(
        F.lit(0).cast("bigint").alias("depth"), *[F.lit(0).cast("bigint").alias(c) for c in ("k1", "k2", "p1", "p2", "n_bytes")],
        F.lit(total).cast("bigint").alias("n_convs"), F.lit(least).cast("bigint").alias("owner"),
    )
    nodes = land(shared.unionByName(parted).unionByName(root), "trie-nodes")

    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
    nodes = land(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("n_bytes")), "trie-children")
    chains = nodes.groupBy("owner").agg(F.min("depth").alias("top"), F.sum("saved").alias("total"), (F.max_by("n_children", "depth") == 0).cast("bigint").alias("leaf"))
    chains = land(chains, "trie-chains")

    # Chains added to the nodes above them: by block and first, for all nodes of a block at once.
    first = F.col("j") * BLOCK
    given = blocks.join(chains.withColumnRenamed("owner", "conv_id"), "conv_id").filter((F.col("top") > first + 1) & ((F.col("total") > 0) | (F.col("leaf") > 0)))
    given = given.withColumn("below", F.least("top", first + BLOCK + 1)).groupBy(*group, "below").agg(
        F.sum("total").alias("total"), F.sum("leaf").alias("leaf"), F.first("turns").alias("turns")
    )
    given = _nodes_of(given, ["below", "total", "leaf"]).filter(F.col("depth") < F.col("below")).select(*_NODE, "total", "leaf")
    to_root = chains.filter("top > 0").select(*[F.lit(0).cast("bigint").alias(c) for c in _NODE], "total", "leaf")
    given = given.unionByName(to_root).groupBy(*_NODE).agg(F.sum("total").alias("given"), F.sum("leaf").alias("given_leaves"))

    # A node with one member has one leaf below it and saves nothing.
    several = nodes.filter("n_convs > 1").select(*_NODE, "owner", "saved")
    several = running(several, "owner", [F.col("depth").desc()], "trie-suffixes", sums=("saved",)).join(chains.select("owner", "leaf"), "owner")
    several = several.join(given, _NODE, "left").select(
        *_NODE, (F.col("leaf") + F.coalesce("given_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("given", F.lit(0))).alias("saved_tokens")
    )
    last = blocks.groupBy("conv_id").agg(F.max(F.struct("j", "size", "k1", "k2")).alias("b"))
    ends = members.select("conv_id").join(last, "conv_id", "left")
    ends = ends.select(
        F.coalesce(F.col("b.j") * BLOCK + F.col("b.size"), F.lit(0)).alias("depth"), F.coalesce("b.k1", F.lit(0)).alias("k1"), F.coalesce("b.k2", F.lit(0)).alias("k2"), "conv_id"
    )
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("owner").alias("above"))
    out = nodes.drop("saved").join(several, _NODE, "left").join(_ends(ends), _NODE, "left")
    near, far = out.filter("depth < 2").withColumn("above", F.when(F.col("depth") == 1, F.lit(least).cast("bigint"))), out.filter("depth > 1")
    out = near.unionByName(far.join(parents.filter("depth > 1"), ["depth", "p1", "p2"]).select(*near.columns))
    return out.select(
        F.col("owner").alias("conv_id"), "depth", F.col("above").alias("parent_conv_id"), "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1).cast("bigint")).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0).cast("bigint")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, rebuilt: bool = False, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The prefix trie of a table of turns, as of ``prefix_trie``; with ``rebuilt`` of the conversations that ``rebuild`` makes.

    A null role or text counts as empty, a null turn comes first, repeated turns count each; rows without a conversation
    id are left out. Other columns are not read. An empty table gives no rows. Texts and conversations of any length are
    taken whole.
    """
    turns = land(turn_digests(conversations, conv_id, turn, role, text), "trie-positions")
    members = land(turns.select("conv_id").distinct(), "trie-members")
    return prefix_trie(rebuild(turns) if rebuilt else turns, members)


TRIE_SQL = f"""
WITH tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), len AS (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id
), h AS (
  SELECT conv_id, conv_id - conv_id % {FAMILY} AS head, n, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % {SHARED} AS h FROM len, tab
), g AS (SELECT h.*, least(h.h, coalesce(len.n, 0)) AS given FROM h LEFT JOIN len ON len.conv_id = h.head
), t AS (
  SELECT g.conv_id, o.pos AS d, role, text FROM g JOIN own o ON o.conv_id = g.head WHERE o.pos <= g.given
  UNION ALL
  SELECT g.conv_id, o.pos - g.h + g.given, role, text FROM g JOIN own o ON o.conv_id = g.conv_id WHERE o.pos > g.h
), p AS (
  SELECT conv_id, d, strlen(text) AS bytes, md5(string_agg(strlen(role) || ':' || strlen(text) || ':' || role || text, '' ) OVER (PARTITION BY conv_id ORDER BY d)) AS path FROM t
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM len
), q AS (SELECT *, lag(path) OVER (PARTITION BY conv_id ORDER BY d) AS above, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM p
), n AS (
  SELECT d, path, any_value(above) AS above, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM q GROUP BY d, path
), k AS (SELECT d - 1 AS d, above AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL
), c AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.d = k.d AND n.path = k.path
), s AS (
  SELECT q.d, q.path, count(*) FILTER (c.n_children = 0) AS n_leaves, CAST(sum((c.n_convs - 1) * c.bytes) AS BIGINT) AS saved_tokens
  FROM c JOIN q ON q.conv_id = c.conv_id AND q.d <= c.d GROUP BY ALL
)
SELECT c.conv_id, c.d AS depth, u.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
FROM c JOIN s ON s.d = c.d AND s.path = c.path LEFT JOIN n u ON u.d = c.d - 1 AND u.path = c.above
"""


@registered("op12_conversation_trie", TRIE_SQL)
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"), rebuilt=True)
