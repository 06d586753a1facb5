"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, documents, land, prefix_sums, registered

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SALTS = 16


def word_count(text: str) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Target of every source: ``source, source_size, source_start, target`` from rows of ``source, size``.

    Sources in code-point order, null last, get the weights in turn and share the sum of all sizes. A target stops at
    ``max_epochs`` times its source's size and the excess is shared again. In order of ``max_epochs * size / weight``
    the capped sources come first, so prefix sums find them in one pass over the sources, of any number.
    ``source_start`` is the size of all sources before this one.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("bigint"))
    ranked = prefix_sums(sources, [F.col("source").asc_nulls_last()], ["one", "source_size"], "mix-sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("one_before") % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", F.col("source_size_before").alias("source_start"),
                           weight.cast("bigint").alias("weight"), (F.col("source_size") * max_epochs).alias("most"))
    by_ratio = [F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()]
    shares = land(prefix_sums(ranked, by_ratio, ["most", "weight"], "mix-shares"), "mix-shares-summed")
    total = shares.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    size, weight_sum = total["size"] or 0, total["weight"] or 0
    capped = F.col("most") * (F.lit(weight_sum) - F.col("weight_before")) <= F.col("weight") * (F.lit(size) - F.col("most_before"))
    rest = shares.filter(~capped).agg(F.sum("most").alias("most"), F.sum("weight").alias("weight")).first()
    capped_most = (shares.filter(capped).agg(F.sum("most").alias("m")).first()["m"] or 0)
    per_weight = (size - capped_most) / rest["weight"] if rest["weight"] else 0.0
    target = F.when(capped, F.col("most").cast("double")).otherwise(F.col("weight") * F.lit(float(per_weight)))
    return shares.select("source", "source_size", "source_start", target.alias("target"))


def _mixed(docs: DataFrame, weights: tuple[int, ...], max_epochs: int, seed: str, doc_id: str, text: str, source: str, carried: list[Column]) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row, and what is ``carried``."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), F.xxhash64(F.col(text)).alias("tie"), *carried,
    )
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id"), F.col("size"), F.col("tie")]
    placed = prefix_sums(rows.withColumn("key", key), order, ["size"], "mix-rows")
    targets = source_targets(placed.select("source", "size"), weights, max_epochs)
    # A source may hold a third of all rows: both sides carry a salt, the small one once for each of its values.
    salted = targets.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    placed = placed.withColumn("salt", F.pmod(F.hash("doc_id", "tie"), F.lit(SALTS)))
    no_name, t_no_name = F.col("p.source").isNull(), F.col("t.source").isNull()
    joined = placed.alias("p").join(
        salted.alias("t"),
        (F.col("p.salt") == F.col("t.salt")) & (F.coalesce("p.source", F.lit("")) == F.coalesce("t.source", F.lit(""))) & (no_name == t_no_name),
    )
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    left = budget - epochs * F.col("source_size") - (F.col("size_before") - F.col("source_start"))
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    kept = [F.col(c) for c in rows.columns[4:]]
    return joined.select("doc_id", "size", "source_size", "target", taken.cast("bigint").alias("taken"), *kept)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix",
        doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """What the mix takes of every row: ``doc_id, size, source_size, target, taken``.

    Rows are range-sorted by source and a hash of (seed, id); prefix sums of sizes then place every row inside its
    source. Each epoch takes the whole source, the last one is cut at the exact budget (the target, rounded), so one
    row per source is taken in part. Rows of a source that repeat an id go by size and a hash of the text: reruns agree.

    A null text has size 0 and is taken 0 times; a null source is a source of its own, last in order; a null id has
    the key of the empty id. Repeated rows are rows of their own. Other columns are not read. No rows give no rows.
    """
    return _mixed(docs, weights, max_epochs, seed, doc_id, text, source, [])


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix",
               doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed corpus with the columns of ``docs``: each row once per whole epoch, and the cut row's words up to the cut.

    A cut text is its first words joined by one space. Rows taken 0 times go, so rows without words do. Every row travels
    with its share, as one struct: ids may repeat, within a source or across, and columns may have any name. Null ids,
    null sources and repeated rows are as in ``mix``. An empty table stays empty.
    """
    plan = _mixed(docs, weights, max_epochs, seed, doc_id, text, source, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")])
    plan = plan.filter("taken > 0").select("row", F.expr("taken div size").cast("int").alias("whole"), F.expr("taken % size").alias("part"))
    copies = F.concat(F.array_repeat(F.lit(0).cast("bigint"), F.col("whole")), F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<bigint>")))
    rows = plan.select("row", F.explode(copies).alias("cut"))
    body = F.col("row")[text]
    words = F.array_join(F.slice(F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), 1, F.col("cut").cast("int")), " ")
    out = {c: F.col("row")[c] for c in docs.columns} | {text: F.when(F.col("cut") > 0, words).otherwise(body)}
    return rows.select(*[column.alias(c) for c, column in out.items()])


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(doc_id::VARCHAR || ':mix') AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM d GROUP BY source
), p AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
         coalesce(sum(3 * source_size) OVER w, 0) AS most_before, coalesce(sum(weight) OVER w, 0) AS weight_before
  FROM s WINDOW w AS (ORDER BY 3 * source_size / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, 3 * source_size * (weights - weight_before) <= weight * (total - most_before) AS capped FROM p
), l AS (
  SELECT (max(total) - coalesce(sum(3 * source_size) FILTER (capped), 0))::DOUBLE / (sum(weight) FILTER (NOT capped))::DOUBLE AS per_weight FROM c
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE weight * per_weight END AS target FROM c, l
), r AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
            + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM r
"""


@registered("op4_mixing", MIX_SQL)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))
