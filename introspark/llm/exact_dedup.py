"""Exact deduplication by a 128-bit content hash, with the bytes of equal hashes compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, documents, land, registered


def normalised(text: str) -> Column:
    """The text without ASCII spaces; null counts as empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), SPACES, "")


def _hashed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), normalised(text).alias("norm"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("n_cp"),
    )
    return rows.withColumn("h128", F.unhex(F.md5(F.col("norm").cast("binary")))).withColumn("sha", F.unhex(F.sha2("norm", 256)))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Class of every row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Rows are grouped by the 128-bit hash of the normalised text. The row with the most code points stays, then the
    smallest id. The bytes behind every hash are compared: grouping hash and text together, pre-aggregated before the
    shuffle, leaves one row per different text, and a hash that stands for several texts is split by its texts' second
    digest. Two different texts equal in both digests stop the job.

    The large group is never gathered: counts and the best row are aggregated before they are shuffled, and the
    verdict goes back to the rows by a join whose one side has one row per hash.

    Null and empty texts (and texts of spaces only) form one class. A null id ranks after all others. Rows that repeat
    id and text are counted each and share the verdict. Other columns are not read. An empty table gives no rows.
    """
    hashed = _hashed(docs, doc_id, text)
    slim = land(hashed.drop("norm"), "exact-hashes")
    texts = hashed.groupBy("h128", "sha", "norm").agg(F.count(F.lit(1)).alias("n")).groupBy("h128", "sha").agg(
        F.count(F.lit(1)).alias("n_texts"), F.sum("n").alias("group_size")
    )
    checked = texts.withColumn(
        "group_size",
        F.when(F.col("n_texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("different texts share both digests")).cast("bigint")),
    )
    best = slim.groupBy("h128", "sha").agg(F.max(F.struct("n_cp", (-F.col("doc_id")).alias("neg"))).alias("best"))
    groups = best.join(checked, ["h128", "sha"]).select("h128", "sha", (-F.col("best.neg")).alias("keep_id"), "group_size")
    return slim.join(groups, ["h128", "sha"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without all rows but one of every class of ``exact_groups``, columns unchanged, whatever their names.

    Null and empty texts are one class. Of rows that repeat the kept id and text, or have a null id, one with the most
    code points stays. An empty table stays empty.
    """
    kept = exact_groups(docs, doc_id, text).filter("kept").select("keep_id", F.unhex("text_sha256").alias("keep_sha")).distinct()
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("id"), F.unhex(F.sha2(normalised(text), 256)).alias("sha"),
        F.length(F.coalesce(F.col(text), F.lit(""))).alias("n"),
    )
    rows = rows.join(kept, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("sha") == F.col("keep_sha")), "left_semi")
    first = Window.partitionBy("sha").orderBy(F.col("n").desc())  # what is left of a class: repeats of its kept row
    rows = rows.withColumn("k", F.row_number().over(first)).filter("k = 1")
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])


@registered("op8_exact_dedup", r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS n FROM documents
), k AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))
