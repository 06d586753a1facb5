"""Secret scans over an incremental ledger of content-addressed blobs, in DataFrame functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, land, registered, shared_folder

#: Fixed rules: kind, version, pattern, group whose length counts, least length. The first three are the base rules.
RULES = (
    ("assign", 1, r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", 1, r"[0-9a-f]{16,}", 0, 16),  # a run of 16 or more: shorter runs fail, and no match begins inside a longer one
    ("key_block", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)
BASE = 3


def _matches(text: Column, number: int, wanted: Column) -> Column:
    """All matches of a rule: rule number, order, code points before it since the last match, of it, and of the group that counts."""
    kind, _, pattern, group, _ = RULES[number]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    between = F.split(text, pattern, -1)
    rows = F.transform(
        F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("gap"), whole.alias("whole"), counted.alias("counted")),
        lambda x, i: F.struct(
            F.lit(number).alias("rule"), i.alias("nth"), F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("width"), F.length(x["counted"]).alias("counted"),
        ),
    )
    return F.when(F.array_contains(wanted, number) & F.rlike(text, F.lit(pattern)), rows)


def scan(blobs: DataFrame) -> DataFrame:
    """``blob, rule, start, end`` (code points, end exclusive) of ``blobs`` with columns ``blob, text, wanted``.

    The matches of a pattern and the stretches between them, as lengths, give every position by a running sum. Only
    blobs with a match get that far; a window holds the matches of one rule in one text.
    """
    kinds = [F.coalesce(_matches(F.col("text"), n, F.col("wanted")), F.array().cast("array<struct<rule:int,nth:int,gap:int,width:int,counted:int>>")) for n in range(len(RULES))]
    found = blobs.select("blob", F.inline(F.concat(*kinds)))
    upto = Window.partitionBy("blob", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap").cast("bigint") + F.col("width")).over(upto)
    least = F.element_at(F.array(*[F.lit(r[4]) for r in RULES]), F.col("rule") + 1)
    return found.withColumn("end", end).filter(F.col("counted") >= least).select("blob", "rule", (F.col("end") - F.col("width")).alias("start"), "end")


class Ledger:
    """What has been scanned: tables ``scanned`` (blob, rule, version) and ``findings`` (blob, rule, version, start, end) in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def create(cls, spark: SparkSession, folder: str) -> Ledger:
        ledger = cls(spark, folder)
        spark.createDataFrame([], "blob binary, rule int, version int").write.parquet(f"{folder}/scanned")
        spark.createDataFrame([], "blob binary, rule int, version int, start bigint, end bigint").write.parquet(f"{folder}/findings")
        return ledger

    def scanned(self) -> DataFrame:
        return self.spark.read.schema("blob binary, rule int, version int").parquet(f"{self.folder}/scanned")

    def findings(self) -> DataFrame:
        """Findings by the present rule versions; a scan that broke off and ran again shows once."""
        rows = self.spark.read.schema("blob binary, rule int, version int, start bigint, end bigint").parquet(f"{self.folder}/findings")
        return rows.filter(F.col("version") == _version()).drop("version").distinct()

    def add(self, versions: DataFrame) -> DataFrame:
        """Scan what is new in ``versions`` (``path, text``: every version of every path) and return ``path, blob`` of all its rows.

        A blob is addressed by the SHA-256 of its text and read from one of its rows. Findings are written before their
        blobs are marked as scanned, so a lost run is done again, never skipped.
        """
        addressed = versions.withColumn("blob", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
        paths = land(addressed.select("path", "blob"), "blob-paths")
        new = paths.groupBy("blob").agg(F.min("path").alias("path")).withColumn("rule", F.explode(F.array(*[F.lit(n) for n in range(len(RULES))])))
        new = new.withColumn("version", _version()).join(self.scanned(), ["blob", "rule", "version"], "left_anti")
        new = land(new.groupBy("blob").agg(F.min("path").alias("path"), F.collect_set("rule").alias("wanted")), "new-blobs")
        same = addressed["path"].eqNullSafe(new["path"]) & (addressed["blob"] == new["blob"])
        texts = addressed.join(new, same).select(addressed["blob"], "text", "wanted").dropDuplicates(["blob"])  # rows may repeat path and text
        scan(texts).withColumn("version", _version()).select("blob", "rule", "version", "start", "end").write.mode("append").parquet(f"{self.folder}/findings")
        marks = new.select("blob", F.explode("wanted").alias("rule")).withColumn("version", _version())
        marks.write.mode("append").parquet(f"{self.folder}/scanned")
        return paths


def _version() -> Column:
    return F.element_at(F.array(*[F.lit(r[1]) for r in RULES]), F.col("rule") + 1)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def findings_by_path(ledger: Ledger, paths: DataFrame) -> DataFrame:
    """Findings of every row of ``paths`` (``path, blob``), as counts and as text; rows without findings included."""
    kind = F.element_at(F.array(*[F.lit(r[0]) for r in RULES]), F.col("rule") + 1)
    spans = F.array_sort(F.collect_list(F.struct("start", "rule", "end", kind.alias("kind"))))  # of one text
    counts = [F.count_if(F.col("rule") == n).alias(f"n_{RULES[n][0]}") for n in range(BASE)]
    by_blob = ledger.findings().groupBy("blob").agg(spans.alias("s"), *counts)
    by_blob = by_blob.select(
        "blob", *[f"n_{RULES[n][0]}" for n in range(BASE)], _joined("s").alias("spans"), _joined(F.filter("s", lambda x: x["rule"] < BASE)).alias("base"),
    )
    out = paths.join(by_blob, "blob", "left")
    return out.select(
        "path", *[F.coalesce(f"n_{RULES[n][0]}", F.lit(0)).cast("bigint").alias(f"n_{RULES[n][0]}") for n in range(BASE)],
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def scan_documents(docs: DataFrame, ledger: Ledger | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Findings of every row of ``docs``: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    Without a ledger a new one is made in the cluster's shared folder. Texts that many rows share are scanned once.
    Null and empty texts are one blob without findings. Null ids and repeated rows keep their rows. Other columns are
    not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ledger = ledger or Ledger.create(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")
    paths = ledger.add(docs.select(F.col(doc_id).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    return findings_by_path(ledger, paths).withColumnRenamed("path", "doc_id")


def _sql() -> str:
    parts = []
    for n, (kind, _, pattern, group, least) in enumerate(RULES):
        quoted = pattern.replace("'", "''")
        parts.append(f"""
  SELECT doc_id, {n} AS rule, '{kind}' AS kind, {least} AS least, unnest(range(len(regexp_extract_all(text, '{quoted}')))) AS nth,
         unnest(string_split_regex(text, '{quoted}')[1:len(regexp_extract_all(text, '{quoted}'))]) AS gap,
         unnest(regexp_extract_all(text, '{quoted}')) AS whole, unnest(regexp_extract_all(text, '{quoted}', {group})) AS counted FROM t""")
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS ({' UNION ALL '.join(parts)}
), e AS (
  SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY doc_id, rule ORDER BY nth) AS stop FROM m
), s AS (
  SELECT doc_id, rule, CAST(stop - length(whole) AS BIGINT) AS start, kind || ':' || CAST(stop - length(whole) AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span
  FROM e WHERE length(counted) >= least
), g AS (
  SELECT doc_id, count(*) FILTER (rule = 0) AS n_assign, count(*) FILTER (rule = 1) AS n_access, count(*) FILTER (rule = 2) AS n_hex,
         string_agg(span, ',' ORDER BY start, rule) FILTER (rule < {BASE}) AS base, string_agg(span, ',' ORDER BY start, rule) AS spans FROM s GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g ON t.doc_id = g.doc_id
"""


@registered("op9_secret_scan", _sql())
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(documents(spark, sf_dir))
