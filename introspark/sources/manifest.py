"""Sample manifest and marker map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from introspark.functions.chrom import SOYBEAN, Crop, canonical_chrom
from introspark.functions.text import centimorgan, position
from introspark.operators.common import duplicates
from introspark.schema import MANIFEST_COLUMNS, SAMPLE_ROLES
from introspark.sources.lines import named_rows, read_lines, table_problems


def read_samples(spark: SparkSession, path: str, parts: bool = False) -> tuple[DataFrame, DataFrame]:
    return parse_samples(read_lines(spark, path, parts))


def parse_samples(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, violations). Missing names default to the id; empty optional cells are NULL."""
    rows = named_rows(lines, MANIFEST_COLUMNS)
    empty = F.lit("")
    samples = rows.select(
        "file", "ord", F.coalesce("sample_id", empty).alias("sample_id"),
        F.coalesce(F.nullif("line_name", empty), F.col("sample_id")).alias("line_name"),
        F.lower(F.coalesce("role", empty)).alias("role"),
        *[F.nullif(c, empty).alias(c) for c in ("generation", "family_id", "notes")],
    )
    text = table_problems(lines, MANIFEST_COLUMNS, ("sample_id", "role")).withColumn("ord", F.lit(0))
    return samples.select(*MANIFEST_COLUMNS, F.struct("file", "ord").alias("sample_ord")), sample_violations(samples).unionByName(text)


def sample_violations(samples: DataFrame) -> DataFrame:
    """Broken manifest rules: empty or repeated ids, unknown roles, and the parents and progeny every manifest needs."""
    none = F.lit("")
    per_row = samples.select(
        F.explode(F.array_compact(F.array(
            F.when(F.col("sample_id") == "", F.struct(F.lit("empty sample_id").alias("kind"), none.alias("detail"))),
            F.when(~F.col("role").isin(*SAMPLE_ROLES), F.struct(F.lit("unknown role").alias("kind"), F.concat_ws(" ", "sample_id", "role").alias("detail"))),
        ))).alias("v")
    ).select("v.kind", "v.detail")
    repeated = duplicates(samples, "sample_id").select(F.lit("duplicate sample_id").alias("kind"), F.col("sample_id").alias("detail"))
    n = {r: F.count_if(F.col("role") == r) for r in ("recurrent_parent", "donor_parent")}
    rules = F.array_compact(F.array(
        F.when(n["recurrent_parent"] != 1, "exactly one recurrent_parent required"),
        F.when(n["donor_parent"] != 1, "exactly one donor_parent required"),
        F.when(F.count_if(F.col("role").isin("progeny", "candidate")) == 0, "no progeny or candidate samples"),
    ))
    whole = samples.agg(rules.alias("rules")).select(F.explode("rules").alias("kind"), none.alias("detail"))
    return per_row.unionByName(repeated).unionByName(whole).select(none.alias("file"), F.lit(0).alias("ord"), "kind", "detail")


def read_marker_map(spark: SparkSession, path: str, crop: Crop = SOYBEAN, parts: bool = False) -> tuple[DataFrame, DataFrame]:
    return parse_marker_map(read_lines(spark, path, parts), crop)


def parse_marker_map(lines: DataFrame, crop: Crop = SOYBEAN) -> tuple[DataFrame, DataFrame]:
    """(markers, violations)."""
    rows = named_rows(lines, ("marker_id", "chrom", "pos_bp", "cm"))
    given = ~F.coalesce("cm", F.lit("")).isin("", "NA", "na", ".")
    parsed = rows.select(
        "file", "ord", F.coalesce("marker_id", F.lit("")).alias("marker_id"), canonical_chrom(F.col("chrom"), crop).alias("chrom"),
        position(F.col("pos_bp")).alias("pos_bp"), centimorgan(F.col("cm")).alias("cm"), given.alias("given"),
    )
    kind = (
        F.when(F.col("marker_id") == "", "empty marker_id").when(F.col("given") & F.col("cm").isNull(), "invalid cm")
        .when(F.col("pos_bp").isNull(), "invalid position")
    )
    broken = parsed.select("file", "ord", kind.alias("kind"), F.col("marker_id").alias("detail")).filter("kind is not null")
    repeated = duplicates(parsed, "marker_id").select(
        F.lit("").alias("file"), F.lit("duplicate marker_id").alias("kind"), F.col("marker_id").alias("detail")
    )
    text = table_problems(lines, ("marker_id",), ("marker_id", "chrom", "pos_bp")).select("file", "kind", "detail")
    violations = broken.select("file", "kind", "detail").unionByName(repeated).unionByName(text).withColumn("ord", F.lit(0))
    return parsed.select("marker_id", "chrom", "pos_bp", "cm", F.struct("file", "ord").alias("file_ord")), violations
