"""Marker positions of several assemblies from GFF3 files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from introspark.functions.chrom import SOYBEAN, canonical_chrom, chrom_order
from introspark.functions.text import SIGNED_DIGITS, after_last_dot
from introspark.sources.lines import content

# Assemblies and marker panels of the position table.
ASSEMBLIES = ("gnm1", "gnm2", "gnm4", "gnm5", "gnm6")
PANELS = ("SoySNP50K", "SoySNP6K")


def parse_gff3(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(positions, violations): file, ord, marker_id, chrom, pos_bp of every feature row."""
    rows = content(lines).filter(~F.col("value").startswith("#")).withColumn("f", F.split("value", "\t", -1))
    fields = F.transform(F.split(F.try_element_at("f", F.lit(9)), ";"), lambda x: F.trim(x))
    named = F.filter(fields, lambda x: x.rlike(r"^Name\s*="))
    name = F.trim(F.regexp_extract(F.try_element_at(named, F.lit(-1)), "=(.*)$", 1))
    start = F.try_element_at("f", F.lit(4))
    judged = rows.select(
        "file", "ord", "value", F.size("f").alias("n"), F.coalesce(name, F.lit("")).alias("marker_id"),
        canonical_chrom(after_last_dot(F.element_at("f", 1))).alias("chrom"), F.when(start.rlike(SIGNED_DIGITS), start.try_cast("bigint")).alias("pos_bp"),
    )
    kind = F.when(F.col("n") != 9, "expected 9 fields").when(F.col("marker_id") == "", "no Name attribute").when(F.col("pos_bp").isNull(), "invalid start")
    judged = judged.withColumn("kind", kind)
    return (
        judged.filter("kind is null").select("file", "ord", "marker_id", "chrom", "pos_bp"),
        judged.filter("kind is not null").select("file", "ord", "kind", F.substring("value", 1, 60).alias("detail")),
    )


def position_table(positions: DataFrame, assemblies: tuple[str, ...] = ASSEMBLIES, panels: tuple[str, ...] = PANELS) -> DataFrame:
    """One row per marker: a flag per panel, and chromosome and position per assembly (the first read wins).

    ``positions`` has assembly, panel, file_ord (the file's place in the list) and ord besides the parsed columns.
    """

    def first(assembly: str):
        here = F.col("assembly") == assembly
        return F.min_by(F.when(here, F.struct("chrom", "pos_bp")), F.when(here, F.struct("file_ord", "ord")))

    table = positions.groupBy("marker_id").agg(
        *[F.bool_or(F.col("panel") == p).alias(f"in_{p}") for p in panels], *[first(a).alias(a) for a in assemblies]
    )
    placed = [c for a in assemblies for c in (F.col(f"{a}.chrom").alias(f"chrom_{a}"), F.col(f"{a}.pos_bp").alias(f"pos_bp_{a}"))]
    return table.select("marker_id", *[f"in_{p}" for p in panels], *placed)


def longest_positions(positions: DataFrame) -> DataFrame:
    """(assembly, chrom, max_bp) on canonical chromosomes."""
    return positions.filter(F.col("chrom").isin(*SOYBEAN.chromosomes)).groupBy("assembly", "chrom").agg(F.max("pos_bp").alias("max_bp"))


def assembly_markers(table: DataFrame, assembly: str) -> DataFrame:
    """marker_id, chrom, pos_bp of one assembly, canonical chromosomes only, in marker order."""
    chrom = F.col(f"chrom_{assembly}")
    return (
        table.filter(chrom.isin(*SOYBEAN.chromosomes))
        .select("marker_id", chrom.alias("chrom"), F.col(f"pos_bp_{assembly}").alias("pos_bp"))
        .orderBy(chrom_order(F.col("chrom")), "pos_bp", "marker_id")
    )
