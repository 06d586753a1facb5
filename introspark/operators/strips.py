"""Graphical genotypes as data: runs of equal states along each chromosome, and locus ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from introspark.functions.chrom import Crop, assembly_length


def strip_lengths(markers: DataFrame, assembly: str, crop: Crop) -> DataFrame:
    """(chrom, length_bp, n_markers): reference length or last marker, whichever is farther; never zero."""
    per = markers.groupBy("chrom").agg(F.max("pos_bp").alias("last_bp"), F.count(F.lit(1)).alias("n_markers"))
    length = F.greatest(F.coalesce(assembly_length(F.col("chrom"), assembly, crop), F.lit(0)), F.col("last_bp"))
    return per.select("chrom", F.when(length > 0, length).otherwise(1).cast("double").alias("length_bp"), "n_markers")


def segments(state_rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """(sample_id, chrom, start, end, state): runs of one state as fractions of the chromosome.

    A boundary lies midway between two markers of different states. One shuffle and one sort by (sample, chromosome)
    serve both looks at neighbours: a run opens where the state changes, and ends where the next one opens. A group
    holds the markers of one chromosome, once.
    """
    along = Window.partitionBy("sample_id", "chrom").orderBy("pos_bp", "file_ord")
    before = F.lag(F.struct("pos_bp", "state")).over(along)
    opening = (
        state_rows.select("sample_id", "chrom", "pos_bp", "file_ord", "state").withColumn("_before", before)
        .filter(F.col("_before").isNull() | (F.col("_before.state") != F.col("state")))
    )
    middle = F.when(F.col("_before").isNull(), 0.0).otherwise((F.col("_before.pos_bp") + F.col("pos_bp")) / 2.0)
    runs = opening.withColumn("_start", middle).withColumn("_end", F.lead("_start").over(along))
    return runs.join(lengths.select("chrom", "length_bp"), "chrom").select(
        "sample_id", "chrom", "pos_bp", (F.col("_start") / F.col("length_bp")).alias("start"),
        F.coalesce(F.col("_end") / F.col("length_bp"), F.lit(1.0)).alias("end"), "state",
    )


def locus_ticks(resolved: DataFrame, lengths: DataFrame) -> DataFrame:
    """Loci as fractions of their chromosome; loci on a chromosome without a strip are dropped."""
    return resolved.join(lengths, "chrom").select(
        "chrom", "locus_id", F.col("section").alias("kind"),
        (F.col("start_bp") / F.col("length_bp")).alias("start"), (F.col("end_bp") / F.col("length_bp")).alias("end"),
    )
