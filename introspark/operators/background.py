"""Marker weights and recurrent-parent proportion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from introspark.functions.chrom import Crop, assembly_length
from introspark.operators.classify import is_counted
from introspark.operators.common import neighbours
from introspark.schema import DEFAULT_COVERAGE, STATE_A, STATE_B, STATE_H

# Width of the position bins that bound every ordered window over markers.
BIN_BP = 1_000_000


def chromosome_ends(markers: DataFrame, assembly: str, crop: Crop) -> DataFrame:
    """Per chromosome: last marker, reference length, the end in use, and whether the reference places it.

    A chromosome without a length, or overrun by its markers, ends at its last marker and is unplaced.
    """
    per = markers.groupBy("chrom").agg(
        F.max("pos_bp").alias("last_bp"), F.max("cm").alias("last_cm"), F.count(F.lit(1)).alias("n_markers")
    )
    length = assembly_length(F.col("chrom"), assembly, crop)
    kind = F.when(length.isNull(), "missing").when(F.col("last_bp") > length, "beyond").otherwise("placed")
    return (
        per.withColumn("length_bp", length)
        .withColumn("kind", kind)
        .withColumn("end_bp", F.when(F.col("kind") == "placed", F.col("length_bp")).otherwise(F.col("last_bp")))
    )


def end_warnings(ends: DataFrame) -> DataFrame:
    """(kind, chrom, last_bp, length_bp): every chromosome whose end the length table doesn't give. ``beyond``: markers lie
    past its length; otherwise it has none, and its last marker is taken for its end. Sort by ``chrom_order`` to print."""
    return ends.filter("kind <> 'placed'").select("kind", "chrom", "last_bp", "length_bp")


def marker_weights(markers: DataFrame, ends: DataFrame, unit: str, max_coverage: float | None = None) -> DataFrame:
    """Add ``weight2``: twice the map length each informative marker stands for (0 for the others).

    Doubling keeps every bp weight a whole number, so sums do not depend on their order.
    """
    cap = float(DEFAULT_COVERAGE[unit] if max_coverage is None else max_coverage)
    at = F.col("pos_bp").cast("double") if unit == "bp" else F.col("cm")
    usable = (
        markers.withColumn("_at", at)
        .filter(F.col("informative") & F.col("_at").isNotNull())
        .select("marker_id", "chrom", "pos_bp", "file_ord", "_at", F.floor(F.col("pos_bp") / BIN_BP).alias("_bin"))
    )
    placed = ends.select("chrom", F.when(F.col("kind") == "placed", F.col("end_bp").cast("double")).alias("_end"))
    cap_column = F.lit(cap)
    first_outer = cap_column if unit == "cm" else F.least(2 * F.col("_at"), cap_column)
    last_outer = cap_column if unit == "cm" else F.coalesce(F.least(2 * (F.col("_end") - F.col("_at")), cap_column), cap_column)
    # an absent reference length must not turn into a zero side
    if unit == "bp":
        last_outer = F.when(F.col("_end").isNull(), cap_column).otherwise(last_outer)
    left = F.when(F.col("prev").isNull(), first_outer).otherwise(F.least(F.col("_at") - F.col("prev._at"), cap_column))
    right = F.when(F.col("next").isNull(), last_outer).otherwise(F.least(F.col("next._at") - F.col("_at"), cap_column))
    zero = F.lit(0.0)
    weighed = (
        neighbours(usable, ["chrom"], "_bin", ["pos_bp", "file_ord"], ["_at"])
        .join(placed, "chrom", "left")
        .select("marker_id", (F.greatest(left, zero) + F.greatest(right, zero)).alias("weight2"))
    )
    return markers.join(weighed, "marker_id", "left").withColumn("weight2", F.coalesce("weight2", zero))


def unit_weights(markers: DataFrame) -> DataFrame:
    """The count model: every informative marker weighs the same."""
    return markers.withColumn("weight2", F.when(F.col("informative"), 1.0).otherwise(0.0))


def contribution2(state: Column) -> Column:
    """Twice the recurrent-parent share of a state."""
    return F.when(state == STATE_A, 2).when(state == STATE_H, 1).when(state == STATE_B, 0)


def rpp_sums(prefix: str = "") -> list[Column]:
    """The two sums whose quotient is RPP, as aggregates over state and weight2."""
    counted = is_counted(F.col("state"))
    return [
        F.sum(F.when(counted, F.col("weight2") * contribution2(F.col("state"))).otherwise(0.0)).alias(prefix + "rpp_num"),
        F.sum(F.when(counted, 2 * F.col("weight2")).otherwise(0.0)).alias(prefix + "rpp_den"),
    ]


def ratio(num: Column, den: Column) -> Column:
    """NULL instead of a division by zero."""
    return F.try_divide(num, den)


def rpp_by_chromosome(state_rows: DataFrame) -> DataFrame:
    return (
        state_rows.groupBy("sample_id", "chrom").agg(*rpp_sums())
        .select("sample_id", "chrom", ratio(F.col("rpp_num"), F.col("rpp_den")).alias("rpp"))
    )
