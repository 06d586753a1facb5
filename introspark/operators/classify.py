"""Parent of origin: informative markers and the state of every call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from introspark.operators.dataset import Dataset
from introspark.schema import STATE_A, STATE_B, STATE_H, STATE_LABELS, STATE_N, STATE_U, STATE_X

# Reasons a marker cannot tell the parents apart, in order of precedence.
RP_MISSING = "recurrent parent missing"
DONOR_MISSING = "donor parent missing"
RP_HET = "recurrent parent heterozygous"
DONOR_HET = "donor parent heterozygous"
MONOMORPHIC = "parents identical (monomorphic)"


def classified_markers(dataset: Dataset) -> DataFrame:
    """Markers with both parents' alleles, ``informative`` and ``reason``.

    The parents are two rows per marker, so they are folded into the marker table with one aggregate.
    """

    def allele(role: str, side: str) -> Column:
        return F.max(F.when(F.col("role") == f"{role}_parent", F.col(side)))

    parents = dataset.parent_calls().groupBy("marker_id").agg(
        allele("recurrent", "a1").alias("rp1"), allele("recurrent", "a2").alias("rp2"),
        allele("donor", "a1").alias("dp1"), allele("donor", "a2").alias("dp2"),
    )
    rp_missing = F.col("rp1").isNull() | F.col("rp2").isNull()
    dp_missing = F.col("dp1").isNull() | F.col("dp2").isNull()
    reason = (
        F.when(rp_missing, RP_MISSING)
        .when(dp_missing, DONOR_MISSING)
        .when(F.col("rp1") != F.col("rp2"), RP_HET)
        .when(F.col("dp1") != F.col("dp2"), DONOR_HET)
        .when(F.col("rp1") == F.col("dp1"), MONOMORPHIC)
    )
    return (
        dataset.markers.join(parents, "marker_id", "left")
        .withColumn("reason", reason)
        .withColumn("informative", F.col("reason").isNull())
    )


def state_of_call() -> Column:
    """State code from a1, a2, the parents' alleles and ``informative``."""
    a1, a2, rp, dp = F.col("a1"), F.col("a2"), F.col("rp1"), F.col("dp1")
    return (
        F.when(~F.col("informative"), STATE_U)
        .when(a1.isNull() | a2.isNull(), STATE_N)
        .when((a1 == rp) & (a2 == rp), STATE_A)
        .when((a1 == dp) & (a2 == dp), STATE_B)
        .when(((a1 == rp) & (a2 == dp)) | ((a1 == dp) & (a2 == rp)), STATE_H)
        .otherwise(STATE_X)
        .cast("tinyint")
    )


def state_label(state: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(x) for x in STATE_LABELS]), state.cast("int") + 1)


def is_counted(state: Column) -> Column:
    """Called and informative."""
    return state <= STATE_B


def states(calls: DataFrame, markers: DataFrame) -> DataFrame:
    """Every call with its marker's attributes and its state.

    A plain equi-join on marker_id: the optimizer broadcasts a small panel and shuffles a large one.
    """
    return calls.join(markers, "marker_id").withColumn("state", state_of_call())


def uninformative_summary(markers: DataFrame) -> DataFrame:
    return (
        markers.filter(F.col("reason").isNotNull())
        .groupBy("reason").agg(F.count(F.lit(1)).alias("n_markers"))
        .orderBy(F.desc("n_markers"), "reason")
    )
