"""Linkage drag: bounds of the donor segment around each target, and flanking recombinants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from introspark.config import Criteria, Locus
from introspark.operators.loci import every_sample_at_every_locus
from introspark.schema import STATE_A, STATE_B, STATE_H


def interpolated(lower: Column, upper: Column, x: Column, at: str, value: str) -> Column:
    """Linear interpolation between two anchors (structs), clamped when one of them is absent."""
    slope = (upper[value] - lower[value]) / F.nullif((upper[at] - lower[at]).cast("double"), F.lit(0.0))
    return (
        F.when(lower.isNull(), upper[value])
        .when(upper.isNull() | (lower[at] == x), lower[value])
        .otherwise(slope * (x - lower[at]) + lower[value])
    )


def locus_edges(markers: DataFrame, resolved: DataFrame, ends: DataFrame, unit: str) -> DataFrame:
    """Loci with both edges and the far chromosome end in the drag unit: one row per locus."""
    if unit == "bp":
        far = ends.select("chrom", F.col("end_bp").cast("double").alias("far_end"))
        return resolved.join(far, "chrom", "left").select(
            "*", F.col("start_bp").cast("double").alias("left_edge"), F.col("end_bp").cast("double").alias("right_edge")
        )
    anchor = F.struct("pos_bp", "file_ord", "cm")

    def edge(x: str) -> Column:
        lower = F.max(F.when(F.col("pos_bp") <= F.col(x), anchor))
        upper = F.min(F.when(F.col("pos_bp") > F.col(x), anchor))
        return F.struct(lower.alias("lower"), upper.alias("upper"))

    at = (
        markers.filter("cm is not null").select("chrom", "pos_bp", "file_ord", "cm")
        .join(F.broadcast(resolved.select("locus_id", "chrom", "start_bp", "end_bp")), "chrom")  # one row per locus
        .groupBy("locus_id", "start_bp", "end_bp")
        .agg(edge("start_bp").alias("s"), edge("end_bp").alias("e"), F.max("cm").alias("far_end"))
        .select(
            "locus_id", "far_end",
            interpolated(F.col("s.lower"), F.col("s.upper"), F.col("start_bp"), "pos_bp", "cm").alias("left_edge"),
            interpolated(F.col("e.lower"), F.col("e.upper"), F.col("end_bp"), "pos_bp", "cm").alias("right_edge"),
        )
    )
    return resolved.join(at, "locus_id", "left")


def flank_markers(markers: DataFrame, members: DataFrame, edges: DataFrame, unit: str) -> DataFrame:
    """Markers outside each target on its chromosome: side, distance from the locus, and walking order."""
    at = F.col("pos_bp").cast("double") if unit == "bp" else F.col("cm")
    near = edges.filter("section = 'target'").select("locus_id", "chrom", "start_bp", "end_bp", "left_edge", "right_edge")
    side = F.when(F.col("pos_bp") < F.col("start_bp"), "left").when(F.col("pos_bp") > F.col("end_bp"), "right")
    distance = F.when(F.col("side") == "left", F.col("left_edge") - F.col("_at")).otherwise(F.col("_at") - F.col("right_edge"))
    return (
        markers.select("marker_id", "chrom", "pos_bp", "file_ord", at.alias("_at")).filter("_at is not null")
        .join(F.broadcast(near), "chrom")  # one row per target
        .withColumn("side", side).filter("side is not null")
        .join(members.select("locus_id", "marker_id"), ["locus_id", "marker_id"], "left_anti")
        .select("locus_id", "marker_id", "side", F.struct(distance.alias("distance"), "pos_bp", "file_ord").alias("step"))
    )


def drag_bounds(near: DataFrame, samples: DataFrame, targets: Sequence[Locus], edges: DataFrame, criteria: Criteria) -> DataFrame:
    """(sample_id, locus_id, left/right min/max, recombinant flags, totals) for every sample and target.

    Outward from the locus, the segment ends at the first recurrent-parent call (or the chromosome
    end) and reaches at least to the last donor call before it. ``near`` are ``loci.locus_calls``. Two unordered
    aggregates instead of an ordered walk, both on one shuffle: the ending calls of a group are found in a window
    over it, the farthest donor calls before them in its aggregate. A group is one sample's calls beside one
    target (a chromosome at most), and spills.
    """
    key = ["sample_id", "locus_id"]
    walk = near.filter(F.col("side").isin("left", "right")).select(*key, "state", "side", "step")

    def on(side: str, condition: Column) -> Column:
        return F.when((F.col("side") == side) & condition, F.col("step"))

    group = Window.partitionBy(*key)
    ended = walk.select("*", *[F.min(on(x, F.col("state") == STATE_A)).over(group).alias(f"{x}_a") for x in ("left", "right")])

    def before_end(side: str) -> Column:
        donor = F.col("state").isin(STATE_H, STATE_B)
        return F.max(on(side, donor & (F.col(f"{side}_a").isNull() | (F.col("step") < F.col(f"{side}_a")))))["distance"]

    reached = ended.groupBy(*key).agg(*[f(x).alias(f"{x}_{n}") for x in ("left", "right") for f, n in ((lambda x: F.first(f"{x}_a"), "a"), (before_end, "d"))])
    zero, window = F.lit(0.0), F.lit(float(criteria.flank_window))
    span = edges.select("locus_id", "ord", "left_edge", "right_edge", "far_end", "flank_left", "flank_right")
    bounds = (
        every_sample_at_every_locus(samples, targets)
        .join(F.broadcast(span), "locus_id")  # one row per target
        .join(reached, key, "left")
        .select(
            *key, "ord", "far_end", "flank_left", "flank_right",
            F.coalesce("left_d", zero).alias("left_min"),
            F.coalesce("left_a.distance", F.greatest(F.col("left_edge"), zero)).alias("left_max"),
            F.coalesce("right_d", zero).alias("right_min"),
            F.coalesce("right_a.distance", F.greatest(F.col("far_end") - F.col("right_edge"), zero)).alias("right_max"),
        )
    )
    total_max, total_min = F.col("left_max") + F.col("right_max"), F.col("left_min") + F.col("right_min")
    return bounds.select(
        *key, "ord", "far_end", "left_min", "left_max", "right_min", "right_max",
        (F.col("left_max") <= F.coalesce("flank_left", window)).alias("recombinant_left"),
        (F.col("right_max") <= F.coalesce("flank_right", window)).alias("recombinant_right"),
        total_max.alias("total_max"), total_min.alias("total_min"), ((total_min + total_max) / 2).alias("total_est"),
    )


def span_share() -> Column:
    """Share of the chromosome the estimated segment covers, in [0, 1]; a chromosome without extent counts 1."""
    share = F.least(F.greatest(F.col("total_est") / F.nullif("far_end", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.when(F.col("far_end") > 0, share).otherwise(1.0)


def drag_columns(n_targets: int) -> tuple[list[Column], list[Column]]:
    """(aggregates over one sample's targets, the columns made from them): totals and the two components."""
    flanks = F.col("recombinant_left").cast("int") + F.col("recombinant_right").cast("int")
    per_target = F.when(F.col("total_est").isNotNull(), F.struct("ord", "total_est", "total_max", span_share().alias("share")))
    aggregates = [F.array_sort(F.collect_list(per_target)).alias("_t"), F.sum(flanks).cast("int").alias("recombinant_flanks")]

    def in_order(name: str) -> Column:
        """Sum over the targets in criteria order, so that rounding does not depend on the partitioning."""
        return F.aggregate("_t", F.lit(0.0), lambda total, t: total + t[name])

    return aggregates, [
        in_order("total_est").alias("drag_total_est"), in_order("total_max").alias("drag_total_max"), F.col("recombinant_flanks"),
        (1 - in_order("share") / n_targets).alias("drag"), (F.col("recombinant_flanks") / F.lit(2 * n_targets)).alias("recombinant"),
    ]


def drag_summary(drag: DataFrame, n_targets: int) -> DataFrame:
    aggregates, columns = drag_columns(n_targets)
    return drag.groupBy("sample_id").agg(*aggregates).select("sample_id", *columns)
