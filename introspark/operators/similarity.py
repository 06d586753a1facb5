"""Identity by state between samples, and duplicate detection."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from introspark.functions.calls import shared_alleles
from introspark.operators import bitplanes
from introspark.operators.common import land, land_counted
from introspark.schema import DUPLICATE_IBS, DUPLICATE_OVERLAP_FRACTION


def ibs_to_parents(calls: DataFrame, markers: DataFrame) -> DataFrame:
    """(sample_id, ibs_rp, ibs_donor): mean shared allele share over markers called in both."""
    rows = calls.join(markers.select("marker_id", "rp1", "rp2", "dp1", "dp2"), "marker_id")
    a1, a2 = F.col("a1"), F.col("a2")
    return (
        rows.withColumn("s_rp", shared_alleles(a1, a2, F.col("rp1"), F.col("rp2")))
        .withColumn("s_dp", shared_alleles(a1, a2, F.col("dp1"), F.col("dp2")))
        .groupBy("sample_id").agg(
            F.try_divide(F.sum("s_rp"), 2 * F.count("s_rp")).alias("ibs_rp"),
            F.try_divide(F.sum("s_dp"), 2 * F.count("s_dp")).alias("ibs_donor"),
        )
    )


def compared_markers(markers: DataFrame) -> DataFrame:
    """The markers pairs are compared on: every one, once."""
    return markers.select("marker_id").distinct()


def similar_pairs(calls: DataFrame, markers: DataFrame, samples: DataFrame, min_ibs: float, floor: int, n_markers: int) -> DataFrame:
    """Pairs of samples of one ``scope`` with IBS of at least ``min_ibs`` over at least ``floor`` common markers.

    Samples are dealt to blocks and ``markers`` to chunks, and numbered inside them. Every call is shuffled once, to its
    block and chunk, where it becomes a few bits: planes of presence and of allele copies, or, where few calls are known, a
    list (``bitplanes``), which are written. Blocks meet block by block, and bounds end a comparison as soon as no pair of it
    is open. Only pairs above the threshold leave a task, and one row (without samples) with the number of pairs that reach
    the floor. Samples with fewer calls than the floor are in no such pair and are left out before. The work is that of all
    pairs of the others in a scope, as the definition asks.

    A sample has at most one call per marker. Absent and half-missing calls are no calls.
    """
    def dealt(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
        """Places 0, 1, ... inside each part: parts are small by choice."""
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)

    n_chunks = max(1, -(-n_markers // bitplanes.CHUNK))
    places = dealt(markers.withColumn("chunk", F.pmod(F.xxhash64("marker_id"), F.lit(n_chunks))), ["chunk"], ["marker_id"], "at")
    places = places.withColumn("n_at", F.count(F.lit(1)).over(Window.partitionBy("chunk")).cast("int"))
    placed = calls.filter("a1 is not null and a2 is not null").join(places, "marker_id").select("sample_id", "chunk", "at", "n_at", "a1", "a2")
    placed = land(placed, "placed-calls")
    # a sample with fewer calls than the floor is in no pair that reaches it
    able = placed.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_calls")).filter(F.col("n_calls") >= floor)
    able, seen = land_counted(samples.select("scope", "sample_ord", "sample_id").join(able, "sample_id"), "able-samples", n=F.count(F.lit(1)), n_calls=F.sum("n_calls"))
    per_block = bitplanes.block_size(n_markers, seen["n"], seen["n_calls"] or 0)
    sizes = able.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / per_block).alias("n_blocks"))
    own = able.drop("n_calls").join(sizes, "scope").withColumn("block", F.pmod(F.xxhash64("sample_id"), "n_blocks"))
    own = land(dealt(own.drop("n_blocks"), ["scope", "block"], ["sample_ord", "sample_id"], "row"), "sample-places")
    packed = placed.join(own.drop("sample_ord"), "sample_id").select("scope", "block", "chunk", "row", "at", "n_at", "a1", "a2")
    packed = land(packed.groupBy("scope", "block", "chunk").applyInArrow(bitplanes.pack, bitplanes.PACKED), "bit-planes")
    blocks = packed.select("scope", "block").distinct()
    met = blocks.withColumnRenamed("block", "i").join(blocks.withColumnRenamed("block", "j"), "scope").filter("i <= j")
    met = met.select("scope", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    kernel = bitplanes.pair_kernel(min_ibs, floor, n_markers)
    found = met.join(packed, ["scope", "block"]).groupBy("scope", "i", "j").applyInArrow(kernel, bitplanes.PAIRS)
    side = lambda block, row, name: own.select("scope", F.col("block").alias(block), F.col("row").alias(row), F.struct("sample_ord", "sample_id").alias(name))
    named = found.join(side("i", "a", "x"), ["scope", "i", "a"], "left").join(side("j", "b", "y"), ["scope", "j", "b"], "left")
    pair = F.array_sort(F.array("x", "y"))
    return named.select(pair[0]["sample_id"].alias("sample_a"), pair[1]["sample_id"].alias("sample_b"), "n_overlap", "n_shared", "n_assessed")


def overlap_floor(pool: int, fraction: float = DUPLICATE_OVERLAP_FRACTION) -> int:
    return max(1, math.ceil(fraction * pool))


def duplicate_scan(
    calls: DataFrame,
    pool: DataFrame,
    progeny: DataFrame,
    n_pool: int,
    n_samples: int,
    threshold: float = DUPLICATE_IBS,
    min_overlap: float = DUPLICATE_OVERLAP_FRACTION,
    pair_scope: str = "all",
) -> DataFrame:
    """(sample_a, sample_b, ibs, n_overlap, n_assessed); rows without samples carry the assessed count of a block pair.

    ``pool`` holds the markers to compare on (the informative ones), ``progeny`` the samples in manifest order
    (``sample_ord``). ``pair_scope`` is ``all``, or ``family`` to compare only within families: the caller's choice,
    never made by size.
    """
    if pair_scope not in ("all", "family"):
        raise ValueError("pair_scope must be all or family")
    scope = F.coalesce("family_id", F.lit("")) if pair_scope == "family" else F.lit("")
    pairs = similar_pairs(
        calls, compared_markers(pool), progeny.select("sample_id", "sample_ord", scope.alias("scope")), threshold,
        overlap_floor(n_pool, min_overlap), n_pool,
    )
    return pairs.select("sample_a", "sample_b", F.try_divide(F.col("n_shared"), 2 * F.col("n_overlap")).alias("ibs"), "n_overlap", "n_assessed")


def duplicate_members(pairs: DataFrame) -> DataFrame:
    """Samples that take part in any duplicate pair."""
    return pairs.filter("sample_a is not null").select(F.explode(F.array("sample_a", "sample_b")).alias("sample_id")).distinct()


def skipped_pairs(pairs: DataFrame, n_samples: int) -> DataFrame:
    """One row: how many pairs have too few common calls to be assessed."""
    return pairs.agg((F.lit(n_samples * (n_samples - 1) // 2) - F.coalesce(F.sum("n_assessed"), F.lit(0))).alias("n_skipped"))
