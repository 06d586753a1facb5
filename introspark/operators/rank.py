"""Hard filters, composite score and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from introspark.config import Filters, Weights
from introspark.operators.common import land
from introspark.operators.qc import excluding_flags


def reasons_column(filters: Filters) -> Column:
    """Aggregate over one sample's loci: the reason texts of those that fail, targets first, in criteria order."""
    unknown_ok = F.when(F.col("section") == "target", filters.unknown_target_is == "pass").otherwise(filters.unknown_avoid_is == "pass")
    bad = (F.col("status") == "fail") | ((F.col("status") == "unknown") & ~unknown_ok)
    reason = F.struct(
        F.when(F.col("section") == "target", 0).otherwise(1).alias("s"), "ord",
        F.concat_ws(":", "section", "locus_id", "status").alias("text"),
    )
    return F.transform(F.array_sort(F.collect_list(F.when(bad, reason))), lambda r: r["text"]).alias("locus_reasons")


def hard_filters(flagged: DataFrame, filters: Filters) -> DataFrame:
    """Add ``passes_filters`` and ``exclusion_reason`` from ``locus_reasons``, the missing rate and the flags."""
    hits = excluding_flags(F.col("flags"), filters)
    late = F.array_compact(F.array(
        F.when(F.col("missing_rate") > filters.max_missing_rate, f"missing_rate>{filters.max_missing_rate}"),
        F.when(F.size(hits) > 0, F.concat(F.lit("qc:"), F.array_join(hits, "|"))),
    ))
    reasons = F.concat("locus_reasons", late)
    return flagged.withColumns({"passes_filters": F.size(reasons) == 0, "exclusion_reason": F.array_join(reasons, ";")}).drop("locus_reasons")


def composite_score(weights: Weights) -> Column:
    """Weighted mean of the known components, each clipped to [0, 1]; NULL when none is known."""
    components = {
        "rpp_noncarrier": F.coalesce("rpp_noncarrier", "rpp_total"),
        "rpp_carrier": F.col("rpp_carrier"),
        "drag": F.col("drag"),
        "recombinant": F.col("recombinant"),
        "similarity_rp": F.col("ibs_rp"),
        "completeness": F.lit(1.0) - F.col("missing_rate"),
    }
    num, den = F.lit(0.0), F.lit(0.0)
    for name, w in weights.positive():
        value = components[name]
        clipped = F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))
        num = num + F.coalesce(w * clipped, F.lit(0.0))
        den = den + F.when(value.isNotNull(), w).otherwise(0.0)
    return F.try_divide(num, den)


def ranking_order(mode: str) -> list[Column]:
    """Best first; unknown values last; the sample id settles every tie."""
    first = (
        [F.desc_nulls_last("recombinant_flanks"), F.desc_nulls_last("rpp_carrier"), F.desc_nulls_last("rpp_noncarrier")]
        if mode == "staged"
        else [F.desc_nulls_last("composite_score"), F.desc_nulls_last("rpp_total")]
    )
    return [*first, F.asc_nulls_last("drag_total_est"), F.asc_nulls_last("missing_rate"), F.asc("sample_id")]


def positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number all rows 1..n in a total order without bringing them into one task.

    Rows are range-partitioned and sorted; the id Spark gives a row is (partition, index), and it is
    pinned by writing the table. Only the partition sizes meet in a window.
    """
    numbered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    pinned = land(numbered, "positions")
    part, index = F.shiftrightunsigned("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pinned.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        pinned.withColumn("_part", part).join(offsets, "_part")
        .withColumn(name, F.col("_offset") + index + 1)
        .drop("_id", "_part", "_offset")
    )


def ranks(scored: DataFrame, mode: str) -> DataFrame:
    """Add ``rank_overall`` and ``rank_in_family``; excluded samples have none.

    ``scored`` should be materialised, for it is read twice. Rows are numbered by ranges, however many there are.
    """
    keys = ["recombinant_flanks", "rpp_carrier", "rpp_noncarrier", "composite_score", "rpp_total", "drag_total_est", "missing_rate"]
    passing = scored.filter("passes_filters").select("sample_id", F.coalesce("family_id", F.lit("")).alias("_family"), *keys)
    overall = positions(passing, ranking_order(mode), "rank_overall")
    by_family = positions(overall.select("sample_id", "_family", "rank_overall"), [F.asc("_family"), F.asc("rank_overall")], "_p")
    starts = by_family.groupBy("_family").agg(F.min("_p").alias("_first"))
    numbered = by_family.join(starts, "_family").select(
        "sample_id", F.col("rank_overall").cast("int"), (F.col("_p") - F.col("_first") + 1).cast("int").alias("rank_in_family")
    )
    return scored.join(numbered, "sample_id", "left")


def result_order() -> list[Column]:
    return [F.asc_nulls_last("rank_overall"), F.asc("sample_id")]
