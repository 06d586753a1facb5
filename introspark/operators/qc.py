"""Quality control: per-sample rates, flags, family outliers, parent checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from introspark.config import Filters
from introspark.functions.calls import shared_alleles
from introspark.functions.generation import expected_fractions, parse_generation
from introspark.operators.background import ratio, rpp_sums
from introspark.operators.classify import is_counted
from introspark.schema import (
    EXCLUDING_FLAGS,
    MAD_TO_SIGMA,
    OUTLIER_MIN_MEMBERS,
    OUTLIER_MIN_SCALE,
    OUTLIER_Z,
    SIBLING_MIN_BACKCROSS,
    STATE_A,
    STATE_B,
    STATE_H,
    STATE_X,
)


def metrics_by_chromosome(state_rows: DataFrame) -> DataFrame:
    """Every per-sample sum the analysis needs, in one pass, per (sample, chromosome).

    Calls are aggregated map-side before the only shuffle, so neither a large sample nor a large
    chromosome meets in one task.
    """
    state, a1, a2 = F.col("state"), F.col("a1"), F.col("a2")
    both = a1.isNotNull() & a2.isNotNull()
    s_rp = shared_alleles(a1, a2, F.col("rp1"), F.col("rp2"))
    s_dp = shared_alleles(a1, a2, F.col("dp1"), F.col("dp2"))
    return state_rows.groupBy("sample_id", "chrom").agg(
        F.count_if(both).alias("n_called"),
        *[F.count_if(state == code).alias(name) for code, name in
          ((STATE_A, "n_a"), (STATE_H, "n_h"), (STATE_B, "n_b"), (STATE_X, "n_x"))],
        *rpp_sums(),
        F.sum(s_rp).alias("shared_rp"), F.count(s_rp).alias("n_rp"),
        F.sum(s_dp).alias("shared_dp"), F.count(s_dp).alias("n_dp"),
    )


SUMS = ("n_called", "n_a", "n_h", "n_b", "n_x", "rpp_num", "rpp_den", "shared_rp", "n_rp", "shared_dp", "n_dp")


def sample_metrics(by_chromosome: DataFrame, samples: DataFrame, n_markers: Column, carrier: DataFrame | None = None) -> DataFrame:
    """One row per sample: totals over its chromosomes, RPP overall / on / off carrier chromosomes, rates.

    ``n_markers`` counts every marker of the dataset: a cell nobody wrote is a missing call. ``carrier``
    lists the chromosomes that hold a target.
    """
    rows = by_chromosome
    if carrier is not None:
        rows = rows.join(F.broadcast(carrier.select("chrom", F.lit(True).alias("on_carrier"))), "chrom", "left")  # one row per target
    else:
        rows = rows.withColumn("on_carrier", F.lit(None).cast("boolean"))
    on = F.coalesce("on_carrier", F.lit(False))
    per_sample = rows.groupBy("sample_id").agg(
        *[F.sum(c).alias(c) for c in SUMS],
        *[F.sum(F.when(on, F.col(f"rpp_{x}"))).alias(f"carrier_{x}") for x in ("num", "den")],
        *[F.sum(F.when(~on, F.col(f"rpp_{x}"))).alias(f"noncarrier_{x}") for x in ("num", "den")],
        F.map_from_entries(F.collect_list(F.struct("chrom", ratio(F.col("rpp_num"), F.col("rpp_den"))))).alias("rpp_chrom"),
    )
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("n_called", "n_a", "n_h", "n_b", "n_x")}
    counted = counts["n_a"] + counts["n_h"] + counts["n_b"]
    informative_called = counted + counts["n_x"]
    shares = F.greatest(counted, F.lit(1))
    generation = parse_generation(F.col("generation"))
    return (
        samples.join(per_sample, "sample_id", "left")
        .withColumn("gen", generation)
        .withColumn("expected", expected_fractions(F.col("gen")))
        .select(
            *samples.columns, "gen", "rpp_chrom",
            ratio(F.col("rpp_num"), F.col("rpp_den")).alias("rpp_total"),
            ratio(F.col("carrier_num"), F.col("carrier_den")).alias("rpp_carrier"),
            ratio(F.col("noncarrier_num"), F.col("noncarrier_den")).alias("rpp_noncarrier"),
            F.try_divide(n_markers - counts["n_called"], n_markers).alias("missing_rate"),
            F.try_divide(counts["n_h"], counted).alias("het_rate"),
            F.try_divide(counts["n_b"], counted).alias("hom_donor_rate"),
            F.try_divide(counts["n_x"], informative_called).alias("nonparental_rate"),
            (counts["n_a"] / shares).alias("frac_a"), (counts["n_h"] / shares).alias("frac_h"), (counts["n_b"] / shares).alias("frac_b"),
            counted.alias("n_informative_called"),
            F.try_divide("shared_rp", 2 * F.col("n_rp")).alias("ibs_rp"),
            F.try_divide("shared_dp", 2 * F.col("n_dp")).alias("ibs_donor"),
            F.col("expected.rpp").alias("expected_rpp"),
            F.when(F.col("gen.filial_known"), F.col("expected.het")).alias("expected_het"),
        )
    )


def grouped_median(df: DataFrame, keys: list[str], value: str, scale: int = 4096) -> DataFrame:
    """Exact median of a column in [0, 1] per key, for groups of any size.

    Rows collapse to value counts, counts to at most ``scale + 1`` buckets per key; only the bucket that
    holds the middle rank is ordered. Returns the keys, ``median`` and ``n``.
    """
    counts = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", F.floor(F.col("_v") * scale))
    per_key = Window.partitionBy(*keys)
    running = per_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = (
        counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"))
        .select(*keys, "_b", F.sum("_n").over(running).alias("_upto"), F.col("_n").alias("_nb"), F.sum("_n").over(per_key).alias("n"))
        .withColumn("_before", F.col("_upto") - F.col("_nb"))
        .withColumn("_lo", F.expr("(n + 1) div 2")).withColumn("_hi", F.expr("(n + 2) div 2"))
        .filter("(_before < _lo and _lo <= _upto) or (_before < _hi and _hi <= _upto)")
        .select(*keys, "_b", "_before", "_lo", "_hi", "n")
    )
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        counts.join(middle, [*keys, "_b"])
        .withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
        .withColumn("_from", F.col("_upto") - F.col("_n"))
        .groupBy(*keys).agg(
            F.max("n").alias("n"),
            F.max(F.when((F.col("_from") < F.col("_lo")) & (F.col("_lo") <= F.col("_upto")), F.col("_v"))).alias("_x"),
            F.max(F.when((F.col("_from") < F.col("_hi")) & (F.col("_hi") <= F.col("_upto")), F.col("_v"))).alias("_y"),
        )
        .select(*keys, "n", ((F.col("_x") + F.col("_y")) / 2).alias("median"))
    )


def donor_shares(metrics: DataFrame, filters: Filters) -> DataFrame:
    """(sample_id, family, donor) of the members a family is judged by.

    Members over the missing-rate limit or without a share neither count nor get flagged.
    """
    donor = F.col("hom_donor_rate") + F.col("het_rate") / 2
    return metrics.filter((F.col("missing_rate") <= filters.max_missing_rate) & F.col("het_rate").isNotNull()).select(
        "sample_id", F.coalesce("family_id", F.lit("")).alias("family"), donor.alias("donor")
    )


def _cut(centre: Column, mad: Column) -> Column:
    return centre + OUTLIER_Z * F.greatest(MAD_TO_SIGMA * mad, F.lit(OUTLIER_MIN_SCALE))


def family_outliers(shares: DataFrame) -> DataFrame:
    """Samples whose donor share is far above their family's median: robust, one-sided, strict. Families of any size."""
    centre = grouped_median(shares, ["family"], "donor").filter(F.col("n") >= OUTLIER_MIN_MEMBERS)
    around = shares.join(centre.select("family", F.col("median").alias("centre")), "family")
    deviation = around.withColumn("deviation", F.abs(F.col("donor") - F.col("centre")))
    spread = grouped_median(deviation, ["family"], "deviation").select("family", F.col("median").alias("mad"))
    return around.join(spread, "family").filter(F.col("donor") > _cut(F.col("centre"), F.col("mad"))).select("sample_id")


def small_family_outliers(shares: DataFrame) -> DataFrame:
    """The same rule with each family as one sorted array: one shuffle, for families of a checked size."""

    def median(values: Column) -> Column:
        n = F.size(values)
        lower, upper = F.floor((n + 1) / 2).cast("int"), F.floor((n + 2) / 2).cast("int")
        return (F.element_at(values, lower) + F.element_at(values, upper)) / 2

    families = (
        shares.groupBy("family").agg(F.collect_list(F.struct("donor", "sample_id")).alias("m"))
        .filter(F.size("m") >= OUTLIER_MIN_MEMBERS)
        .select("m", median(F.array_sort("m.donor")).alias("centre"))
        .select("m", "centre", median(F.array_sort(F.transform("m", lambda x: F.abs(x["donor"] - F.col("centre"))))).alias("mad"))
    )
    return families.select("centre", "mad", F.inline("m")).filter(F.col("donor") > _cut(F.col("centre"), F.col("mad"))).select("sample_id")


def largest_family(shares: DataFrame) -> int:
    sizes = shares.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]


def rate_flags(filters: Filters) -> Column:
    """The flags that follow from one sample's own metrics, in their fixed order."""
    counted = F.col("n_informative_called") > 0
    gen = F.col("gen")
    still = F.col("het_rate") < 0.005
    checks = (
        ("high_missing", F.col("missing_rate") > filters.max_missing_rate),
        ("generation_unparsed", gen.isNull() & (F.col("generation") != "")),
        ("possible_self_or_outcross",
         counted & gen["filial_known"] & (gen["n_filial"] == 1) & (gen["n_backcross"] >= 1)
         & (F.col("hom_donor_rate") > filters.max_hom_donor_rate_bcf1)),
        ("het_rate_deviates", counted & (F.abs(F.col("het_rate") - F.col("expected_het")) > filters.het_rate_tolerance)),
        ("possible_outcross", counted & (F.col("nonparental_rate") > filters.max_nonparental_rate)),
        ("possible_rp_sample", counted & (F.col("ibs_rp") > 0.995) & still),
        ("possible_donor_sample", counted & (F.col("ibs_donor") > 0.995) & still),
    )
    return F.array_compact(F.array(*[F.when(check, name) for name, check in checks]))


def with_flags(metrics: DataFrame, filters: Filters, outliers: DataFrame, duplicated: DataFrame | None = None) -> DataFrame:
    """Add ``flags``: own metrics, then the family outlier flag, then the duplicate flag."""
    out = metrics.withColumn("flags", rate_flags(filters)).join(outliers.select("sample_id", F.lit(True).alias("is_outlier")), "sample_id", "left")
    if duplicated is None:
        out = out.withColumn("is_duplicate", F.lit(None).cast("boolean"))
    else:
        out = out.join(duplicated.select("sample_id", F.lit(True).alias("is_duplicate")), "sample_id", "left")
    late = F.array_compact(F.array(F.when(F.col("is_outlier"), "family_donor_outlier"), F.when(F.col("is_duplicate"), "possible_duplicate")))
    return out.withColumn("flags", F.concat("flags", late)).drop("is_outlier", "is_duplicate")


def excluding_flags(flags: Column, filters: Filters) -> Column:
    if not filters.exclude_qc_flagged:
        return F.array().cast("array<string>")
    return F.filter(flags, lambda f: f.isin(*EXCLUDING_FLAGS))


def qc_table(flagged: DataFrame, filters: Filters) -> DataFrame:
    return flagged.select(
        "sample_id", "line_name", "family_id", "generation", "missing_rate", "het_rate", "expected_het", "hom_donor_rate",
        "nonparental_rate", "expected_rpp", "ibs_rp", "ibs_donor", F.array_join("flags", "|").alias("flags"),
        (F.size(excluding_flags(F.col("flags"), filters)) > 0).alias("qc_excluded"),
    )


def parent_rates(parent_calls: DataFrame, markers: DataFrame) -> DataFrame:
    """(role, sample_id, het_rate over called markers, missing_rate over all markers)."""
    called = F.col("a1").isNotNull() & F.col("a2").isNotNull()
    n_markers = markers.agg(F.count(F.lit(1)).alias("n")).scalar()
    return parent_calls.groupBy("role", "sample_id").agg(
        F.try_divide(F.count_if(called & (F.col("a1") != F.col("a2"))), F.count_if(called)).alias("het_rate"), F.count_if(called).alias("n")
    ).select("role", "sample_id", "het_rate", (F.lit(1.0) - F.col("n") / n_markers).alias("missing_rate"))


# A parent with more missing calls, or a panel with fewer informative markers, is worth a warning.
PARENT_MISSING = 0.1
LEAST_INFORMATIVE = 0.2


def parent_qc(parent_calls: DataFrame, markers: DataFrame, filters: Filters) -> DataFrame:
    """(kind, role, sample_id, value): parents with many heterozygous or missing calls, and a panel on which they hardly
    differ (its value is the share of informative markers)."""
    rates = parent_rates(parent_calls, markers)
    high = F.array_compact(F.array(
        F.when(F.col("het_rate") > filters.parent_max_het_rate, F.struct(F.lit("heterozygous parent").alias("kind"), F.col("het_rate").alias("value"))),
        F.when(F.col("missing_rate") > PARENT_MISSING, F.struct(F.lit("missing parent calls").alias("kind"), F.col("missing_rate").alias("value"))),
    ))
    parents = rates.select("role", "sample_id", F.inline(high)).select("kind", "role", "sample_id", F.col("value").cast("double").alias("value"))
    share = F.count_if("informative") / F.count(F.lit(1))
    none = F.lit(None).cast("string")
    panel = markers.agg(share.alias("value")).filter(F.col("value") < LEAST_INFORMATIVE).select(F.lit("few informative markers").alias("kind"), none.alias("role"), none.alias("sample_id"), "value")
    return parents.unionByName(panel)


def sibling_caveat(samples: DataFrame) -> DataFrame:
    """(n_backcross, sibling_ibs) when siblings are expected to be as alike as duplicates, else no row."""
    n = F.max(parse_generation(F.col("generation"))["n_backcross"])
    advanced = samples.agg(n.alias("n_backcross")).filter(F.col("n_backcross") >= SIBLING_MIN_BACKCROSS)
    return advanced.select("n_backcross", (1 - F.pow(F.lit(2.0), -(F.col("n_backcross") + 1))).alias("sibling_ibs"))


def validation_summary(markers: DataFrame, samples: DataFrame, flagged: DataFrame, n_duplicate_pairs: Column, n_warnings: Column) -> DataFrame:
    """One row of counts."""
    return markers.agg(
        F.count(F.lit(1)).alias("n_markers"), F.count_if("informative").alias("n_informative")
    ).select(
        "n_markers", "n_informative",
        samples.agg(F.count(F.lit(1)).alias("n")).scalar().alias("n_samples"),
        flagged.agg(F.count(F.lit(1)).alias("n")).scalar().alias("n_progeny"),
        flagged.agg(F.count_if(F.size("flags") > 0).alias("n")).scalar().alias("n_flagged"),
        n_duplicate_pairs.alias("n_duplicate_pairs"), n_warnings.alias("n_warnings"),
    )
