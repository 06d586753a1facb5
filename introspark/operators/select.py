"""From ranked results to the parents of the next generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from introspark.schema import MANIFEST_COLUMNS

# Expected composition one generation on, from mean A/H/B: (A', H', B'), and the share that carries a target. Loci are
# taken to segregate freely and in Mendelian ratios.
_STEPS = {
    "backcross": (lambda a, h, b: (a + h / 2, h / 2 + b, F.lit(0.0)), 0.5),
    "self": (lambda a, h, b: (a + h / 4, h / 2, b + h / 4), 0.75),
}


def top_n(results: DataFrame, n: int, per_family: bool = True) -> DataFrame:
    """Passing samples ranked n or better, per family or overall. Unordered; see ``selection_order``."""
    rank = "rank_in_family" if per_family else "rank_overall"
    return results.filter(F.col("passes_filters") & (F.col(rank) <= n))


def selection_order(per_family: bool = True) -> list[Column]:
    return [F.coalesce("family_id", F.lit("")), F.col("rank_in_family" if per_family else "rank_overall")]


def project_next_generation(selected: DataFrame, step: str = "backcross") -> DataFrame:
    """One row of expectations; no row when nothing is selected."""
    if step not in _STEPS:
        raise ValueError("step must be backcross or self")
    change, carriers = _STEPS[step]
    a2, h2, b2 = change(F.col("a"), F.col("h"), F.col("b"))
    return (
        selected.agg(F.count(F.lit(1)).alias("n_selected"), F.avg("frac_a").alias("a"), F.avg("frac_h").alias("h"), F.avg("frac_b").alias("b"))
        .filter("n_selected > 0")
        .select(
            F.lit(step).alias("step"), "n_selected", (F.col("a") + F.col("h") / 2).alias("mean_rpp_selected"),
            (a2 + h2 / 2).alias("expected_rpp_next"), h2.alias("expected_het_next"),
            F.lit(carriers).alias("expected_target_carrier_fraction"),
            b2.alias("expected_hom_donor_next"),
        )
    )


def next_manifest(selected: DataFrame, samples: DataFrame, next_generation: str, n_per_selected: int = 1) -> DataFrame:
    """Both parents, then ``n_per_selected`` placeholder progeny of every selected sample."""
    label = (next_generation or "").strip()
    if not label:
        raise ValueError("next generation label must not be empty")
    if n_per_selected < 1:
        raise ValueError("placeholder rows per selected individual must be 1 or more")
    empty = F.lit("")
    parents = samples.filter(F.col("role").isin("recurrent_parent", "donor_parent")).select(
        "sample_id", "line_name", "role", empty.alias("generation"), empty.alias("family_id"), F.coalesce("notes", empty).alias("notes")
    )
    numbered = selected.select("sample_id", "line_name", F.explode(F.sequence(F.lit(1), F.lit(n_per_selected))).alias("k"))
    number = F.when(F.col("k") < 1000, F.lpad(F.col("k").cast("string"), 3, "0")).otherwise(F.col("k").cast("string"))
    progeny = numbered.select(
        F.concat_ws("-", "sample_id", F.lit(label), number).alias("sample_id"), F.coalesce("line_name", empty).alias("line_name"),
        F.lit("progeny").alias("role"), F.lit(label).alias("generation"), F.col("sample_id").alias("family_id"),
        F.concat(F.lit("derived from "), F.col("sample_id")).alias("notes"),
    )
    return parents.unionByName(progeny).select(*MANIFEST_COLUMNS)


def merge_selection(existing: DataFrame, more: DataFrame) -> DataFrame:
    """Sample ids of an existing selection and of new picks, each once."""
    return existing.select("sample_id").union(more.select("sample_id")).distinct()


def still_present(selected_ids: DataFrame, results: DataFrame) -> DataFrame:
    """Selected ids with whether the results still hold them."""
    found = results.select("sample_id", F.lit(True).alias("present")).distinct()
    return selected_ids.select("sample_id").join(found, "sample_id", "left").withColumn("present", F.coalesce("present", F.lit(False)))
