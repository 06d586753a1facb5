"""Cross, family and generation: counts at each level, and the row filter that follows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNASSIGNED = ""


def cross_name(samples: DataFrame) -> DataFrame:
    """One row: ``<recurrent line> x <donor line>``."""
    rp = F.max(F.when(F.col("role") == "recurrent_parent", F.col("line_name")))
    donor = F.max(F.when(F.col("role") == "donor_parent", F.col("line_name")))
    return samples.agg(F.concat(rp, F.lit(" x "), donor).alias("cross"))


def family_tree(progeny: DataFrame) -> DataFrame:
    """(level, family_id, generation, n): the cross, its families, and each family's generations, NULL last."""
    return (
        progeny.rollup("family_id", "generation")
        .agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
        .select(
            F.when(F.col("g") == 3, "cross").when(F.col("g") == 1, "family").otherwise("generation").alias("level"),
            "family_id", "generation", "n", F.col("g").alias("_g"),
        )
        .orderBy(
            F.desc(F.col("_g") == 3), F.asc_nulls_last("family_id"), F.desc("_g"), F.asc_nulls_last("generation")
        )
        .drop("_g")
    )


def _selected(column: str, selector: str | None) -> Column:
    if selector is None:
        return F.lit(True)
    if selector == UNASSIGNED:
        return F.coalesce(column, F.lit("")) == ""
    return F.coalesce(F.col(column) == selector, F.lit(False))


def filter_rows(rows: DataFrame, family: str | None = None, generation: str | None = None) -> DataFrame:
    """None keeps everything, the empty selector keeps unassigned rows, a value keeps its own rows."""
    return rows.filter(_selected("family_id", family) & _selected("generation", generation))
