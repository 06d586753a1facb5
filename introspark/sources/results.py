"""Read a results table back, and check it against its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from introspark.functions.text import cells
from introspark.schema import NUMERIC_RESULT_COLUMNS, RESULT_LAST, RESULT_PREFIX
from introspark.sources.lines import read_lines


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Text cells of a folder that ``sinks.export.write_table`` has written, under the names in its header line."""
    rows = read_lines(spark, path, parts=True)
    head = rows.agg(F.min(F.struct("ord", "value")).alias("h")).select("h.ord", cells(F.col("h.value"), F.lit(",")).alias("names")).first()
    body = rows.filter(F.col("ord") > head["ord"]).select(cells(F.col("value"), F.lit(",")).alias("c"))
    return body.select(*[F.get("c", F.lit(i)).alias(name) for i, name in enumerate(head["names"])])


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return parse_results(read_table(spark, path))


def parse_results(text: DataFrame) -> DataFrame:
    """Text cells to values. NA is missing only where a missing value has a meaning."""
    typed = {c: F.nullif(F.nullif(c, F.lit("NA")), F.lit("")).try_cast("double") for c in NUMERIC_RESULT_COLUMNS if c in text.columns}
    labels = {c: F.nullif(c, F.lit("NA")) for c in ("family_id", "generation") if c in text.columns}
    return text.withColumns({**typed, **labels, "passes_filters": F.coalesce(F.col("passes_filters") == "TRUE", F.lit(False))})


def contract_problems(columns: list[str]) -> list[str]:
    """What is wrong with the column list: the fixed prefix in order, and the profile last."""
    out = []
    if tuple(columns[: len(RESULT_PREFIX)]) != RESULT_PREFIX:
        out.append("the fixed columns are missing or out of order")
    if not columns or columns[-1] != RESULT_LAST:
        out.append("token_profile is not the last column")
    return out


def contract_summary(text: DataFrame) -> DataFrame:
    """One row: rows, passing rows, rows of another schema version."""
    return text.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("passes_filters") == "TRUE").alias("n_passing"),
        F.count_if(~F.coalesce(F.col("results_schema").startswith("1."), F.lit(False))).alias("n_other_schema"),
    )
