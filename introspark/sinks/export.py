"""Text outputs. Every writer leaves a folder of numbered CSV parts, whole or not at all; Parquet is the native form of every table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from introspark import __version__
from introspark.functions.chrom import SOYBEAN, Crop, chrom_order
from introspark.operators.rank import result_order
from introspark.operators.select import selection_order
from introspark.schema import CALL_SET_COLUMNS, RESULTS_SCHEMA, SELECTION_COLUMNS, TOOL_NAME


def number_text(x: Column) -> Column:
    """Six significant digits without trailing zeros; whole numbers from a million on; NA for NULL."""
    general = F.format_string("%.6g", x.cast("double"))
    trimmed = F.regexp_replace(F.regexp_replace(general, r"(\.[0-9]*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
    whole = F.format_string("%.0f", x.cast("double"))
    return F.when(x.isNull() | F.isnan(x.cast("double")), "NA").when(F.abs(x.cast("double")) < 1e6, trimmed).otherwise(whole)


def cell_text(df: DataFrame, name: str) -> Column:
    """One output cell: NULL is NA, empty text stays empty."""
    kind, c = dict(df.dtypes)[name], F.col(f"`{name}`")
    if kind == "boolean":
        out = F.when(c.isNull(), "NA").when(c, "TRUE").otherwise("FALSE")
    elif kind in ("double", "float"):
        out = number_text(c)
    else:
        out = F.coalesce(c.cast("string"), F.lit("NA"))
    return out.alias(name)


def results_text(results: DataFrame) -> DataFrame:
    return results.select(*[cell_text(results, c) for c in results.columns])


def csv_cell(c: Column) -> Column:
    """A cell as it stands in a line: quoted where it must be, empty for NULL."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def write_lines(head: DataFrame, body: DataFrame, path: str) -> None:
    """Write a folder of text parts: first ``head``, then ``body`` (both with ``value``) in the order it is sorted in.

    The parts are written beside ``path`` and renamed to it when all are whole, so a run that broke off leaves nothing
    there. An existing ``path`` is refused. ``read_lines(..., parts=True)`` reads the parts as one file.
    """
    spark = body.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, held = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path.rstrip('/')}.{uuid.uuid4().hex}.writing"))
    store = target.getFileSystem(conf)
    if store.exists(target):
        raise FileExistsError(path)
    head.select("value").unionByName(body.select("value")).write.text(held.toString())
    if not store.rename(held, target):
        raise OSError(f"{held.toString()} can't be renamed to {path}")


def write_table(df: DataFrame, path: str) -> None:
    """A sorted table of text cells as CSV lines under one header line."""
    names = [c if not set(c) & set('",') else '"' + c.replace('"', '""') + '"' for c in df.columns]
    head = df.sparkSession.range(1).select(F.lit(",".join(names)).alias("value"))
    write_lines(head, df.select(F.concat_ws(",", *[csv_cell(F.col(f"`{c}`")) for c in df.columns]).alias("value")), path)


def write_results(results: DataFrame, path: str) -> None:
    write_table(results_text(results.orderBy(*result_order())), path)


def selection_table(selected: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """The selection list with its notes, as text cells in contract order."""
    empty = F.lit("")
    rows = selected.drop("notes")
    rows = rows.withColumn("notes", empty) if notes is None else rows.join(notes.select("sample_id", "notes"), "sample_id", "left")
    unset = {c: empty for c in ("crop", "call_set_db_id", "sample_db_id", "token_profile") if c not in rows.columns}
    rows = rows.withColumns({
        **unset, "notes": F.coalesce("notes", empty),
        **{c: F.nullif(c, empty) for c in ("family_id", "generation")},
        "results_schema": F.lit(RESULTS_SCHEMA), "tool": F.lit(TOOL_NAME), "tool_version": F.lit(__version__), "tool_commit": F.lit(None).cast("string"),
    })
    return rows.select(*[cell_text(rows, c) for c in SELECTION_COLUMNS])


def write_selection(selected: DataFrame, path: str, notes: DataFrame | None = None, per_family: bool = True) -> None:
    listed = selection_table(selected, notes)
    order = selected.select(F.col("sample_id").alias("_id"), *[k.alias(f"_k{i}") for i, k in enumerate(selection_order(per_family))])
    sorted_rows = listed.join(order, listed["sample_id"] == order["_id"]).orderBy(*[F.col(f"_k{i}").asc_nulls_last() for i in range(len(order.columns) - 1)])
    write_table(sorted_rows.select(*listed.columns), path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Parents first, then the others by id."""
    write_table(manifest.orderBy(F.col("role").endswith("_parent").desc(), F.col("role").desc(), "sample_id"), path)


def write_call_sets(call_sets: DataFrame, path: str) -> None:
    write_table(call_sets.select(*CALL_SET_COLUMNS).orderBy("sample_id", "call_set_db_id"), path)


def write_map(markers: DataFrame, path: str, crop: Crop = SOYBEAN) -> None:
    write_table(map_text(markers.orderBy(chrom_order(F.col("chrom"), crop), "pos_bp", "marker_id")), path)


def write_wide(wide: DataFrame, order: DataFrame, path: str, crop: Crop = SOYBEAN) -> None:
    """A wide table in map order under its header of samples."""
    head, body = wide_lines(wide, order)
    write_lines(head, body.orderBy(chrom_order(F.col("chrom"), crop), "pos_bp", "marker_id"), path)


def position_table_text(table: DataFrame) -> DataFrame:
    """The marker x assembly table as text cells: TRUE/FALSE flags, empty where an assembly lacks the marker."""
    return table.select(*[
        F.when(F.col(c), "TRUE").otherwise("FALSE").alias(c) if kind == "boolean" else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
        for c, kind in table.dtypes
    ])


def wide_lines(wide: DataFrame, order: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(header, lines) of a wide table and its sample order: a one-row table and one line per marker, both with ``value``."""
    line = F.concat_ws(",", "marker_id", "chrom", F.col("pos_bp").cast("string"), "cells")
    names = order.groupBy(F.expr("place div 512").alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "sample_id"))), lambda s: s["sample_id"]), ",").alias("part"))
    head = names.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda s: s["part"]), ",").alias("names"))
    return head.select(F.concat_ws(",", F.lit("marker_id,chrom,pos_bp"), "names").alias("value")), wide.select("marker_id", "chrom", "pos_bp", line.alias("value"))


def map_text(markers: DataFrame) -> DataFrame:
    """markers.csv rows with cM to six places, empty where unknown."""
    cm = F.regexp_replace(F.format_string("%.6f", F.round("cm", 6)), r"(\.[0-9]+?)0+$", "$1")
    return markers.select("marker_id", "chrom", F.col("pos_bp").cast("string").alias("pos_bp"), F.when(F.col("cm").isNull(), "").otherwise(cm).alias("cm"))
