"""Small DataFrame helpers used by several operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, or a local one where a local session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-tables-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def run_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def drop_tables(spark: SparkSession) -> None:
    """Remove the application's intermediate tables; what still reads them fails from then on."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(run_folder(spark))
    if store.get_file_info(base).type != fs.FileType.NotFound:
        store.delete_dir(base)


def land(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table once and read it back.

    A table read by several branches is computed once, survives lost executors, and comes back with its true
    size, from which the optimizer chooses its joins.
    """
    path = f"{run_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def land_counted(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict]:
    """``land``, and aggregates of the rows that are observed while they are written: no job of their own."""
    seen = Observation()
    return land(df.observe(seen, *[c.alias(k) for k, c in counts.items()]), name), seen.get


def computed_once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """Add columns that later filters and projections read without evaluating their expressions again.

    A filter on a computed column is pushed below it by repeating its expression; a generated row is not.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))


def pinned(rows: DataFrame) -> DataFrame:
    """A table of a few rows (one per locus of the criteria) as a literal of the plan."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def neighbours(df: DataFrame, keys: list[str], bin_column: str, order: list[str], values: list[str]) -> DataFrame:
    """Add ``prev`` and ``next``: structs of ``values`` of the adjacent rows of each key, in order.

    A key may hold most of the table (one chromosome, one sample), so the ordered windows run per
    ``(key, bin)``. Only the first and last row of every bin meet in a window per key, and bins must
    follow the order.
    """
    inside = Window.partitionBy(*keys, bin_column).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(bin_column)
    payload = F.struct(*values)
    edges = (
        df.groupBy(*keys, bin_column)
        .agg(F.min_by(payload, F.struct(*order)).alias("_first"), F.max_by(payload, F.struct(*order)).alias("_last"))
        .select(
            *keys, bin_column,
            F.lag("_last").over(across).alias("_before"),
            F.lead("_first").over(across).alias("_after"),
        )
    )
    return (
        df.withColumn("prev", F.lag(payload).over(inside))
        .withColumn("next", F.lead(payload).over(inside))
        .join(edges, [*keys, bin_column], "left")
        .withColumn("prev", F.coalesce("prev", "_before"))
        .withColumn("next", F.coalesce("next", "_after"))
        .drop("_before", "_after")
    )


def running(df: DataFrame, keys: list[str], bin_column: str, order: list[str], fold, value: Column, name: str) -> DataFrame:
    """Add a running ``max`` or ``min`` of ``value`` over each key, from its first row to the current one.

    As with ``neighbours``, rows are ordered per (key, bin); a window per key sees one row per bin.
    """
    inside = Window.partitionBy(*keys, bin_column).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outside = Window.partitionBy(*keys).orderBy(bin_column).rowsBetween(Window.unboundedPreceding, -1)
    bins = df.groupBy(*keys, bin_column).agg(fold(value).alias("_bin_value"))
    carried = bins.select(*keys, bin_column, fold("_bin_value").over(outside).alias("_carried"))
    best = {F.max: F.greatest, F.min: F.least}[fold]
    out = df.withColumn("_inside", fold(value).over(inside)).join(carried, [*keys, bin_column])
    return out.withColumn(name, best("_inside", "_carried")).drop("_inside", "_carried")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")
