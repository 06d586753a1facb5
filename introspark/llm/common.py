"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import os
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from introspark.operators.common import land, shared_folder

__all__ = ["NO_SPACE", "SPACES", "WORD", "documents", "land", "prefix_sums", "registered", "shared_folder", "table"]

#: Words are maximal runs of anything but these six ASCII spaces.
SPACES = " \t\n\u000b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
NO_SPACE = str.maketrans("", "", SPACES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_names(columns: list[str], *stems: str) -> list[str]:
    """The stems, with as many underscores added as it takes to clash with no column."""
    taken, out = {c.lower() for c in columns}, []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        out.append(stem)
    return out


def prefix_sums(df: DataFrame, order: list[Column], values: list[str], name: str) -> DataFrame:
    """Add ``<value>_before`` for every value: its sum over all earlier rows in ``order``, without one global window.

    Rows are dealt by range and written with their partition number, so the numbering cannot change on a retry. Each
    partition is summed on its own; partitions meet as one row each. Rows equal in ``order`` stay in one partition,
    so ``order`` should end in columns that are nearly unique.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(shuffle_partitions(spark), *order).withColumn("_part", F.spark_partition_id())
    dealt = land(dealt, name)
    parts = dealt.groupBy("_part").agg(*[F.sum(v).alias(f"_{v}_sum") for v in values])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(  # one row per partition
        "_part", *[F.coalesce(F.sum(f"_{v}_sum").over(earlier), F.lit(0)).alias(f"_{v}_off") for v in values]
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(parts), "_part")  # as many rows as there are shuffle partitions
    for v in values:
        out = out.withColumn(f"{v}_before", F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"_{v}_off"))
    return out.drop("_part", *[f"_{v}_off" for v in values])


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: they need not find the repository themselves."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).parents[1]
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-"), package.name), "zip", package.parent, package.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


#: Queries and their SQL by name, filled by ``registered``.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(name: str, sql: str | None = None):
    """Register a query of (spark, sf_dir) and, where SQL can express it, its SQL for DuckDB."""

    def keep(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return keep


def give_back_memory() -> None:
    """Hand freed memory back to the system: a worker lives on after its task, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def one_thread_libraries() -> None:
    """Inside a task: one core per task, so a library must not start a thread per core of the machine."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
