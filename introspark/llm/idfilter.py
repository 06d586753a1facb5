"""A bitmap of fixed size that lets a scan drop rows whose id certainly isn't wanted, before they are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import U64, mixed

#: 2^26 bits are 8 MB whatever the input; a full bitmap lets all rows pass, which costs a shuffle but no result.
BITS = 1 << 26
_PER_BITMAP = 32768  # bits of one aggregated bitmap


def _positions(ids: np.ndarray) -> np.ndarray:
    return (mixed(ids.astype(np.int64).view(U64)) % U64(BITS)).astype(np.int64)


def _bitmap(wanted: DataFrame) -> np.ndarray:
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64()).drop_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(_positions(ids))], names=["at"])

    at = wanted.mapInArrow(places, "at long")
    found = at.groupBy(F.expr(f"at div {_PER_BITMAP}").alias("k")).agg(F.bitmap_construct_agg(F.expr(f"at % {_PER_BITMAP}")).alias("bits")).collect()
    table = np.zeros(BITS // 8, np.uint8)
    for row in found:  # at most BITS / 32768 rows of 4 KB
        table[row["k"] * _PER_BITMAP // 8 : (row["k"] + 1) * _PER_BITMAP // 8] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return table


def parted(docs: DataFrame, wanted: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` whose id may be in ``wanted`` (one column of ids), and all others. Null ids are among the former."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def passing(hit: bool):
        def pass_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = shared.value
            for batch in batches:
                ids = batch.column(batch.schema.get_field_index(doc_id))
                p = _positions(ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False))
                found = ((bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1).astype(bool) | np.asarray(ids.is_null())
                yield batch.filter(pa.array(found == hit))

        return pass_on

    return docs.mapInArrow(passing(True), docs.schema), docs.mapInArrow(passing(False), docs.schema)


def probably(docs: DataFrame, wanted: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id may be in ``wanted``; rows with a null id pass."""
    return parted(docs, wanted, doc_id)[0]
