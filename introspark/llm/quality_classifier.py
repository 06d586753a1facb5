"""Document quality from line marginals of a linear-chain CRF over neighbouring-line features."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf
from .bytewords import pieces
from .common import documents, registered, table
from .quality_rules import fit

THRESHOLD = 0.3
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def score(docs: DataFrame, model: crf.Model, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Quality of every row of ``docs``: ``doc_id, held_out, score, predicted``.

    Forward-backward gives every line its probability of being good, from its own features and those of the lines
    before and after; the mean over lines, weighted by their code points plus one, is the document's score. One scan,
    no shuffle.

    Null and empty texts are one line without a word and get that line's probability. A null id is not held out.
    Repeated rows get equal scores. Other columns are not read. An empty table gives no rows.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                lines = crf.line_table(part.column("text"))
                of, n = lines.runs.text, part.num_rows
                p = model.marginals(crf.with_neighbours(lines.features, of), of)
                weight = lines.n_chars + 1.0
                value = np.clip(np.bincount(of, p * weight, n) / np.bincount(of, weight, n), 0.0, 1.0)
                ids = part.column("doc_id").cast(pa.int64())
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array([held_out(i) for i in ids.to_pylist()], pa.bool_()), pa.array(value), pa.array((value >= threshold).astype(np.int32)),
                ], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(scored, SCHEMA)


@registered("op6_quality_classifier")
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, table(spark, sf_dir, "labels"), neighbours=True))
