"""Quality rules with line labelling: Viterbi decoding of a linear-chain CRF marks content or boilerplate."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf
from .bytewords import pieces, words
from .common import documents, land, registered, table

#: Bound of the labelled sample a model is fitted on.
TRAINING_DOCUMENTS = 3000
#: Bound of that sample's lines: documents come in whole, in drawn order, until their lines together reach it.
TRAINING_LINES = 150_000
#: Share of a document's words that must lie in content lines.
CONTENT_SHARE = 0.5
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, content_share double"
)


def training_rows(docs: DataFrame, labels: DataFrame, n: int = TRAINING_DOCUMENTS) -> DataFrame:
    """``doc_id, text, quality`` of at most ``n`` labelled documents, drawn by a hash of the id among those whose
    crc32 of the id is not divisible by 5 (the rest are held out)."""
    drawn = (
        labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
        .orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(n)
    )
    # At most n rows of two numbers: small whatever the input.
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id"])


def whole_documents(lines: dict[int, int], most: int) -> list[int]:
    """The ids, in drawn order, up to the one whose lines make the total reach ``most``."""
    out, total = [], 0
    for i in sorted(lines, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)):
        if total >= most:
            break
        out.append(i)
        total += lines[i]
    return out


def fit(docs: DataFrame, labels: DataFrame, neighbours: bool, n: int = TRAINING_DOCUMENTS, most_lines: int = TRAINING_LINES) -> crf.Model:
    """Fit the CRF: every line of a labelled document carries the document's label.

    With ``neighbours`` the model scores whole documents and is fitted to these labels as they stand. Without, it
    labels single lines, which may differ from their document: ``crf.train_by_line``.

    Executors compute the features of all lines of the drawn documents; the driver gets those numbers only, of fewer
    than ``most_lines`` lines and one more document. Without both labels the stated prior scores are used.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                lines = crf.line_table(part.column("text"))
                x = crf.with_neighbours(lines.features, lines.runs.text) if neighbours else lines.features
                ids, quality = part.column("doc_id").to_pylist(), part.column("quality").to_pylist()
                bounds = np.searchsorted(lines.runs.text, np.arange(part.num_rows + 1))
                rows = [x[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids, pa.int64()), "quality": pa.array(quality, pa.int32()), "n_lines": pa.array([len(r) for r in rows], pa.int64()), "x": pa.array([r.astype("f4").tobytes() for r in rows], pa.binary()),
                })

    drawn = land(training_rows(docs, labels, n).mapInArrow(features, "doc_id long, quality int, n_lines long, x binary"), "training-lines")
    lines = {r["doc_id"]: r["n_lines"] for r in drawn.select("doc_id", "n_lines").collect()}  # at most n rows
    chosen = whole_documents(lines, most_lines)
    rows = (drawn if len(chosen) == len(lines) else drawn.filter(F.col("doc_id").isin(chosen))).collect()
    rows.sort(key=lambda r: r["doc_id"])
    if len({r["quality"] for r in rows}) < 2:
        weights = np.concatenate([crf.PRIOR.weights, np.zeros(2 * len(crf.FEATURES))]) if neighbours else crf.PRIOR.weights
        return crf.Model(weights, crf.PRIOR.jump)
    width = len(crf.FEATURES) * (3 if neighbours else 1)
    parts = [np.frombuffer(r["x"], "f4").reshape(-1, width) for r in rows]
    counts = [len(p) for p in parts]
    train = crf.train if neighbours else crf.train_by_line
    return train(np.concatenate(parts), np.repeat(np.arange(len(parts)), counts), np.repeat([r["quality"] for r in rows], counts))


def assess(docs: DataFrame, model: crf.Model, content_share: float = CONTENT_SHARE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, rule verdict and CRF verdict of every row of ``docs``.

    ``kept`` needs the base rules (20 words; at most 30 % of words in repeated 8-word windows) and at least
    ``content_share`` of the words in lines that Viterbi decoding labels content. The work on a row needs no other row:
    one scan, no shuffle, and memory bounded by a piece of a batch or the longest text.

    Null and empty texts have no words and fail. Null ids and repeated rows are judged like any row. Other columns are
    not read. An empty table gives no rows.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                column = part.column("text")
                w, lines = words(column), crf.line_table(column)
                content = model.viterbi(lines.features, lines.runs.text)
                n_words = w.per_text()
                repeated = crf.repeated_window_words(w, 8)
                good = np.bincount(lines.runs.text, lines.n_words * content, w.n_texts)
                share = good / np.maximum(n_words, 1)
                failed = (n_words < 20) | (100 * repeated > 30 * n_words)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").cast(pa.int64()), pa.array(n_words), pa.array(crf.code_points_in_words(w)), pa.array(crf.symbols(w)),
                    pa.array(np.bincount(lines.runs.text, lines.duplicate, w.n_texts).astype(np.int64)), pa.array(repeated),
                    pa.array(failed), pa.array(~failed & (share >= content_share)), pa.array(share.astype(float)),
                ], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(judge, SCHEMA)


def keep_good(docs: DataFrame, model: crf.Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that ``assess`` rejects, columns unchanged; the verdict is made while rows pass."""

    def verdicts(column: pa.Array) -> np.ndarray:
        w, lines = words(column), crf.line_table(column)
        n_words, repeated = w.per_text(), crf.repeated_window_words(w, 8)
        good = np.bincount(lines.runs.text, lines.n_words * model.viterbi(lines.features, lines.runs.text), w.n_texts)
        return (n_words >= 20) & (100 * repeated <= 30 * n_words) & (good >= CONTENT_SHARE * n_words)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                yield part.filter(pa.array(verdicts(part.column(text))))

    return docs.mapInArrow(passing, docs.schema)


@registered("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return assess(docs, fit(docs, table(spark, sf_dir, "labels"), neighbours=False))
