"""Token ids as Arrow files of equal-length sequences with masks, for zero-copy random access."""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import pieces
from .common import documents, land, prefix_sums, registered, shared_folder, shuffle_partitions
from .tokens import PIECE, encoder

SEQUENCE = 1024
END_ID = 2
#: Ids of one file, about; a file ends after a whole document.
FILE_IDS = 1 << 20
#: Sequences of one record batch of a file.
BATCH = 256
_WRITTEN = "part int, shard int, n_tokens long, n_docs long, path string"
_READ = "part int, shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def to_file(doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray, part: int, shard: int, vocabulary: int, sequence: int = SEQUENCE) -> bytes:
    """The bytes of one file: batches of fixed-size lists ``ids`` and ``mask`` (true where an id is no padding).

    Ids are 16 bits wide where the vocabulary allows. Documents follow each other without gaps; the schema's metadata
    holds their ids and lengths, so a document is a slice of the flat ids.
    """
    kind = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    rows = -(-len(ids) // sequence)
    flat = np.zeros(rows * sequence, kind.to_pandas_dtype())
    flat[: len(ids)] = ids
    mask = np.arange(rows * sequence) < len(ids)
    schema = pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))]).with_metadata({
        "part": str(part), "shard": str(shard), "n_tokens": str(len(ids)), "null_ids": np.packbits([i is None for i in doc_ids]).tobytes().hex(),
        "doc_ids": np.array([i or 0 for i in doc_ids], "<i8").tobytes().hex(), "lengths": lengths.astype("<i8").tobytes().hex(),
    })
    out = io.BytesIO()
    with pa.ipc.new_file(out, schema) as writer:
        for a in range(0, rows, BATCH):
            b = min(a + BATCH, rows)
            writer.write_batch(pa.record_batch([
                pa.FixedSizeListArray.from_arrays(pa.array(flat[a * sequence : b * sequence], kind), sequence),
                pa.FixedSizeListArray.from_arrays(pa.array(mask[a * sequence : b * sequence]), sequence),
            ], schema=schema))
    return out.getvalue()


class TokenFile:
    """Random access to the bytes of one file, or to a mapped file: what it returns are views of the record batches' buffers."""

    def __init__(self, content: bytes | pa.Buffer | pa.NativeFile):
        self._reader = pa.ipc.open_file(content if isinstance(content, pa.NativeFile) else pa.py_buffer(content))
        meta = {k.decode(): v.decode() for k, v in self._reader.schema.metadata.items()}
        self.part, self.shard, self.n_tokens = int(meta["part"]), int(meta["shard"]), int(meta["n_tokens"])
        self.sequence_length = self._reader.schema.field("ids").type.list_size
        doc_ids = np.frombuffer(bytes.fromhex(meta["doc_ids"]), "<i8")
        null = np.unpackbits(np.frombuffer(bytes.fromhex(meta["null_ids"]), np.uint8))[: len(doc_ids)]
        self.doc_ids = [None if x else int(i) for i, x in zip(doc_ids, null, strict=True)]
        self.lengths = np.frombuffer(bytes.fromhex(meta["lengths"]), "<i8")
        self.starts = np.cumsum(self.lengths) - self.lengths

    def ids(self, start: int, n: int) -> list[np.ndarray]:
        """``n`` ids from place ``start``, as one view for each record batch they lie in."""
        out, size = [], BATCH * self.sequence_length  # all batches but the last have as many
        while n > 0:
            flat = self._reader.get_batch(start // size).column("ids").flatten().to_numpy(zero_copy_only=True)
            view = flat[start % size : start % size + n]
            out.append(view)
            start, n = start + len(view), n - len(view)
        return out

    def document(self, k: int) -> list[np.ndarray]:
        return self.ids(int(self.starts[k]), int(self.lengths[k]))

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one padded sequence."""
        batch = self._reader.get_batch(i // BATCH)
        return batch.column("ids")[i % BATCH].values.to_numpy(zero_copy_only=True), batch.column("mask")[i % BATCH].values.to_numpy(zero_copy_only=False)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, vocabulary: int, end_id: int = END_ID,
                      sequence: int = SEQUENCE, file_ids: int = FILE_IDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` in ascending id order as files below ``folder`` and return their list: ``part, shard, n_tokens, n_docs, path``.

    Documents are range-partitioned and sorted by id; a task writes the files of its range one after the other, each
    under a name of its attempt first, then moved to its own, so that a lost or repeated task leaves whole files only.

    Null and empty texts are the end id alone. A null id comes first. Rows that repeat an id follow each other by a
    hash of their texts. Other columns are not read. An empty table writes no file.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        task, own = TaskContext.get(), encoder(tokenizer, end_id)
        part, shard = task.partitionId(), 0
        doc_ids, ids, lengths, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            content = to_file(doc_ids, np.concatenate(ids), np.concatenate(lengths), part, shard, vocabulary, sequence)
            path = f"{base}/tokens-{part:06d}-{shard:06d}.arrow"
            with store.open_output_stream(f"{path}.{task.taskAttemptId()}") as out:
                out.write(content)
            store.move(f"{path}.{task.taskAttemptId()}", path)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "n_tokens": [held], "n_docs": [len(doc_ids)], "path": [path],
            })

        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                flat, offsets = own.encode(piece.column("text"))
                doc_ids += piece.column("doc_id").to_pylist()
                ids.append(flat)
                lengths.append(np.diff(offsets))
                held += len(flat)
                if held >= file_ids:
                    yield flush()
                    doc_ids, ids, lengths, held, shard = [], [], [], 0, shard + 1
        if doc_ids:
            yield flush()

    return land(rows.mapInArrow(write, _WRITTEN), "token-file-list")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the files below ``folder``: ``doc_id, start, n_tokens, ids_crc32``, ``start`` counting over all files in order.

    Every document is read as slices of its file's record batches.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                file = TokenFile(content.as_buffer())
                sums, n = [], len(file.doc_ids)
                for k in range(n):
                    crc = 0
                    for view in file.document(k):
                        crc = zlib.crc32(view.astype("<u4"), crc)
                    sums.append(crc)
                yield pa.RecordBatch.from_arrays([
                    pa.array([file.part] * n, pa.int32()), pa.array([file.shard] * n, pa.int32()), pa.array(file.doc_ids, pa.int64()),
                    pa.array(file.starts), pa.array(file.lengths), pa.array(sums, pa.int64()),
                ], names=[c.split()[0] for c in _READ.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.arrow").load(folder).select("content")
    found = land(files.mapInArrow(read, _READ), "token-documents")
    sizes = found.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n"))
    before = prefix_sums(sizes, [F.col("part").asc(), F.col("shard").asc()], ["n"], "token-file-sizes")
    out = found.join(before.select("part", "shard", "n_before"), ["part", "shard"])
    return out.select("doc_id", (F.col("n_before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, vocabulary: int, **options) -> DataFrame:
    """Write files in a new folder of the cluster's shared folder and read them back."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    new_folder(spark, folder)
    write_token_files(docs, folder, tokenizer, vocabulary, **options)
    return read_token_files(spark, folder)


def new_folder(spark: SparkSession, folder: str) -> None:
    """Make an empty folder in the store of ``folder``, so that tasks can write and an empty result can be read."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@registered("op7_token_files")
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir), byte_bpe(), vocabulary=50257)
