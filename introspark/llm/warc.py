"""WARC archives: records with payload digests, revisits, segments and chunked transfer framing, written and read back."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import land, registered, shared_folder, table
from .idfilter import parted
from .token_files import new_folder

#: Bytes of a record's block from which it goes on in continuation records.
SEGMENT_BYTES = 16 << 10
#: Bytes of one chunk of the chunked transfer framing.
CHUNK_BYTES = 4 << 10
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT_BYTES = 0
#: Uncompressed bytes of one archive file, about.
FILE_BYTES = 16 << 20
CRLF = b"\r\n"
_PARSED = "record_type string, record_id string, page_id long, payload_digest string, payload_bytes long, refers_to long, origin string, segment int, total long, block binary"
_RESPONSE_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; a broken frame raises."""
    out, at = [], 0
    while True:
        line = body.index(CRLF, at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != CRLF:
            raise ValueError("broken chunk")
        out.append(body[at : at + size])
        at += size + 2


def record(fields: dict[str, object], block: bytes) -> bytes:
    """One WARC/1.1 record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in (fields | {"Content-Length": len(block)}).items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + CRLF + block + CRLF + CRLF


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an uncompressed archive."""
    at = 0
    while at < len(data):
        stop = data.index(CRLF + CRLF, at)
        lines = data[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record")
        head = dict(line.split(": ", 1) for line in lines[1:])
        at = stop + 4 + int(head["Content-Length"])
        yield head, data[stop + 4 : at]
        at += 4


def page_id_of(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:") : -1].split(":")[0]) if urn and urn.startswith("<urn:page:") else None


def page_records(page_id: int | None, url: str | None, payload: bytes, record_type: str, refers_to: int | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page: a revisit, or a response in as many segments as it needs."""
    told = digest(payload)
    stem = f"urn:page:{page_id}:{told}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    name = f"<{stem}>"
    fields = {"WARC-Target-URI": url and url.replace("\r", "%0D").replace("\n", "%0A"), "WARC-Payload-Digest": f"sha1:{told}"}
    if record_type == "revisit":
        refers = {"WARC-Type": "revisit", "WARC-Record-ID": name, "WARC-Refers-To": f"<urn:page:{refers_to}:{told}>",
                  "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        yield record(refers | fields, b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = _RESPONSE_HEAD + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    for number, part in enumerate(parts, 1):
        segment = {"WARC-Segment-Number": number if len(parts) > 1 else None}
        if number == 1:
            yield record({"WARC-Type": "response", "WARC-Record-ID": name} | fields | segment, part)
        else:
            last = {"WARC-Segment-Total-Length": len(block) if number == len(parts) else None}
            yield record({"WARC-Type": "continuation", "WARC-Record-ID": f"<{stem}:{number}>", "WARC-Segment-Origin-ID": name} | segment | last, part)


def with_verdicts(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """``page_id, url, html, record_type, refers_to``: of equal payloads, the largest page id is the response.

    Payloads are compared by their SHA-1 digest and length, as the format does. Only digests are shuffled to find the
    groups; the large group is aggregated before. Pages are shuffled only where they may be revisits.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    slim = pages.select("page_id", F.unhex(F.sha1("html")).alias("sha"), F.octet_length("html").cast("long").alias("bytes"))
    slim = land(slim, "page-digests")
    kept = slim.filter(F.col("bytes") >= least_bytes).groupBy("sha", "bytes").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    revisits = slim.join(kept, ["sha", "bytes"]).filter("page_id <> refers_to").select("page_id", "sha", "bytes", "refers_to").distinct()
    revisits = land(revisits, "revisits")
    maybe, never = parted(pages, revisits.select("page_id"), "page_id")
    maybe = maybe.withColumns({"sha": F.unhex(F.sha1("html")), "bytes": F.octet_length("html").cast("long")})  # an id may have several payloads
    maybe = maybe.join(revisits, ["page_id", "sha", "bytes"], "left").drop("sha", "bytes")
    joined = maybe.unionByName(never.withColumn("refers_to", F.lit(None).cast("bigint")))
    return joined.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def write_archives(pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the records of ``pages`` (with verdicts) as gzip archives below ``folder``; returns the list of files.

    Each record is a gzip member of its own. A response's later segments go to the archive after the one it began in
    where one is closed in between. Files appear under their final names only when they are whole.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        number, held, out = 0, 0, io.BytesIO()

        def close() -> pa.RecordBatch:
            path = f"{base}/pages-{task.partitionId():06d}-{number:06d}.warc.gz"
            with store.open_output_stream(f"{path}.{task.taskAttemptId()}", compression=None) as stream:
                stream.write(out.getvalue())
            store.move(f"{path}.{task.taskAttemptId()}", path)
            return pa.RecordBatch.from_pydict({"path": [path]})

        for batch in batches:
            for page in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "record_type", "refers_to")], strict=True):
                page_id, url, html, record_type, refers_to = page
                for one in page_records(page_id, url, html.encode(), record_type, refers_to, segment_bytes):
                    out.write(gzip.compress(one, 1))
                    held += len(one)
                    if held >= file_bytes:
                        yield close()
                        number, held, out = number + 1, 0, io.BytesIO()
        if held:
            yield close()

    return land(pages.select("page_id", "url", "html", "record_type", "refers_to").mapInArrow(write, "path string"), "archive-list")


def payload_of(block: bytes, told: str) -> bytes:
    """The payload of a response's block; raises where it doesn't match its digest."""
    head, body = block.split(CRLF + CRLF, 1)
    payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    if digest(payload) != told:
        raise ValueError("payload doesn't match its digest")
    return payload


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """All pages of the archives below ``folder``: ``page_id, payload_digest, record_type, refers_to, payload_bytes, payload``.

    Records in one piece are decoded where they are read. Continuation records are grouped by the record they go on
    from, ordered by segment number and joined; a missing segment, a wrong total length, a broken chunk or a payload
    that doesn't match its digest stops the job. A revisit has no payload of its own. Without ``with_payload`` only
    the payloads' lengths leave a task, and nothing but segments is shuffled in full.
    """
    names = [c.split()[0] for c in _PARSED.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                with gzip.open(io.BytesIO(content.as_buffer())) as archive:
                    data = archive.read()
                for n, (head, block) in enumerate(records(data)):
                    segment, told = int(head.get("WARC-Segment-Number", 0)), head.get("WARC-Payload-Digest", "")[5:] or None
                    name, length = head.get("WARC-Segment-Origin-ID", head["WARC-Record-ID"]), None
                    if not segment:
                        name = f"{path}#{n}"
                        payload = None if head["WARC-Type"] == "revisit" else payload_of(block, told)
                        length, block = (None, None) if payload is None else (len(payload), payload if with_payload else None)
                    rows.append((
                        head["WARC-Type"], head["WARC-Record-ID"], page_id_of(head["WARC-Record-ID"]), told, length, page_id_of(head.get("WARC-Refers-To")), name,
                        segment, int(head["WARC-Segment-Total-Length"]) if "WARC-Segment-Total-Length" in head else None, block,
                    ))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "content")
    records_of = files.mapInArrow(parse, _PARSED).groupBy("origin").agg(
        F.array_sort(F.array_distinct(F.collect_list(F.struct("segment", "block")))).alias("s"),  # of one record: bounded by one page
        F.max("total").alias("total"), F.max("payload_digest").alias("payload_digest"), F.min("page_id").alias("page_id"), F.max("refers_to").alias("refers_to"),
        F.max("payload_bytes").alias("payload_bytes"), F.count_if(F.col("segment") <= 1).alias("copies"), F.max("record_type").alias("record_type"),
    )
    joined = records_of.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select(
        "page_id", "payload_digest", "record_type", "refers_to", "payload_bytes", "total", F.col("s.segment").alias("segments"), F.col("s.block").alias("blocks"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, lengths = [], []
            for told, length, total, segments, blocks in zip(*[batch.column(c) for c in ("payload_digest", "payload_bytes", "total", "segments", "blocks")], strict=True):
                length, numbers, payload = length.as_py(), segments.as_py(), blocks[0].as_py()
                if numbers[0] > 0:
                    block = b"".join(blocks.as_py())
                    if numbers != list(range(1, len(numbers) + 1)) or len(block) != total.as_py():
                        raise ValueError("segments missing or of wrong length")
                    payload = payload_of(block, told.as_py())
                    length = len(payload)
                lengths.append(length)
                payloads.append(payload if with_payload else None)
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in ("page_id", "payload_digest")], pa.array(["response" if x != "revisit" else x for x in batch.column("record_type").to_pylist()]),
                batch.column("refers_to"), pa.array(lengths, pa.int64()), pa.array(payloads, pa.binary()),
            ], names=["page_id", "payload_digest", "record_type", "refers_to", "payload_bytes", "payload"])

    return joined.mapInArrow(decode, "page_id long, payload_digest string, record_type string, refers_to long, payload_bytes long, payload binary")


_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]


def round_trip(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES, with_payload: bool = True) -> DataFrame:
    """Write ``pages`` as archives in a new folder of the cluster's shared folder and read them back.

    Null html is an empty payload. A row without a page id is a response under a random name and comes back with a null
    id. Rows may repeat a page id: a record is named by page id and payload, and each row has the verdict of its own
    payload; rows that repeat both are records of one name, and come back as often as they were written. Other columns
    are not read. No rows give no archive and no rows.
    """
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    new_folder(spark, folder)
    write_archives(with_verdicts(pages), folder, segment_bytes)
    return read_archives(spark, folder, with_payload)


@registered("op2_warc", r"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), b AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS last_id,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
      (list_reduce(list_transform(string_split(substr(hex, 1 + 5 * (i // 4)::INT, 5), ''), lambda c: instr('0123456789abcdef', c)::BIGINT - 1), lambda a, d: a * 16 + d)
       >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last_id THEN NULL ELSE last_id END AS refers_to
FROM b
""")
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = land(round_trip(table(spark, sf_dir, "pages"), with_payload=False).drop("payload"), "archived-pages")
    lengths = read.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("referred")).distinct()
    found = read.join(lengths, ["refers_to", "payload_digest"], "left")
    return found.select("page_id", F.coalesce("payload_bytes", "referred").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
