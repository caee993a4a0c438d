"""WARC records kept as a chunked record table.

A record is the rows (archive, record_no, chunk_no, data); data in that order is a valid WARC/1.1 byte stream: the first
row starts with the WARC and HTTP headers, the last ends with the record's blank lines, and each carries the SHA-1 of the
payload up to its end.  A payload is cut by native functions, a row for each chunk of ``chunk_bytes`` (the chunks of a
record are never held together), and streams through writer and reader, each holding one running digest.

Of equal payloads of at least ``min_revisit_bytes`` the one with the largest page_id is stored; the others become
``revisit`` records that refer to it.  The holder of each digest is found by a pre-aggregated maximum of
(digest, page_id); payloads stay where they were read, and only the holders of shared digests are sent to them.

Defined cases: null html is an empty payload; null url an empty target; repeated rows are separate records (rows that
share the largest page_id of a group are all responses); a null page_id is never the holder, and a group with null ids
only has no revisits; an empty table gives an empty archive; other columns of the input are not stored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import shared_dir, written

CHUNK_BYTES = 1 << 16
MIN_REVISIT_BYTES = 1000
#: The most shared payloads whose digests and holders are broadcast, about 50 MB; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
WARC_DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "archive int, record_no long, chunk_no int, n_chunks int, data binary, sha1_so_far string"
RECORDS = "page_id long, target_uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, intact boolean"
_NAMES = [c.split()[0] for c in CHUNKS.split(", ")]


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def _head(page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=chr(37) + ':/?#[]@!$&()*+,;=~')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *([] if page_id is None else [f"X-Page-ID: {page_id}"]),
        *([] if refers_to is None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(http) + (size if refers_to is None else 0)}",
    ]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + http


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of payload, in order, to chunks of records; one running digest."""
    archive, record, sha = TaskContext.get().partitionId(), -1, hashlib.sha1()
    for batch in batches:
        rows: list[tuple] = []
        held = 0
        columns = [batch.column(k) for k in ("page_id", "url", "digest", "size", "refers_to", "chunk_no", "n_chunks", "part")]
        for k in range(batch.num_rows):
            page_id, url, digest, size, refers_to, chunk_no, n_chunks, part = (c[k].as_py() for c in columns)
            if chunk_no == 0:
                record, sha = record + 1, hashlib.sha1()
            sha.update(part)
            data = (_head(page_id, url, digest, size, refers_to) if chunk_no == 0 else b"") + part + (b"\r\n\r\n" if chunk_no == n_chunks - 1 else b"")
            rows.append((archive, record, chunk_no, n_chunks, data, digest if refers_to is not None else sha.hexdigest()))
            held += len(data)
            if held > 1 << 23:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)


def records(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """The chunked record table of ``pages`` (page_id, url, html), not yet written."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    sized = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    sized = sized.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    large = sized.where(F.col("size") >= min_revisit_bytes).select("digest", "page_id")
    holders = large.groupBy("digest").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n")).where("n > 1 AND holder IS NOT NULL").select("digest", "holder")
    holders = written(holders, "holders")
    if holders.count() <= BROADCAST_ROWS:
        marked = sized.join(F.broadcast(holders), "digest", "left")
    else:
        # By page as well, so that no payload that many pages share is a hot key.
        by_page = large.join(holders, "digest").select(F.col("page_id").alias("its_page"), F.col("digest").alias("its_digest"), "holder").distinct()
        marked = sized.join(by_page, F.col("page_id").eqNullSafe(F.col("its_page")) & (F.col("digest") == F.col("its_digest")), "left")
    marked = marked.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder")))
    kept = F.when(F.col("refers_to").isNull(), F.col("size")).otherwise(F.lit(0))
    cut = marked.withColumn("n_chunks", F.greatest(F.ceil(kept / F.lit(chunk_bytes)), F.lit(1)).cast("int"))
    numbered = cut.select("page_id", "url", "digest", "size", "refers_to", "n_chunks", "payload", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk_no"))
    part = F.when(F.col("refers_to").isNull(), F.substring(F.col("payload"), F.col("chunk_no") * F.lit(chunk_bytes) + 1, F.lit(chunk_bytes))).otherwise(F.lit(b""))
    return numbered.withColumn("part", part).drop("payload").mapInArrow(_assemble, CHUNKS)


def write(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    records(pages, chunk_bytes, min_revisit_bytes).write.parquet(path)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from chunks in order; holds the current record's header and digest only."""
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    now, fields, sha, read, http_size, fine = None, {}, None, 0, 0, True
    for batch in batches:
        done: list[tuple] = []
        columns = [batch.column(k) for k in _NAMES]
        for k in range(batch.num_rows):
            archive, record, chunk_no, n_chunks, data, so_far = (c[k].as_py() for c in columns)
            if chunk_no == 0:
                now, sha, read, fine = (archive, record), hashlib.sha1(), 0, True
                head, _, rest = data.partition(b"\r\n\r\n")
                fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                http, _, data = rest.partition(b"\r\n\r\n")
                http_size = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
                block = int(fields["Content-Length"]) - len(http) - 4
            elif now != (archive, record):
                raise ValueError(f"archive {archive}: chunk {chunk_no} of record {record} has no first chunk")
            if chunk_no == n_chunks - 1:
                if data[-4:] != b"\r\n\r\n":
                    raise ValueError(f"archive {archive}: record {record} has no end")
                data = data[:-4]
            sha.update(data)
            read += len(data)
            declared = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
            revisit = fields["WARC-Type"] == "revisit"
            fine = fine and (so_far == declared if revisit else so_far == sha.hexdigest())
            if chunk_no == n_chunks - 1:
                fine = fine and read == block and (read == 0 if revisit else sha.hexdigest() == declared and read == http_size)
                page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
                done.append((page and int(page), fields["WARC-Target-URI"], fields["WARC-Type"], http_size, declared if revisit else sha.hexdigest(), refers and int(refers), fine))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of an archive table; ``intact`` is false where a digest or length does not hold."""
    chunks = spark.read.schema(CHUNKS).parquet(path)
    whole = chunks.where("n_chunks = 1").mapInArrow(_parse, RECORDS)
    long = chunks.where("n_chunks > 1").repartition("archive", "record_no").sortWithinPartitions("archive", "record_no", "chunk_no")
    return whole.unionByName(long.mapInArrow(_parse, RECORDS))


def op5_warc_chunks(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


ORACLES = {
    "op5_warc_chunks": f"""
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
    d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
    h AS (SELECT *, CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY payload_digest) END AS holder FROM d)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN holder <> page_id THEN holder END AS refers_to, true AS intact FROM h"""
}
QUERIES = {"op5_warc_chunks": op5_warc_chunks}
