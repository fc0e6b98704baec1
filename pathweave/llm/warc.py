"""WARC archives: writing captures, reading them back, assembling transactions.

Writing: each capture becomes a request, a response (or revisit) and a metadata
record.  The records are text, so Spark's own text writer puts them into
gzipped archives in any store Spark can write.  Reading: each archive is parsed
once, by Content-Length, and the three records of a capture meet through
WARC-Concurrent-To in one nested row.

A payload of at least ``min_payload`` bytes that several rows share is stored
once, with the row of smallest key; the others are revisit records that carry
its digest and length.

Defined cases: a null payload is an empty one; of rows that share the smallest
key each is a response; a null key is larger than any other; repeated rows give
a capture each; a very long payload is one record, held whole; an empty table gives an empty archive folder.  Control
characters of a url are percent-encoded.  Extra columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_PAYLOAD = 100
CAPTURES_PER_FILE = 1_000
_DATE = "2024-01-01T00:00:00Z"
_END = "\r\n\r\n"

RECORD_SCHEMA = (
    "record_id string, record_type string, concurrent_to string, target_uri string, payload_digest string,"
    " payload_bytes bigint, payload string, fields map<string,string>"
)


def with_revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to): refers_to is null for a response."""
    rows = pages.select(F.col(key).alias("page_id"), "url", F.coalesce(payload, F.lit("")).alias("payload")).select(
        "*", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    # digests are counted before the shuffle, so a hot payload costs one row a task
    shared = (
        rows.filter(F.col("payload_bytes") >= min_payload).groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .filter((F.col("n") > 1) & F.col("first_id").isNotNull()).drop("n")
    )
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(shared, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(again, F.col("first_id")).alias("refers_to"))


def _record(kind: str, record_id: str, headers: list[tuple[str, str]], block: str) -> str:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", _DATE), *headers])
    return f"WARC/1.1\r\n{head}Content-Length: {len(block.encode())}\r\n\r\n{block}{_END}"


def _capture(name: str, row: dict) -> str:
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"] or "about:blank")
    main, digest = f"<urn:capture:{name}:response>", row["payload_digest"]
    here = [("WARC-Target-URI", uri)]
    host = re.match(r"[^:]*://([^/?#]*)", uri)
    request = f"GET {uri} HTTP/1.1\r\nHost: {host[1] if host else ''}{_END}"
    reply = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}{_END}"
    headers = [*here, ("WARC-Payload-Digest", f"sha256:{digest}")]
    kind = "response"
    if row["refers_to"] is None:
        reply += row["payload"]
    else:
        kind = "revisit"
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{row['refers_to']}>")]
    about = "" if row["page_id"] is None else f"pageId: {row['page_id']}\r\n"
    return (
        _record("request", f"<urn:capture:{name}:request>", [*here, ("WARC-Concurrent-To", main), ("Content-Type", "application/http; msgtype=request")], request)
        + _record(kind, main, [*headers, ("Content-Type", "application/http; msgtype=response")], reply)
        + _record("metadata", f"<urn:capture:{name}:metadata>", [*here, ("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields")], about)
    )


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # The three records of a capture leave one task for one file, so names made
    # of the task's partition and a counter agree whichever attempt is kept.
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            texts = []
            for row in batch.slice(at, 200).to_pylist():
                # the writer's line separator is the last character of a record
                texts.append(_capture(f"{part}-{n}", row)[:-1])
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["value"])


def write_archives(pages: DataFrame, path: str, key: str = "page_id", payload: str = "html", min_payload: int = MIN_PAYLOAD) -> None:
    """Write one capture for each row to gzipped archives under ``path``."""
    (
        with_revisits(pages, key, payload, min_payload).mapInArrow(_captures, "value string")
        .write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", CAPTURES_PER_FILE).text(path)
    )


def parse_archive(stream: io.BufferedIOBase) -> Iterator[dict]:
    """Records of one archive, in order, by Content-Length."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        yield {"fields": fields, "block": stream.read(int(fields["content-length"]))}


def _as_row(record: dict, with_payload: bool) -> dict:
    fields, block = record["fields"], record["block"]
    row = {
        "record_id": fields["warc-record-id"], "record_type": fields["warc-type"], "concurrent_to": fields.get("warc-concurrent-to"),
        "target_uri": fields.get("warc-target-uri"), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha256:") or None,
        "payload_bytes": None, "payload": None, "fields": None,
    }
    if row["record_type"] in ("response", "revisit"):
        head, _, body = block.partition(b"\r\n\r\n")
        if row["record_type"] == "response":
            row["payload_bytes"] = len(body)
            if hashlib.sha256(body).hexdigest() != row["payload_digest"]:
                raise ValueError(f"payload of {row['record_id']} does not have its digest")
            row["payload"] = body.decode() if with_payload else None
        else:
            row["payload_bytes"] = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)[1])
        row["fields"] = list({k: v for k, v in fields.items() if k == "warc-refers-to"}.items())
    elif row["record_type"] == "metadata":
        lines = (x.partition(":") for x in block.decode().splitlines() if x)
        row["fields"] = [(k.strip(), v.strip()) for k, _, v in lines]
    return row


#: Records, and bytes of their payloads, that a reader holds at a time.
_HELD, _HELD_BYTES = 300, 4 << 20


def _parser(with_payload: bool):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()),
            ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.string()), ("fields", pa.map_(pa.string(), pa.string())),
        ])
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                with gzip.open(io.BytesIO(content.as_buffer())) as stream:
                    for record in parse_archive(stream):
                        rows.append(_as_row(record, with_payload))
                        held += len(record["block"]) if with_payload else 0
                        if len(rows) == _HELD or held >= _HELD_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return parse


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row for each record of the archives under ``path``; payload digests are checked."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_parser(with_payload), RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: its request, response (or revisit) and metadata records.

    Records meet under the identifier of their response, their own or the one
    they are concurrent to; archives are read once.  Of several requests or
    metadata records of a capture the one of least identifier is taken; one
    that it lacks is null; records whose response is not there make no capture.
    """
    main = F.col("record_type").isin("response", "revisit")

    def one(kind: Column, name: str) -> Column:
        return F.min_by(F.when(kind, F.struct(*records.columns)), F.when(kind, F.col("record_id"))).alias(name)

    return (
        records.withColumn("capture", F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to"))).filter("capture is not null").groupBy("capture")
        .agg(one(main, "response"), one(F.col("record_type") == "request", "request"), one(F.col("record_type") == "metadata", "metadata"))
        .filter("response is not null")
    )
