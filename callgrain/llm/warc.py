"""WARC archives with resolved revisits.

Headers (page_id, payload digest, size) are shuffled by digest; the smallest page_id of
a digest is the original, and the other pages of that digest become revisit records,
which hold HTTP headers but no payload. Payloads under `min_bytes` are always stored.
Every record gets fresh headers: an id derived from page and digest, date, digest and,
for revisits, the original's id and URI. Records are single gzip members, one archive
per task. Only headers meet by digest, so a payload that many pages share skews nothing
but a join that Spark can split.

Defined cases: a null html is an empty payload. Rows with a null page_id are responses
and never originals. Rows that repeat page_id and payload have the same record type. A
null url leaves the target URI out. Extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrain.llm.common import fresh_dir, materialize, open_folder, python_ready, write_whole

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
MIN_BYTES = 100
ROWS = 4096  # records that a reader hands over at once


def with_headers(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))


def revisits(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """headers(page_id, url, digest, bytes): page_id, digest, first_id and first_url of the pages that revisit another."""
    h = headers.where((F.col("bytes") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "url", "digest")
    firsts = h.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.max("page_id").alias("last"))
    firsts = firsts.where("first.page_id < last").select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    return h.join(firsts, "digest").where("page_id <> first_id").select("page_id", "digest", "first_id", "first_url").distinct()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _uri(url: str) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)


def record(page_id, url, payload: bytes, digest: str, first_id, first_url, date: str = DATE) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first_id is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first_id is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_uri(url)}")
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if first_id is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(first_id, digest)}", f"WARC-Refers-To-Date: {date}"]
        if first_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_uri(first_url)}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def read_records(f) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an open archive, one gzip member at a time."""
    rest = b""
    while True:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            data = rest or f.read(1 << 20)
            rest = b""
            if not data:
                break
            parts.append(z.decompress(data))
        rest = z.unused_data
        raw = b"".join(parts)
        if not raw:
            return
        head, _, block = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield fields, block[: int(fields["Content-Length"])]


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write pages(page_id, url, html) as deduplicated archives: file and number of records, one row per archive."""
    python_ready(pages.sparkSession)
    filesystem, root = open_folder(folder)
    filesystem.create_dir(root, recursive=True)
    headed = with_headers(pages)
    again = revisits(headed.drop("payload"), min_bytes).withColumnsRenamed({"page_id": "_p", "digest": "_d"})
    joined = headed.join(again, (F.col("page_id") == F.col("_p")) & (F.col("digest") == F.col("_d")), "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, top = open_folder(folder)
        name, n = f"part-{task.partitionId():06d}.warc.gz", [0]

        def body(out) -> None:
            for b in batches:
                for row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                    out.write(record(*row))
                    n[0] += 1

        write_whole(fs, f"{top}/{name}", task.taskAttemptId(), body)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array(n)], ["file", "records"])

    return materialize(joined.select("page_id", "url", "payload", "digest", "first_id", "first_url").mapInArrow(write, "file string, records long"), "archives")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """One row per record; digest and size of responses are those of the stored payload, held against its header."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_folder(folder)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "refers_to_record"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows: list[tuple] = []
                with fs.open_input_stream(f"{top}/{name}", compression=None) as f:
                    for h, block in read_records(f):
                        if len(rows) >= ROWS:
                            yield batch(rows)
                            rows = []
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest, kind = h["WARC-Payload-Digest"].removeprefix("sha256:"), h["WARC-Type"]
                        size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{name}: {h['WARC-Record-ID']} is damaged")
                        page = h.get("WARC-Page-ID")
                        rows.append((None if page is None else int(page), size, digest, kind, h["WARC-Record-ID"], h.get("WARC-Refers-To")))
                yield batch(rows)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers_to_record string"
    return index.select("file").repartition(max(1, index.count())).mapInArrow(read, schema)


def resolve(records: DataFrame) -> DataFrame:
    """Join revisit records to the responses they refer to: adds refers_to, the response's page_id."""
    firsts = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), "payload_digest", F.col("page_id").alias("refers_to")).distinct()
    back = records.where("record_type = 'revisit'").join(firsts, ["payload_digest", "refers_to_record"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    stored = records.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    return stored.select(*columns).unionByName(back.select(*columns))


def op7_warc_revisits(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = fresh_dir(spark, "warc")
    index = write_archives(pages, folder)
    return resolve(materialize(read_archives(index, folder), "records"))
