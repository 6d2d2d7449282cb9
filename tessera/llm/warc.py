"""WARC archives with an index first: each record's file, offset, length, URL and digest. Readers select records in the
index, sort them by place and read coalesced byte ranges.

Records are gzip members of their own, so any range of whole records can be read by itself. Payloads equal to that of
a smaller page are revisit records, which hold no payload.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import doc_text, fresh_path, keep
from tessera.llm.files import Reader, Writer

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, record_type string, refers_to long, payload_digest string, file string, offset long, length long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload binary"
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
END = b"\r\n\r\n"
#: Compressed bytes that a reading task has at most, or one record.
TASK_BYTES = 1 << 28


def with_first(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """pages: page_id, url, html. Adds digest and first: of pages with equal payloads the smallest id, null where that is the page itself."""
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), doc_text("html").alias("html"))
    df = df.withColumn("digest", F.sha2("html", 256))
    ids = keep(df.filter(F.octet_length("html") >= least_bytes).select("page_id", "digest"), "payloads")
    first = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    again = ids.join(first, "digest").filter("NOT page_id <=> first").distinct()
    again = again.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "first")
    return df.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "html", "digest", "first")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    kind = "response" if first is None else "revisit"
    body = payload if first is None else b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: quote(m[0]), url)}")
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if first is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first, digest)}", f"WARC-Refers-To-Page-ID: {first}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    return "\r\n".join(lines).encode() + END + http + body + END


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, block = data.split(END, 1)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
    block = block[: int(headers["content-length"])]
    return headers, block.split(END, 1)[1]


def write_warc(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = 4) -> DataFrame:
    """Writes the archives, one for each task, and returns their index, itself a kept table.

    pages: page_id, url, html; null html is empty, null ids and URLs leave out their headers. Rows that repeat id and
    payload are both responses, or both revisits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            out = out or Writer(folder, ".warc.gz")
            ids, urls, htmls, digests, firsts = (batch.column(i) for i in range(5))
            offsets, lengths = [], []
            for page_id, url, html, digest, first in zip(ids, urls, htmls.cast(pa.binary()), digests, firsts, strict=True):
                data = record(page_id.as_py(), url.as_py(), html.as_py(), digest.as_py(), first.as_py(), date)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = packer.compress(data) + packer.flush()
                offsets.append(out.write(data))
                lengths.append(len(data))
            kinds = pa.array(["response" if x is None else "revisit" for x in firsts.to_pylist()], pa.string())
            places = [pa.array([out.uri] * len(offsets), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())]
            yield pa.RecordBatch.from_arrays([ids, urls, kinds, firsts, digests, *places], [x.split()[0] for x in INDEX.split(", ")])
        if out:
            out.close()

    return keep(with_first(pages).mapInArrow(run, INDEX), "warc_index")


def read_records(index: DataFrame, gap: int = 1 << 16, most: int = 1 << 23) -> DataFrame:
    """The records that index (all of it or a selection) tells of: headers' values and payload (empty for revisits).

    Records are dealt to tasks by place (of TASK_BYTES at most, and as many as the session's shuffle partitions while they
    have most bytes each) and read in ranges of up to most bytes (one record at least), over gaps of up to
    gap bytes. A payload that does not have its digest fails the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            places = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            columns: list[list] = [[] for _ in range(6)]
            i = 0
            while i < len(places):
                file, start, length = places[i]
                end, j = start + length, i + 1
                while j < len(places) and places[j][0] == file and places[j][1] - end <= gap and places[j][1] + places[j][2] - start <= most:
                    end, j = max(end, places[j][1] + places[j][2]), j + 1
                data = reader.read(file, start, end - start)
                for _, offset, n in places[i:j]:
                    headers, payload = parse(zlib.decompress(data[offset - start : offset - start + n], 31))
                    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{file} at {offset}: the payload does not have its digest")
                    page_id, first = headers.get("warc-page-id"), headers.get("warc-refers-to-page-id")
                    for column, value in zip(columns, (page_id and int(page_id), headers.get("warc-target-uri"), kind, first and int(first), digest, payload), strict=True):
                        column.append(value)
                if sum(map(len, columns[5])) > most:
                    yield batch_of(columns)
                    columns = [[] for _ in range(6)]
                i = j
            yield batch_of(columns)
        reader.close()

    def batch_of(columns: list[list]) -> pa.RecordBatch:
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])

    # Tasks by the records' bytes: the index itself is too small to be dealt out by its size.
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(-(-total // TASK_BYTES), min(-(-total // most), int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 1)
    placed = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(run, RECORDS)


def warc_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit's size is that of the response it refers to. An empty table gives an empty one.
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")
    read = keep(read_records(write_warc(pages, folder)).withColumn("payload_bytes", F.octet_length("payload").cast("long")).drop("payload", "url"), "records")
    revisits = read.filter("record_type = 'revisit'")
    needed = revisits.select("refers_to", "payload_digest").distinct()
    responses = read.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    sizes = needed.join(responses, ["refers_to", "payload_digest"])
    full = revisits.drop("payload_bytes").join(sizes, ["refers_to", "payload_digest"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return read.filter("record_type = 'response'").select(columns).unionByName(full.select(columns))
