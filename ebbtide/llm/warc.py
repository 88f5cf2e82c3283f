"""WARC 1.1 archives: a deterministic sharded writer, and a reader.

Records are sorted by ``page_id`` in shards that are ranges of it. A shard's files are rolled when the
next record would take them past ``roll_bytes`` compressed; a record that is larger alone has a file of
its own. Every record is a gzip member without a time stamp. Ids, dates and digests follow from the
row, so writing the same rows again gives the same bytes, whatever the partitions. Files are written
under temporary names and committed by a manifest (`shard_files`).

Of records with equal payloads of at least ``least_revisit`` bytes, the one with the largest page_id is
a response and the others are revisits that refer to it; a null page_id is the smallest, rows that
repeat the largest are all responses. Null html is an empty payload, a null url leaves the target out.
An empty table gives no file and an empty result. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.shard_files import ShardFile, committed, contents, shard_of, written
from ebbtide.llm.shared import new_folder, slices, whole_text

SUFFIX = ".warc.gz"
DATE = "1970-01-01T00:00:00Z"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
IDS = uuid.uuid5(uuid.NAMESPACE_URL, "page")


def labelled_digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(IDS, str(page_id))}>"


def in_header(value: str) -> str:
    """A header value on one line: control characters and spaces percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, block: bytes, fields: list[tuple[str, str | None]]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {v}" for k, v in fields if v is not None]
    lines += [f"WARC-Block-Digest: {labelled_digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, html: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the HTTP head alone."""
    payload = html.encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    return record("revisit" if revisit else "response", head if revisit else head + payload, [
        ("WARC-Record-ID", record_id(page_id)), ("WARC-Target-URI", None if url is None else in_header(url)),
        ("Page-ID", None if page_id is None else str(page_id)), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", labelled_digest(payload)), ("WARC-Profile", SAME_PAYLOAD if revisit else None),
        ("WARC-Refers-To", record_id(refers_to) if revisit else None),
        ("Refers-To-Page-ID", str(refers_to) if revisit else None),
    ])


def info_record(name: str) -> bytes:
    return record("warcinfo", b"format: WARC File Format 1.1\r\n", [
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(IDS, name)}>"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")])


def member(data: bytes, level: int) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def revisits(rows: DataFrame, least_revisit: int) -> DataFrame:
    """page_id, payload (its SHA-256), refers_to: the pages that are revisits, without their html."""
    keyed = rows.filter(F.octet_length("html") >= least_revisit).select(F.sha2("html", 256).alias("payload"), "page_id")
    groups = keyed.groupBy("payload").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
    found = keyed.join(groups.filter("n > 1 AND response IS NOT NULL"), "payload").filter(~F.col("page_id").eqNullSafe(F.col("response")))
    return found.select("page_id", "payload", F.col("response").alias("refers_to")).distinct()


def write_archives(pages: DataFrame, folder: str, least_revisit: int = 1000, shard_bytes: int = 32 << 20,
                   roll_bytes: int = 16 << 20, level: int = 5) -> DataFrame:
    """Write all pages; returns the manifest of the committed files.

    The html moves once, to its shard. What a revisit refers to is sent there as a row of its own, ahead of its
    page, instead of being joined to it.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), whole_text("html").alias("html"))
    shard, shards = shard_of(rows, "page_id", F.octet_length("html") + 500, shard_bytes)
    both = rows.unionByName(revisits(rows, least_revisit), allowMissingColumns=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        file = None
        told_of, told = None, {}  # a page_id, and payload to response of its revisits

        def begun(shard: int, number: int) -> ShardFile:
            new = ShardFile(folder, shard, number)
            new.write(member(info_record(f"shard-{shard:05d}-{number:03d}{SUFFIX}"), level))
            return new

        for batch in slices(batches, 128):
            for values in zip(*batch.columns):
                page_id, url, html, payload, refers_to, shard = (v.as_py() for v in values)
                if told_of != (page_id, shard):
                    told_of, told = (page_id, shard), {}
                if html is None:
                    told[payload] = refers_to
                    continue
                refers_to = told.get(hashlib.sha256(html.encode()).hexdigest()) if told else None
                data = member(page_record(page_id, url, html, refers_to), level)
                if file is None or file.shard != shard:
                    if file:
                        yield file.close()
                    file = begun(shard, 0)
                elif file.records and file.bytes + len(data) > roll_bytes:
                    yield file.close()
                    file = begun(shard, file.number + 1)
                file.write(data)
                file.records += 1
                file.items += 1
        if file:
            yield file.close()

    ahead = both.withColumn("shard", shard).select("page_id", "url", "html", "payload", "refers_to", "shard")
    return committed(written(ahead, shards, ["page_id", F.desc_nulls_last("payload"), "url", "html"], write), folder, SUFFIX)


def members(content: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a file, one after the other."""
    at = 0
    while at < len(content):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if at >= len(content):
                raise ValueError("the archive ends inside a record")
            part = content[at:at + step]
            parts.append(unpack.decompress(part))
            at += len(part) - len(unpack.unused_data)
        yield b"".join(parts)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[:int(fields["Content-Length"])]


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per response or revisit: page_id, url, payload (binary, null for revisits),
    payload_bytes, payload_digest, record_type, refers_to."""
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def row(fields: dict[str, str], block: bytes) -> tuple:
        head, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        response = fields["WARC-Type"] == "response"
        if labelled_digest(block) != fields["WARC-Block-Digest"] or response and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
        number = lambda name: int(fields[name]) if name in fields else None
        return (number("Page-ID"), fields.get("WARC-Target-URI"), payload if response else None, size, digest,
                fields["WARC-Type"], number("Refers-To-Page-ID"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = []
            for data in members(batch.column(0)[0].as_py()):
                fields, block = parsed(data)
                if fields["WARC-Type"] != "warcinfo":
                    rows.append(row(fields, block))
                if len(rows) == 128:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return contents(manifest, folder, SUFFIX).select("content").mapInArrow(
        parse, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(spark: SparkSession, pages: DataFrame, **options: int) -> DataFrame:
    """Write the archives into a new folder and read them back."""
    folder = new_folder(spark, "warc")
    return read_archives(write_archives(pages, folder, **options), folder)
