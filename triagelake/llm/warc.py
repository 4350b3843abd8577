"""WARC archives compressed with Zstandard, written and read.

An archive (.warc.zst) begins with a skippable frame that holds the dictionary; every record then
is one frame compressed with it. The reader takes the dictionary from that leading frame, decodes
a frame for each record, and checks the version line, required headers, Content-Length, block and
payload digests and the closing blank lines.

Of the records with equal payloads of at least ``min_bytes`` bytes, the one with the largest
page_id is a response; the others are revisits that refer to it. Archives are rows of a table (a
name and the archive's bytes, about ``ARCHIVE_BYTES`` of payload each), so they are written and
read through Spark in any store; ``export`` is that column's bytes as they are.

The dictionary is trained on a bounded sample of whole payloads (``SAMPLE`` rows, ``SAMPLE_BYTES`` bytes, smallest
hashes); if there are too few to train on it is raw content. It shapes the stored form, no result.

Defined cases: null html is the empty payload; null url is written as an empty target; a null
page_id counts as smaller than all; rows that repeat the largest page_id of a payload are all
responses; other columns are not archived; an empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NULL_ID, prepare, read, save, scratch

#: Magic of the skippable frame that holds a dictionary (fixed value of the format).
SKIPPABLE = 0x184D2A5D
ARCHIVE_BYTES, SAMPLE, SAMPLE_BYTES, DICT_BYTES = 4 << 20, 400, 6 << 20, 64 << 10
DATE = "2024-01-01T00:00:00Z"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header, with the length, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    target = url.encode().replace(b"\r", b"%0D").replace(b"\n", b"%0A")
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Record-ID: <urn:page:%d>" % page_id,
        b"WARC-Date: " + DATE.encode(),
        b"WARC-Target-URI: " + target,
        b"Content-Type: application/http; msgtype=response",
        b"WARC-Payload-Digest: sha1:" + digest32(payload).encode(),
        b"WARC-Block-Digest: sha1:" + digest32(block).encode(),
        b"Content-Length: %d" % len(block),
    ]
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%d>" % refers_to]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


class Writer:
    def __init__(self, dictionary: bytes, raw: bool):
        self.dictionary = dictionary
        kind = zstd.DICT_TYPE_RAWCONTENT if raw else zstd.DICT_TYPE_FULLDICT
        self.codec = zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(dictionary, dict_type=kind), write_content_size=True)

    def start(self) -> bytes:
        return struct.pack("<II", SKIPPABLE, len(self.dictionary)) + self.dictionary

    def add(self, data: bytes) -> bytes:
        return self.codec.compress(data)


def frames(archive: bytes) -> Iterator[bytes]:
    """The decoded records of an archive."""
    if len(archive) < 8:
        raise ValueError("no dictionary frame")
    magic, size = struct.unpack_from("<II", archive)
    if magic != SKIPPABLE or 8 + size > len(archive):
        raise ValueError("no dictionary frame")
    body = archive[8 : 8 + size]
    if body[:4] == b"\x28\xb5\x2f\xfd":  # the format allows a compressed dictionary
        body = zstd.ZstdDecompressor().decompressobj().decompress(body)
    # a trained dictionary bears its magic; other content is used as it is
    kind = zstd.DICT_TYPE_FULLDICT if body[:4] == b"\x37\xa4\x30\xec" else zstd.DICT_TYPE_RAWCONTENT
    codec = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(body, dict_type=kind))
    rest = memoryview(archive)[8 + size :]
    while len(rest):
        frame = codec.decompressobj()
        data = frame.decompress(rest)
        if not frame.eof:
            raise ValueError("cut frame")
        yield data
        rest = rest[len(rest) - len(frame.unused_data) :]


def parse(data: bytes) -> dict:
    """Headers and payload of a record; raises ValueError if anything is wrong with it."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC header")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without a colon")
        headers[name.decode().strip().lower()] = value.decode().strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in headers:
            raise ValueError(f"no {name}")
    size = int(headers["content-length"])
    block, end = rest[:size], rest[size:]
    if len(block) != size or end != b"\r\n\r\n":
        raise ValueError("length differs")
    if "warc-block-digest" in headers and headers["warc-block-digest"] != "sha1:" + digest32(block):
        raise ValueError("block digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    if not gap or length is None:
        raise ValueError("no HTTP header")
    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or digest32(payload) != digest):
        raise ValueError("payload differs")
    if kind == "revisit" and (payload or "warc-refers-to" not in headers):
        raise ValueError("revisit with a payload or without a target")
    number = lambda x: int(x.removeprefix("<urn:page:").removesuffix(">"))
    return {
        "page_id": number(headers["warc-record-id"]),
        "url": headers.get("warc-target-uri", ""),
        "payload": payload,
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number(headers["warc-refers-to"]) if kind == "revisit" else None,
    }


def train_dictionary(pages: DataFrame) -> tuple[bytes, bool]:
    """(dictionary, whether it is raw content) from whole payloads, in order of a hash, of up to SAMPLE_BYTES together."""
    some = pages.select(F.xxhash64("__id", "__html").alias("k"), F.octet_length("__html").alias("n"), "__id").where(f"n BETWEEN 1 AND {SAMPLE_BYTES}").orderBy("k").limit(SAMPLE)
    some = some.withColumn("run", F.sum("n").over(W.orderBy("k").rowsBetween(W.unboundedPreceding, 0))).where(f"run <= {SAMPLE_BYTES}")  # at most SAMPLE rows
    picked = [r["k"] for r in some.collect()]
    rows = pages.where(F.xxhash64("__id", "__html").isin(picked)).select("__html").distinct().collect() if picked else []
    samples = sorted(r["__html"].encode() for r in rows)
    try:
        return zstd.train_dictionary(DICT_BYTES, samples).as_bytes(), False
    except (zstd.ZstdError, ValueError):
        return (b"".join(samples)[:DICT_BYTES] or b"<!DOCTYPE html><html><head></head><body></body></html>"), True


def write(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A table of archives (binary column ``archive``), saved in the shared folder."""
    spark = pages.sparkSession
    prepare(spark)
    folder = scratch(spark, "warc")
    base = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("__id"), F.coalesce(url_col, F.lit("")).alias("__url"), F.coalesce(html_col, F.lit("")).alias("__html"))
    slim = save(base.select("__id", F.unhex(F.sha1("__html")).alias("__sha"), F.octet_length("__html").alias("__n")), f"{folder}/digests")
    # written first, so that the joins' sides are plain exchanges and a common payload's partition can be split
    tops = slim.where(F.col("__n") >= min_bytes).groupBy("__sha", "__n").agg(F.max("__id").alias("__top"), F.min("__id").alias("__low")).where("__top <> __low")
    tops = save(tops.select("__sha", "__n", "__top"), f"{folder}/tops")
    refers = slim.join(tops.hint("merge"), ["__sha", "__n"]).where("__id <> __top").select("__id", "__sha", "__top").distinct()
    refers = save(refers, f"{folder}/refers").hint("merge")
    rows = base.withColumn("__sha", F.unhex(F.sha1("__html"))).join(refers, ["__id", "__sha"], "left")
    dictionary, raw = train_dictionary(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(dictionary, raw)
        parts, size = [writer.start()], 0
        for batch in batches:
            for i, url, html, top in zip(*(batch.column(n).to_pylist() for n in ("__id", "__url", "__html", "__top"))):
                payload = html.encode()
                parts.append(writer.add(record(i, url, payload, top)))
                size += len(payload) + 300
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["archive"])
                    parts, size = [writer.start()], 0
        if len(parts) > 1:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["archive"])

    made = rows.select("__id", "__url", "__html", "__top").mapInArrow(run, "archive binary")
    made.write.option("compression", "none").parquet(f"{folder}/archives")
    return spark.read.schema(made.schema).parquet(f"{folder}/archives")


def read_archives(archives: DataFrame, archive_col: str = "archive", payloads: bool = True) -> DataFrame:
    """A row for each record of the archives."""
    prepare(archives.sparkSession)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["url", "payload"] if payloads else [])]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                held: list[dict] = []
                for data in frames(value.as_py()):
                    held.append(parse(data) if payloads else {k: v for k, v in parse(data).items() if k != "payload"})
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in held], t) for n, t in zip(names, types)], names=names)

    shape = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", url string, payload binary" if payloads else "")
    out = archives.select(archive_col).mapInArrow(run, shape)
    shown = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.withColumns({"page_id": shown("page_id"), "refers_to": shown("refers_to")})


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write(read(spark, sf_dir, "pages").select("page_id", "url", "html")), payloads=False)


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
h AS (SELECT *, sha1(html) AS x FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
         (((('0x' || substr(x, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT]), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM h
"""
