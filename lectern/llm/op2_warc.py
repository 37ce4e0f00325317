"""Operator 2: WARC archives of individually compressed records with an embedded Zstandard dictionary.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds a dictionary trained on a bounded sample of
that archive's own records; every record follows as a Zstandard frame of its own that uses it.  The first record is
a ``warcinfo``.  Of records with equal payloads of at least ``min_bytes`` the one with the largest key is a
``response`` and the others are ``revisit`` records that name it and carry no payload.

Cases: a null payload counts as empty; a null URL gives a record without target URI; a null key gives a response
with a record id of its own kind and takes no part in the choice of the largest; rows that repeat the largest key
are all responses; control characters in URLs are percent-encoded; other columns are ignored; an empty table gives
no archive and no row.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Workspace, n_parts, read_file, slices, write_file

SKIPPABLE = 0x184D2A5D
ARCHIVE_BYTES = 16 << 20
DICT_BYTES = 64 << 10
SAMPLE_BYTES = 2 << 20
MIN_BYTES = 1000
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def record_id(key: int | None, sha1_hex: str) -> str:
    """A version 8 UUID that holds the key's 64 bits, whether it is null, and 40 bits of the payload digest."""
    bits = (key or 0) & (2**64 - 1)
    tail = f"{bits & 15:x}{1 if key is None else 0:x}{sha1_hex[:10]}"
    h = f"{bits >> 16:012x}8{bits >> 4 & 0xFFF:03x}9000{tail}"
    return f"<urn:uuid:{uuid.UUID(h)}>"


def key_of(rid: str) -> int | None:
    h = uuid.UUID(rid.strip("<>").removeprefix("urn:uuid:")).hex
    if h[21] == "1":
        return None
    bits = int(h[:12], 16) << 16 | int(h[13:16], 16) << 4 | int(h[20], 16)
    return bits - 2**64 if bits >> 63 else bits


def b32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def head(lines: list[tuple[str, object]], block: bytes) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def record(key: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record; ``payload`` is unused for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    lines: list[tuple[str, object]] = [("WARC-Type", kind), ("WARC-Record-ID", record_id(key, digest)), ("WARC-Date", date)]
    if url is not None:
        lines.append(("WARC-Target-URI", "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)))
    lines += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{b32(digest)}")]
    if refers_to is not None:
        return head([*lines, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))], http)
    return head(lines, http + (payload or b""))


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from an even sample of at most SAMPLE_BYTES of the records (longer ones by their start)."""
    size, step = sum(map(len, records)), 1
    while size // step > SAMPLE_BYTES:
        step += 1
    sample = [r[: 64 << 10] for r in records[::step]]
    for size in (DICT_BYTES, 4 << 10, 1 << 10):
        # too few or too small records: their quarters stand in beside them, until there is enough to train on
        parts = sample if size == DICT_BYTES else [r[k * len(r) // 4 : (k + 3) * len(r) // 4] for r in sample for k in range(2)] * (1 + 64 // len(sample)) + sample
        try:
            return zstandard.train_dictionary(size, parts)
        except zstandard.ZstdError:
            continue
    return zstandard.ZstdCompressionDict(b"".join(sample)[-DICT_BYTES:].ljust(8, b"\n"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive_chunks(records: list[bytes], date: str):
    info = head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, hashlib.sha1(records[0]).hexdigest())}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
    dictionary = train(records)
    raw = dictionary.as_bytes()
    yield struct.pack("<II", SKIPPABLE, len(raw)) + raw
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)
    for r in [info, *records]:
        yield packer.compress(r)


def read_archive(data: bytes):
    """Rows ``(key, url, payload or None, payload bytes, sha1 hex, type, refers_to)`` of an archive's records."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    with unpacker.stream_reader(memoryview(data)[8 + size :], read_across_frames=True) as src:
        held = b""
        while True:
            while (cut := held.find(b"\r\n\r\n")) < 0:
                more = src.read(1 << 20)
                if not more:
                    if held:
                        raise ValueError("broken record")
                    return
                held += more
            fields = dict(line.split(": ", 1) for line in held[:cut].decode().split("\r\n")[1:])
            end = cut + 4 + int(fields["Content-Length"])
            while len(held) < end + 4:
                more = src.read(max(1 << 20, end + 4 - len(held)))
                if not more:
                    raise ValueError("broken record")
                held += more
            block, held = held[cut + 4 : end], held[end + 4 :]
            kind = fields["WARC-Type"]
            if kind == "warcinfo":
                continue
            http = block.index(b"\r\n\r\n") + 4
            stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
            url, key = fields.get("WARC-Target-URI"), key_of(fields["WARC-Record-ID"])
            if kind == "revisit":
                length = next(int(x[16:]) for x in block[:http].decode().split("\r\n") if x.startswith("Content-Length: "))
                yield key, url, None, length, stated, kind, key_of(fields["WARC-Refers-To"])
            else:
                payload = block[http:]
                if hashlib.sha1(payload).hexdigest() != stated:
                    raise ValueError("payload does not match its digest")
                yield key, url, payload, len(payload), stated, kind, None


def write_archives(ws: Workspace, df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write archives; the manifest ``(path, n_records)``.

    Equal payloads are found by their SHA-1 and length.  The largest key per digest is pre-aggregated on the map
    side and only digests that repeat are kept, as a table; the join with it is a shuffle join that AQE splits where
    a digest is hot.  Payloads below the bound get a join key of their own row, so they never meet.
    """
    folder = ws.path("archives")
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("size", F.octet_length("html").cast("long")).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    again = rows.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("key").alias("target"), F.count("*").alias("n")).where("n > 1 and target is not null").select(F.col("digest").alias("at"), "target")
    again = ws.save(again, "repeats")
    rows = rows.withColumn("at", F.when(F.col("size") >= min_bytes, F.col("digest")).otherwise(F.concat_ws("-", F.lit("own"), "digest", F.col("key").cast("string"))))
    planned = rows.join(again, "at", "left").withColumn("refers_to", F.when(F.col("key") < F.col("target"), F.col("target")))
    planned = planned.select("key", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "size", "digest", "refers_to")

    def write(batches):
        part, records, held, file = TaskContext.get().partitionId(), [], 0, 0

        def flush():
            nonlocal records, held, file
            path = write_file(folder, f"part-{part:08d}-{file:05d}.warc.zst", archive_chunks(records, date))
            row = pa.record_batch([pa.array([path]), pa.array([len(records)], pa.int64())], names=["path", "n_records"])
            records, held, file = [], 0, file + 1
            return row

        for batch in batches:
            for cut in slices(batch):
                for k, u, h, size, digest, refers in zip(*(c.to_pylist() for c in cut.columns), strict=True):
                    records.append(record(k, u, h.encode() if h is not None else None, size, digest, refers, date))
                    held += len(records[-1])
                    if held >= ARCHIVE_BYTES:
                        yield flush()
        if records:
            yield flush()

    return ws.save(planned.mapInArrow(write, "path string, n_records long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Rows ``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of all records."""

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = [(k, n, d, kind, refers) for k, _, _, n, d, kind, refers in read_archive(read_file(path))]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RECORD, strict=True)], schema=RECORD)

    spread = manifest.select("path").repartition(n_parts(manifest.sparkSession), "path")
    return spread.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
     m AS (SELECT d, max(page_id) AS target FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN p.page_id < m.target THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id < m.target THEN m.target END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d AND p.n >= 1000
"""
