"""Operator 3: token ids in a fixed-width bit-packed file format, and its reader.

A file holds whole documents in ascending key order::

    magic, then blocks of BLOCK ids at `bits` bits each (each block on a byte boundary),
    then int64 arrays: block byte offsets, document id offsets (n + 1), document keys,
    then a JSON footer and its length.

``bits`` is the least width that holds the vocabulary.  Any id is found from its block's offset, and a block is
unpacked with numpy at once.  Files hold at most ``FILE_IDS`` ids (or one longer document).

Cases: null text is a document of the end id alone; null keys come first (the footer counts them); rows with equal keys keep all
their copies, ordered by a hash of their text; other columns are ignored; an empty table gives no file and no row.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import bpe
from lectern.llm.common import Workspace, n_parts, read_file, slices, write_file

MAGIC = b"LBPK0001"
BLOCK = 4096
FILE_IDS = 1 << 24
MANIFEST = pa.schema([("part", pa.int64()), ("file", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids at ``bits`` bits each, least significant bit first, padded to whole bytes."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = ids.astype("<u8")[:, None] >> np.arange(bits, dtype="<u8")
    return np.packbits((wide & np.uint64(1)).astype("u1"), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of packed data."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    flags = np.unpackbits(np.frombuffer(data, "u1"), bitorder="little", count=n * bits).reshape(n, bits)
    return (flags.astype("<u4") << np.arange(bits, dtype="<u4")).sum(axis=1, dtype="<u4")


def file_chunks(keys: list[int | None], docs: list[np.ndarray], bits: int):
    """The bytes of a file of these documents."""
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype("<i8")
    ids = np.concatenate(docs) if docs else np.empty(0, "<u4")
    yield MAGIC
    at, blocks = len(MAGIC), []
    for lo in range(0, len(ids), BLOCK):
        raw = pack(ids[lo : lo + BLOCK], bits)
        blocks.append(at)
        at += len(raw)
        yield raw
    yield np.array(blocks, "<i8").tobytes()
    yield offsets.tobytes()
    yield np.array([0 if k is None else k for k in keys], "<i8").tobytes()
    foot = json.dumps({"bits": bits, "block": BLOCK, "n_ids": len(ids), "n_docs": len(docs), "n_blocks": len(blocks), "n_null_keys": sum(k is None for k in keys), "tables_at": at}).encode()
    yield foot
    yield struct.pack("<I", len(foot))


class PackedFile:
    """Reader with random access to ids and documents."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a packed id file")
        (size,) = struct.unpack("<I", data[-4:])
        self.data, self.meta = memoryview(data), json.loads(data[-4 - size : -4])
        m, at = self.meta, self.meta["tables_at"]
        self.blocks = np.frombuffer(data, "<i8", m["n_blocks"], at)
        self.offsets = np.frombuffer(data, "<i8", m["n_docs"] + 1, at + 8 * m["n_blocks"])
        self.keys = np.frombuffer(data, "<i8", m["n_docs"], at + 8 * (m["n_blocks"] + m["n_docs"] + 1))

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids ``lo`` to ``hi`` of the file; only the blocks that hold them are unpacked."""
        if hi <= lo:
            return np.empty(0, "<u4")
        block, first = self.meta["block"], lo // self.meta["block"]
        out = []
        for k in range(first, (hi - 1) // block + 1):
            n = min(block, self.meta["n_ids"] - k * block)
            out.append(unpack(self.data[self.blocks[k] : self.blocks[k] + (n * self.meta["bits"] + 7) // 8], n, self.meta["bits"]))
        return np.concatenate(out)[lo - first * block : hi - first * block]

    def key(self, k: int) -> int | None:
        return None if k < self.meta["n_null_keys"] else int(self.keys[k])

    def doc(self, k: int) -> np.ndarray:
        return self.ids(int(self.offsets[k]), int(self.offsets[k + 1]))


def write_ids(ws: Workspace, df: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the documents' ids in key order; the manifest ``(part, file, path, n_docs, n_ids, start)``.

    Documents are dealt out by key range and sorted inside a range, so concatenating the files by
    ``(part, file)`` gives the whole corpus in order.  ``start`` is the number of ids in earlier files.
    """
    folder = ws.path("files")

    def write(batches):
        codec = bpe.codec(tokenizer)
        bits, part = bits_for(codec.size), TaskContext.get().partitionId()
        keys, docs, held, file = [], [], 0, 0

        def flush():
            nonlocal keys, docs, held, file
            path = write_file(folder, f"part-{part:08d}-{file:05d}", file_chunks(keys, docs, bits))
            row = pa.record_batch([pa.array([v], f.type) for v, f in zip((part, file, path, len(docs), held), MANIFEST, strict=True)], schema=MANIFEST)
            keys, docs, held, file = [], [], 0, file + 1
            return row

        for batch in batches:
            for cut in slices(batch, 2048, 2 << 20):
                for k, ids in zip(cut.column(0).to_pylist(), codec.encode(cut.column(1).to_pylist()), strict=True):
                    if docs and held + len(ids) + 1 > FILE_IDS:
                        yield flush()
                    keys.append(k)
                    docs.append(np.append(ids, np.array([end_id], "<u4")))
                    held += len(ids) + 1
        if docs:
            yield flush()

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    order = [F.col("key"), F.xxhash64("text")]
    ranged = rows.repartitionByRange(n_parts(df.sparkSession), *order).sortWithinPartitions(*order, "text")
    manifest = ws.save(ranged.mapInArrow(write, "part long, file long, path string, n_docs long, n_ids long"), "manifest")
    # one row per file: the only thing that meets in one task
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_ids(manifest: DataFrame) -> DataFrame:
    """Rows ``(doc_id, start, n_tokens, ids)`` read back from the files; ``start`` counts all ids before."""
    return _read(manifest, lambda k, start, ids: (k, start, len(ids), ids.tobytes()), ["doc_id long", "start long", "n_tokens long", "ids binary"])


def read_digests(manifest: DataFrame) -> DataFrame:
    """As ``read_ids``, with the ids' CRC-32 in their place."""
    return _read(manifest, lambda k, start, ids: (k, start, len(ids), zlib.crc32(ids.tobytes())), ["doc_id long", "start long", "n_tokens long", "ids_crc32 long"])


def _read(manifest: DataFrame, row, columns: list[str]) -> DataFrame:
    kinds = [pa.binary() if c.endswith("binary") else pa.int64() for c in columns]
    names = [c.split(" ")[0] for c in columns]

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = PackedFile(read_file(path))
                for lo in range(0, len(file.keys), 512):
                    rows = [row(file.key(k), start + int(file.offsets[k]), file.doc(k)) for k in range(lo, min(lo + 512, len(file.keys)))]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    spread = manifest.select("path", "start").repartition(n_parts(manifest.sparkSession), "path")
    return spread.mapInArrow(read, ", ".join(columns))
