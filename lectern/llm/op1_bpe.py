"""Operator 1: BPE encoding and decoding of whole texts, long ones by tree concatenation.

Texts up to ``piece_chars`` are coded where they are scanned, without a shuffle.  Longer ones are cut into
pieces that are dealt out over the cluster and encoded in parallel.  A cut falls on a certain pre-token boundary
where there is one; inside long unsplit text it falls anywhere, and the two halves are joined by re-encoding
growing windows until both sides agree (``bpe.Codec.join``).

Cases: null text counts as empty (no ids, empty text); ids of null documents stay null; repeated rows each give
a row; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import bpe
from lectern.llm.common import n_parts, slices

PIECE_CHARS = 1 << 15
CODED = "key long, ids binary, decoded string"
PIECES = "uid long, key long, ix long, kind int, body string"
ENCODED = "uid long, key long, ix long, kind int, ids binary"
#: Kinds of piece: whole-text piece, pre-token units in the byte alphabet, one unit's start, its continuation, special token.
TEXT, UNITS, START, MORE, SPECIAL = range(5)


def cut(codec: bpe.Codec, text: str, size: int) -> Iterator[tuple[int, str]]:
    """Pieces of about ``size`` characters whose encodings concatenate, after joins at each MORE, to the text's."""
    if bpe.odd(text):
        yield from cut_units(codec, text, size)
        return
    run: list[str] = []
    held = 0
    for piece in bpe.PIECES.findall(text):
        if len(piece) > size:
            if run:
                yield TEXT, "".join(run)
                run, held = [], 0
            yield from cut_units(codec, piece, size)
            continue
        run.append(piece)
        held += len(piece)
        if held >= size:
            yield TEXT, "".join(run)
            run, held = [], 0
    if run:
        yield TEXT, "".join(run)


def cut_units(codec: bpe.Codec, text: str, size: int) -> Iterator[tuple[int, str]]:
    run: list[str] = []
    held = 0
    for special, unit in codec.units(text):
        if not special and len(unit) <= size:
            run.append(unit)
            held += len(unit)
        if run and (special or len(unit) > size or held >= size):
            yield UNITS, " ".join(run)  # the byte alphabet has no blank
            run, held = [], 0
        if special:
            yield SPECIAL, unit
        elif len(unit) > size:
            for k in range(0, len(unit), size):
                yield (MORE if k else START), unit[k : k + size]
    if run:
        yield UNITS, " ".join(run)


def encode_piece(codec: bpe.Codec, kind: int, body: str) -> np.ndarray:
    if kind == TEXT:
        return codec.encode([body])[0]
    if kind == SPECIAL:
        return np.array([codec.tok.token_to_id(body)], "<u4")
    units = body.split(" ") if kind == UNITS else [body]
    out: list[int] = []
    for unit in units:
        out += codec.join_all([codec.leaf_ids(unit[k : k + codec.leaf]) for k in range(0, len(unit), codec.leaf)]) if len(unit) > codec.long else codec.leaf_ids(unit)
    return np.array(out, "<u4")


def assemble(codec: bpe.Codec, kinds: list[int], parts: list[bytes]) -> bytes:
    """Ids of a text from its pieces in order: runs START, MORE... are joined as a tree, the rest concatenated."""
    out: list[bytes] = []
    k = 0
    while k < len(parts):
        end = k + 1
        if kinds[k] == START:
            while end < len(parts) and kinds[end] == MORE:
                end += 1
        if end == k + 1:
            out.append(parts[k])
        else:
            out.append(np.array(codec.join_all([np.frombuffer(p, "<u4").tolist() for p in parts[k:end]]), "<u4").tobytes())
        k = end
    return b"".join(out)


def encode_decode(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", piece_chars: int = PIECE_CHARS, finish=None, schema: str = CODED) -> DataFrame:
    """Rows ``(key, ids, decoded)``: ids as little-endian uint32 bytes, and the text they decode to.

    ``finish(key, ids, decoded) -> tuple`` with its ``schema`` derives other columns where the row is made, so
    that a digest never moves the texts themselves.
    """
    fin = finish or (lambda k, ids, decoded: (k, ids.tobytes(), decoded))
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def emit(rows: list[tuple], out_schema: pa.Schema) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in out_schema]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, out_schema, strict=True)], schema=out_schema)

    out_schema = arrow_schema(schema)
    assert out_schema.names == names

    def short(batches):
        codec = bpe.codec(tokenizer)
        for batch in batches:
            for part in slices(batch, 2048, 2 << 20):
                keys, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                yield emit([fin(k, ids, codec.decode(ids)) for k, ids in zip(keys, codec.encode(texts), strict=True)], out_schema)

    def split(batches):
        codec = bpe.codec(tokenizer)
        for batch in batches:
            for part in slices(batch, 16, 1 << 20):
                rows = [(u, k, ix, kind, body) for u, k, t in zip(*(c.to_pylist() for c in part.columns), strict=True) for ix, (kind, body) in enumerate(cut(codec, t, piece_chars))]
                yield emit(rows, arrow_schema(PIECES))

    def encode(batches):
        codec = bpe.codec(tokenizer)
        for batch in batches:
            for part in slices(batch, 64, 1 << 20):
                rows = [(u, k, ix, kind, encode_piece(codec, kind, body).tobytes()) for u, k, ix, kind, body in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                yield emit(rows, arrow_schema(ENCODED))

    def gather(table: pa.Table) -> pa.Table:
        codec = bpe.codec(tokenizer)
        t = table.sort_by("ix")
        ids = np.frombuffer(assemble(codec, t["kind"].to_pylist(), t["ids"].to_pylist()), "<u4")
        return pa.Table.from_batches([emit([fin(t["key"][0].as_py(), ids, codec.decode(ids))], out_schema)])

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    length = F.coalesce(F.length("text"), F.lit(0))
    near = rows.where(length <= piece_chars).mapInArrow(short, schema)
    pieces = rows.withColumn("uid", F.monotonically_increasing_id()).where(length > piece_chars).select("uid", "key", "text").mapInArrow(split, PIECES)
    dealt = pieces.repartition(n_parts(df.sparkSession), "uid", "ix").mapInArrow(encode, ENCODED)
    far = dealt.groupBy("uid").applyInArrow(gather, schema)
    return near.unionByName(far)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (f.strip().split(" ") for f in ddl.split(","))])


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest(key, ids: np.ndarray, decoded: str) -> tuple:
    return key, len(ids), bpe.sha256(ids.tobytes()), bpe.sha256(decoded.encode("utf-8"))
