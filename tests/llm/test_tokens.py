"""Operators 1, 3 and 10: exact round trips and brute-force comparisons."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import bpe, op1_bpe, op3_tokens, op10_packing
from lectern.llm.common import Workspace
from lectern.llm.queries import tokenizer_path

PATH = tokenizer_path()
TOK = Tokenizer.from_file(PATH)
ROWS = [(1, "Hello, world. It's 3.5!"), (2, None), (3, ""), (4, " \n\t "), (5, "a<|endoftext|>b  c\xa0d"), (6, "x" * 5000 + " 日本" * 900 + "ab" * 4000), (7, "word " * 3000), (7, "word " * 3000), (None, "no id"), (9, "é" * 3000)]


def reference(text):
    return np.array(TOK.encode(text or "", add_special_tokens=False).ids, "<u4")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "x", "y") for k, t in ROWS], "doc_id long, text string, key string, ids string")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"ab '.,!?\n\té日😀0_\xa0\x1c", "the", "  ", "<|endoftext|>", "'s"]), max_size=80).map("".join))
def test_pieces_and_tree_are_exact(text):
    codec = bpe.codec(PATH, 24, 5)
    want = reference(text).tolist()
    assert codec.encode([text])[0].tolist() == want
    assert codec.tree(text) == want
    assert codec.decode(np.array(want, "<u4")) == TOK.decode(want, skip_special_tokens=False)


def test_decode_broken_bytes():
    ids = np.random.default_rng(1).integers(0, 50257, 3000).astype("<u4")
    assert bpe.codec(PATH).decode(ids) == TOK.decode(ids.tolist(), skip_special_tokens=False)


def test_cut_and_assemble():
    codec = bpe.codec(PATH)
    for text in (t for _, t in ROWS if t):
        pieces = list(op1_bpe.cut(codec, text, 500))
        parts = [op1_bpe.encode_piece(codec, k, b).tobytes() for k, b in pieces]
        assert op1_bpe.assemble(codec, [k for k, _ in pieces], parts) == reference(text).tobytes()


def test_encode_decode(docs):
    got = op1_bpe.encode_decode(docs, PATH, finish=op1_bpe.digest, schema=op1_bpe.DIGEST, piece_chars=700).collect()
    want = sorted((str(k), len(i := reference(t)), hashlib.sha256(i.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for k, t in ROWS)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_plain_outputs(docs):
    got = {r.key: r for r in op1_bpe.encode_decode(docs.where("doc_id = 1"), PATH).collect()}
    assert got[1].decoded == ROWS[0][1] and got[1].ids == reference(ROWS[0][1]).tobytes()


@pytest.mark.parametrize("bits", [1, 7, 12, 16, 17, 32])
def test_packing_of_bits(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 9001).astype("<u4")
    assert (op3_tokens.unpack(op3_tokens.pack(ids, bits), len(ids), bits) == ids).all()
    file = op3_tokens.PackedFile(b"".join(op3_tokens.file_chunks([None, -(1 << 63)], [ids[:8000], ids[8000:]], bits)))
    assert (file.ids(4090, 8195) == ids[4090:8195]).all() and (file.doc(1) == ids[8000:]).all() and file.key(0) is None and file.key(1) == -(1 << 63)


def test_least_width():
    assert [op3_tokens.bits_for(n) for n in (1, 2, 3, 50257, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_token_files(spark, docs):
    got = op3_tokens.read_digests(op3_tokens.write_ids(Workspace(spark, "t3"), docs, PATH, 2)).collect()
    at, want = 0, []
    for k, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.append(reference(t), np.array([2], "<u4")).astype("<u4")
        want.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_packed_sequences(docs):
    schema = pa.schema([("ids_crc32", pa.int64())])
    got = op10_packing.pack_documents(docs, PATH, 0, finish=op10_packing.crc, schema=schema).collect()
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and len(rows) <= op10_packing.SEGMENTS and at & (at - 1) == 0
    assert sum(r.length for r in got) == sum(len(reference(t)) + 1 for _, t in ROWS)
    whole = defaultdict(list)
    for k, t in ROWS:
        whole[k].append(np.append(reference(t), np.array([0], "<u4")))
    for k, copies in whole.items():
        ids, own = copies[0], sorted((r for r in got if r.doc_id == k), key=lambda r: (r.start, r.length))
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].astype("<u4").tobytes()) for r in own)
        covered = np.zeros(len(ids), int)
        for r in own:
            covered[r.start : r.start + r.length] += 1
        assert (covered == len(copies)).all()


def test_instruction_data(spark):
    """Prompts bear no loss; each sequence keeps all three limits, and each id lies in one piece."""
    rows = [(k, "ask " * (k % 7 * 20), "tell " * (1 + k % 5 * 30)) for k in range(60)] + [(100, None, "x y"), (101, "long " * 700, None)]
    df = spark.createDataFrame([(k, p, t, 1) for k, p, t in rows], "doc_id long, prompt string, text string, length int")
    got = op10_packing.pack_documents(df, PATH, 0, tokens=256, segments=5, loss=100, prompt="prompt").collect()
    size = {k: (len(reference(p)), len(reference(t)) + 1) for k, p, t in rows}
    sequences, placed = defaultdict(list), defaultdict(int)
    for r in got:
        sequences[r.sequence_id].append(r)
        placed[r.doc_id] += r.length
    assert placed == {k: a + b for k, (a, b) in size.items()}
    bearing = [sum(max(0, r.start + r.length - max(r.start, size[r.doc_id][0])) for r in rows_) for rows_ in sequences.values()]
    assert 90 <= max(bearing) <= 100 and all(sum(r.length for r in rows_) <= 256 and len(rows_) <= 5 for rows_ in sequences.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 90), st.integers(0, 3)), max_size=60), st.integers(1, 40), st.integers(1, 6), st.integers(1, 40))
def test_packer_limits(examples, tokens, segments, loss):
    packer, out = op10_packing.Packer(tokens, segments, loss, pool=5), []
    flags = [np.arange(n) % (every + 1) == 0 for n, every in examples]
    for k, f in enumerate(flags):
        out += list(packer.add(k, len(f), f))
    out += list(packer.finish())
    seen = defaultdict(list)
    for seq in out:
        assert sum(n for _, _, n in seq) <= tokens and len(seq) <= segments and sum(int(flags[e][s : s + n].sum()) for e, s, n in seq) <= loss
        for e, s, n in seq:
            seen[e].append((s, n))
    for k, f in enumerate(flags):
        at = 0
        for s, n in sorted(seen[k]):
            assert s == at
            at += n
        assert at == len(f)


def test_empty_tables(spark, docs):
    none = docs.where("false")
    assert op1_bpe.encode_decode(none, PATH).count() == 0
    assert op10_packing.pack_documents(none, PATH, 0).count() == 0
    assert op3_tokens.read_ids(op3_tokens.write_ids(Workspace(spark, "t3"), none, PATH, 2)).count() == 0
