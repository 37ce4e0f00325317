"""Operator 4: MinHash near-duplicates with tensored banding.

Two collections of ``HALVES`` half-keys, each of ``ROWS`` minhashes, are computed per document; every pair of a
half-key of the first and one of the second is the key of a table.  So ``HALVES**2`` tables need only
``2 * HALVES * ROWS`` minhashes.  At similarity J a pair meets in some table with probability
``(1 - (1 - J**ROWS)**HALVES)**2``: 0.9985 at 0.8, 0.99999 at 0.9.  Every link is confirmed on the full shingle sets.

A shingle is its 64-bit hash: two different shingles of one pair of documents count as one with probability 2**-64 for each
pair of them.  Documents with equal sets are one class.  The member whose buckets hold most other members, the middle of a group
of copies, leads a bucket.  All members of the buckets with one leader are a family, which holds every candidate pair of those buckets.
A family is dealt out in chunks of about ``CHUNK`` members and ``SHINGLES`` shingles at most, each with the leader, and a task compares
all pairs of a chunk at once: with R the leader's set and E_x the symmetric difference of
x and R, ``|x ^ y| = |E_x| + |E_y| - 2 |E_x & E_y|``, and the last term is a product of small 0/1 matrices.  In families of several chunks,
members that are not in their leader's component are then compared with all other members, again in chunks.  So no link between
candidates is given up, no pair becomes a row, and no task holds a group.  Buckets and their leaders come from aggregates that are
made on the map side first and joined back, so a hot key is never sorted in one task.

Cases: null or blank texts have an empty set and link with nothing; texts of fewer words than a shingle are one shingle; repeated
rows of an id are one document and each gets a row; a null id links with nothing and has a null component;
ties go to the smallest id; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Workspace, claim, components, n_parts, slices
from lectern.llm.op9_itq import smallest

HALVES, ROWS, CHUNK = 10, 3, 1024
SHINGLES = 1 << 20
WORDS_KEPT = 150_000
GOLD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Words(dict):
    """Hash of each word; bounded by ``shingles``."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_words = Words()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * GOLD
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; words are split at the six ASCII blanks, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, "u8")
    if len(_words) > WORDS_KEPT:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), "u8", n)
    k = min(size, n)
    acc = h[: n - k + 1] + np.uint64(k)
    for j in range(1, k):
        acc = mixed(acc) + h[j : n - k + 1 + j]
    return np.unique(mixed(acc))


def coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(4)
    return rng.integers(0, 1 << 63, n, dtype="u8") * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype="u8")


_A, _B = coefficients(2 * HALVES * ROWS)


def half_keys(s: np.ndarray) -> np.ndarray:
    """The ``2 * HALVES`` half-keys of a shingle set."""
    low = np.full(len(_A), ~np.uint64(0))
    for at in range(0, len(s), 2048):
        low = np.minimum(low, ((s[at : at + 2048, None] * _A + _B) >> np.uint64(16)).min(axis=0))
    rows = low.reshape(2 * HALVES, ROWS)
    acc = np.arange(2 * HALVES, dtype="u8")
    for j in range(ROWS):
        acc = mixed(acc * GOLD + rows[:, j])
    return acc


def table_keys(halves: np.ndarray) -> np.ndarray:
    """Rows of half-keys to rows of ``HALVES**2`` table keys."""
    left, right = halves[:, :HALVES], halves[:, HALVES:]
    return mixed(left[:, :, None] * GOLD + mixed(right)[:, None, :]).reshape(len(halves), -1)


def linked_pairs(sets: list[np.ndarray], percent: int, split: int | None = None) -> np.ndarray:
    """Boolean matrix of the pairs whose Jaccard similarity is at least ``percent`` per cent, exactly.

    With ``split``, only rows before it against rows from it on.
    """
    n, ref = len(sets), sets[0]
    edits = [np.setxor1d(s, ref, assume_unique=True) for s in sets]
    sizes, counts = np.array([len(s) for s in sets], "i8"), np.array([len(e) for e in edits], "i8")
    values, row = np.concatenate(edits), np.repeat(np.arange(n, dtype="i4"), counts)
    del edits
    order = np.argsort(values)
    values, row = values[order], row[order]
    del order
    first, last = np.ones(len(values), bool), np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    last[:-1] = first[1:]
    shared = ~(first & last)  # an edit of one row alone meets no other
    row, column = row[shared], np.cumsum(first[shared], dtype="i4") - 1
    del values
    both = np.zeros((n, n) if split is None else (split, n - split), "f4")
    width = max(256, (1 << 22) // n)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, [lo, lo + width])
        x = np.zeros((n, width), "f4")
        x[row[i:j], column[i:j] - lo] = 1
        both += x @ x.T if split is None else x[:split] @ x[split:].T
    left, right = (slice(None), slice(None)) if split is None else (slice(0, split), slice(split, None))
    apart = counts[left][:, None] + counts[right][None, :] - 2 * both.astype("i8")
    total = sizes[left][:, None] + sizes[right][None, :]
    # J = (total - apart) / (total + apart)
    return (100 - percent) * total >= (100 + percent) * apart


def cell_edges(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of one chunk."""
    if len(ids) < 2:
        return []
    linked = linked_pairs(sets, percent)
    np.fill_diagonal(linked, False)
    low = smallest(linked, ids)
    return [(int(a), int(b)) for a, b in zip(ids, low, strict=True) if a != b]


def cross_edges(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """For rows of side 0 their links with rows of side 1, one edge per component that they reach."""
    order = np.argsort(side, kind="stable")
    split = int((side == 0).sum())
    if not 0 < split < len(ids):
        return []
    ids, linked = ids[order], linked_pairs([sets[k] for k in order], percent, split)
    adjacent = np.zeros((len(ids), len(ids)), bool)
    adjacent[:split, split:] = linked
    adjacent |= adjacent.T
    low = smallest(adjacent, ids)
    return [(int(a), int(b)) for a, b in zip(ids, low, strict=True) if a != b]


def grouped(batches, keys: int):
    """Runs of rows with equal first ``keys`` columns, from batches sorted by them; a run is bounded by its chunk."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.nonzero(change)[0] + 1).tolist(), batch.num_rows]
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            held.append(batch.slice(lo, hi - lo))
            if hi < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Rows ``(doc_id, n_shingles, component_id, kept)``, one per row of the input.

    Links are pairs of documents whose sets of ``size``-word shingles have a Jaccard similarity of at least
    ``percent`` per cent; a component's id is its smallest document id.
    """
    ws = Workspace(df.sparkSession, "op4")
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def signature(batches):
        claim("minhash", _words.clear)
        for batch in batches:
            for part in slices(batch, 256, 1 << 20):
                sets = [shingles(t, size) for t in part.column(1).to_pylist()]
                fps = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                halves = [half_keys(s).tobytes() if len(s) else None for s in sets]
                yield pa.record_batch([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.binary()), pa.array(halves, pa.binary())], names=["doc_id", "n", "fp", "halves"])

    signed = ws.save(docs.mapInArrow(signature, "doc_id long, n long, fp binary, halves binary"), "signed")
    classes = ws.save(signed.where("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("halves").alias("halves")), "classes")

    def keyed(batches):
        for batch in batches:
            for part in slices(batch, 1024):
                keys = table_keys(np.frombuffer(b"".join(part.column(1).to_pylist()), "u8").reshape(part.num_rows, -1))
                yield pa.record_batch([pa.array(keys.ravel().view("i8")), pa.array(np.repeat(part.column(0).to_numpy(), keys.shape[1]))], names=["key", "id"])

    entries = classes.select("id", "halves").mapInArrow(keyed, "key long, id long")  # cheaper to make twice than to keep
    shared = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    met = ws.save(entries.join(shared.hint("merge"), "key"), "met")
    # buckets of the same members in several tables count once
    prints = met.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64("id", F.lit(1)) % (1 << 40)).alias("s"))
    once = ws.save(prints.groupBy("c", "x", "s").agg(F.min("key").alias("key")).select("key", "c"), "once")
    bucketed = ws.save(met.join(once.hint("merge"), "key"), "bucketed")
    weighed = ws.save(bucketed.groupBy("id").agg(F.sum("c").alias("score")).join(classes.groupBy("id").agg(F.max("n").alias("n")).hint("merge"), "id"), "weighed")
    scored = bucketed.select("key", "id").join(weighed.hint("merge"), "id")
    lead = ws.save(scored.groupBy("key").agg(F.min(F.struct(-F.col("score"), "id")).alias("first")).select("key", F.col("first.id").alias("lead")), "lead")
    ws.drop("met", "once")
    texts = ws.save(docs.join(weighed.select(F.col("id").alias("doc_id")).hint("merge"), "doc_id", "left_semi"), "texts")

    def cells(batches, keys: int, work):
        claim("minhash", _words.clear)
        for table in grouped(batches, keys):
            sets = [shingles(t, size) for t in table["text"].to_pylist()]
            edges = work(table, table["id"].to_numpy(), sets)
            if edges:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*edges, strict=True)], names=["a", "b"])

    def within(batches):
        yield from cells(batches, 2, lambda table, ids, sets: cell_edges(ids, sets, percent))

    def across(batches):
        yield from cells(batches, 3, lambda table, ids, sets: cross_edges(ids, sets, table["side"].to_numpy(), percent))

    def with_text(rows: DataFrame) -> DataFrame:
        return rows.join(texts.select(F.col("doc_id").alias("id"), "text"), "id")

    parts = n_parts(df.sparkSession)
    family = bucketed.select("key", "id").join(lead.hint("merge"), "key").select("lead", "id").distinct()
    family = ws.save(family.join(weighed.select("id", "n").hint("merge"), "id"), "family")
    ws.drop("bucketed", "lead")

    def shares() -> Column:
        """Chunks that keep a group of rows under both bounds."""
        return F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / SHINGLES)).cast("int")

    counts = ws.save(family.groupBy("lead").agg(shares().alias("chunks")), "counts")
    placed = family.join(counts.hint("merge"), "lead")
    own = F.when(F.col("id") == F.col("lead"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), "chunks").cast("int")))
    chunked = with_text(placed.select("lead", F.explode(own).alias("chunk"), "id")).select("lead", "chunk", "id", "text")
    edges = chunked.repartition(parts, "lead", "chunk").sortWithinPartitions("lead", "chunk").mapInArrow(within, "a long, b long")
    edges = ws.save(edges, "edges")
    roots = components(ws, edges, "cc-0")
    # families of several chunks: members outside their leader's component against all others
    wide = placed.where("chunks > 1").join(roots.hint("merge"), "id", "left").select("lead", "id", "n", "chunks", F.coalesce("root", "id").alias("root"))
    wide = ws.save(wide, "wide")
    heads = wide.where("id = lead").select("lead", F.col("root").alias("head"))
    loose = ws.save(wide.join(heads, "lead").where("root <> head").select("lead", "id", "n"), "loose")
    if loose.head(1):
        blocks = loose.groupBy("lead").agg(shares().alias("blocks"))
        blocks = ws.save(blocks.join(counts, "lead"), "blocks")
        at = F.pmod(F.xxhash64("id"), "blocks").cast("int")
        left = loose.join(blocks, "lead").select("lead", at.alias("i"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"), F.lit(0).alias("side"), "id")
        right = wide.select("lead", "id").join(blocks, "lead").select("lead", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("j"), F.lit(1).alias("side"), "id")
        crossed = with_text(left.unionByName(right)).select("lead", "i", "j", "side", "id", "text")
        more = crossed.repartition(parts, "lead", "i", "j").sortWithinPartitions("lead", "i", "j", "side").mapInArrow(across, "a long, b long")
        more = ws.save(more, "more")
        if more.head(1):
            roots = components(ws, edges.unionByName(more), "cc-1")
    rooted = ws.save(classes.select("fp", "id").join(roots.hint("merge"), "id", "left").select("fp", F.coalesce("root", "id").alias("root")), "rooted")
    linked = signed.where("fp is not null and doc_id is not null").select("doc_id", "n", "fp").join(rooted.hint("merge"), "fp").select("doc_id", "n", "root")
    alone = signed.where("fp is null or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("root"))
    both = linked.unionByName(alone)
    return both.select("doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("root"), F.lit(False)).alias("kept"))
