"""Operator 9: embedding near-duplicates through iterative quantisation and multi-index Hamming tables.

A rotation that balances binary codes is learned (Gong and Lazebnik, 2011) on a bounded sample; a vector's code is the
signs of its centred, rotated unit vector.  The code is cut into substrings, each of which keys a table; vectors that share a
substring are candidates, and the exact cosine of the original vectors decides.  A substring has ``SUBSTRING`` bits, or with
more vectors so many that a mean bucket holds ``BLOCK`` of them, so that the candidates of a vector grow with the number of tables and not
with the number of vectors.

One rotation gives few tables, and a pair of the least cosine may share none of them, the more so in few dimensions or
where all vectors share a direction.  So rotations from other starts are added until, of sampled vectors turned towards
other ones to exactly that cosine, ``RECALL`` share a substring with their origin.  Where that takes more
copies of a vector than comparing all blocks of vectors with each other, all pairs are compared instead.
Where the vectors have several dimensions, each dimension is a search of its own: across them there is no cosine.

Equal vectors are one weighted class.  A table bucket of over ``BLOCK`` classes is cut into blocks and handled as
pairs of blocks, each a task's work of its own.  A cell returns one row per linked class: the weight of
its partners that no earlier table has (so that none counts twice) and the smallest class that it reaches in the cell.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their
own component; vectors of other dimensions are no pair; rows of equal vectors link with each other; null ids are kept with null component and without links; other columns
are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import vectors
from lectern.llm.common import Workspace, components

SUBSTRING, MAX_BITS, BLOCK, SAMPLE, ROUNDS = 8, 64, 1_024, 4_000, 30
WIDEST, RECALL, MOST = 24, 0.995, 1024
CLASS = "fp binary, vec_id long, vec array<double>"
LINK = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])


def turned(u: np.ndarray, cosine: float, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and each turned towards another one (that is not as near) until they have this cosine."""
    rng = np.random.default_rng(seed)
    other = u[rng.permutation(len(u))]
    along = (u * other).sum(axis=1, keepdims=True)
    side = other - along * u
    far = (along[:, 0] < cosine) & (np.linalg.norm(side, axis=1) > 1e-9)
    u, side = u[far], side[far]
    return u, cosine * u + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side, axis=1, keepdims=True)


class Codes:
    """Mean and rotations of iterative quantisation, as many as pairs of the cosine need within ``most`` tables.

    ``bits`` is 0 where that is not enough.
    """

    def __init__(self, x: np.ndarray, cosine: float, most: int = MOST, width: int = SUBSTRING, seed: int = 9):
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        self.bits = min(MAX_BITS, x.shape[1])
        self.width = min(width, self.bits)
        self.mean = u.mean(axis=0)
        v = u - self.mean
        _, vectors_ = np.linalg.eigh(v.T @ v)
        axes = vectors_[:, ::-1][:, : self.bits]
        p = v @ axes
        pairs = turned(u, cosine)
        self.maps: list[np.ndarray] = []
        self.tables, self.recall = 0, 0.0
        met = np.zeros(len(pairs[0]), bool)
        while self.recall < RECALL:
            self.maps.append(axes @ self.rotation(p, seed + len(self.maps)))
            self.tables += -(-self.bits // self.width)
            if self.tables > most:
                self.bits, self.tables, self.maps, self.recall = 0, 1, [], 1.0
                return
            met |= (self.code(pairs[0], self.maps[-1]) == self.code(pairs[1], self.maps[-1])).any(axis=1)
            self.recall = float(met.mean()) if len(met) else 1.0

    def rotation(self, p: np.ndarray, seed: int) -> np.ndarray:
        r, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((self.bits, self.bits)))
        for _ in range(ROUNDS):
            s, _, t = np.linalg.svd(np.where(p @ r >= 0, 1.0, -1.0).T @ p)
            r = (s @ t).T
        return r

    def code(self, u: np.ndarray, by: np.ndarray) -> np.ndarray:
        """A rotation's substrings as numbers; the last one ends with the code and may share bits with the one before it."""
        bits = (u - self.mean) @ by >= 0
        starts = [min(k, self.bits - self.width) for k in range(0, self.bits, self.width)]
        return np.stack([bits[:, k : k + self.width] @ (1 << np.arange(self.width)) for k in starts], axis=1).astype("<u4")

    def substrings(self, x: np.ndarray) -> np.ndarray:
        """Codes as numbers, one per table; all zero in the only table where all pairs are compared."""
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.hstack([self.code(u, by) for by in self.maps]) if self.maps else np.zeros((len(x), 1), "<u4")


def smallest(adjacent: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id in each row's component of a symmetric boolean matrix."""
    rank = np.argsort(np.argsort(ids))
    label = rank.copy()
    while True:
        low = np.minimum(label, np.where(adjacent, label[None, :], len(ids)).min(axis=1))
        low = low[np.argsort(rank)[low]]  # follow the label of the label's owner
        if (low == label).all():
            return np.sort(ids)[label]
        label = low


def link_cell(table: int, ids, weights, x, codes, side, across: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(id, partners' weight, root)`` of linked rows in a cell.

    ``side`` is the block, 0 or 1; ``across`` blocks only pairs of both count.  Pairs that share an earlier table's substring are left to it.
    """
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= threshold
    np.fill_diagonal(linked, False)
    if across:
        linked &= side[:, None] != side[None, :]
    if table:
        a, b = np.nonzero(linked)
        for lo in range(0, len(a), 1 << 18):
            i, j = a[lo : lo + (1 << 18)], b[lo : lo + (1 << 18)]
            linked[i, j] = (codes[i, :table] != codes[j, :table]).all(axis=1)
    some = linked.any(axis=1)
    if not some.any():
        return ids[:0], weights[:0], ids[:0]
    linked = linked[some][:, some]
    return ids[some], linked @ weights[some], smallest(linked, ids[some])


def near_duplicates(df: DataFrame, key: str = "vec_id", col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """Rows ``(vec_id, n_links, component_id, kept)``, one per row of the input."""
    usable = F.col(key).isNotNull() & vectors.usable(col)
    parts = [_of_dimension(df.where(usable & (F.size(col) == dim)), key, col, dim, threshold) for dim in vectors.dimensions(df.where(usable), col)]
    rest = df.where(~F.coalesce(usable, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(key).cast("long").alias("component_id"))
    return reduce(DataFrame.unionByName, parts, rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _of_dimension(df: DataFrame, key: str, col: str, dim: int, threshold: float) -> DataFrame:
    """Rows ``(vec_id, n_links, component_id)`` of usable vectors of one dimension."""
    ws = Workspace(df.sparkSession, "op9")
    rows = vectors.rows(df, key, col)

    def fingerprint(batches):
        for batch in batches:
            x = vectors.block(batch.column(1), dim) + 0.0  # -0.0 is 0.0
            fps = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in x]
            yield pa.record_batch([pa.array(fps, pa.binary()), batch.column(0), vectors.lists(x)], names=["fp", "vec_id", "vec"])

    members = ws.save(rows.mapInArrow(fingerprint, CLASS), "members")
    classes = ws.save(members.groupBy("fp").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("vec").alias("vec")), "classes")
    learned = vectors.sample(classes.select("vec"), SAMPLE)
    n = classes.count()
    width = min(WIDEST, max(SUBSTRING, round(np.log2(max(1, n / BLOCK)))))
    codes = Codes(learned if len(learned) else np.array([classes.first()["vec"]]), threshold, min(MOST, -(-n // BLOCK)), width)
    tables = codes.tables
    kind = "float" if dict(df.dtypes)[col] == "array<float>" else "double"  # the index holds vectors as wide as they came

    def keyed(batches):
        for batch in batches:
            ids, weights = batch.column(0), batch.column(1)
            c = codes.substrings(vectors.block(batch.column(2), dim))
            vecs = batch.column(2).cast(pa.list_(pa.float32() if kind == "float" else pa.float64()))
            packed = pa.array([row.tobytes() for row in c], pa.binary())
            for t in range(tables):
                yield pa.record_batch([pa.array(np.full(len(c), t, "i4")), pa.array(c[:, t].astype("i4")), ids, weights, packed, vecs], names=["t", "sub", "id", "weight", "code", "vec"])

    index = classes.select("id", "weight", "vec").mapInArrow(keyed, f"t int, sub int, id long, weight long, code binary, vec array<{kind}>")
    sizes = ws.save(index.groupBy("t", "sub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    own = F.pmod(F.xxhash64("id"), "blocks").cast("int")
    placed = index.join(sizes, ["t", "sub"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = placed.select("t", "sub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "weight", "code", "vec")

    def cell(table: pa.Table) -> pa.Table:
        code = np.frombuffer(b"".join(table["code"].to_pylist()), "<u4").reshape(table.num_rows, -1)
        got = link_cell(table["t"][0].as_py(), table["id"].to_numpy(), table["weight"].to_numpy(), vectors.block(table["vec"], dim), code, table["side"].to_numpy(), table["i"][0].as_py() != table["j"][0].as_py(), threshold)
        return pa.table([pa.array(c) for c in got], schema=LINK)

    found = ws.save(cells.groupBy("t", "sub", "i", "j").applyInArrow(cell, "id long, n long, root long"), "found")
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(ws, found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    groups = classes.select("fp", "id", "weight").join(links, "id", "left").join(roots, "id", "left").select("fp", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("root", "id").alias("root"))
    groups = ws.save(groups, "groups")
    return members.select("vec_id", "fp").join(groups, "fp").select("vec_id", F.col("n").alias("n_links"), F.col("root").alias("component_id"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
        AND list_cosine_similarity(a.e, b.e) >= 0.9),
  r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
  c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id),
  n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
