"""Operator 8: nearest neighbours by inner product through multiprobe p-stable hashing.

Rows are parted by norm into ranges of a factor of the square root of two.  In a range vectors get one more component so that
all have its largest norm; the order by inner product is then the order by distance.  Each of ``TABLES`` tables hashes
with ``HASHES`` Gaussian projections cut into slots.  For a query the projection of a neighbour of inner product ``rho``
(in units of both norms) is normal with mean ``rho`` times the query's plus the filling component's mean share; what the
neighbours' norms leave beside ``rho`` and the filling component's variance make its variance.  That gives every perturbed
bucket a success probability; buckets are visited in descending order of it until their sum reaches ``COVER`` in each
range and table.  Candidates are merged and ranked by the exact inner product.  The inner product that a twentieth
neighbour has is estimated on a bounded sample, by the rank that corresponds to it there.  A range of at most ``FEW`` rows is
one bucket that all queries visit.

Buckets are grouped into cells.  A cell over ``CELL`` rows is split by a hash of the row, and queries are sent to every part of the
cells that they visit.  A task sorts a part's rows by bucket, holds them and lets its queries stream past; a query is multiplied with
the rows of the buckets that it visits and with no others.  Only a part that over ``QUERY_BLOCK`` queries visit is copied, once for each
such block.  So a hot bucket never meets in one task and no candidate pair becomes a row: a part returns at most ``k`` rows per
query.  Queries with fewer than ``k`` candidates are completed by an exact search over all rows, in the same cells.
Where the vectors have several dimensions, each dimension is a search of its own: across them there is no inner product.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids; ties go to
the smaller id; rows that repeat an id count as one candidate (the nearest); other columns are ignored; an empty
table or one without queries gives no row.
"""

from __future__ import annotations

from functools import reduce
from itertools import count
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import vectors
from lectern.llm.common import Workspace, n_parts

TABLES, HASHES, WIDTH, COVER = 2, 4, 1.0, 0.85
REACH = 6  # slots on either side of zero; the outermost ones are open
CELL, QUERY_BLOCK, SAMPLE = 16_384, 65_536, 2_000
RANGES, FEW = 24, 512
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class Hashes:
    """Projections and slots of a range of norms, from a fixed seed.

    ``norm`` is the largest norm, ``rho`` the neighbours' inner product with a unit query in units of it, ``norms`` those of sampled rows.
    """

    def __init__(self, dim: int, norm: float, rho: float, norms: np.ndarray, cover: float = COVER, seed: int = 20):
        rng = np.random.default_rng(seed)
        self.a = rng.standard_normal((TABLES, HASHES, dim + 1))
        self.b = rng.uniform(0, WIDTH, (TABLES, HASHES))
        self.norm, self.rho, self.cover = norm, float(np.clip(rho, 0.0, 0.995)), cover
        r = np.minimum(norms / norm, 1.0)
        r = r[r >= self.rho]  # shorter rows are no neighbours
        r = r if len(r) else np.array([(1 + self.rho) / 2])
        fill = np.sqrt(1 - r * r)
        self.fill, self.rest = fill.mean(), max(0.0, float((r * r).mean()) - self.rho**2)
        self.spread = fill.var()

    def slots(self, x: np.ndarray) -> np.ndarray:
        """Projections in units of the norm, for vectors with the norm-filling component: rows x tables x hashes."""
        u = x / self.norm
        fill = np.sqrt(np.maximum(0, 1 - (u * u).sum(axis=1, keepdims=True)))
        return np.einsum("nd,thd->nth", np.hstack([u, fill]), self.a) + self.b

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Bucket numbers: rows x tables."""
        s = np.clip(np.floor(self.slots(x) / WIDTH), -REACH, REACH - 1).astype("i8") + REACH
        return s @ (2 * REACH) ** np.arange(HASHES)

    def probes(self, q: np.ndarray) -> list[np.ndarray]:
        """For one query and each table the buckets to visit, in descending order of estimated success."""
        unit = np.append(q / np.linalg.norm(q), 0.0)
        out = []
        for t in range(TABLES):
            mean = self.rho * (self.a[t] @ unit) + self.fill * self.a[t][:, -1] + self.b[t]
            sd = np.sqrt(np.maximum(1e-12, self.rest + self.spread * self.a[t][:, -1] ** 2))
            edges = np.arange(-REACH, REACH + 1) * WIDTH
            cdf = normal_cdf((edges[None, :] - mean[:, None]) / sd[:, None])
            cdf[:, 0], cdf[:, -1] = 0.0, 1.0
            share = np.diff(cdf, axis=1)
            prob, number = share[0], np.arange(2 * REACH)
            for j in range(1, HASHES):
                keep = prob > 1e-7
                prob, number = prob[keep], number[keep]
                prob = (prob[:, None] * share[j][None, :]).ravel()
                number = (number[:, None] + (2 * REACH) ** j * np.arange(2 * REACH)[None, :]).ravel()
            order = np.argsort(-prob, kind="stable")
            n = int(np.searchsorted(np.cumsum(prob[order]), self.cover)) + 1
            out.append(number[order[:n]])
        return out


_GRID = np.linspace(-8, 8, 4097)
_CDF = np.array([NormalDist().cdf(v) for v in _GRID])


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return np.interp(z, _GRID, _CDF)


def estimate_product(x: np.ndarray, total: int, k: int) -> float:
    """The low quartile, over sampled vectors as unit queries, of the inner product at the rank that matches the k-th neighbour."""
    if len(x) < 3:
        return 0.0
    s = x[:256] / np.linalg.norm(x[:256], axis=1, keepdims=True) @ x.T
    s[np.arange(len(s)), np.arange(len(s))] = -np.inf
    rank = min(len(x) - 2, max(0, round(k * len(x) / max(total, 1))))
    return float(np.quantile(-np.sort(-s, axis=1)[:, rank], 0.25))


def best(ids: np.ndarray, x: np.ndarray, qid: int, q: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of the candidates (rough > -inf) but the query's own row, by exact products, ties to smaller ids."""
    at = np.nonzero((rough > -np.inf) & (ids != qid))[0]
    if len(at) > k:
        least = -np.partition(-rough[at], k - 1)[k - 1]
        at = at[rough[at] >= least - 1e-9 * max(1.0, abs(least))]
    score = (x[at] * q).sum(axis=1)  # the same order of additions for equal vectors
    order = np.lexsort((ids[at], -score))[:k]
    return ids[at][order], score[order]


class Part:
    """The rows of one part of a cell, sorted by bucket."""

    def __init__(self, ids: np.ndarray, bucket: np.ndarray, x: np.ndarray):
        order = np.argsort(bucket, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.buckets, starts = np.unique(bucket[order], return_index=True)
        self.edges = np.append(starts, len(order))

    def nearest(self, qids: np.ndarray, q: np.ndarray, visited: pa.ListArray, k: int):
        """``(query ids, row ids, scores)`` of each query's k nearest among the rows of its buckets, of all rows where it has no list."""
        n = len(self.ids)
        step = max(1, (1 << 22) // n)
        for lo in range(0, len(qids), step):
            block, lists = q[lo : lo + step], visited.slice(lo, step)
            rough = np.full((len(block), n), -np.inf)
            every = lists.is_null().to_numpy(zero_copy_only=False)
            if every.any():
                rough[every] = block[every] @ self.x.T
            who = np.repeat(np.arange(len(block)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
            wanted = np.asarray(lists.flatten(), "i8")
            at = np.minimum(np.searchsorted(self.buckets, wanted), len(self.buckets) - 1)
            here = self.buckets[at] == wanted
            who, at = who[here], at[here]
            order = np.argsort(at, kind="stable")
            who, at = who[order], at[order]
            cuts = np.append(np.unique(at, return_index=True)[1], len(at)).tolist()
            for i, j in zip(cuts, cuts[1:], strict=False):
                first, last = self.edges[at[i]], self.edges[at[i] + 1]
                rough[who[i:j], first:last] = block[who[i:j]] @ self.x[first:last].T
            for i, row in enumerate(rough):
                got, score = best(self.ids, self.x, qids[lo + i], block[i], row, k)
                if len(got):
                    yield np.full(len(got), qids[lo + i]), got, score


def search(df: DataFrame, key: str = "vec_id", col: str = "embedding", every: int = 20, k: int = 20, cover: float = COVER) -> DataFrame:
    """Rows ``(query_id, rank, vec_id, score)`` for queries whose id is divisible by ``every``."""
    usable = df.where(F.col(key).isNotNull() & vectors.usable(col))
    none = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, [_of_dimension(usable.where(F.size(col) == dim), key, col, dim, every, k, cover) for dim in vectors.dimensions(usable, col)] or [none])


def _of_dimension(df: DataFrame, key: str, col: str, dim: int, every: int, k: int, cover: float) -> DataFrame:
    ws = Workspace(df.sparkSession, "op8")
    rows = vectors.rows(df, key, col)
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    norm2 = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v)
    total, top = rows.agg(F.count_distinct("vec_id"), F.max(norm2)).first()
    low = F.when(norm2 > top / 2 ** (RANGES - 1), F.floor(F.log2(F.lit(top) / norm2))).otherwise(RANGES - 1).cast("int")
    rows = rows.withColumn("range", low)
    ranges = {r["range"]: (r["n"], float(np.sqrt(r["top"])) * (1 + 1e-12)) for r in rows.groupBy("range").agg(F.count("*").alias("n"), F.max(norm2).alias("top")).collect()}
    learned = vectors.sample(rows, SAMPLE)
    least, norms = estimate_product(learned, total, k), np.linalg.norm(learned, axis=1)
    place = np.digitize(norms, [norm for _, norm in sorted(ranges.values(), key=lambda v: v[1])], right=True)
    order_of = {j: i for i, j in enumerate(sorted(ranges, key=lambda j: ranges[j][1]))}
    hashes = {j: Hashes(dim, norm, least / norm, norms[place == order_of[j]], cover) for j, (n, norm) in ranges.items() if n > FEW}
    serial = count()
    groups = {j: max(1, n // CELL) for j, (n, _) in ranges.items()}
    small = np.zeros(1, "i8")

    def group_of(bucket: np.ndarray, j: int) -> np.ndarray:
        return (bucket * 2654435761 % (1 << 32)) % groups[j]

    def index(batches):
        for batch in batches:
            kinds = batch.column(2).to_numpy()
            for j in np.unique(kinds).tolist():
                part = batch.filter(pa.array(kinds == j))
                ids = part.column(0)
                b = hashes[j].buckets(vectors.block(part.column(1), dim)) if j in hashes else np.zeros((len(ids), 1), "i8")
                for t in range(b.shape[1]):
                    yield pa.record_batch([pa.array(np.full(len(ids), j * TABLES + t, "i4")), pa.array(group_of(b[:, t], j)), pa.array(b[:, t]), ids, part.column(1)], names=["t", "g", "bucket", "vec_id", "vec"])

    def probe(batches):
        for batch in batches:
            x, ids = vectors.block(batch.column(1), dim), batch.column(0).to_pylist()
            out: list[tuple] = []
            for qid, q in zip(ids, x, strict=True):
                for j in ranges:
                    for t, visited in enumerate(hashes[j].probes(q) if j in hashes else [small]):
                        g = group_of(visited, j)
                        out += [(j * TABLES + t, int(v), qid, visited[g == v].tolist(), q.tolist()) for v in np.unique(g)]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
            for lo in range(0, len(out), 4096):
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*out[lo : lo + 4096], strict=True), kinds, strict=True)], names=["t", "g", "query_id", "visited", "q"])

    def meet(batches):
        """Rows of a part come first, then its queries."""
        held, at, part = [], None, None

        def found(out):
            return pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=FOUND)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in range(5)], axis=1)
            cuts = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                *cell, side = keys[lo].tolist()
                run = batch.slice(lo, hi - lo)
                if cell != at:
                    held, at, part = [], cell, None
                if not side:
                    held.append(run)
                    continue
                if part is None and held:
                    table = pa.Table.from_batches(held)
                    part, held = Part(table["id"].to_numpy(), table["bucket"].to_numpy(), vectors.block(table["vec"], dim)), []
                if part is not None:
                    out = list(part.nearest(run["id"].to_numpy(), vectors.block(run["vec"], dim), run["visited"], k))
                    if out:
                        yield found(out)

    def in_cells(indexed: DataFrame, probes: DataFrame) -> DataFrame:
        probes = ws.save(probes, f"probes-{(no := next(serial))}")
        visits = probes.groupBy("t", "g").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
        sizes = indexed.groupBy("t", "g").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts")).join(visits, ["t", "g"])
        sizes = ws.save(sizes, f"sizes-{no}")
        block = F.pmod(F.xxhash64("query_id"), "blocks").cast("int")
        left = indexed.join(sizes, ["t", "g"]).select("t", "g", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("qb"), F.lit(0).alias("side"), F.col("vec_id").alias("id"), "bucket", "vec", F.lit(None).cast("array<long>").alias("visited"))
        right = probes.join(sizes, ["t", "g"]).select("t", "g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), block.alias("qb"), F.lit(1).alias("side"), F.col("query_id").alias("id"), F.lit(0).cast("long").alias("bucket"), F.col("q").alias("vec"), "visited")
        on = ["t", "g", "part", "qb"]
        dealt = left.unionByName(right).repartition(n_parts(df.sparkSession), *on).sortWithinPartitions(*on, "side")
        return dealt.mapInArrow(meet, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    indexed = rows.mapInArrow(index, "t int, g long, bucket long, vec_id long, vec array<double>")
    queries = rows.where(is_query)
    found = ws.save(in_cells(indexed, queries.mapInArrow(probe, "t int, g long, query_id long, visited array<long>, q array<double>")), "found")
    short = queries.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("q")).join(found.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < min(k, total - 1))
    short = ws.save(short.select("query_id", "q"), "short")
    if total > 1 and short.head(1):
        cells = [F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda v: F.struct(F.lit(j * TABLES).alias("t"), v.cast("long").alias("g"))) for j, n in groups.items()]
        everywhere = short.select(F.explode(F.concat(*cells)).alias("at"), "query_id", F.lit(None).cast("array<long>").alias("visited"), "q").select("at.t", "at.g", "query_id", "visited", "q")
        found = found.join(short, "query_id", "left_anti").unionByName(in_cells(indexed.where(F.col("t") % TABLES == 0), everywhere))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
