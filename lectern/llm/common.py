"""Shared plumbing: the cluster's shared folder, materialised cuts, connected components, row keys."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset in local mode one of our own, on a cluster an error."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return "file://" + os.path.join(tempfile.gettempdir(), "lectern-shared")


def fresh(name: str, taken: list[str]) -> str:
    """The name, or with underscores before it as long as it is among those taken (in either case)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def without_names(df: DataFrame, *names: str) -> DataFrame:
    """The table without columns of these names, in whatever case, so that an operator can add its own."""
    lower = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lower])


_held: dict[str, Callable[[], None]] = {}


def claim(owner: str, release: Callable[[], None] = lambda: None) -> None:
    """Called in a task by an operator that keeps a cache in its Python process: those of other operators are released.

    Spark uses a process for one stage after another, so without this the caches of all operators of a job would add up.
    """
    others = [k for k in _held if k != owner]
    for k in others:
        _held.pop(k)()
    _held[owner] = release
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()


class Workspace:
    """A folder of intermediate tables and files under the shared folder.

    ``save`` writes a DataFrame as Parquet and reads it back, which cuts lineage with a copy that
    outlives any executor.  ``drop`` removes tables that no later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(self.path(name))
            at.getFileSystem(conf).delete(at, True)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path behind a URI, usable inside tasks."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def write_file(folder: str, stem: str, chunks) -> str:
    """Write chunks to a new file named after this attempt and return its URI.

    A repeated or speculative task writes another file; readers only open files named in a manifest.
    """
    fs, at = open_fs(folder)
    fs.create_dir(at, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}"
    with fs.open_output_stream(f"{at}/{name}") as out:
        for chunk in chunks:
            out.write(chunk)
    return f"{folder}/{name}"


def read_file(uri: str) -> bytes:
    fs, at = open_fs(uri)
    with fs.open_input_stream(at) as src:
        return src.read()


def slices(batch: pa.RecordBatch, rows: int = 256, budget: int = 4 << 20):
    """Cut a batch into runs of at most ``rows`` rows and, by mean row size, about ``budget`` bytes."""
    n = batch.num_rows
    step = max(1, min(rows, int(n * budget / max(1, batch.nbytes)))) if n else 1
    for at in range(0, n, step):
        yield batch.slice(at, min(step, n - at))


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(*cols: str) -> Column:
    """128 bits that identify a row's content."""
    joined = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols])
    return F.substring(F.sha2(joined, 256), 1, 32)


def components(ws: Workspace, edges: DataFrame, name: str = "cc", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge table ``(a, b)`` of longs: rows ``(id, root)``, root the
    smallest id reachable.  Only nodes with an edge to another node appear.

    Alternates the large-star and small-star steps (Kiveris et al., 2014).  Each step is an equi-join of the
    edge list with its per-node minimum, so no node's neighbourhood is gathered in a task; the minimum is
    pre-aggregated on the map side and the join is a plain shuffle join that AQE can split when a node is hot.
    Each round is written to the shared folder.  Stops when a round leaves the edge list unchanged.
    """

    def directed(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(low, "u")
        if large:
            return directed(out.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        joined = out.select(F.col("v").alias("a"), F.col("m").alias("b"))
        return directed(joined.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))))

    def digest(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40)), F.sum((F.xxhash64("b", "a")) % F.lit(1 << 40))).first()

    cur = ws.save(directed(edges), f"{name}-0")
    seen = digest(cur)
    for k in range(1, rounds + 1):
        nxt = ws.save(star(star(cur, True), False), f"{name}-{k}")
        now = digest(nxt)
        ws.drop(f"{name}-{k - 1}")
        cur = nxt
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return cur.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots)
