"""Vector columns as numpy blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(col: str) -> Column:
    """Vectors that take part: not null, not empty, not zero, all components present and finite."""
    c = F.col(col)
    odd = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & ~odd & F.exists(c, lambda x: x != 0)


def dimensions(df: DataFrame, col: str) -> list[int]:
    """The dimensions that a table's usable vectors have, ascending; each is searched on its own, so there should be few."""
    return sorted(r["d"] for r in df.select(F.size(col).alias("d")).distinct().collect())


def rows(df: DataFrame, key: str, col: str) -> DataFrame:
    """Rows ``(vec_id, vec)`` with vectors as doubles."""
    return df.select(F.col(key).cast("long").alias("vec_id"), F.col(col).cast("array<double>").alias("vec"))


def sample(rows: DataFrame, n: int) -> np.ndarray:
    """About ``n`` distinct vectors (never over ``2 n``), chosen by a hash of their content, in a fixed order."""
    total = rows.count()
    slots = 1 << 30
    keep = min(slots, -(-slots * n // max(total, 1)))
    got = rows.select("vec").where(F.pmod(F.xxhash64("vec"), F.lit(slots)) < keep).distinct().limit(2 * n).collect()
    x = np.array(sorted(tuple(r["vec"]) for r in got), "f8")
    return x if len(x) else np.zeros((0, 1))


def block(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column as a matrix."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten(), "f8").reshape(-1, dim)


def lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype="i4")), pa.array(np.ascontiguousarray(x).ravel()))
