"""Vectors that take part in a search or a join, as rows and as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def comparable(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id`` and ``embedding`` of rows that can be compared; singles stay singles, all else is doubles.

    Left out: null ids, null or zero vectors, vectors with null or non-finite components, and those
    whose length is not the most common one (the shorter of equally common ones).
    """
    kind = "array<float>" if dict(df.dtypes)[embedding] == "array<float>" else "array<double>"
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("embedding") == (sizes["d"] if sizes else 0))


def usable(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The rows of ``comparable``; repeated rows once."""
    return comparable(df, vec_id, embedding).dropDuplicates()


def first_by_hash(rows: DataFrame, n: int) -> DataFrame:
    """At most ``n`` rows: the first by a hash of vec_id, then by vec_id. Only hashes travel until the last one is known."""
    key = F.xxhash64("vec_id")
    last = rows.select(key.alias("h")).orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return rows.filter(key <= F.lit(last).cast("long")).orderBy(key, "vec_id").limit(n)


def matrix(column) -> np.ndarray:
    """Rows of a list column as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return stored(column).astype(np.float64, copy=False)


def stored(column) -> np.ndarray:
    """Rows of a list column as a matrix of the numbers as they are stored."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def lists(x: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] if len(x) else 0), pa.array(x.ravel()))


def number(kind: str):
    """The numpy type of the components of a Spark array type."""
    return np.float32 if kind == "array<float>" else np.float64


def places(mask: np.ndarray) -> np.ndarray:
    """Where a long mask with few hits holds: ``mask.nonzero()[0]``, eight entries at a time first."""
    whole = len(mask) // 8 * 8
    words = (mask[:whole].view(np.uint64) != 0).nonzero()[0]
    if 32 * len(words) > whole:
        return mask.nonzero()[0]
    at = (8 * words[:, None] + np.arange(8)).ravel()
    at = at[mask[at]]
    return np.concatenate([at, whole + mask[whole:].nonzero()[0]]) if whole < len(mask) else at
