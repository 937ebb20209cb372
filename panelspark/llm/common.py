"""Shared helpers: Arrow batches of texts, 64-bit hashing in numpy, and connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType

from panelspark.storage import cut_lineage

M1, M2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9  # odd multipliers of 64-bit mixing


def typed(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Only the two named columns, as ``doc_id`` long and ``text`` string."""
    return df.select(F.col(id_column).cast(LongType()).alias("doc_id"), F.col(text_column).cast(StringType()).alias("text"))


def text_key(text: str = "text") -> list[Column]:
    """Two independent 64-bit hashes of a text; with the doc_id they name a row's content."""
    return [F.xxhash64(F.col(text), F.lit(i)).alias(f"_k{i}") for i in (1, 2)]


def slices(batches, column: str, limit: int):
    """Cut Arrow batches into runs of rows with about ``limit`` bytes in ``column``, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)


def raw_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column end to end, and each row's start (one more than rows); null is empty."""
    flat = array.cast(pa.large_binary())
    flat = pc.fill_null(flat, b"") if flat.null_count else flat
    starts = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = flat.buffers()[2]
    data = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, starts - starts[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(M2)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-sensitive hash of two hashes."""
    return mix(a * np.uint64(M1) + b)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start, byte end and row of every word ``[^\\x20\\x09-\\x0D]+``."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~SPACE[data]
    inner = starts[(starts > 0) & (starts < len(data))]
    edge = solid[1:] != solid[:-1]
    a, b = np.flatnonzero(edge[:-1] & solid[1:-1]), np.flatnonzero(edge[1:] & solid[1:-1]) + 1
    crossing = inner[solid[inner] & solid[inner + 1]]  # rows that touch without space between them
    if len(crossing):
        crossing = crossing[np.append(True, crossing[1:] != crossing[:-1])]
        a, b = np.sort(np.concatenate([a, crossing])), np.sort(np.concatenate([b, crossing]))
    return a, b, np.searchsorted(starts, a, side="right") - 1


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, from eight-byte blocks; length is part of it."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    view = np.ndarray((len(data) + 8,), np.uint64, buffer=padded.data, strides=(1,))
    size = end - begin
    h = mix(size.astype(np.uint64) * np.uint64(M1) + np.uint64(1))
    todo, at = np.arange(len(begin)), begin.astype(np.int64)
    while len(todo):
        left = end[todo] - at
        block = view[at]
        short = np.flatnonzero(left < 8)
        block[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        h[todo] = combine(h[todo], block)
        more = left > 8
        todo, at = todo[more], at[more] + 8
    return h


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive hashes (shorter result by width - 1)."""
    out = np.full(max(0, len(hashes) - width + 1), np.uint64(width))
    for i in range(width):
        out = combine(out, hashes[i : len(hashes) - width + 1 + i])
    return out


def is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every ``u`` has one ``v`` and no ``v`` is a ``u``."""
    degree = edges.groupBy("u").agg(F.count("*").alias("n"))
    centres = edges.select(F.col("v").alias("u"), F.lit(1).alias("centre")).distinct()
    return degree.join(centres, "u", "left").filter("n > 1 OR centre = 1").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest id reachable from every id named by an edge: columns ``node``, ``root``.

    Alternating large-star and small-star steps, until all edges lead to roots. Every round is
    written as a table. A hub's edges are only ever aggregated, never gathered.
    """
    def pairs(df, x, y):
        return df.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).filter("u > v").distinct()

    current = cut_lineage(pairs(edges, a, b), "edges")
    while not is_forest_of_stars(current):
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # greater neighbours go to the least one; a node itself keeps its link to that one
        large = both.join(low, "u").select(F.when(F.col("v") > F.col("u"), F.col("v")).otherwise(F.col("u")).alias("v"), "m")
        large = cut_lineage(pairs(large, "v", "m"), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        current = cut_lineage(pairs(large.join(low, "u").select("v", "m").union(low.select("u", "m")), "v", "m"), "small")
    roots = current.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
