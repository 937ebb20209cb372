"""Running sums and ranks over ordered groups of any size.

A window with ``partitionBy(month)`` puts a whole cross-section into one task. Here the
rows are range-partitioned by (group, order), so a large group is spread over many tasks.
Each task sums its own slice, and the slice totals - one row per slice and group - give
the offset at which the slice starts. The rows are written once after placement because
both passes must see the same slices. They are also stored before placement, unless the caller
says that they come from a stored table: the range sampling reads them a second time, and a
recomputed row must not move to another slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.functions.expr import same_key, without_nan
from panelspark.storage import cut_lineage

SLICE = "_slice"
GROUP_ROWS = 1_000_000  # largest group that one window task may hold
TASK_ROWS = 200_000  # rows of several groups that one window task should hold


def fits_window(df: DataFrame, by: list[str]) -> bool:
    """Whether every group is small enough for a plain window. Windows and slices give the same values.

    ``df`` should come from a stored table: its groups are counted here.
    """
    largest = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return (largest or 0) <= GROUP_ROWS


def tasks_for(df: DataFrame) -> int:
    """Tasks of about ``TASK_ROWS`` rows of ``df``, at least the session's partitions. ``df``, a stored table, is counted."""
    return max(-(-df.count() // TASK_ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dealt_by_size(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` dealt by ``by`` to as many tasks as its rows ask for, where the session's partitions are too few.

    A window over ``by`` then sorts about ``TASK_ROWS`` rows or a few groups in a task, however many rows there
    are. ``df`` should come from a stored table: it is counted here.
    """
    tasks = tasks_for(df)
    return df.repartition(tasks, *by) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def place(df: DataFrame, by: list[str], order: list[Column], stored: bool = False) -> DataFrame:
    """A table of ``df`` in slices ordered by (group, order), numbered in the column ``SLICE``."""
    if not stored:
        df = cut_lineage(df, "unplaced")
    sliced = df.repartitionByRange(*[F.col(c) for c in by], *order)
    return cut_lineage(sliced.withColumn(SLICE, F.spark_partition_id()), "placed")


def slice_offsets(totals: DataFrame, by: list[str], names: dict[str, str]) -> DataFrame:
    """Sums of the earlier slices of the group; ``names`` maps a total to its offset column."""
    earlier = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("*", *[F.coalesce(F.sum(t).over(earlier), F.lit(0)).alias(o) for t, o in names.items()])


def accumulate(placed: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column],
               totals: dict[str, str] | None = None) -> DataFrame:
    """Inclusive running sums per group over a placed table."""
    keys = [SLICE, *by]
    totals = totals or {}
    parts = placed.groupBy(*keys).agg(*[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
    offsets = slice_offsets(parts, by, {f"_t_{n}": f"_o_{n}" for n in sums}).select(
        *keys, *[f"_o_{n}" for n in sums],
        *[F.sum(f"_t_{n}").over(Window.partitionBy(*by)).alias(c) for n, c in totals.items()])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = placed.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_r_{n}") for n, v in sums.items()])
    return same_key(own, offsets, keys).select(
        *placed.columns, *[(F.col(f"_r_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums], *totals.values())


def running_sums(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column],
                 totals: dict[str, str] | None = None, stored: bool = False) -> DataFrame:
    """Add inclusive running sums of ``sums`` per group ``by`` in ``order``.

    ``order`` must be total within a group; NULL is a group like any other. ``totals`` maps a sum's
    name to a column that gets its group total.
    """
    return accumulate(place(df, by, order, stored), by, order, sums, totals).drop(SLICE)


def with_row_number(df: DataFrame, by: list[str], order: list[Column], name: str,
                    total: str | None = None) -> DataFrame:
    """Row number per group, and the group size when ``total`` is given."""
    return running_sums(df, by, order, {name: F.lit(1).cast("long")},
                        {name: total} if total else None)


def with_average_rank(df: DataFrame, by: list[str], value: str, tie_break: list[str],
                      name: str, count: str, stored: bool = False) -> DataFrame:
    """Ascending rank of ``value`` per group, ties get the mean of their positions.

    NULL values get no rank. ``count`` receives the number of values in the group. Ties are found
    inside each slice. Only a value at a slice border can reach into the next slice; its positions
    follow from the counts at the borders, two small rows per slice and group.
    """
    df = without_nan(df, [value])
    keys = [SLICE, *by]
    valued, x = F.col(value).isNotNull(), F.col(value)
    order = [x.asc_nulls_last(), *[F.col(c).asc() for c in tie_break]]
    placed = place(df, by, order, stored)

    known = placed.filter(valued)
    ends = known.groupBy(*keys).agg(F.min(value).alias("_a"), F.max(value).alias("_b"), F.count("*").alias("_n"))
    ends = slice_offsets(ends, by, {"_n": "_o"})
    border = same_key(known.select(*keys, value), ends, keys).filter((x == F.col("_a")) | (x == F.col("_b")))
    at = border.groupBy(*keys, value, "_a", "_n", "_o").agg(F.count("*").alias("_c"))
    first = F.col("_o") + F.when(x == F.col("_a"), 1).otherwise(F.col("_n") - F.col("_c") + 1)
    across = (
        at.groupBy(*by, value).agg(((F.min(first) + F.max(first + F.col("_c") - 1)) / 2).alias("_across"),
                                   F.count("*").alias("_slices"))
        .filter(F.col("_slices") > 1).drop("_slices")
    )

    numbered = accumulate(placed, by, order, {"_pos": valued.cast("long")}, {"_pos": count})
    peers = Window.partitionBy(*keys).orderBy(order[0]).rangeBetween(Window.currentRow, Window.currentRow)
    local = (F.min("_pos").over(peers) + F.max("_pos").over(peers)) / 2
    return same_key(numbered.withColumn("_local", F.when(valued, local)), across, [*by, value], "left").withColumn(name, F.coalesce("_across", "_local")).select(*df.columns, name, count)
