"""Incremental cleaning of arriving panel files against a stored profile.

Row-wise steps are stateless and run in the stream. Month scaling needs the whole month, so the
stream keeps state tables beside the staged rows:

- ``rows``: cleaned rows by (month, batch);
- ``histogram``: per (month, feature) the counts, smallest and largest values of all value buckets up
  to a batch. Counts add and extremes compare, so a batch is merged into the last state of its months
  without their rows;
- ``statistics``: per (month, feature) the median and MAD up to a batch, taken from the histogram and
  the values of the few buckets that can hold them.

A month whose statistics a batch leaves as they were only gets the batch's rows; any other is scaled
again as a whole. Every write replaces the partitions of its own (month, batch) and reads state of
earlier batches only, so a batch that is repeated after a failure writes the same again. State older
than the one a batch started from is removed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from panelspark.functions.expr import same_key
from panelspark.functions.quantile import histogram, median_and_mad
from panelspark.operators import cleaning as cl
from panelspark.sources.tables import read_profile
from panelspark.storage import children, remove


def among(column: Column, values: list) -> Column:
    """Whether ``column`` is one of ``values``, where NULL is a value; prunes partitions."""
    parts = [column.isin([x for x in values if x is not None])] * any(x is not None for x in values)
    return reduce(lambda a, b: a | b, parts + [column.isNull()] * (None in values))


class Table:
    """A state table with partitions (month, batch)."""

    def __init__(self, spark: SparkSession, path: str, month: str):
        self.spark, self.path, self.month = spark, path, month

    def write(self, rows: DataFrame, batch_id: int) -> None:
        (rows.withColumn("batch", F.lit(batch_id)).hint("rebalance", F.col(self.month)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(self.month, "batch").parquet(self.path))

    def read(self, like: DataFrame, months: list | None = None) -> DataFrame:
        """Rows of ``months`` (None: all) with the columns of ``like`` and ``batch``; none if nothing was written yet."""
        if not children(self.spark, self.path):
            return like.withColumn("batch", F.lit(0)).filter("false")
        fields = sorted(like.schema.fields, key=lambda f: f.name == self.month)  # partition columns come last
        rows = self.spark.read.schema(StructType([*fields, StructField("batch", IntegerType())])).parquet(self.path)
        return rows if months is None else rows.filter(among(F.col(self.month), months))

    def last(self, like: DataFrame, months: list, before: int) -> DataFrame:
        """Of each month, the state of its last batch before ``before``."""
        rows = self.read(like, months).filter(F.col("batch") < before)
        newest = rows.groupBy(self.month).agg(F.max("batch").alias("batch"))
        return same_key(rows, newest, [self.month, "batch"], "left_semi").drop("batch")

    def prune(self, batch_id: int) -> None:
        """Keep, of each month, this batch and the last one before it: all that a repeated batch reads."""
        for month in children(self.spark, self.path):
            found = sorted(int(b.rsplit("batch=", 1)[1]) for b in children(self.spark, month) if "batch=" in b)
            for old in [b for b in found if b < batch_id][:-1] if batch_id in found else []:
                remove(self.spark, f"{month}/batch={old}")


def clean_batch(staging: str, out: str, features: list[str], month: str = "mon"):
    """The function for ``foreachBatch``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows, hist, stats, scaled = (Table(spark, p, month) for p in (f"{staging}/rows", f"{staging}/histogram", f"{staging}/statistics", out))
        rows.write(batch, batch_id)
        own = rows.read(batch).filter(F.col("batch") == batch_id).drop("batch")
        touched = [r[0] for r in own.select(month).distinct().collect()]  # months only
        if not touched:
            return
        new = histogram(own, [month], features)
        keys = [month, "feature", "bucket"]
        both = hist.last(new, touched, batch_id).select(new.columns).unionByName(new)
        hist.write(both.groupBy(*keys).agg(F.sum("c").alias("c"), F.min("a").alias("a"), F.max("b").alias("b")), batch_id)
        whole = hist.read(new, touched).filter(F.col("batch") == batch_id).select(new.columns)
        known = rows.read(batch, touched).filter(F.col("batch") <= batch_id).select(batch.columns)
        found = median_and_mad(known, [month], features, whole)
        before = stats.last(found, touched, batch_id).select(found.columns)
        stats.write(found, batch_id)
        now = stats.read(found, touched).filter(F.col("batch") == batch_id).select(found.columns)
        moved = [r[0] for r in now.exceptAll(before).select(month).distinct().collect()]  # months only
        fresh = among(F.col(month), moved) if moved else F.lit(False)
        due = rows.read(batch, touched).filter((F.col("batch") == batch_id) | (fresh & (F.col("batch") < batch_id)))
        result = cl.scaled_by(due, month, features, now)
        (result.hint("rebalance", F.col(month)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(month, "batch").parquet(scaled.path))
        hist.prune(batch_id)
        stats.prune(batch_id)

    return run


def clean_stream(arriving: DataFrame, profile: cl.Profile | str, features: list[str], staging: str, out: str, checkpoint: str,
                 month: str = "mon"):
    """Start the streaming query over all files available now; ``profile`` may be the path of a stored one.

    ``out`` has the panel's columns and ``batch``, the micro-batch that brought the row.
    """
    if isinstance(profile, str):
        profile = cl.to_profile(read_profile(arriving.sparkSession, profile))
    rows = cl.rowwise(arriving, features, profile)
    return (rows.writeStream.foreachBatch(clean_batch(staging, out, features, month))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_arriving(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
