"""Writers for the tables and documents that the engine produces."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, functions as F

from panelspark.constants import MISSING_CELL


def write_partitioned(df: DataFrame, path: str, by=("year", "month")) -> None:
    """Zstd Parquet by partition columns; only the partitions present in ``df`` are replaced.

    The rebalance hint lets adaptive execution split a large month over several tasks and join
    small months into one.
    """
    (df.hint("rebalance", *[F.col(c) for c in by]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("compression", "zstd").partitionBy(*by).parquet(path))


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int) -> DataFrame:
    """A table of ``buckets`` sorted files by the hash of ``keys``, and its scan.

    Rows are dealt to as many tasks as buckets, so a task writes one file. Joins and groups on ``keys``
    need no exchange of such tables. The layout is kept in the session's catalog; the data lie at ``path``.
    """
    name = "bucketed_" + hashlib.md5(path.encode()).hexdigest()
    (df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").option("compression", "zstd").option("path", path)
     .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name))
    return df.sparkSession.table(name)


def write_company_csv(df: DataFrame, path: str, company: str = "company_id") -> None:
    """One folder of CSV per company. A company has at most one row per date.

    Opening files takes longer than filling them, so all of the session's partitions write, however few bytes they hold.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(tasks, company).write.mode("overwrite").partitionBy(company).csv(path, header=True)


#: Where each field of a written position comes from; absent columns are written as NULL.
POSITION_FIELDS = {
    "company_id": ("company_id", "string"), "gvkey": ("gvkey", "bigint"), "iid": ("iid", "string"),
    "algo_score_raw": ("algo_score", "double"), "algo_score_normalized": ("algo_norm", "double"),
    "ml_score_raw": ("ml_score", "double"), "ml_score_normalized": ("ml_norm", "double"),
    "combined_score": ("combined_score", "double"), "candidate_type": ("side", "string"), "portfolio_weight": ("weight", "double"),
}


def portfolio_documents(positions: DataFrame, version: str = "1.0", parameters: dict | None = None) -> DataFrame:
    """One document per year, month and sector with both position lists, score lists, a summary and metadata.

    A document holds one portfolio, whose size the selection bounds. ``parameters`` are written as given.
    """
    if "combined_score" not in positions.columns:
        positions = positions.withColumnRenamed("score", "combined_score")
    long, short = F.col("side") == "long", F.col("side") == "short"
    have = lambda c, t: F.col(c).cast(t) if c in positions.columns else F.lit(None).cast(t)
    item = F.struct(*[have(c, t).alias(n) for n, (c, t) in POSITION_FIELDS.items()])
    listed = lambda hit: F.transform(F.array_sort(F.collect_list(F.when(hit, F.struct(
        (-F.col("combined_score")).alias("o"), F.col("company_id").alias("k"), item.alias("p"))))), lambda x: x["p"])
    scores = lambda hit: F.sort_array(F.collect_list(F.when(hit, F.col("combined_score"))), asc=False)
    given = F.struct(*[F.lit(x).alias(k) for k, x in (parameters or {"weights": "by combined score"}).items()])
    name = F.concat_ws("_", F.lit("portfolio"), F.col("yr").cast("string"), F.lpad(F.col("mo").cast("string"), 2, "0"), "sector")
    return positions.groupBy("yr", "mo", "sector").agg(
        listed(long).alias("long_positions"), listed(short).alias("short_positions"),
        F.struct(F.count(F.when(long, 1)).alias("total_long_positions"), F.count(F.when(short, 1)).alias("total_short_positions"),
                 F.count("*").alias("total_positions"), scores(long).alias("long_combined_scores"),
                 scores(short).alias("short_combined_scores")).alias("summary"),
    ).select(name.alias("doc"), "long_positions", "short_positions", "summary",
             F.struct(F.col("sector"), F.col("yr").alias("target_year"), F.col("mo").alias("target_month"),
                      F.lit(version).alias("pipeline_version"), given.alias("parameters")).alias("metadata"))


def write_portfolios(positions: DataFrame, path: str, parameters: dict | None = None) -> None:
    """Portfolio documents, one folder per document name."""
    portfolio_documents(positions, parameters=parameters).write.mode("overwrite").partitionBy("doc").json(path)


def write_metrics(row: DataFrame, path: str) -> None:
    """A one-row report as a JSON document."""
    row.coalesce(1).write.mode("overwrite").json(path)


def write_profile(rows: DataFrame, path: str) -> None:
    """The profile as one JSON line per feature; one row per feature, so one file."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_text_lines(df: DataFrame, path: str, key: str = "text_id", text: str = "text") -> None:
    """``id<TAB>text`` lines; line breaks and tabs inside a text become blanks, so one record stays one line."""
    line = F.concat_ws("\t", F.col(key).cast("string"), F.regexp_replace(text, "[\\r\\n\\t]+", " "))
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def write_features(grid: DataFrame, calendar: DataFrame, path: str, features: list[str], key: str = "sec") -> None:
    """Dense features with the missing-cell sentinel, the calendar and the company list."""
    cells = [F.coalesce(F.col(c), F.lit(MISSING_CELL)).alias(c) for c in features]
    grid.select(key, "day", *cells).write.mode("overwrite").parquet(f"{path}/features")
    calendar.write.mode("overwrite").parquet(f"{path}/calendar")
    written = grid.sparkSession.read.parquet(f"{path}/features")  # the grid is not computed again
    written.select(key).distinct().write.mode("overwrite").parquet(f"{path}/companies")
