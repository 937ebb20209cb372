"""Scans of the panel, dimension, sector, portfolio, return and filing files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from panelspark.constants import PROFILE_PROBS

SECTORINFO_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("gvkey", T.LongType()), T.StructField("iid", T.StringType()),
    T.StructField("excntry", T.StringType()), T.StructField("gics", T.DoubleType()), T.StructField("sic", T.DoubleType()),
    T.StructField("naics", T.DoubleType()), T.StructField("year", T.ShortType()), T.StructField("month", T.ByteType()),
    T.StructField("date", T.DateType()), T.StructField("eom", T.DateType()),
])

POSITION = T.StructType([
    T.StructField("company_id", T.StringType()), T.StructField("gvkey", T.LongType()), T.StructField("iid", T.StringType()),
    T.StructField("algo_score_raw", T.DoubleType()), T.StructField("algo_score_normalized", T.DoubleType()),
    T.StructField("ml_score_raw", T.DoubleType()), T.StructField("ml_score_normalized", T.DoubleType()),
    T.StructField("combined_score", T.DoubleType()), T.StructField("candidate_type", T.StringType()),
    T.StructField("portfolio_weight", T.DoubleType()),
])
PORTFOLIO_SCHEMA = T.StructType([
    T.StructField("long_positions", T.ArrayType(POSITION)), T.StructField("short_positions", T.ArrayType(POSITION))])


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_panel_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The raw panel under a declared schema."""
    return spark.read.schema(schema).csv(path, header=True)


def read_feature_dim(spark: SparkSession, path: str) -> DataFrame:
    """(feature, theme) in lower case from either accepted layout, empty for any other or a missing file."""
    if path_exists(spark, path):
        df = spark.read.csv(path, header=True)
        if {"Acronym", "Feature"} <= set(df.columns):
            return df.select(F.lower(F.trim("Acronym")).alias("feature"), F.lit("other").alias("theme"))
        if {"feature", "theme"} <= set(df.columns):
            return df.select(F.lower("feature").alias("feature"), F.lower("theme").alias("theme"))
    return spark.createDataFrame([], "feature string, theme string")


def read_sectorinfo(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SECTORINFO_SCHEMA).csv(path, header=True, dateFormat="yyyy-MM-dd")


def parquet_of_csv(spark: SparkSession, csv: str, parquet: str, schema: T.StructType, force: bool = False) -> DataFrame:
    """Convert a CSV once to zstd Parquet and read that afterwards."""
    if force or not path_exists(spark, f"{parquet}/_SUCCESS"):
        spark.read.schema(schema).csv(csv, header=True).write.mode("overwrite").option("compression", "zstd").parquet(parquet)
    return spark.read.parquet(parquet)


def read_month(spark: SparkSession, path: str, year: int, month: int) -> DataFrame:
    """One month of a table partitioned by year and month; only its directory is read."""
    return spark.read.parquet(path).filter((F.col("year") == year) & (F.col("month") == month))


def read_company_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All per-company files, the company taken from the path.

    Spark lists folders in one task each, up to a limit; here a task lists many.
    """
    name = F.regexp_extract(F.col("_metadata.file_path"), r"company_id=([^/]+)/|/(comp_[^/]+)_ohlcv\.csv", 0)
    limit = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(limit)
    spark.conf.set(limit, str(8 * spark.sparkContext.defaultParallelism))
    try:
        df = spark.read.schema(schema).option("recursiveFileLookup", "true").csv(path, header=True)
    finally:
        spark.conf.set(limit, before)
    return df.select("*", F.regexp_replace(name, r"^company_id=|^/|/$|_ohlcv\.csv$", "").alias("company_id"))


def read_portfolios(spark: SparkSession, path: str) -> DataFrame:
    """Positions of all portfolio documents; year, month and sector come from the file or folder name.

    The sector may contain underscores; a name without one is the portfolio of rows without a sector.
    """
    doc = r"portfolio_(\d{4})_(\d{1,2})(?:_([^/]+?))?(?:\.json)?(?:/|$)"
    where = F.col("_metadata.file_path")
    docs = (spark.read.schema(PORTFOLIO_SCHEMA).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
            .select("*", where.alias("p")))
    both = F.concat(
        F.transform(F.coalesce("long_positions", F.array().cast(T.ArrayType(POSITION))), lambda x: F.struct(F.lit("long").alias("side"), x.alias("p"))),
        F.transform(F.coalesce("short_positions", F.array().cast(T.ArrayType(POSITION))), lambda x: F.struct(F.lit("short").alias("side"), x.alias("p"))))
    return docs.select(
        F.regexp_extract("p", doc, 1).cast("int").alias("yr"), F.regexp_extract("p", doc, 2).cast("int").alias("mo"),
        F.nullif(F.regexp_extract("p", doc, 3), F.lit("")).alias("sector"), F.explode(both).alias("x")).select("yr", "mo", "sector", "x.side", "x.p.*")


def read_filings(spark: SparkSession, paths: dict[int, str], years: range) -> DataFrame:
    """Union of the yearly tables in a range; missing years and columns are tolerated."""
    found = [spark.read.parquet(paths[y]).withColumn("yr", F.lit(y)) for y in years if y in paths and path_exists(spark, paths[y])]
    if not found:
        raise FileNotFoundError(f"no filings for {years.start}-{years.stop - 1}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """The stored profile: feature and its statistics."""
    stats = ", ".join(f"{s} double" for s in PROFILE_PROBS)
    return spark.read.schema(f"feature string, {stats}").json(path)


def read_returns(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(date, monthly_return) from the first file that exists and holds a return column.

    The return is ``portfolio_return`` or ``monthly_return``; the date is a column or built from
    year and month.
    """
    for path in paths:
        if not path_exists(spark, path):
            continue
        df = spark.read.csv(path, header=True)
        value = next((c for c in ("portfolio_return", "monthly_return") if c in df.columns), None)
        if value is None:
            continue
        date = F.to_date("date") if "date" in df.columns else F.make_date(F.col("year").cast("int"), F.col("month").cast("int"), F.lit(1))
        return df.select(date.alias("date"), F.expr(f"try_cast(`{value}` AS double)").alias("monthly_return"))
    raise FileNotFoundError(f"no return series among {paths}")
