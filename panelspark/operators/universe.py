"""Sector mapping and universe rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from panelspark.constants import DEFAULT_SECTOR, SECTORS
from panelspark.functions.expr import nan_to_null, ratio
from panelspark.functions.ordered import with_row_number
from panelspark.functions.quantile import exact_quantiles
from panelspark.storage import cut_lineage

SECTOR_SCHEMA = T.StructType([
    T.StructField("sector", T.StringType()), T.StructField("gics_prefix", T.StringType()),
    T.StructField("ma_window", T.IntegerType()), T.StructField("mom_lag", T.IntegerType()),
])


def sector_dim(spark) -> DataFrame:
    """The 11 sectors with code prefix and signal settings."""
    return spark.createDataFrame(SECTORS, SECTOR_SCHEMA)


def drop_invalid(df: DataFrame, keys=("id", "date", "gvkey")) -> DataFrame:
    return df.na.drop(subset=list(keys))


def gics_text(gics: Column) -> Column:
    """Numeric code as text without a decimal part; NULL becomes empty."""
    return F.coalesce(gics.cast("bigint").cast("string"), F.lit(""))


def in_sector(code: Column, prefix: str) -> Column:
    return code.startswith(prefix)


def sector_lookup(info: DataFrame, code: str = "gics_str") -> DataFrame:
    """Sector name and prefix for each row with a known code; the dimension has 11 rows."""
    dim = F.broadcast(sector_dim(info.sparkSession).select(F.col("sector").alias("sector_name"), "gics_prefix"))
    return info.join(dim, F.left(F.col(code), F.lit(2)) == F.col("gics_prefix"))


def keep_sector(panel: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Panel rows whose security is in the sector."""
    return panel.join(ids.select(key).distinct(), key, "left_semi")


def attach_codes(panel: DataFrame, lookup: DataFrame, keys=("id", "date"), value: str = "gics") -> DataFrame:
    """Left join on (security, date); the lookup is made unique first, so rows do not multiply.

    Two tables that ``sinks.write_bucketed`` wrote by ``keys`` with as many buckets meet without an exchange.
    """
    unique = lookup.groupBy(*keys).agg(F.min(value).alias(value))
    return panel.join(unique, list(keys), "left")


def code_counts(info: DataFrame, code: str, top: int = 10) -> DataFrame:
    return info.groupBy(code).agg(F.count("*").alias("n")).orderBy(F.desc("n"), code).limit(top)


def sector_validation(info: DataFrame, panel: DataFrame, prefix: str, key: str, date: str, code: str) -> DataFrame:
    """Coverage report of one sector, one row: its own figures and its share of all panel rows.

    Panel rows are counted per security first, so the join meets one row per security.
    """
    mine = info.filter(in_sector(F.col(code), prefix))
    rows = panel.groupBy(key).agg(F.count("*").alias("_rows"))
    hits = rows.join(mine.select(F.col(key), F.lit(1).alias("_in")).distinct(), key, "left")
    share = hits.agg(F.struct(F.sum(F.when(F.col("_in") == 1, F.col("_rows")).otherwise(0)).alias("hits"), F.sum("_rows").alias("n")).alias("s"))
    return mine.agg(
        F.countDistinct(key).alias("companies"), F.count("*").alias("observations"),
        F.min(date).alias("start_date"), F.max(date).alias("end_date"),
        # the code list of one sector is a short fixed classification
        F.array_join(F.sort_array(F.collect_set(code)), ",").alias("codes"),
    ).select("*", share.scalar()["hits"].alias("covered_rows"),
             ratio(share.scalar()["hits"].cast("double"), share.scalar()["n"].cast("double")).alias("coverage"))


def prepare_panel(raw: DataFrame, keys: list[str], tie_break: list[str], date: str, price: str,
                  others: list[str] = (), numbers: list[str] = ()) -> DataFrame:
    """Numeric, absolute price; rows without keys or price dropped; one row per (keys, date).

    The first row in ``tie_break`` order wins. ``min_by`` combines on the map side, so many
    copies of one key shrink before the shuffle. Prices and ``numbers`` that are no numbers, or NaN,
    are missing.
    """
    num = lambda c: nan_to_null(F.expr(f"try_cast(`{c}` AS double)"))
    rows = raw.withColumns({price: F.abs(num(price)), **{c: num(c) for c in numbers}}).na.drop(subset=[*keys, date, price])
    first = F.min_by(F.struct(price, *others), F.struct(*tie_break))
    return rows.groupBy(*keys, date).agg(first.alias("_r")).select(
        *keys, date, "_r.*", F.year(date).alias("year"), F.month(date).alias("month"))


def rebuild_returns(df: DataFrame, keys: list[str], date: str, price: str, ret: str) -> DataFrame:
    """Replace all returns by price changes when they look mis-scaled.

    Mis-scaled: median of |ret| above 0.5, or its 99% quantile above 5.
    """
    df = cut_lineage(df, "returns")  # the quantile passes and the rebuild read it
    size = df.select(F.abs(F.col(ret)).alias("size"))
    stats = exact_quantiles(size, [], ["size"], {"mid": 0.5, "tail": 0.99}).select(
        ((F.col("mid") > 0.5) | (F.col("tail") > 5)).alias("bad"))
    win = Window.partitionBy(*keys).orderBy(date)
    rebuilt = ratio(F.col(price), F.lag(price).over(win)) - 1
    bad = F.coalesce(stats.scalar(), F.lit(False))
    return df.withColumn("_rebuilt", rebuilt).withColumn(
        ret, F.when(bad, F.col("_rebuilt")).otherwise(F.col(ret))).drop("_rebuilt")


def sector_params(names: DataFrame, sector: str = "sector") -> DataFrame:
    """Signal settings by sector name; unknown names get the default sector's."""
    default = next(s for s in SECTORS if s[0] == DEFAULT_SECTOR)
    dim = F.broadcast(sector_dim(names.sparkSession).withColumnRenamed("sector", "_s"))
    return names.join(dim, F.col(sector) == F.col("_s"), "left").drop("_s").withColumns({
        "gics_prefix": F.coalesce("gics_prefix", F.lit(default[1])),
        "ma_window": F.coalesce("ma_window", F.lit(default[2])),
        "mom_lag": F.coalesce("mom_lag", F.lit(default[3]))})


def sector_members(df: DataFrame, sector: str, key: str) -> DataFrame:
    """Securities of each sector in order, one row each with its position."""
    return with_row_number(df.select(sector, key).distinct(), [sector], [F.col(key).asc()], "position")


def top_by_history(df: DataFrame, key: str, min_rows: int, top: int) -> DataFrame:
    """Most observed securities with at least ``min_rows`` rows."""
    return (df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= min_rows)
            .orderBy(F.desc("n"), key).limit(top))


def calendar_slice(df: DataFrame, date: str, length: int) -> DataFrame:
    """Rows of ``length`` dates from the middle of the calendar, or of the last ones when it is short."""
    days = df.select(date).distinct().select(
        date, (F.row_number().over(Window.orderBy(date)) - 1).alias("i"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    long = F.col("n") > 2 * length
    start = F.when(long, F.floor(F.col("n") / 2)).otherwise(F.greatest(F.lit(0), F.col("n") - length))
    kept = days.filter((F.col("i") >= start) & (F.col("i") < start + length)).select(date)
    return df.join(kept, date, "left_semi")
