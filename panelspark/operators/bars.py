"""Price-bar derivation and quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.constants import BAR_SETS, BASE_PRICE
from panelspark.functions.expr import clip, ratio


def derive_bars(df: DataFrame, settings: dict | str = "company", keys="sec", date: str = "dt",
                log_price: str = "prc", ret: str = "stock_ret", turnover: str | None = "turnover_126d",
                noise: Column | None = None) -> DataFrame:
    """Open, high, low, close and volume from a log price, a return and a turnover.

    Open is the previous close moved by the overnight share of the return; high and low widen the
    open-close range, more on the side of the return. ``noise`` is added to the overnight gap.
    """
    s = BAR_SETS[settings] if isinstance(settings, str) else settings
    win = Window.partitionBy(keys).orderBy(date)
    close = BASE_PRICE * F.exp(F.col(log_price) * s["price_scale"])
    r = F.coalesce(F.col(ret), F.lit(0.0))
    gap = r * s["overnight"] + (noise if noise is not None else F.lit(0.0))
    if s["gap_cap"] is not None:
        gap = clip(gap, -s["gap_cap"], s["gap_cap"])
    move = r * s["intraday"]
    width = F.abs(move) * s["vol"]
    if s["vol_floor"] is not None:
        width = F.least(F.greatest(width, F.lit(s["vol_floor"])), F.lit(s["vol_cap"]))
    base = df.select("*", close.alias("close"), move.alias("_move"), width.alias("_width"), gap.alias("_gap"))
    base = base.withColumn("open", F.coalesce(F.lag("close").over(win) * (1 + F.col("_gap")), F.col("close")))
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    up = F.col("_move") >= 0
    full, part = F.col("_width"), F.col("_width") * s["counter"]
    high = F.greatest(top * (1 + F.when(up, full).otherwise(part)), top)
    low = F.least(bottom * (1 - F.when(up, part).otherwise(full)), bottom)
    return base.withColumns({"_h": high, "_l": low}).withColumns({
        "high": F.greatest("_h", "_l"), "low": F.least("_h", "_l"),
        "volume": derive_volume(F.col(ret), F.col(turnover) if turnover else None, s),
    }).drop("_move", "_width", "_gap", "_h", "_l")


def derive_volume(ret: Column, turnover: Column | None, s: dict) -> Column:
    """Whole number from turnover, clipped, and raised with the absolute return."""
    share = s["volume_ret"] if turnover is not None else s.get("volume_ret_alone", s["volume_ret"])
    lift = 1 + F.abs(F.coalesce(ret, F.lit(0.0))) * share
    size = F.lit(s["base_volume"])
    if turnover is not None:
        size = clip(s["base_volume"] * F.exp(turnover * s["volume_scale"]), s["volume_lo"], s["volume_hi"])
    return F.floor(size * lift).cast("bigint")


def violations(o="open", h="high", lo="low", c="close") -> Column:
    """How many of low <= open <= high and low <= close <= high fail in a row."""
    bad = lambda x: (~F.col(x).between(F.col(lo), F.col(h))).cast("int")
    return bad(o) + bad(c)


def bar_stats(df: DataFrame, key="sec", date="ym", given: str | None = "given_ret") -> DataFrame:
    """Price, volume, return and range statistics per company; deviations are population ones."""
    win = Window.partitionBy(key).orderBy(date)
    rows = df.withColumn("_r", ratio(F.col("close"), F.lag("close").over(win)) - 1)
    rows = rows.withColumn("_range", ratio(F.col("high") - F.col("low"), F.col("close")))
    lowest, highest = F.least("open", "high", "low", "close"), F.greatest("open", "high", "low", "close")
    out = rows.groupBy(key).agg(
        F.count("*").alias("total_days"), F.min(date).alias("first_date"), F.max(date).alias("last_date"),
        F.sum(violations()).alias("ohlc_violations"),
        F.min(lowest).alias("min_price"), F.max(highest).alias("max_price"), F.avg("close").alias("mean_close"),
        F.stddev_pop("close").alias("close_volatility"), F.min("volume").alias("min_volume"),
        F.max("volume").alias("max_volume"), F.avg("volume").alias("mean_volume"),
        F.count(F.when(F.col("volume") == 0, 1)).alias("zero_volume_days"),
        F.count("_r").alias("n_returns"), F.avg("_r").alias("mean_return"), F.stddev_pop("_r").alias("return_volatility"),
        F.max("_r").alias("max_daily_return"), F.min("_r").alias("min_daily_return"),
        F.count(F.when(F.abs("_r") > 0.5, 1)).alias("extreme_returns"),
        F.avg("_range").alias("mean_daily_range"), F.max("_range").alias("max_daily_range"),
        F.count(F.when(F.col("_range") == 0, 1)).alias("days_no_range"),
        (F.stddev_pop(given) if given else F.lit(None).cast("double")).alias("given_volatility"))
    kept = F.when(F.col("given_volatility") > 0, F.col("return_volatility") / F.col("given_volatility"))
    return out.withColumn("volatility_preservation", F.when(
        F.col("given_volatility").isNotNull() & (F.col("n_returns") > 0), F.coalesce(kept, F.lit(0.0))))


def warning_list() -> Column:
    n, keep = F.col("total_days"), F.col("volatility_preservation")
    rules = [
        ("negative_prices", F.col("min_price") < 0), ("very_high_prices", F.col("max_price") > 10000),
        ("very_low_prices", F.col("min_price") < 1), ("zero_volume", F.col("zero_volume_days") > n * 0.1),
        ("extreme_returns", F.col("extreme_returns") > F.col("n_returns") * 0.05),
        ("volatility_preservation", (keep < 0.01) | (keep > 100)),
        ("no_range", F.col("days_no_range") > n * 0.2),
    ]
    return F.array_compact(F.array(*[F.when(hit, name) for name, hit in rules]))


def quality(stats: DataFrame) -> DataFrame:
    """Warnings and a score of 100 less 10 per violation and 5 per warning, at least 0."""
    marked = stats.withColumn("warnings", warning_list())
    score = 100 - F.col("ohlc_violations") * 10 - F.size("warnings") * 5
    return marked.withColumn("n_warnings", F.size("warnings")).withColumn(
        "quality_score", F.greatest(F.lit(0), score))


def quality_bands(q: DataFrame) -> DataFrame:
    s = F.col("quality_score")
    part = lambda hit: F.count(F.when(hit, 1))
    good = (s >= 70) & (s < 90)
    return q.agg(F.count("*").alias("companies"), F.avg(s).alias("mean_score"),
                 part(s >= 90).alias("excellent"), part(good).alias("good"), part(s < 70).alias("poor"),
                 (part(s >= 90) / F.count("*") * 100).alias("excellent_pct"),
                 (part(good) / F.count("*") * 100).alias("good_pct"), (part(s < 70) / F.count("*") * 100).alias("poor_pct"),
                 F.sum("ohlc_violations").alias("total_violations"), F.sum("n_warnings").alias("total_warnings"))


def bounds_share(df: DataFrame, key="sec", date="dt") -> DataFrame:
    """Share of prices, volumes and returns within reasonable bounds, annualized mean and volatility."""
    win = Window.partitionBy(key).orderBy(date)
    rows = df.withColumn("_r", ratio(F.col("close"), F.lag("close").over(win)) - 1)
    share = lambda hit: F.avg(hit.cast("double"))
    return rows.agg(
        share(F.col("close").between(5, 500)).alias("price_share"),
        share(F.col("volume").between(1000, 50000000)).alias("volume_share"),
        share(F.abs("_r") <= 0.5).alias("return_share"),
        F.avg("_r").alias("mean_return"), (F.avg("_r") * 252).alias("annual_return"),
        F.stddev_pop("_r").alias("volatility"), (F.stddev_pop("_r") * F.sqrt(F.lit(252.0))).alias("annual_volatility"))
