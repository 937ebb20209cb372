"""Books, realized returns and performance metrics. Return series hold one row per month, so a
window over all of them is bounded by the calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.functions.expr import ratio


def monthly_book(positions: DataFrame, year="yr", month="mo", side="side") -> DataFrame:
    """Positions of all sectors per month, counted by side."""
    return positions.groupBy(year, month).agg(
        F.make_date(F.first(year).cast("int"), F.first(month).cast("int"), F.lit(1)).alias("date"),
        F.count("*").alias("total_positions"), F.count(F.when(F.col(side) == "long", 1)).alias("long_count"),
        F.count(F.when(F.col(side) == "short", 1)).alias("short_count"))


def portfolio_returns(positions: DataFrame, realized: DataFrame, key: str, month: str = "m",
                      ret: str = "r") -> DataFrame:
    """Mean of the weighted long return and the weighted short return, per month.

    A position formed in month m earns the realized return of month m + 1; shorts earn its
    negative. Positions without a realized return are counted apart; a month of such positions only
    has no return.
    """
    nxt = realized.select(key, (F.col(month) - 1).alias(month), F.col(ret).alias("_r"))
    held = positions.join(nxt, [key, month], "left")
    known = F.col("_r").isNotNull()
    w, long = F.when(known, F.abs(F.col("weight"))), F.col("side") == "long"

    def leg(hit, sign):
        return F.coalesce(ratio(F.sum(F.when(hit, w * F.col("_r") * sign)), F.sum(F.when(hit, w))), F.lit(0.0))

    out = held.groupBy(month).agg(leg(long, 1).alias("long_return"), leg(~long, -1).alias("short_return"),
                                  F.count("_r").alias("positions_count"), F.count(F.when(~known, 1)).alias("unpriced_count"))
    return out.withColumn("portfolio_return", F.when(F.col("positions_count") > 0, (F.col("long_return") + F.col("short_return")) / 2))


def _around_zero(c: Column) -> Column:
    return F.abs(c) <= 1e-12


def oos_r2(actual: Column, predicted: Column) -> Column:
    """1 - sum((a - p)^2) / sum(a^2) as an aggregate; 1 or 0 when the divisor is near zero."""
    num, den = F.sum(F.pow(actual - predicted, 2)), F.sum(F.pow(actual, 2))
    edge = F.when(_around_zero(num), 1.0).otherwise(0.0)
    return F.when(F.count(actual) == 0, 0.0).when(_around_zero(den), edge).otherwise(
        F.coalesce(1 - ratio(num, den), F.lit(0.0)))


def drawdowns(df: DataFrame, date: str, ret: str, include_start: bool = False) -> DataFrame:
    """Equity, its running peak and the drawdown per month.

    The peak starts at the first equity value, or at 1 with ``include_start``.
    """
    upto = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    eq = df.withColumn("equity", F.product(1 + F.col(ret)).over(upto))
    peak = F.max("equity").over(upto)
    if include_start:
        peak = F.greatest(peak, F.lit(1.0))
    return eq.withColumn("peak", peak).withColumn("drawdown", (F.col("equity") - F.col("peak")) / F.col("peak"))


METRICS = [
    "avg_monthly_return", "avg_annual_return", "total_return", "monthly_volatility", "annual_volatility",
    "sharpe_ratio", "information_ratio", "tracking_error", "oos_r2_vs_bench", "oos_r2_excess_returns",
    "bench_avg_monthly_return", "bench_avg_annual_return", "bench_annual_volatility", "bench_total_return",
    "monthly_alpha", "annual_alpha", "win_rate", "months_tracked", "max_monthly_return",
    "min_monthly_return", "max_drawdown",
]


def performance_metrics(df: DataFrame, date: str, ret: str, bench: str) -> DataFrame:
    """All metrics of a return series next to a benchmark, one row. Standard deviations are sample ones."""
    whole = Window.partitionBy()
    joined = drawdowns(df.filter(F.col(ret).isNotNull() & F.col(bench).isNotNull()), date, ret)
    p, b = F.col(ret), F.col(bench)
    joined = joined.withColumn("_x", p - b)
    joined = joined.withColumn("_mx", F.avg("_x").over(whole))
    x, year = F.col("_x"), F.sqrt(F.lit(12.0))
    per_risk = lambda c: F.coalesce(
        F.when(F.stddev_samp(c) > 0, F.avg(c) / F.stddev_samp(c) * year), F.lit(0.0))
    return joined.agg(
        F.avg(p).alias("avg_monthly_return"), (F.avg(p) * 12).alias("avg_annual_return"),
        (F.product(1 + p) - 1).alias("total_return"), F.stddev_samp(p).alias("monthly_volatility"),
        (F.stddev_samp(p) * year).alias("annual_volatility"), per_risk(p).alias("sharpe_ratio"),
        per_risk(x).alias("information_ratio"), (F.stddev_samp(x) * year).alias("tracking_error"),
        oos_r2(p, b).alias("oos_r2_vs_bench"), oos_r2(x, F.col("_mx")).alias("oos_r2_excess_returns"),
        F.avg(b).alias("bench_avg_monthly_return"), (F.avg(b) * 12).alias("bench_avg_annual_return"),
        (F.stddev_samp(b) * year).alias("bench_annual_volatility"), (F.product(1 + b) - 1).alias("bench_total_return"),
        F.avg(x).alias("monthly_alpha"), (F.avg(x) * 12).alias("annual_alpha"),
        F.avg((p > 0).cast("double")).alias("win_rate"), F.count(p).cast("double").alias("months_tracked"),
        F.max(p).alias("max_monthly_return"), F.min(p).alias("min_monthly_return"),
        F.min("drawdown").alias("max_drawdown"))


def metrics_long(metrics: DataFrame) -> DataFrame:
    return metrics.unpivot([], metrics.columns, "metric", "value")
