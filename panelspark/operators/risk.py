"""Risk and turnover reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.functions.expr import bands, month_index, ratio
from panelspark.operators.performance import drawdowns


def position_sets(positions: DataFrame, year="yr", month="mo", side="side", key="company_id") -> DataFrame:
    """Distinct side-tagged positions per month over all sectors."""
    tagged = F.concat(F.when(F.col(side) == "long", "L_").otherwise("S_"), F.col(key))
    held = positions.filter(F.col(key).isNotNull() & (F.col(key) != ""))
    return held.select(year, month, tagged.alias("position")).distinct()


def turnover(sets: DataFrame, year="yr", month="mo") -> DataFrame:
    """Turnover of each month against the previous month present.

    Each position looks at its neighbouring months: it entered where the month before lacks it and
    left where the month after lacks it. One window per position replaces a self-join; a position
    has at most one row per month.
    """
    months = sets.select(year, month).distinct().withColumn(
        "i", F.row_number().over(Window.orderBy(year, month)))
    last = F.max("i").over(Window.partitionBy())
    ordered = months.withColumn("last", last)
    line = Window.partitionBy("position").orderBy("i")
    i = F.col("i")
    marked = sets.join(F.broadcast(ordered), [year, month]).select(
        i, "last", (F.coalesce(F.lag("i").over(line), F.lit(0)) != i - 1).alias("entered"),
        (F.coalesce(F.lead("i").over(line), F.lit(0)) != i + 1).alias("left"))
    size = marked.groupBy("i").agg(F.count("*").alias("total_positions"),
                                   F.sum(F.col("entered").cast("long")).alias("positions_entered"),
                                   F.sum(F.col("left").cast("long")).alias("left"))
    step = Window.orderBy("i")
    full = size.join(F.broadcast(months), "i").select(
        year, month, "i", "total_positions", "positions_entered", F.lag("left").over(step).alias("positions_exited"),
        F.lag("total_positions").over(step).alias("_before"),
        (month_index(F.col(year), F.col(month)) - F.lag(month_index(F.col(year), F.col(month))).over(step)).alias("gap_months"))
    mean = (F.col("total_positions") + F.col("_before")) / 2
    rate = F.coalesce(ratio((F.col("positions_entered") + F.col("positions_exited")).cast("double"), mean), F.lit(0.0))
    return full.filter(F.col("i") > 1).select(
        year, month, "gap_months", "positions_entered", "positions_exited", "total_positions",
        (F.col("positions_entered") - F.col("positions_exited")).alias("net_change"), rate.alias("turnover_rate"))


def turnover_stats(t: DataFrame) -> DataFrame:
    r = "turnover_rate"
    return t.agg(
        F.avg(r).alias("avg_monthly_turnover"), F.median(r).alias("median_monthly_turnover"),
        F.max(r).alias("max_monthly_turnover"), F.min(r).alias("min_monthly_turnover"),
        F.stddev_samp(r).alias("turnover_volatility"), F.avg("total_positions").alias("avg_positions_per_month"),
        (F.avg(r) * 12).alias("annual_turnover"), F.min("total_positions").alias("min_positions"),
        F.max("total_positions").alias("max_positions"))


def turnover_top(t: DataFrame, n: int = 5, year="yr", month="mo") -> DataFrame:
    return t.orderBy(F.col("turnover_rate").desc(), year, month).limit(n)


def risk_metrics(df: DataFrame, date: str, ret: str) -> DataFrame:
    """Risk figures of a monthly series, one row; volatility is the population one."""
    r = F.col(ret)
    known = drawdowns(df.filter(r.isNotNull()), date, ret)
    low = F.when(r < 0, r)
    sd = F.stddev_pop(r)
    return known.agg(
        F.min(r).alias("max_monthly_loss"), (F.min(r) * 100).alias("max_monthly_loss_pct"),
        F.min_by(date, F.struct(r, F.col(date))).alias("max_loss_date"), F.max(r).alias("max_monthly_gain"),
        (F.max(r) * 100).alias("max_monthly_gain_pct"), F.avg(r).alias("mean_monthly_return"),
        sd.alias("monthly_volatility"), (sd * F.sqrt(F.lit(12.0))).alias("annual_volatility"),
        F.coalesce(F.sqrt(F.avg(low * low)), F.lit(0.0)).alias("downside_volatility"),
        F.count(low).alias("negative_months"), (F.count(low) / F.count(r) * 100).alias("negative_months_pct"),
        F.percentile(r, 0.05).alias("var_5pct"), F.percentile(r, 0.01).alias("var_1pct"),
        F.min("drawdown").alias("max_drawdown"), (F.min("drawdown") * 100).alias("max_drawdown_pct"),
        F.coalesce(F.when(sd > 0, F.avg(r) / sd * F.sqrt(F.lit(12.0))), F.lit(0.0)).alias("sharpe_ratio"))


def extreme_months(df: DataFrame, date: str, ret: str, details: list[str]) -> DataFrame:
    """Worst and best month with their details, the earlier month on ties."""
    row = F.struct(F.col(date).alias("month"), F.col(ret).alias("value"), *details)
    known = df.filter(F.col(ret).isNotNull())
    picked = known.agg(F.min_by(row, F.struct(F.col(ret), F.col(date))).alias("worst"),
                       F.min_by(row, F.struct(-F.col(ret), F.col(date))).alias("best"))
    return picked.unpivot([], ["worst", "best"], "kind", "r").select("kind", "r.*")


def loss_stats(df: DataFrame, ret: str) -> DataFrame:
    low = F.when(F.col(ret) < 0, F.col(ret))
    return df.agg(F.count(low).alias("negative_months"), F.avg(low).alias("avg_loss"), F.median(low).alias("median_loss"))


def worst_months(df: DataFrame, date: str, ret: str, n: int = 5) -> DataFrame:
    return df.filter(F.col(ret).isNotNull()).orderBy(F.col(ret).asc(), date).limit(n).select(date, ret)


def drawdown_low(df: DataFrame, date: str) -> DataFrame:
    """The deepest drawdown and its first date; the date only when there was one."""
    low = df.agg(F.min("drawdown").alias("max_drawdown"),
                 F.min_by(date, F.struct("drawdown", date)).alias("_d"))
    return low.select("max_drawdown", F.when(F.col("max_drawdown") < 0, F.col("_d")).alias("max_drawdown_date"))


# Band labels and bounds (fixed values).
RISK_BANDS = [(20.0, "HIGH RISK"), (10.0, "MODERATE-HIGH RISK"), (5.0, "MODERATE RISK")]
TURNOVER_BANDS = [(5.0, "VERY HIGH"), (3.0, "HIGH"), (2.0, "MODERATE")]
TURNOVER_SUMMARY_BANDS = [(4.0, "VERY HIGH"), (2.0, "HIGH")]


def risk_band(loss_pct: Column) -> Column:
    return bands(F.abs(loss_pct), RISK_BANDS, "LOW RISK")


def turnover_band(annual: Column) -> Column:
    return bands(annual, TURNOVER_BANDS, "LOW")


def turnover_summary_band(annual: Column) -> Column:
    return bands(annual, TURNOVER_SUMMARY_BANDS, "MODERATE")


def loss_band(loss: Column) -> Column:
    return F.when(F.abs(loss) < 0.01, "VERY LOW").when(F.abs(loss) < 0.05, "MODERATE").otherwise("HIGH")


def negative_share_band(pct: Column) -> Column:
    return F.when(pct > 50, "HIGH FREQUENCY").otherwise("REASONABLE FREQUENCY")
