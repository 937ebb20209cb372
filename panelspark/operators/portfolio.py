"""Point-in-time selection and portfolio construction for all months and sectors in one plan.

Selection keeps at most N longs and M shorts per group through row limits that Spark applies
before the shuffle; later windows only see these few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark import constants as C
from panelspark.functions.expr import month_index, ratio, same_key
from panelspark.storage import cut_lineage


def company_id(gvkey: Column, iid: Column) -> Column:
    """``comp_<gvkey>_<iid>`` without decimal parts; NULL for null-like parts."""
    plain = lambda c: F.replace(c.cast("string"), F.lit(".0"), F.lit(""))
    known = lambda c: c.isNotNull() & ~c.cast("string").isin(C.NULL_LIKE)
    number = plain(gvkey)
    padded = F.when(F.length(number) < 6, F.lpad(number, 6, "0")).otherwise(number)
    return F.when(known(gvkey) & known(iid), F.concat(F.lit("comp_"), padded, F.lit("_"), plain(iid)))


def period_grid(spark, start: str, end: str, sectors: list[str]) -> DataFrame:
    """Every month from start to end with every sector."""
    months = spark.range(1).select(F.explode(F.sequence(
        F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("interval 1 month"))).alias("month_start"))
    return months.select(F.year("month_start").alias("year"), F.month("month_start").alias("month"),
                         F.explode(F.array(*[F.lit(s) for s in sectors])).alias("sector"))


def enough_history(candidates: DataFrame, bars: DataFrame, key: str, month: str = "m", date: str = "dt",
                   years: int = C.HISTORY_YEARS, min_bars: int = C.HISTORY_MIN_BARS) -> DataFrame:
    """Candidates with enough bars in the ``years`` before their month.

    Begin and cutoff lie on month borders, so bars are counted per (security, month) and summed
    by a range window over month numbers; no range join is needed. ``candidates`` is read twice.
    """
    counts = bars.groupBy(key, month_index(F.year(date), F.month(date)).alias("_m")).agg(F.count("*").alias("_n"))
    asked = candidates.select(key, F.col(month).alias("_m")).distinct().withColumn("_n", F.lit(0).cast("long"))
    back = Window.partitionBy(key).orderBy("_m").rangeBetween(-12 * years, -1)
    merged = counts.unionByName(asked).groupBy(key, "_m").agg(F.sum("_n").alias("_n"))
    seen = merged.withColumn("_seen", F.sum("_n").over(back)).filter(F.col("_seen") >= min_bars)
    return candidates.join(seen.select(key, F.col("_m").alias(month)), [key, month], "left_semi")


def as_of_cutoff(candidates: DataFrame, bars: DataFrame, key: str, month_start: str, date: str = "dt",
                 value: str = "prc") -> DataFrame:
    """For each candidate the last bar dated before its month, and the number of such bars.

    Bars and candidates are merged in date order; each candidate reads the state left by the bars.
    """
    events = bars.select(key, F.col(date).alias("_d"), F.col(value).alias("_v"), F.lit(None).cast("date").alias("_ask"))
    asked = candidates.select(key, month_start).distinct().select(
        key, F.date_sub(month_start, 1).alias("_d"), F.lit(None).cast("double").alias("_v"),
        F.col(month_start).alias("_ask"))
    upto = Window.partitionBy(key).orderBy("_d").rangeBetween(Window.unboundedPreceding, 0)
    bar = F.col("_ask").isNull()
    seen = events.unionByName(asked).select(
        key, "_ask", F.max(F.when(bar, F.col("_d"))).over(upto).alias("last_date"),
        F.max_by(F.col("_v"), F.when(bar, F.col("_d"))).over(upto).alias("last_value"),
        F.count(F.when(bar, 1)).over(upto).alias("bars_known"))
    return candidates.join(seen.filter(~bar).withColumnRenamed("_ask", month_start), [key, month_start], "left")


def top_bottom(df: DataFrame, by: list[str], score: str, key: str, n: int, m: int) -> DataFrame:
    """Best ``n`` as longs and worst ``m`` as shorts; when short of rows longs go first.

    Both ends and the group sizes are read separately, so ``df`` should be a stored table.
    """
    best = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(key).asc())
    worst = Window.partitionBy(*by).orderBy(F.col(score).asc(), F.col(key).desc())
    size = df.groupBy(*by).agg(F.count("*").alias("_size"))
    longs = df.withColumn("pos", F.row_number().over(best)).filter(F.col("pos") <= n)
    shorts = df.withColumn("pos", F.row_number().over(worst)).filter(F.col("pos") <= m)
    both = longs.withColumn("side", F.lit("long")).unionByName(shorts.withColumn("side", F.lit("short")))
    room = F.when(F.col("side") == "long", F.lit(n)).otherwise(F.greatest(F.lit(0), F.col("_size") - n))
    return same_key(both, size, by).filter(F.col("pos") <= room).drop("_size")


def minmax(c: Column, win) -> Column:
    """Scaled to [0, 1] within the window; 0 when all values are equal."""
    lo = F.min(c).over(win)
    return F.coalesce(ratio(c - lo, F.max(c).over(win) - lo), F.when(c.isNotNull(), F.lit(0.0)))


def minmax_down(c: Column, win) -> Column:
    hi = F.max(c).over(win)
    return F.coalesce(ratio(hi - c, hi - F.min(c).over(win)), F.when(c.isNotNull(), F.lit(0.0)))


def side_score(c: Column, win) -> Column:
    """Min-max score, inverted for shorts."""
    return F.when(F.col("side") == "long", minmax(c, win)).otherwise(minmax_down(c, win))


def combine_scores(df: DataFrame, by: list[str], algo: str = "algo_score", ml: str = "ml_score",
                   algo_weight: float = C.ALGO_WEIGHT, ml_weight: float = C.ML_WEIGHT) -> DataFrame:
    """Combined score of selected rows that have a prediction. The algo score is scaled over all
    selected rows of a side, the model score over the predicted ones."""
    if abs(algo_weight + ml_weight - 1.0) > 0.01:
        raise ValueError("weights must sum to 1")
    side = Window.partitionBy(*by, "side")
    scaled = df.withColumn("algo_norm", side_score(F.col(algo), side))
    scaled = scaled.filter(F.col(ml).isNotNull()).withColumn("ml_norm", side_score(F.col(ml), side))
    return scaled.withColumn("combined_score", algo_weight * F.col("algo_norm") + ml_weight * F.col("ml_norm"))


def score_weights(df: DataFrame, by: list[str], score: str = "combined_score") -> DataFrame:
    """Longs sum to +1, shorts to -1; equal weights where all scores are 0."""
    side = Window.partitionBy(*by, "side")
    total = F.sum(score).over(side)
    share = F.when(total > 0, F.col(score) / total).otherwise(1.0 / F.count(F.lit(1)).over(side))
    return df.withColumn("weight", F.when(F.col("side") == "long", share).otherwise(-share))


def portfolio_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts, score lists in descending order and weight sums per portfolio.

    The lists hold at most the N longs and M shorts of one portfolio.
    """
    long, short = F.col("side") == "long", F.col("side") == "short"
    scores = lambda hit: F.array_join(F.transform(
        F.sort_array(F.collect_list(F.when(hit, F.round("combined_score", 6))), asc=False),
        lambda x: F.format_number(x, 6)), ",")
    return df.groupBy(*by).agg(
        F.count(F.when(long, 1)).alias("total_long_positions"),
        F.count(F.when(short, 1)).alias("total_short_positions"), F.count("*").alias("total_positions"),
        scores(long).alias("long_combined_scores"), scores(short).alias("short_combined_scores"),
        F.coalesce(F.sum(F.when(long, F.col("weight"))), F.lit(0.0)).alias("long_weights_sum"),
        F.coalesce(F.sum(F.when(short, F.col("weight"))), F.lit(0.0)).alias("short_weights_sum"))


def prediction_stats(df: DataFrame, by: list[str], score: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(score).alias("n"), F.avg(score).alias("mean"),
                               F.stddev_pop(score).alias("std"), F.min(score).alias("lo"),
                               F.max(score).alias("hi"))


def build_portfolios(scored: DataFrame, by: list[str], key: str, n: int, m: int) -> DataFrame:
    """Selection, combined scores and weights for every (month, sector) at once.

    The candidates are stored once; the selection reads them from there.
    """
    picked = top_bottom(cut_lineage(scored, "candidates"), by, "algo_score", key, n, m)
    return score_weights(combine_scores(picked, by), by)


def topk_portfolios(df: DataFrame, by: list[str], score: str, key: str, ks: list[int]) -> DataFrame:
    """Top-K portfolios for several K; weights follow max(score, 0), equal when none is positive."""
    best = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(key).asc())
    top = df.filter(F.col(score).isNotNull()).withColumn("pos", F.row_number().over(best)).filter(F.col("pos") <= max(ks))
    each = top.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter(F.col("pos") <= F.col("k"))
    book = Window.partitionBy(*by, "k")
    gain = F.greatest(F.col(score), F.lit(0.0))
    total = F.sum(gain).over(book)
    return each.withColumn("weight", F.when(total > 0, gain / total).otherwise(1.0 / F.count(F.lit(1)).over(book)))


def cap_weights(df: DataFrame, by: list[str], cap: float = 0.1) -> DataFrame:
    """Cap each position, then scale the portfolio back to 1."""
    capped = F.least(F.col("weight"), F.lit(cap))
    return df.withColumn("capped_weight", ratio(capped, F.sum(capped).over(Window.partitionBy(*by))))
