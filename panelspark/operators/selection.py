"""Cross-sectional scores and candidate selection per (sector, month).

Where one cross-section is too large for a window task, group statistics are aggregated and joined
back and ranks come from ``functions.ordered``. Otherwise all scores and picks are windows over one
partitioning, so the rows are exchanged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark import constants as C
from panelspark.constants import SIDE_RATIO, W_MOMENTUM, W_TREND, W_VOLATILITY
from panelspark.functions.expr import same_key, without_nan
from panelspark.functions.ordered import dealt_by_size, fits_window, with_average_rank, with_row_number
from panelspark.functions.quantile import exact_quantiles
from panelspark.storage import cut_lineage


def zscore(df: DataFrame, by: list[str], value: str, name: str, small: bool = False) -> DataFrame:
    """(x - mean) / (sample std + 1e-8); 0 for missing values and single-value groups.

    One statistics row per group is joined back, or read from a window if the groups are ``small``;
    NULL is a group, NaN a missing value.
    """
    df = without_nan(df, [value])
    stats = {"_mu": F.avg(value), "_sd": F.stddev_samp(value), "_n": F.count(value)}
    if small:
        known = df.withColumns({n: c.over(Window.partitionBy(*by)) for n, c in stats.items()})
    else:
        known = same_key(df, df.groupBy(*by).agg(*[c.alias(n) for n, c in stats.items()]), by)
    z = (F.col(value) - F.col("_mu")) / (F.col("_sd") + 1e-8)
    return known.withColumn(
        name, F.when(F.col("_n") > 1, F.coalesce(z, F.lit(0.0))).otherwise(0.0)).drop("_mu", "_sd", "_n")


def window_average_rank(df: DataFrame, by: list[str], value: str, name: str, count: str) -> DataFrame:
    """What ``with_average_rank`` gives, by windows over whole groups."""
    df, group = without_nan(df, [value]), Window.partitionBy(*by)
    order = group.orderBy(F.col(value).asc_nulls_last())
    ties = F.count(value).over(order.rangeBetween(Window.currentRow, Window.currentRow))
    rank = F.when(F.col(value).isNotNull(), F.rank().over(order) + (ties - 1) / 2)
    return df.withColumns({name: rank, count: F.count(value).over(group)})


def volatility_score(df: DataFrame, by: list[str], value: str, tie_break: list[str], stored: bool = False, small: bool = False) -> DataFrame:
    """Inverted average rank in [0, 1]; 0.5 where the value is missing or alone."""
    if small:
        ranked = window_average_rank(df, by, value, "vol_rank", "_nvol")
    else:
        ranked = with_average_rank(df, by, value, tie_break, "vol_rank", "_nvol", stored)
    score = 1.0 - (F.col("vol_rank") - 1) / (F.col("_nvol") - 1)
    return ranked.withColumn(
        "vol_score", F.when(F.col("_nvol") > 1, F.coalesce(score, F.lit(0.5))).otherwise(0.5)
    ).withColumn("vol_rank", F.when(F.col("_nvol") > 1, F.col("vol_rank"))).drop("_nvol")


def composite(z: Column, trend: Column, vol: Column) -> Column:
    return F.coalesce(W_MOMENTUM * z + W_TREND * trend + W_VOLATILITY * vol, F.lit(0.0))


def apply_thresholds(df: DataFrame, by: list[str], vol: str = "vol_fc", vol_band: tuple[float, float] | None = None,
                     market_cap: str | None = None, min_market_cap: float = C.MIN_MARKET_CAP,
                     liquidity: str | None = None, min_liquidity: float = C.MIN_LIQUIDITY) -> DataFrame:
    """Optional universe filters, all off by default; rows with a missing value stay.

    ``vol_band`` keeps volatilities between two quantiles of their group, e.g. ``C.VOL_BAND``;
    naming a market-cap or liquidity column turns on its lower bound.
    """
    for column, least in ((market_cap, min_market_cap), (liquidity, min_liquidity)):
        if column:
            df = df.filter(F.col(column).isNull() | (F.col(column) >= least))
    if vol_band:
        df = cut_lineage(df, "thresholds")
        ends = exact_quantiles(df, by, [vol], {"_lo": vol_band[0], "_hi": vol_band[1]}).drop("feature")
        df = same_key(df, ends, by, "left")
        inside = F.col(vol).isNull() | F.col(vol).between(F.col("_lo"), F.col("_hi"))
        df = df.filter(inside).drop("_lo", "_hi")
    return df


def score_universe(ind: DataFrame, by: list[str], tie_break: list[str], ma="ma", slope="ma_slope",
                   mom="mom", vol="vol_fc") -> DataFrame:
    """Rows with any indicator, plus trend, momentum and volatility scores and their composite.

    The indicators are stored first: group statistics and ranks read them several times.
    """
    kept = cut_lineage(without_nan(ind).na.drop(how="all", subset=[ma, slope, mom, vol]), "indicators")
    small = fits_window(kept, by)
    kept = dealt_by_size(kept, by) if small else kept
    kept = zscore(kept, by, mom, "mom_zscore", small)
    kept = volatility_score(kept, by, vol, tie_break, stored=True, small=small)
    trend = F.coalesce(F.col(slope), F.lit(0.0))
    return kept.withColumn("ma_slope_signal", trend).withColumn(
        "composite_score", composite(F.col("mom_zscore"), F.col("ma_slope_signal"), F.col("vol_score")))


def select_candidates(scored: DataFrame, by: list[str], tie_break: list[str], date: str = "dt",
                      top_ratio: float = SIDE_RATIO, bottom_ratio: float = SIDE_RATIO,
                      score: str = "composite_score", digits: int | None = 9) -> DataFrame:
    """Best and worst share of each group, at least one row per side; sides may overlap in tiny groups.

    Scores are compared after rounding to ``digits``, ties go to the smaller ``tie_break``, which with
    ``by`` is a key of the rows.
    """
    key = F.round(score, digits) if digits is not None else F.col(score)
    order = [F.col("_key").desc(), *[F.col(c).asc() for c in tie_break]]
    side = lambda r: F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(float(r))))
    n_top, n_bottom = side(top_ratio), side(bottom_ratio)
    picks = F.array_compact(F.array(
        F.when(F.col("_rn") <= n_top,
               F.struct(F.lit("long").alias("type"), F.col("_rn").alias("rank"))),
        F.when(F.col("_rn") > F.col("_n") - n_bottom,
               F.struct(F.lit("short").alias("type"), (F.col("_rn") - F.col("_n") + n_bottom).alias("rank"))),
    ))
    if fits_window(scored, by):
        group = Window.partitionBy(*by)
        numbered = scored.withColumn("_key", key).withColumns({
            "_rn": F.row_number().over(group.orderBy(*order)), "_n": F.count(F.lit(1)).over(group), "selection_date": F.min(date).over(group)})
        out = numbered.withColumn("_pick", F.explode(picks))
    else:
        # only the key is ranked; the picks, a few rows in ten, fetch the wide row
        narrow = scored.select(*dict.fromkeys([*by, *tie_break]), key.alias("_key"))
        numbered = with_row_number(narrow, by, order, "_rn", "_n").drop("_key")
        first = scored.groupBy(*by).agg(F.min(date).alias("selection_date"))
        out = same_key(scored, numbered.withColumn("_pick", F.explode(picks)), list(dict.fromkeys([*by, *tie_break])))
        out = same_key(out, first, by)
    return out.select(
        *scored.columns, F.col("_pick.type").alias("candidate_type"),
        F.col("_pick.rank").alias("selection_rank"), "selection_date",
        F.col("_n").alias("total_universe"), F.col("_n").alias("filtered_universe"))


def candidate_validation(c: DataFrame, score: str = "composite_score") -> DataFrame:
    """Counts, dates, score statistics and warnings of a candidate table, one row."""
    longs = F.sum((F.col("candidate_type") == "long").cast("long"))
    shorts = F.sum((F.col("candidate_type") == "short").cast("long"))
    out = c.agg(
        F.count("*").alias("total_candidates"), longs.alias("long_candidates"),
        shorts.alias("short_candidates"), F.countDistinct("selection_date").alias("unique_dates"),
        F.min("selection_date").alias("start_date"), F.max("selection_date").alias("end_date"),
        F.avg(score).alias("score_mean"), F.stddev_samp(score).alias("score_std"),
        F.min(score).alias("score_min"), F.max(score).alias("score_max"))
    return out.withColumn("status", F.when(F.col("total_candidates") > 0, "success").otherwise("error")) \
        .withColumn("warn_one_sided", (F.col("long_candidates") == 0) | (F.col("short_candidates") == 0)) \
        .withColumn("warn_low_dispersion", F.col("score_std") < 0.01)
