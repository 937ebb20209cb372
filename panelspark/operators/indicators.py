"""Per-security indicators. All windows share one partitioning and order, so Spark plans one
exchange and one sort. A series has at most one row per date, which bounds its task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from panelspark.constants import BAR_COLUMNS, MA_WINDOWS, PAD, VOL_MAX_ROWS, VOL_MIN_ROWS
from panelspark.functions.expr import month_of, ratio, same_key


def series(keys: list[str] | str = "sec", order: str = "dt"):
    keys = [keys] if isinstance(keys, str) else keys
    return Window.partitionBy(*keys).orderBy(order)


def running(c: Column, win) -> tuple[Column, Column]:
    """Running sum and count of the finite values; a difference of two gives any trailing window."""
    frame = win.rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(F.abs(c) < float("inf"), c)
    return F.coalesce(F.sum(value).over(frame), F.lit(0.0)), F.count(value).over(frame)


def trailing(total: str, w: int, win) -> Column:
    """What a running total gained over the last ``w`` rows."""
    return F.col(total) - F.coalesce(F.lag(total, w).over(win), F.lit(0))


def moving_average(price: Column, w: int, win, min_rows: int | None = None) -> Column:
    """Mean of the last ``w`` rows once enough of them hold a value."""
    frame = win.rowsBetween(-(w - 1), 0)
    need = max(5, w // 4) if min_rows is None else min_rows
    return F.when(F.count(price).over(frame) >= need, F.avg(price).over(frame))


def change(c: Column, rows: int, win) -> Column:
    """Relative change against the value ``rows`` rows ago; gaps are not filled."""
    return ratio(c, F.lag(c, rows).over(win)) - 1


def month_end(date: str, win) -> Column:
    """True on the last row of a month in the series."""
    month = month_of(F.col(date))
    return F.coalesce(month != F.lead(month).over(win), F.lit(True))


def forward_fill(c: Column, win) -> Column:
    return F.last(c, ignorenulls=True).over(win.rowsBetween(Window.unboundedPreceding, 0))


def with_rolling_volatility(df: DataFrame, ret: str, keys, date: str, min_rows: int, max_rows: int, name: str) -> DataFrame:
    """Sample deviation of the last ``max_rows`` returns on month-end rows with enough of them, else NULL.

    Running sums of the centred returns and their squares replace a frame that is summed anew for
    every row; centring on the series mean keeps the squares small.
    """
    win = series(keys, date)
    whole = Window.partitionBy(*([keys] if isinstance(keys, str) else keys))
    r = F.when(F.abs(F.col(ret)) < float("inf"), F.col(ret))
    centred = df.withColumn("_r", r - F.avg(r).over(whole))
    total, count = running(F.col("_r"), win)
    square, _ = running(F.col("_r") * F.col("_r"), win)
    sums = centred.withColumns({"_s1": total, "_s2": square, "_n": count})
    parts = sums.withColumns({"_w1": trailing("_s1", max_rows, win), "_w2": trailing("_s2", max_rows, win),
                              "_wn": trailing("_n", max_rows, win), "_end": month_end(date, win)})
    n = F.col("_wn")
    spread = F.greatest(F.col("_w2") - F.col("_w1") * F.col("_w1") / n, F.lit(0.0))
    fit = F.when(F.col("_end") & (n >= min_rows), F.sqrt(F.try_divide(spread, n - 1)))
    return parts.withColumn(name, fit).drop("_r", "_s1", "_s2", "_n", "_w1", "_w2", "_wn", "_end")


def ewma_volatility(rets: Column, decay: float = 0.94) -> Column:
    """Exponentially weighted volatility of an array of returns, oldest first."""
    var = F.aggregate(rets, F.lit(0.0), lambda acc, r: acc * decay + r * r * (1 - decay))
    return F.sqrt(var / (1 - F.pow(F.lit(decay), F.size(rets))))


def month_end_returns(df: DataFrame, keys: list[str], date: str, ret: str, min_rows: int, max_rows: int) -> DataFrame:
    """One row per key and month end with enough returns: the trailing returns, oldest first.

    A series is gathered once, one entry per date, and sliced at its month ends only.
    """
    entry = F.struct(F.col(date).alias("d"), F.when(F.abs(F.col(ret)) < float("inf"), F.col(ret)).alias("r"))
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("_all"))
    month = lambda i: F.trunc(F.get("_all", i - 1)["d"], "MM")
    last = lambda i: (i == F.size("_all")) | (month(i) != month(i + 1))
    ends = rows.select(*keys, "_all", F.explode(F.filter(F.sequence(F.lit(1), F.size("_all")), last)).alias("_i"))
    past = F.slice("_all", F.greatest(F.lit(1), F.col("_i") - max_rows + 1), F.least(F.col("_i"), F.lit(max_rows)))
    known = F.transform(F.filter(past, lambda x: x["r"].isNotNull()), lambda x: x["r"])
    return ends.select(*keys, F.get("_all", F.col("_i") - 1)["d"].alias(date), known.alias("_rets")).filter(F.size("_rets") >= min_rows)


def volatility_forecast(df: DataFrame, method: str = "rolling", keys="sec", date: str = "dt",
                        ret: str = "ret", min_rows: int = VOL_MIN_ROWS, max_rows: int = VOL_MAX_ROWS,
                        name: str = "vol_forecast") -> DataFrame:
    """Refit on month-end rows, give the value to the next row, fill until the next refit.

    ``rolling`` differences running sums. ``ewma`` and ``garch`` work on the trailing returns of
    month-end rows, at most ``max_rows`` values, and are joined back.
    """
    keys = [keys] if isinstance(keys, str) else keys
    win = series(keys, date)
    if method == "rolling":
        fitted = with_rolling_volatility(df, ret, keys, date, min_rows, max_rows, "_fit")
    else:
        if method == "ewma":
            fit = ewma_volatility(F.col("_rets"))
        elif method == "garch":
            from panelspark.operators.garch import garch_forecast
            fit = garch_forecast(F.col("_rets"))
        else:
            raise ValueError(f"unknown method {method}")
        ends = month_end_returns(df, keys, date, ret, min_rows, max_rows)
        fitted = same_key(df, ends.select(*keys, date, fit.alias("_fit")), [*keys, date], "left")
    return fitted.withColumn("_next", F.lag("_fit").over(win)).withColumn(
        name, forward_fill(F.col("_next"), win)).drop("_fit", "_next")


def by_sector(sector: Column, settings: list[tuple[str, int]], make) -> Column:
    """Pick ``make(setting)`` by sector; equal settings share one expression."""
    out = None
    for setting in sorted({s for _, s in settings}):
        names = [n for n, s in settings if s == setting]
        hit = sector.isin(names)
        out = F.when(hit, make(setting)) if out is None else out.when(hit, make(setting))
    return out


def moving_average_by_sector(df: DataFrame, price: str, settings: list[tuple[str, int]], sector: str, keys, date: str,
                             name: str) -> DataFrame:
    """Moving average whose row count depends on the row's sector: two running totals, and per setting
    only their values that many rows ago. Centring on the rounded series mean keeps the totals, and so
    their rounding, small."""
    win = series(keys, date)
    whole = Window.partitionBy(*([keys] if isinstance(keys, str) else keys))
    p = F.when(F.abs(F.col(price)) < float("inf"), F.col(price))
    centred = df.withColumn("_mid", F.round(F.avg(p).over(whole))).withColumn("_p", p - F.col("_mid"))
    total, count = running(F.col("_p"), win)
    sums = centred.withColumns({"_ps": total, "_pn": count})
    pick = lambda make: by_sector(F.col(sector), settings, make)
    parts = sums.withColumns({"_ws": pick(lambda w: trailing("_ps", w, win)), "_wn": pick(lambda w: trailing("_pn", w, win))})
    need = pick(lambda w: F.lit(max(5, w // 4)))
    return parts.withColumn(name, F.when(F.col("_wn") >= need, (F.col("_ws") + F.col("_mid") * F.col("_wn")) / F.col("_wn"))).drop(
        "_ps", "_pn", "_ws", "_wn", "_mid", "_p")


def indicators(df: DataFrame, ma_windows, mom_lags, vol_min: int, vol_max: int, keys="sec",
               date: str = "dt", price: str = "prc", ret: str = "ret", sector: str | None = None) -> DataFrame:
    """Moving average, its 5-row slope, momentum and rolling volatility forecast.

    ``ma_windows`` and ``mom_lags`` are numbers, or (sector, number) lists used with ``sector``.
    """
    win = series(keys, date)
    p = F.col(price)
    if sector is None:
        based = df.withColumn("ma", moving_average(p, ma_windows, win))
        mom = change(p, mom_lags, win)
    else:
        based = moving_average_by_sector(df, price, ma_windows, sector, keys, date, "ma")
        mom = by_sector(F.col(sector), mom_lags, lambda n: change(p, n, win))
    first = based.select("*", mom.alias("mom"), change(F.col("ma"), 5, win).alias("ma_slope"))
    first = with_rolling_volatility(first, ret, keys, date, vol_min, vol_max, "_fit")
    second = first.select("*", F.lag("_fit").over(win).alias("_next"))
    return second.select(*df.columns, "ma", "ma_slope", "mom",
                         forward_fill(F.col("_next"), win).alias("vol_fc"),
                         F.year(date).alias("year"), F.month(date).alias("month"))


def price_path(df: DataFrame, ret: str = "ret", keys="sec", date: str = "dt", start: float = 100.0,
               name: str = "price") -> DataFrame:
    """Price rebuilt from the known returns; the first row has the start price."""
    win = series(keys, date)
    known = df.filter(F.col(ret).isNotNull()).withColumn("_rn", F.row_number().over(win))
    step = F.when(F.col("_rn") == 1, F.lit(1.0)).otherwise(1 + F.col(ret))
    path = F.product(step).over(win.rowsBetween(Window.unboundedPreceding, 0))
    return known.withColumn(name, start * path).drop("_rn")


def trading_calendar(df: DataFrame, date: str) -> DataFrame:
    """Distinct dates with a dense index from 0; bounded by the calendar."""
    return df.select(date).distinct().select(
        date, (F.row_number().over(Window.orderBy(date)) - 1).alias("date_idx"))


def calendar_average(c: Column, w: int, keys="sec", idx: str = "date_idx") -> Column:
    """Mean over rows whose calendar index lies less than ``w`` behind."""
    return F.avg(c).over(series(keys, idx).rangeBetween(-(w - 1), 0))


def row_average(c: Column, w: int, win) -> Column:
    """Mean of ``w`` rows, only once ``w`` rows exist."""
    frame = win.rowsBetween(-(w - 1), 0)
    return F.when(F.count(F.lit(1)).over(frame) >= w, F.avg(c).over(frame))


def contiguous(c: Column, win, idx: str = "date_idx") -> Column:
    """Value kept only if the previous row is the previous calendar step."""
    return F.when(F.col(idx) - F.lag(idx).over(win) == 1, c)


def history_filter(df: DataFrame, start, date: str, keys="sec", min_rows: int = 30) -> DataFrame:
    """Series with enough rows before and after the start filter, rows from the start on."""
    keys = [keys] if isinstance(keys, str) else keys
    whole = Window.partitionBy(*keys)
    kept = df.withColumn("_n", F.count(F.lit(1)).over(whole))
    kept = kept.withColumn("_after", F.count(F.when(F.col(date) >= start, 1)).over(whole))
    return kept.filter((F.col("_n") >= min_rows) & (F.col("_after") >= min_rows)
                       & (F.col(date) >= start)).drop("_n", "_after")


def feature_names(columns=BAR_COLUMNS, windows=MA_WINDOWS) -> list[str]:
    return [f"{c}_{s}" for c in columns for s in [*[f"ma{w}" for w in windows], "raw"]]


def bar_features(df: DataFrame, keys: str = "sec", idx: str = "date_idx", pad: int = PAD, tops: dict[str, str] | None = None,
                 begin: Column | None = None) -> DataFrame:
    """25 features per bar from the pad on: calendar means and the contiguous raw value of each
    bar column, divided by that column's maximum.

    ``tops`` names columns that hold the maxima already; rows before ``begin`` (default: the pad) are
    only looked back at.
    """
    win = series(keys, idx)
    whole = Window.partitionBy(keys)
    cols = []
    for c in BAR_COLUMNS:
        v = F.col(c)
        top = F.col(tops[c]) if tops else F.max(F.when(F.col(idx) >= pad, v)).over(whole)
        for w in MA_WINDOWS:
            mean = calendar_average(v, w, keys, idx)
            cols.append(F.when(top > 0, mean / top).otherwise(mean).alias(f"{c}_ma{w}"))
        cols.append(F.when(top > 0, contiguous(v, win, idx) / top).alias(f"{c}_raw"))
    return df.select(keys, idx, *cols).filter(F.col(idx) >= (pad if begin is None else begin))


def dense_grid(cells: DataFrame, n_steps: DataFrame | int, key: str, pad: int = 0, day: str = "day", begin: Column | None = None) -> DataFrame:
    """Every company with every calendar step (from ``begin`` on); absent steps have NULL values.

    Each row also makes the rows of the gap up to the next one, so neither a join nor a second
    read of the input is needed. ``n_steps`` is the calendar length, or has it in its one row and column.
    """
    win = series(key, day)
    last = ((F.lit(n_steps) if isinstance(n_steps, int) else n_steps.scalar()) - 1 - pad).cast("int")
    first = F.when(F.lag(day).over(win).isNull(), F.lit(0) if begin is None else begin).otherwise(F.col(day))
    spans = cells.withColumn("_from", first.cast("int")).withColumn(
        "_to", F.coalesce(F.lead(day).over(win) - 1, last).cast("int"))
    steps = spans.withColumn("_day", F.explode(F.sequence("_from", "_to")))
    own = F.col("_day") == F.col(day)
    values = [F.when(own, F.col(c)).alias(c) for c in cells.columns if c not in (key, day)]
    return steps.select(key, F.col("_day").alias(day), *values)


def feature_grid(bars: DataFrame, start=None, date: str = "ym", keys: str = "sec", pad: int = PAD,
                 min_rows: int = 30) -> DataFrame:
    """Calendar, history rules, features and the dense grid in one plan; absent cells are NULL."""
    whole = Window.partitionBy(keys)
    valid = bars.withColumn("_n", F.count(F.lit(1)).over(whole)).filter(F.col("_n") >= min_rows).drop("_n")
    calendar = trading_calendar(valid, date)
    kept = valid
    if start is not None:
        kept = valid.filter(F.col(date) >= start).withColumn("_n", F.count(F.lit(1)).over(whole))
        kept = kept.filter(F.col("_n") >= min_rows).drop("_n")
    feats = bar_features(kept.join(F.broadcast(calendar), date), keys, "date_idx", pad)
    feats = feats.withColumn("day", F.col("date_idx") - pad).drop("date_idx")
    return dense_grid(feats, calendar.agg(F.count("*").alias("n")), keys, pad)


def latest_grid(bars: DataFrame, days: int, date: str = "ym", keys: str = "sec", pad: int = PAD, min_rows: int = 30) -> DataFrame:
    """The last ``days`` steps of ``feature_grid`` for every security that has a bar among them.

    Maxima and row counts of whole series are one aggregate, which combines before it is exchanged.
    Only the bars of the last ``days`` steps and of the longest average before them move and meet
    window frames. ``bars`` is read several times, so it should be a stored table.
    """
    counts = bars.groupBy(keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_rows).select(keys)
    valid = same_key(bars, counts, [keys], "left_semi")
    dates = sorted(r[0] for r in valid.select(date).distinct().collect())  # the calendar
    n = len(dates)
    calendar = bars.sparkSession.createDataFrame([(d, i) for i, d in enumerate(dates)], StructType([bars.schema[date], StructField("date_idx", IntegerType())]))
    begin = max(0, n - pad - days)  # the first wanted step
    placed = valid.join(F.broadcast(calendar), date)
    tops = placed.filter(F.col("date_idx") >= pad).groupBy(keys).agg(*[F.max(c).alias(f"_top_{c}") for c in BAR_COLUMNS])
    recent = same_key(placed.filter(F.col("date_idx") > begin + pad - max(MA_WINDOWS)), tops, [keys])
    feats = bar_features(recent, keys, "date_idx", pad, {c: f"_top_{c}" for c in BAR_COLUMNS}, F.lit(begin + pad))
    feats = feats.withColumn("day", F.col("date_idx") - pad).drop("date_idx")
    return dense_grid(feats, n, keys, pad, begin=F.lit(begin))
