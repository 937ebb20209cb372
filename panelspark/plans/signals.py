"""Queries: indicators and candidate selection."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from panelspark.constants import BAR_COLUMNS, MA_WINDOWS, PAD, SECTORS
from panelspark.functions.expr import ratio, rnd
from panelspark.functions.ordered import dealt_by_size, fits_window
from panelspark.operators import indicators as ind, selection as sel
from panelspark.plans import views as v
from panelspark.plans.registry import query
from panelspark.storage import cut_lineage

WIN = ind.series
ROWS = lambda n: f"OVER (PARTITION BY sec ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
SEC = "OVER (PARTITION BY sec ORDER BY dt)"


def ma_sql(w, need, src="prc"):
    return f"CASE WHEN count({src}) {ROWS(w)} >= {need} THEN avg({src}) {ROWS(w)} END"


@query("ma", f"SELECT sec, dt, rnd({ma_sql(30, 7)}, 6) AS ma FROM panel_ret")
def ma(spark, sf):
    return v.panel_ret(spark, sf).select(
        "sec", "dt", rnd(ind.moving_average(F.col("prc"), 30, WIN())).alias("ma"))


@query("ma_slope", f"""
WITH a AS (SELECT sec, dt, {ma_sql(30, 7)} AS ma FROM panel_ret)
SELECT sec, dt, rnd(ma / lag(ma, 5) {SEC} - 1, 6) AS ma_slope FROM a""")
def ma_slope(spark, sf):
    a = v.panel_ret(spark, sf).select("sec", "dt", ind.moving_average(F.col("prc"), 30, WIN()).alias("ma"))
    return a.select("sec", "dt", rnd(ind.change(F.col("ma"), 5, WIN())).alias("ma_slope"))


@query("momentum", f"SELECT sec, dt, rnd(prc / lag(prc, 60) {SEC} - 1, 6) AS mom FROM panel_ret")
def momentum(spark, sf):
    return v.panel_ret(spark, sf).select("sec", "dt", rnd(ind.change(F.col("prc"), 60, WIN())).alias("mom"))


@query("month_end_flag", f"""
SELECT sec, dt, coalesce(date_trunc('month', dt) <> date_trunc('month', lead(dt) {SEC}), true) AS is_month_end
FROM panel""")
def month_end_flag(spark, sf):
    return v.panel(spark, sf).select("sec", "dt", ind.month_end("dt", WIN()).alias("is_month_end"))


DUE = f"(coalesce(date_trunc('month', dt) <> date_trunc('month', lead(dt) {SEC}), true) AND count(ret) {ROWS(250)} >= 60)"


def forecast_sql(fit):
    return f"""
WITH f AS (SELECT sec, dt, CASE WHEN {DUE} THEN {fit} END AS fit FROM panel_ret),
s AS (SELECT sec, dt, lag(fit) {SEC} AS nxt FROM f)
SELECT sec, dt, rnd(last_value(nxt IGNORE NULLS) OVER (PARTITION BY sec ORDER BY dt
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS vol_forecast FROM s"""


def forecast(spark, sf, method):
    df = ind.volatility_forecast(v.panel_ret(spark, sf), method, min_rows=60, max_rows=250)
    return df.select("sec", "dt", rnd("vol_forecast").alias("vol_forecast"))


@query("vol_forecast_rolling", forecast_sql(f"stddev_samp(ret) {ROWS(250)}"))
def vol_forecast_rolling(spark, sf):
    return forecast(spark, sf, "rolling")


@query("vol_forecast_ewma", f"""
WITH e AS (SELECT sec, dt, {DUE} AS due,
             list(ret) FILTER (ret IS NOT NULL) {ROWS(250)} AS rets FROM panel_ret),
f AS (SELECT sec, dt, CASE WHEN due THEN sqrt(list_sum(list_transform(rets,
             lambda x, i: x * x * 0.06E0 * pow(0.94E0, len(rets) - i))) / (1 - pow(0.94E0, len(rets)))) END AS fit FROM e),
s AS (SELECT sec, dt, lag(fit) {SEC} AS nxt FROM f)
SELECT sec, dt, rnd(last_value(nxt IGNORE NULLS) OVER (PARTITION BY sec ORDER BY dt
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS vol_forecast FROM s""")
def vol_forecast_ewma(spark, sf):
    return forecast(spark, sf, "ewma")


@query("vol_forecast_garch")
def vol_forecast_garch(spark, sf):
    return forecast(spark, sf, "garch")


@query("ffill", """
SELECT sec, dt, rnd(last_value(prc IGNORE NULLS) OVER (PARTITION BY sec ORDER BY dt
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS prc_filled FROM panel_ret""")
def ffill(spark, sf):
    return v.panel_ret(spark, sf).select("sec", "dt", rnd(ind.forward_fill(F.col("prc"), WIN())).alias("prc_filled"))


SECTOR_CASE = "CASE left(gics, 2) " + " ".join(f"WHEN '{p}' THEN '{n}'" for n, p, _, _ in SECTORS) + " END"
MA_SETTINGS = [(n, w) for n, _, w, _ in SECTORS]
MOM_SETTINGS = [(n, m) for n, _, _, m in SECTORS]
MA_CASE = "CASE sector " + " ".join(
    f"WHEN '{n}' THEN {ma_sql(w, max(5, w // 4))}" for n, _, w, _ in SECTORS) + " END"
MOM_CASE = "CASE sector " + " ".join(
    f"WHEN '{n}' THEN prc / lag(prc, {m}) {SEC} - 1" for n, _, _, m in SECTORS) + " END"

IND_SQL = f"""
p AS (SELECT *, {SECTOR_CASE} AS sector FROM panel_ret),
i1 AS (SELECT *, {MA_CASE} AS ma, {MOM_CASE} AS mom,
       CASE WHEN {DUE} THEN stddev_samp(ret) {ROWS(250)} END AS fit FROM p),
i2 AS (SELECT *, ma / lag(ma, 5) {SEC} - 1 AS ma_slope, lag(fit) {SEC} AS nxt FROM i1),
i3 AS (SELECT *, last_value(nxt IGNORE NULLS) OVER (PARTITION BY sec ORDER BY dt
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS vol_fc, date_trunc('month', dt) AS mon FROM i2)"""


def sector_name():
    out = None
    for name, prefix, _, _ in SECTORS:
        hit = F.left("gics", F.lit(2)) == prefix
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def indicator_panel(spark, sf):
    p = v.panel_ret(spark, sf).withColumn("sector", sector_name())
    df = ind.indicators(p, MA_SETTINGS, MOM_SETTINGS, 60, 250, sector="sector")
    return df.withColumn("mon", F.trunc("dt", "MM"))


@query("indicators", f"""
WITH {IND_SQL}
SELECT sec, dt, sector, rnd(ma, 6) AS ma, rnd(ma_slope, 6) AS ma_slope, rnd(mom, 6) AS mom,
       rnd(vol_fc, 6) AS vol_fc, year(dt) AS "year", month(dt) AS "month" FROM i3""")
def indicators(spark, sf):
    return indicator_panel(spark, sf).select(
        "sec", "dt", "sector", rnd("ma").alias("ma"), rnd("ma_slope").alias("ma_slope"),
        rnd("mom").alias("mom"), rnd("vol_fc").alias("vol_fc"), "year", "month")


@query("simple_return", f"SELECT sec, dt, rnd(prc / lag(prc) {SEC} - 1, 6) AS ret FROM panel")
def simple_return(spark, sf):
    return v.panel(spark, sf).select("sec", "dt", rnd(ind.change(F.col("prc"), 1, WIN())).alias("ret"))


@query("price_from_returns", f"""
WITH k AS (SELECT sec, dt, ret, row_number() {SEC} AS rn FROM panel_ret WHERE ret IS NOT NULL)
SELECT sec, dt, rnd(100 * product(CASE WHEN rn = 1 THEN 1 ELSE 1 + ret END) OVER (PARTITION BY sec ORDER BY dt
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 5) AS price FROM k""")
def price_from_returns(spark, sf):
    return ind.price_path(v.panel_ret(spark, sf)).select("sec", "dt", rnd("price", 5).alias("price"))


@query("trading_calendar", """
SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS date_idx FROM (SELECT DISTINCT dt FROM panel) d""")
def trading_calendar(spark, sf):
    return ind.trading_calendar(v.panel(spark, sf), "dt")


def bars(spark, sf):
    o = v.bars(spark, sf)
    return o.join(ind.trading_calendar(o, "ym"), "ym")


RANGE = lambda w: f"OVER (PARTITION BY sec ORDER BY date_idx RANGE BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
BSEC = "OVER (PARTITION BY sec ORDER BY date_idx)"


@query("ma_calendar", "SELECT sec, ym, " + ", ".join(
    f"rnd(avg({c}) {RANGE(w)}, 5) AS {c}_ma{w}" for c in BAR_COLUMNS for w in MA_WINDOWS) + " FROM bars")
def ma_calendar(spark, sf):
    return bars(spark, sf).select("sec", "ym", *[
        rnd(ind.calendar_average(F.col(c), w), 5).alias(f"{c}_ma{w}") for c in BAR_COLUMNS for w in MA_WINDOWS])


@query("ma_rows", "SELECT sec, ym, " + ", ".join(
    f"""rnd(CASE WHEN count(*) OVER (PARTITION BY sec ORDER BY date_idx ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) >= {w}
      THEN avg({c}) OVER (PARTITION BY sec ORDER BY date_idx ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) END, 5) AS {c}_ma{w}"""
    for c in BAR_COLUMNS for w in MA_WINDOWS) + " FROM bars")
def ma_rows(spark, sf):
    win = ind.series(order="date_idx")
    return bars(spark, sf).select("sec", "ym", *[
        rnd(ind.row_average(F.col(c), w, win), 5).alias(f"{c}_ma{w}") for c in BAR_COLUMNS for w in MA_WINDOWS])


TOP = lambda c: f"max(CASE WHEN date_idx >= {PAD} THEN {c} END) OVER (PARTITION BY sec)"


@query("max_normalize", "SELECT sec, ym, " + ", ".join(
    f"rnd(CASE WHEN {TOP(c)} > 0 THEN {c} / {TOP(c)} ELSE {c} END, 8) AS {c}_norm" for c in BAR_COLUMNS) + " FROM bars")
def max_normalize(spark, sf):
    whole = Window.partitionBy("sec")
    top = lambda c: F.max(F.when(F.col("date_idx") >= PAD, F.col(c))).over(whole)
    return bars(spark, sf).select("sec", "ym", *[
        rnd(F.when(top(c) > 0, F.col(c) / top(c)).otherwise(F.col(c)), 8).alias(f"{c}_norm") for c in BAR_COLUMNS])


@query("max_normalize_group", """
WITH m AS (SELECT sec, ym, date_idx, close, """ + ", ".join(
    f"""CASE WHEN count(*) OVER (PARTITION BY sec ORDER BY date_idx ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) >= {w}
      THEN avg(close) OVER (PARTITION BY sec ORDER BY date_idx ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) END AS ma{w}"""
    for w in MA_WINDOWS) + """ FROM bars),
t AS (SELECT *, max(CASE WHEN rn > 29 THEN greatest(close, coalesce(ma5, close), coalesce(ma10, close),
        coalesce(ma20, close), coalesce(ma30, close)) END) OVER (PARTITION BY sec) AS top
      FROM (SELECT *, row_number() OVER (PARTITION BY sec ORDER BY date_idx) AS rn FROM m) r)
SELECT sec, ym, """ + ", ".join(
    f"rnd(CASE WHEN top > 0 THEN {c} / top ELSE {c} END, 8) AS {c}_norm" for c in ["close", "ma5", "ma10", "ma20", "ma30"]) + " FROM t")
def max_normalize_group(spark, sf):
    win = ind.series(order="date_idx")
    cols = ["close", *[f"ma{w}" for w in MA_WINDOWS]]
    m = bars(spark, sf).select("sec", "ym", "date_idx", "close", F.row_number().over(win).alias("rn"), *[
        ind.row_average(F.col("close"), w, win).alias(f"ma{w}") for w in MA_WINDOWS])
    peak = F.greatest(*[F.col(c) for c in cols])  # greatest skips NULL
    top = F.max(F.when(F.col("rn") > PAD, peak)).over(Window.partitionBy("sec"))
    return m.select("sec", "ym", *[
        rnd(F.when(top > 0, F.col(c) / top).otherwise(F.col(c)), 8).alias(f"{c}_norm") for c in cols])


DAY_IDX = """d AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS date_idx FROM (SELECT DISTINCT dt FROM panel) q)"""


@query("contiguous_price", f"""
WITH {DAY_IDX}
SELECT p.sec, p.dt, rnd(CASE WHEN d.date_idx - lag(d.date_idx) OVER (PARTITION BY p.sec ORDER BY d.date_idx) = 1
  THEN p.prc END, 6) AS raw_prc FROM panel p JOIN d ON p.dt = d.dt""")
def contiguous_price(spark, sf):
    p = v.stored_panel(spark, sf)
    days = p.join(ind.trading_calendar(p, "dt"), "dt")
    return days.select("sec", "dt", rnd(ind.contiguous(F.col("prc"), ind.series(order="date_idx"))).alias("raw_prc"))


@query("dense_grid", f"""
WITH {DAY_IDX}, n AS (SELECT count(*) AS n FROM d),
g AS (SELECT s.sec, unnest(range(0, (SELECT n FROM n))) AS day FROM (SELECT DISTINCT sec FROM panel) s),
x AS (SELECT p.sec, d.date_idx AS day, p.prc FROM panel p JOIN d ON p.dt = d.dt)
SELECT g.sec, g.day, rnd(x.prc, 6) AS prc FROM g LEFT JOIN x ON g.sec = x.sec AND g.day = x.day""")
def dense_grid(spark, sf):
    p = v.stored_panel(spark, sf)
    calendar = ind.trading_calendar(p, "dt")
    cells = p.join(calendar, "dt").select("sec", F.col("date_idx").alias("day"), "prc")
    grid = ind.dense_grid(cells, calendar.agg(F.count("*").alias("n")), "sec")
    return grid.select("sec", "day", rnd("prc").alias("prc"))


@query("history_filter", """
SELECT sec, dt, rnd(prc, 6) AS prc FROM (
  SELECT *, count(*) OVER (PARTITION BY sec) AS n,
         count(CASE WHEN dt >= DATE '1996-01-01' THEN 1 END) OVER (PARTITION BY sec) AS n_after FROM panel) x
WHERE n >= 30 AND n_after >= 30 AND dt >= DATE '1996-01-01'""")
def history_filter(spark, sf):
    start = F.to_date(F.lit("1996-01-01"))
    return ind.history_filter(v.panel(spark, sf), start, "dt").select("sec", "dt", rnd("prc").alias("prc"))


@query("ma_lag_features", f"""
SELECT sec, dt, rnd(avg(prc) {ROWS(5)}, 6) AS prc_ma5, rnd(coalesce(lag(prc) {SEC}, prc), 6) AS prc_lag1,
       rnd(avg(vol) {ROWS(5)}, 6) AS vol_ma5, coalesce(lag(vol) {SEC}, vol) AS vol_lag1 FROM panel""")
def ma_lag_features(spark, sf):
    mean5 = lambda c: rnd(F.avg(c).over(WIN().rowsBetween(-4, 0)))
    lag1 = lambda c: F.coalesce(F.lag(c).over(WIN()), F.col(c))
    return v.panel(spark, sf).select(
        "sec", "dt", mean5("prc").alias("prc_ma5"), rnd(lag1("prc")).alias("prc_lag1"),
        mean5("vol").alias("vol_ma5"), lag1("vol").alias("vol_lag1"))


def feature_sql(digits=8):
    cols = []
    for c in BAR_COLUMNS:
        for w in MA_WINDOWS:
            cols.append(f"avg({c}) {RANGE(w)} / CASE WHEN {TOP(c)} > 0 THEN {TOP(c)} ELSE 1 END AS {c}_ma{w}")
        cols.append(f"CASE WHEN {TOP(c)} > 0 AND date_idx - lag(date_idx) {BSEC} = 1 THEN {c} / {TOP(c)} END AS {c}_raw")
    return f"""
ok AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY sec) AS n FROM ohlc) q WHERE n >= 30),
cal AS (SELECT ym, row_number() OVER (ORDER BY ym) - 1 AS date_idx FROM (SELECT DISTINCT ym FROM ok) y),
kept AS (SELECT ok.*, cal.date_idx FROM ok JOIN cal ON ok.ym = cal.ym),
fx AS (SELECT sec, date_idx, {", ".join(cols)} FROM kept),
fy AS (SELECT * FROM fx WHERE date_idx >= {PAD}),
grid AS (SELECT s.sec, unnest(range(0, (SELECT count(*) FROM cal) - {PAD})) AS day FROM (SELECT DISTINCT sec FROM fy) s),
feat AS (SELECT g.sec, g.day, {", ".join("fy." + n for n in ind.feature_names())}
         FROM grid g LEFT JOIN fy ON g.sec = fy.sec AND g.day = fy.date_idx - {PAD})"""


FEATURES_SQL = feature_sql()


@query("feature_vector", f"WITH {FEATURES_SQL} SELECT sec, day, " + ", ".join(
    f"rnd({n}, 8) AS {n}" for n in ind.feature_names()) + " FROM feat")
def feature_vector(spark, sf):
    return ind.feature_grid(v.bars(spark, sf)).select(
        "sec", "day", *[rnd(n, 8).alias(n) for n in ind.feature_names()])


BY = ["sector", "mon"]
TIE = ["sec", "dt"]
G = "OVER (PARTITION BY sector, mon)"
SCORE_SQL = f"""{IND_SQL},
k AS (SELECT * FROM i3 WHERE ma IS NOT NULL OR ma_slope IS NOT NULL OR mom IS NOT NULL OR vol_fc IS NOT NULL),
z AS (SELECT *, CASE WHEN count(mom) {G} > 1 THEN coalesce((mom - avg(mom) {G}) / (stddev_samp(mom) {G} + 1e-8), 0) ELSE 0 END AS mom_zscore,
      count(vol_fc) {G} AS nvol,
      CASE WHEN vol_fc IS NOT NULL THEN rank() OVER (PARTITION BY sector, mon ORDER BY vol_fc ASC NULLS LAST)
        + (count(*) OVER (PARTITION BY sector, mon, vol_fc) - 1) / 2.0E0 END AS vrank FROM k),
y AS (SELECT *, CASE WHEN nvol > 1 THEN vrank END AS vol_rank,
      CASE WHEN nvol > 1 THEN coalesce(1.0E0 - (vrank - 1) / (nvol - 1), 0.5E0) ELSE 0.5E0 END AS vol_score,
      coalesce(ma_slope, 0) AS ma_slope_signal FROM z),
c AS (SELECT *, coalesce(0.5E0 * mom_zscore + 0.3E0 * ma_slope_signal + 0.2E0 * vol_score, 0) AS composite_score FROM y)"""


def kept_indicators(spark, sf):
    return indicator_panel(spark, sf).na.drop(how="all", subset=["ma", "ma_slope", "mom", "vol_fc"])


@query("cs_zscore", f"WITH {SCORE_SQL} SELECT sec, dt, sector, mon, rnd(mom_zscore, 6) AS mom_zscore FROM c")
def cs_zscore(spark, sf):
    i = kept_indicators(spark, sf)
    return sel.zscore(i, BY, "mom", "mom_zscore").select("sec", "dt", "sector", "mon", rnd("mom_zscore").alias("mom_zscore"))


@query("cs_rank_score", f"""WITH {SCORE_SQL}
SELECT sec, dt, sector, mon, vol_rank, rnd(vol_score, 6) AS vol_score FROM c""")
def cs_rank_score(spark, sf):
    i = cut_lineage(kept_indicators(spark, sf), "indicators")
    small = fits_window(i, BY)
    return sel.volatility_score(dealt_by_size(i, BY) if small else i, BY, "vol_fc", TIE, stored=True, small=small).select(
        "sec", "dt", "sector", "mon", "vol_rank", rnd("vol_score").alias("vol_score"))


@query("composite_score", f"""WITH {SCORE_SQL}
SELECT sec, dt, sector, mon, rnd(composite_score, 6) AS composite_score FROM c""")
def composite_score(spark, sf):
    return sel.score_universe(indicator_panel(spark, sf), BY, TIE).select(
        "sec", "dt", "sector", "mon", rnd("composite_score").alias("composite_score"))


SELECT_SQL = f"""{SCORE_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY sector, mon ORDER BY round(composite_score, 9) DESC, sec, dt) AS rn,
      count(*) {G} AS n, min(dt) {G} AS selection_date FROM c),
picked AS (
  SELECT *, 'long' AS candidate_type, rn AS selection_rank FROM r WHERE rn <= greatest(1, floor(n * 0.15E0))
  UNION ALL
  SELECT *, 'short' AS candidate_type, rn - n + CAST(greatest(1, floor(n * 0.15E0)) AS BIGINT) AS selection_rank
  FROM r WHERE rn > n - greatest(1, floor(n * 0.15E0)))"""


def candidates(spark, sf):
    scored = sel.score_universe(indicator_panel(spark, sf), BY, TIE)
    return sel.select_candidates(scored, BY, TIE)


@query("select_candidates", f"""WITH {SELECT_SQL}
SELECT sec, dt, sector, candidate_type, selection_rank, selection_date, n AS total_universe, n AS filtered_universe,
       rnd(composite_score, 6) AS composite_score FROM picked""")
def select_candidates(spark, sf):
    return candidates(spark, sf).select(
        "sec", "dt", "sector", "candidate_type", "selection_rank", "selection_date", "total_universe",
        "filtered_universe", rnd("composite_score").alias("composite_score"))


@query("candidate_validation", f"""WITH {SELECT_SQL}
SELECT count(*) AS total_candidates, count(CASE WHEN candidate_type = 'long' THEN 1 END) AS long_candidates,
       count(CASE WHEN candidate_type = 'short' THEN 1 END) AS short_candidates,
       count(DISTINCT selection_date) AS unique_dates, min(selection_date) AS start_date, max(selection_date) AS end_date,
       rnd(avg(composite_score), 6) AS score_mean, rnd(stddev_samp(composite_score), 6) AS score_std,
       rnd(min(composite_score), 6) AS score_min, rnd(max(composite_score), 6) AS score_max,
       CASE WHEN count(*) > 0 THEN 'success' ELSE 'error' END AS status,
       count(CASE WHEN candidate_type = 'long' THEN 1 END) = 0 OR count(CASE WHEN candidate_type = 'short' THEN 1 END) = 0 AS warn_one_sided,
       stddev_samp(composite_score) < 0.01 AS warn_low_dispersion FROM picked""")
def candidate_validation(spark, sf):
    out = sel.candidate_validation(candidates(spark, sf))
    for c in ["score_mean", "score_std", "score_min", "score_max"]:
        out = out.withColumn(c, rnd(c))
    return out
