"""Queries: price bars, model input, scoring and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.constants import BAR_SETS, PREDICTION_EDGES
from panelspark.functions.expr import rnd
from panelspark.operators import bars as ba, indicators as ind, modelprep as mp
from panelspark.plans import views as v
from panelspark.plans.registry import query
from panelspark.plans.signals import FEATURES_SQL, SECTOR_CASE, sector_name
from panelspark.storage import cut_lineage

# ---- bars ----

LOG_SQL = """
lp AS (SELECT sec, dt, ln(prc) - 7 AS prc, prc / lag(prc) OVER (PARTITION BY sec ORDER BY dt) - 1 AS stock_ret,
  ln(vol) - 3 AS turnover_126d FROM panel)"""


def log_panel(spark, sf):
    p = v.panel(spark, sf)
    return p.select("sec", "dt", (F.log("prc") - 7).alias("prc"), ind.change(F.col("prc"), 1, ind.series()).alias("stock_ret"),
                    (F.log("vol") - 3).alias("turnover_126d"))


def bars_sql(name):
    s = BAR_SETS[name]
    gap = f"coalesce(stock_ret, 0) * {s['overnight']}E0"
    if s["gap_cap"] is not None:
        gap = f"greatest(-{s['gap_cap']}E0, least({s['gap_cap']}E0, {gap}))"
    width = f"abs(coalesce(stock_ret, 0) * {s['intraday']}E0) * {s['vol']}E0"
    if s["vol_floor"] is not None:
        width = f"least(greatest({width}, {s['vol_floor']}E0), {s['vol_cap']}E0)"
    return f"""{LOG_SQL},
b1 AS (SELECT *, 50 * exp(prc * {s['price_scale']}E0) AS close, {gap} AS gap, {width} AS width, coalesce(stock_ret, 0) >= 0 AS up,
  CAST(floor(greatest({s['volume_lo']}E0, least({s['volume_hi']}E0, {s['base_volume']}E0 * exp(turnover_126d * {s['volume_scale']}E0)))
    * (1 + abs(coalesce(stock_ret, 0)) * {s['volume_ret']}E0)) AS BIGINT) AS volume FROM lp),
b2 AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY sec ORDER BY dt) * (1 + gap), close) AS open FROM b1),
b3 AS (SELECT *, greatest(open, close) * (1 + CASE WHEN up THEN width ELSE width * {s['counter']}E0 END) AS h,
  least(open, close) * (1 - CASE WHEN up THEN width * {s['counter']}E0 ELSE width END) AS l FROM b2),
b4 AS (SELECT sec, dt, open, close, greatest(h, open, close) AS high, least(l, open, close) AS low, volume FROM b3)"""


@query("ohlc_derive", f"WITH {bars_sql('company')} SELECT sec, dt, rnd(open, 4) AS open, rnd(high, 4) AS high, rnd(low, 4) AS low, rnd(close, 4) AS close FROM b4")
def ohlc_derive(spark, sf):
    return ba.derive_bars(log_panel(spark, sf), "company").select("sec", "dt", *[rnd(c, 4).alias(c) for c in ["open", "high", "low", "close"]])


@query("ohlc_derive_sets", " UNION ALL ".join(
    f"SELECT * FROM (WITH {bars_sql(n)} SELECT '{n}' AS bar_set, sec, dt, rnd(open, 4) AS open, rnd(high, 4) AS high, rnd(low, 4) AS low, rnd(close, 4) AS close, volume FROM b4) t{i}"
    for i, n in enumerate(["transform", "improved"])))
def ohlc_derive_sets(spark, sf):
    parts = [ba.derive_bars(log_panel(spark, sf), n).select(
        F.lit(n).alias("bar_set"), "sec", "dt", *[rnd(c, 4).alias(c) for c in ["open", "high", "low", "close"]], "volume")
        for n in ["transform", "improved"]]
    return parts[0].unionByName(parts[1])


@query("volume_derive", f"WITH {bars_sql('company')} SELECT sec, dt, volume FROM b4")
def volume_derive(spark, sf):
    return ba.derive_bars(log_panel(spark, sf), "company").select("sec", "dt", "volume")


Q_SQL = """
qb AS (SELECT sec, ym, open, CASE WHEN (sec + ym) % 17 = 0 THEN low ELSE high END AS high, low, close,
  CASE WHEN (sec + ym) % 7 = 0 THEN 0 ELSE volume END AS volume, close / open - 1 AS given_ret FROM ohlc),
qr AS (SELECT *, close / lag(close) OVER (PARTITION BY sec ORDER BY ym) - 1 AS r, (high - low) / close AS rg,
  CASE WHEN open BETWEEN low AND high THEN 0 ELSE 1 END + CASE WHEN close BETWEEN low AND high THEN 0 ELSE 1 END AS viol FROM qb),
qs AS (SELECT sec, count(*) AS total_days, min(ym) AS first_date, max(ym) AS last_date, sum(viol) AS ohlc_violations,
  min(least(open, high, low, close)) AS min_price, max(greatest(open, high, low, close)) AS max_price, avg(close) AS mean_close,
  stddev_pop(close) AS close_volatility, min(volume) AS min_volume, max(volume) AS max_volume, avg(volume) AS mean_volume,
  count(CASE WHEN volume = 0 THEN 1 END) AS zero_volume_days, count(r) AS n_returns, avg(r) AS mean_return, stddev_pop(r) AS return_volatility,
  max(r) AS max_daily_return, min(r) AS min_daily_return, count(CASE WHEN abs(r) > 0.5 THEN 1 END) AS extreme_returns,
  avg(rg) AS mean_daily_range, max(rg) AS max_daily_range, count(CASE WHEN rg = 0 THEN 1 END) AS days_no_range,
  CASE WHEN count(r) > 0 THEN coalesce(stddev_pop(r) / nullif(stddev_pop(given_ret), 0), 0) END AS volatility_preservation FROM qr GROUP BY sec),
qw AS (SELECT *, concat_ws(',', CASE WHEN min_price < 0 THEN 'negative_prices' END, CASE WHEN max_price > 10000 THEN 'very_high_prices' END,
  CASE WHEN min_price < 1 THEN 'very_low_prices' END, CASE WHEN zero_volume_days > total_days * 0.1 THEN 'zero_volume' END,
  CASE WHEN extreme_returns > n_returns * 0.05 THEN 'extreme_returns' END,
  CASE WHEN volatility_preservation < 0.01 OR volatility_preservation > 100 THEN 'volatility_preservation' END,
  CASE WHEN days_no_range > total_days * 0.2 THEN 'no_range' END) AS warnings FROM qs),
qq AS (SELECT *, CASE WHEN warnings = '' THEN 0 ELSE length(warnings) - length(replace(warnings, ',', '')) + 1 END AS n_warnings FROM qw),
qz AS (SELECT *, greatest(0, 100 - ohlc_violations * 10 - n_warnings * 5) AS quality_score FROM qq)"""


def quality_bars(spark, sf):
    k = F.col("sec") + F.col("ym")
    return v.ohlc(spark, sf).select(
        "sec", "ym", "open", F.when(k % 17 == 0, F.col("low")).otherwise(F.col("high")).alias("high"), "low", "close",
        F.when(k % 7 == 0, 0.0).otherwise(F.col("volume")).alias("volume"), (F.col("close") / F.col("open") - 1).alias("given_ret"))


def qstats(spark, sf):
    return ba.bar_stats(quality_bars(spark, sf))


@query("ohlc_violations", f"WITH {Q_SQL} SELECT sec, ohlc_violations::BIGINT AS ohlc_violations FROM qs")
def ohlc_violations(spark, sf):
    return quality_bars(spark, sf).groupBy("sec").agg(F.sum(ba.violations()).alias("ohlc_violations"))


STAT = ["min_price", "max_price", "mean_close", "close_volatility", "min_volume", "max_volume", "mean_volume", "mean_return",
        "return_volatility", "max_daily_return", "min_daily_return", "mean_daily_range", "max_daily_range", "volatility_preservation"]
COUNT = ["total_days", "first_date", "last_date", "zero_volume_days", "n_returns", "extreme_returns", "days_no_range"]


@query("ohlcv_stats", f"WITH {Q_SQL} SELECT sec, {', '.join(COUNT)}, {', '.join(f'rnd({c}, 5) AS {c}' for c in STAT)} FROM qs")
def ohlcv_stats(spark, sf):
    return qstats(spark, sf).select("sec", *COUNT, *[rnd(c, 5).alias(c) for c in STAT])


@query("ohlcv_warnings", f"WITH {Q_SQL} SELECT sec, warnings, n_warnings FROM qq")
def ohlcv_warnings(spark, sf):
    return ba.quality(qstats(spark, sf)).select("sec", F.array_join("warnings", ",").alias("warnings"), "n_warnings")


@query("ohlcv_quality", f"""WITH {Q_SQL} SELECT sec, total_days, ohlc_violations::BIGINT AS ohlc_violations, n_warnings, quality_score::BIGINT AS quality_score FROM qz""")
def ohlcv_quality(spark, sf):
    return ba.quality(qstats(spark, sf)).select("sec", "total_days", "ohlc_violations", "n_warnings", "quality_score")


@query("quality_bands", f"""WITH {Q_SQL} SELECT count(*) AS companies, rnd(avg(quality_score), 6) AS mean_score,
  count(CASE WHEN quality_score >= 90 THEN 1 END) AS excellent, count(CASE WHEN quality_score >= 70 AND quality_score < 90 THEN 1 END) AS good,
  count(CASE WHEN quality_score < 70 THEN 1 END) AS poor, rnd(count(CASE WHEN quality_score >= 90 THEN 1 END) / count(*) * 100, 6) AS excellent_pct,
  rnd(count(CASE WHEN quality_score >= 70 AND quality_score < 90 THEN 1 END) / count(*) * 100, 6) AS good_pct,
  rnd(count(CASE WHEN quality_score < 70 THEN 1 END) / count(*) * 100, 6) AS poor_pct,
  sum(ohlc_violations)::BIGINT AS total_violations, sum(n_warnings)::BIGINT AS total_warnings FROM qz""")
def quality_bands(spark, sf):
    b = ba.quality_bands(ba.quality(qstats(spark, sf)))
    return b.withColumns({c: rnd(c) for c in ["mean_score", "excellent_pct", "good_pct", "poor_pct"]})


BOUND = ["price_share", "volume_share", "return_share", "mean_return", "annual_return", "volatility", "annual_volatility"]


@query("bounds_share", f"""WITH {bars_sql('improved')}, br AS (SELECT *, close / lag(close) OVER (PARTITION BY sec ORDER BY dt) - 1 AS r FROM b4)
SELECT rnd(avg(CASE WHEN close BETWEEN 5 AND 500 THEN 1.0E0 ELSE 0 END), 6) AS price_share,
  rnd(avg(CASE WHEN volume BETWEEN 1000 AND 50000000 THEN 1.0E0 ELSE 0 END), 6) AS volume_share,
  rnd(avg(CASE WHEN abs(r) <= 0.5 THEN 1.0E0 WHEN r IS NOT NULL THEN 0 END), 6) AS return_share, rnd(avg(r), 6) AS mean_return,
  rnd(avg(r) * 252, 6) AS annual_return, rnd(stddev_pop(r), 6) AS volatility, rnd(stddev_pop(r) * sqrt(252), 6) AS annual_volatility FROM br""")
def bounds_share(spark, sf):
    return ba.bounds_share(ba.derive_bars(log_panel(spark, sf), "improved")).select(*[rnd(c).alias(c) for c in BOUND])


# ---- model input ----

L = 8
ALL = ind.feature_names()
CLOSE = [n for n in ALL if n.startswith("close_")]
DAY = "OVER (PARTITION BY sec ORDER BY day)"
BACK = f"OVER (PARTITION BY sec ORDER BY day ROWS BETWEEN {L} PRECEDING AND 1 PRECEDING)"
SEQ_SQL = f"""{FEATURES_SQL},
ok2 AS (SELECT *, CASE WHEN {" AND ".join(f"{c} IS NOT NULL" for c in ALL)} THEN 1 ELSE 0 END AS cell_ok, max(day) OVER (PARTITION BY sec) AS last_day FROM feat),
sq AS (SELECT sec, day, last_day, count(*) {BACK} AS n, sum(cell_ok) {BACK} AS oks, lag(close_raw) {DAY} AS base, close_raw AS target,
  avg(close_raw) {BACK} AS window_mean, avg(close_ma5) {BACK} AS pred FROM ok2),
sv AS (SELECT sec, day, base, target, window_mean, pred, oks = {L} AND base IS NOT NULL AND target IS NOT NULL AS valid FROM sq WHERE n = {L} AND day < last_day)"""


def grid(spark, sf):
    return ind.feature_grid(v.bars(spark, sf))


def samples(spark, sf, features=CLOSE):
    return mp.sequences(grid(spark, sf), L, features, check=ALL)


def predicted(spark, sf):
    """Samples with a stand-in prediction: the window mean of the 5-step close average."""
    mean = F.aggregate("x", F.lit(0.0), lambda acc, r: acc + r[0]) / F.size("x")
    return samples(spark, sf, ["close_ma5"]).withColumn("pred", mean)


@query("sequences", f"""WITH {SEQ_SQL} SELECT sv.sec, sv.day, CAST({L} - (sv.day - f.day) AS INTEGER) AS step, sv.valid, """ + ", ".join(
    f"rnd(f.{c}, 8) AS {c}" for c in CLOSE) + f" FROM sv JOIN feat f ON f.sec = sv.sec AND f.day BETWEEN sv.day - {L} AND sv.day - 1")
def sequences(spark, sf):
    steps = samples(spark, sf).select("sec", "day", "valid", F.posexplode("x").alias("step", "r"))
    return steps.select("sec", "day", "step", "valid", *[rnd(F.col("r")[i], 8).alias(c) for i, c in enumerate(CLOSE)])


@query("label_pair", f"WITH {SEQ_SQL} SELECT sec, day, rnd(base, 8) AS base, rnd(target, 8) AS target FROM sv")
def label_pair(spark, sf):
    return samples(spark, sf).select("sec", "day", rnd("base", 8).alias("base"), rnd("target", 8).alias("target"))


@query("time_split", f"""WITH {SEQ_SQL} SELECT CASE WHEN day < 30 THEN 'train' WHEN day < 40 THEN 'valid' ELSE 'test' END AS split,
  count(*) AS samples, count(CASE WHEN valid THEN 1 END) AS usable FROM sv GROUP BY 1""")
def time_split(spark, sf):
    split = mp.time_split(F.col("day"), 30, 40).alias("split")
    return samples(spark, sf).groupBy(split).agg(F.count("*").alias("samples"), F.count(F.when(F.col("valid"), 1)).alias("usable"))


@query("sequence_mask", f"WITH {SEQ_SQL} SELECT sec, day, valid FROM sv")
def sequence_mask(spark, sf):
    return samples(spark, sf).select("sec", "day", "valid")


@query("window_mean_label", f"WITH {SEQ_SQL} SELECT sec, day, rnd(window_mean, 8) AS window_mean FROM sv WHERE valid")
def window_mean_label(spark, sf):
    return samples(spark, sf).filter("valid").select("sec", "day", rnd("window_mean", 8).alias("window_mean"))


@query("label_encode", f"""WITH s AS (SELECT sec, CASE WHEN sec % 10 = 0 THEN 'n/a' ELSE {SECTOR_CASE} END AS sector FROM secdim),
k AS (SELECT sec, dense_rank() OVER (ORDER BY sec) - 1 AS key_label FROM s),
q AS (SELECT sector, dense_rank() OVER (ORDER BY sector) - 1 AS sector_label FROM (SELECT DISTINCT sector FROM s WHERE sector <> 'n/a') d)
SELECT s.sec, s.sector, k.key_label, coalesce(q.sector_label, -1) AS sector_label FROM s JOIN k ON s.sec = k.sec LEFT JOIN q ON s.sector = q.sector""")
def label_encode(spark, sf):
    s = v.secdim(spark, sf).select("sec", F.when(F.col("sec") % 10 == 0, "n/a").otherwise(sector_name()).alias("sector"))
    return mp.label_encode(s, "sec", "sector")


HIDDEN = [f"row_number() OVER (PARTITION BY s.sec, s.day ORDER BY md5(concat_ws('|', s.sec, s.day, {j}, s.step, 42))) <= {round(L * 0.3)}" for j in range(len(CLOSE))]


@query("random_mask", f"""WITH {SEQ_SQL},
st AS (SELECT sec, day, CAST(unnest(range({L})) AS INTEGER) AS step FROM sv WHERE valid)
SELECT s.sec, s.day, s.step, {", ".join(f"rnd(CASE WHEN {h} THEN 0 ELSE f.{c} END, 8) AS {c}" for c, h in zip(CLOSE, HIDDEN, strict=True))}
FROM st s JOIN feat f ON f.sec = s.sec AND f.day = s.day - {L} + s.step""")
def random_mask(spark, sf):
    masked = mp.random_mask(samples(spark, sf).filter("valid"), CLOSE, L, 0.3, 42)
    # Outer: every sample has L steps, and the filter that a plain explode infers would make the draws a second time.
    steps = masked.select("sec", "day", F.posexplode_outer("masked_x").alias("step", "r"))
    return steps.select("sec", "day", "step", *[rnd(F.col("r")[i], 8).alias(c) for i, c in enumerate(CLOSE)])


LATEST_SQL = f"""{FEATURES_SQL},
lr AS (SELECT *, row_number() OVER (PARTITION BY sec ORDER BY day DESC) AS rn FROM feat),
lk AS (SELECT sec, sum({" + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in ALL)}) / (count(*) * {len(ALL)}.0E0) AS missing_share FROM lr WHERE rn <= 32 GROUP BY sec),
lw AS (SELECT lr.*, 32 - rn AS step FROM lr JOIN lk ON lr.sec = lk.sec WHERE rn <= 32 AND missing_share <= 0.75)"""


def latest_grid(spark, sf):
    return ind.latest_grid(v.bars(spark, sf), 32)


@query("latest_window", f"WITH {LATEST_SQL} SELECT sec, CAST(step AS INTEGER) AS step, " + ", ".join(
    f"rnd(coalesce({c}, 0), 8) AS {c}" for c in ALL) + " FROM lw")
def latest_window(spark, sf):
    steps = mp.latest_window(latest_grid(spark, sf), ALL).select("sec", F.posexplode("x").alias("step", "r"))
    return steps.select("sec", "step", *[rnd(F.col("r")[i], 8).alias(c) for i, c in enumerate(ALL)])


def recency_mean(x):
    """Stand-in model: mean raw close with linearly rising weights."""
    import numpy as np
    w = np.arange(1, x.shape[1] + 1, dtype=float)
    return (x[:, :, 19] * w).sum(axis=1) / w.sum()


@query("score_windows", f"WITH {LATEST_SQL} SELECT sec, rnd(sum(coalesce(close_raw, 0) * (step + 1)) / 528.0E0, 6) AS ml_score FROM lw GROUP BY sec")
def score_windows(spark, sf):
    return mp.score_windows(mp.latest_window(latest_grid(spark, sf), ALL), recency_mean).select("sec", rnd("ml_score").alias("ml_score"))


BASELINE_SQL = f"""{SEQ_SQL},
bl AS (SELECT *, day >= 40 AS later FROM sv WHERE valid),
bm AS (SELECT count(*) AS n, avg(base) AS mb, avg(window_mean) AS mw, avg(target) AS mt, var_pop(base) * 1.001E0 AS vb, var_pop(window_mean) * 1.001E0 AS vw,
  covar_pop(base, window_mean) AS c, covar_pop(base, target) AS tb, covar_pop(window_mean, target) AS tw FROM bl WHERE day < 30),
bs AS (SELECT *, (tb * vw - tw * c) / (vb * vw - c * c) AS b0, (tw * vb - tb * c) / (vb * vw - c * c) AS b1 FROM bm)"""


def baseline(spark, sf):
    """Samples with two inputs, the last close and the window mean, and the regression on the days before the 30th."""
    data = cut_lineage(samples(spark, sf).withColumn("inputs", F.array("base", "window_mean")).filter("valid").drop("x"), "baseline")
    return data, mp.fit_baseline(data.filter(mp.time_split(F.col("day"), 30, 40) == "train"))


@query("fit_baseline", f"""WITH {BASELINE_SQL} SELECT -1 AS term, rnd(mt - b0 * mb - b1 * mw, 4) AS coefficient FROM bs
  UNION ALL SELECT 0, rnd(b0, 6) FROM bs UNION ALL SELECT 1, rnd(b1, 6) FROM bs""")
def fit_baseline(spark, sf):
    terms = baseline(spark, sf)[1]
    return terms.select("term", F.when(F.col("term") < 0, rnd("coefficient", 4)).otherwise(rnd("coefficient")).alias("coefficient"))


@query("baseline_predictions", f"""WITH {BASELINE_SQL} SELECT sec, day, rnd(base, 8) AS base, rnd(target, 8) AS target,
  rnd(mt + b0 * (base - mb) + b1 * (window_mean - mw), 4) AS pred FROM bl, bs WHERE later""")
def baseline_predictions(spark, sf):
    data, terms = baseline(spark, sf)
    test = mp.predict(data.filter(mp.time_split(F.col("day"), 30, 40) == "test"), terms)
    return test.select("sec", "day", rnd("base", 8).alias("base"), rnd("target", 8).alias("target"), rnd("pred", 4).alias("pred"))


PR = "(pred - base) / base"
OR = "(target - base) / base"


@query("masked_return_mse", f"WITH {SEQ_SQL} SELECT day, rnd(avg(({PR} - {OR}) * ({PR} - {OR})), 6) AS reg_loss, count(*) AS n FROM sv WHERE valid GROUP BY day")
def masked_return_mse(spark, sf):
    return mp.masked_return_mse(predicted(spark, sf)).withColumn("reg_loss", rnd("reg_loss"))


@query("pairwise_rank_loss", f"""WITH {SEQ_SQL}, r AS (SELECT sec, day, {PR} AS p, {OR} AS o FROM sv WHERE valid)
SELECT a.day, rnd(avg(greatest(0, (a.p - b.p) * (b.p - a.o))), 6) AS rank_loss, count(DISTINCT a.sec) AS n FROM r a JOIN r b ON a.day = b.day GROUP BY a.day""")
def pairwise_rank_loss(spark, sf):
    return mp.pairwise_rank_loss(predicted(spark, sf)).withColumn("rank_loss", rnd("rank_loss"))


@query("pairwise_rank_loss_symmetric", f"""WITH {SEQ_SQL}, r AS (SELECT sec, day, {PR} AS p, {OR} AS o FROM sv WHERE valid)
SELECT a.day, rnd(avg(greatest(0, -(a.p - b.p) * (a.o - b.o))), 6) AS rank_loss, count(DISTINCT a.sec) AS n FROM r a JOIN r b ON a.day = b.day GROUP BY a.day""")
def pairwise_rank_loss_symmetric(spark, sf):
    return mp.pairwise_rank_loss(predicted(spark, sf), symmetric=True).withColumn("rank_loss", rnd("rank_loss"))


@query("volume_derive_alone", f"""WITH {LOG_SQL} SELECT sec, dt, CAST(floor(200000 * (1 + abs(coalesce(stock_ret, 0)) * 0.15E0)) AS BIGINT) AS volume FROM lp""")
def volume_derive_alone(spark, sf):
    """Without a turnover column."""
    return ba.derive_bars(log_panel(spark, sf), "company", turnover=None).select("sec", "dt", "volume")


@query("topk_pnl", f"""WITH {SEQ_SQL}, r AS (SELECT sec, day, round({PR}, 9) AS p, {OR} AS o FROM sv WHERE valid),
t AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY p DESC, sec) AS pos FROM r),
d AS (SELECT k, day, avg(o) AS r FROM t, (VALUES (1), (5), (10)) ks(k) WHERE pos <= k GROUP BY k, day)
SELECT k, rnd(sum(r), 6) AS pnl, rnd(avg(r) / stddev_pop(r), 6) AS sharpe, count(*) AS days FROM d GROUP BY k""")
def topk_pnl(spark, sf):
    return mp.topk_pnl(predicted(spark, sf), [1, 5, 10]).withColumns({"pnl": rnd("pnl"), "sharpe": rnd("sharpe")})


@query("shuffle_samples", f"WITH {SEQ_SQL} SELECT sec, day, rnd(base, 8) AS base, rnd(target, 8) AS target FROM sv WHERE valid")
def shuffle_samples(spark, sf):
    s = samples(spark, sf).filter("valid").select("sec", "day", rnd("base", 8).alias("base"), rnd("target", 8).alias("target"))
    return mp.shuffle_samples(s, ["sec", "day"], 42)


LAST_SQL = "ls AS (SELECT sec, algo_score, ml_score FROM (SELECT *, row_number() OVER (PARTITION BY sec ORDER BY ym DESC) AS rn FROM scored) q WHERE rn = 1)"


def last_scores(spark, sf):
    """The newest scores of each security."""
    newest = F.max_by(F.struct("algo_score", "ml_score"), "ym")
    return v.scored(spark, sf).groupBy("sec").agg(newest.alias("s")).select("sec", "s.*")


@query("compare_predictions", f"""WITH {LAST_SQL}, st AS (""" + " UNION ALL ".join(
    f"SELECT '{n}' AS metric, CAST({e.format(c='algo_score')} AS DOUBLE) AS first, CAST({e.format(c='ml_score')} AS DOUBLE) AS second FROM ls"
    for n, e in [("total", "count(*)"), ("valid", "count({c})"), ("mean", "avg({c})"), ("max", "max({c})"), ("min", "min({c})"),
                 ("std", "stddev_pop({c})"), ("top", "max_by(sec, {c})")])
    + """) SELECT metric, rnd(first, 6) AS first, rnd(second, 6) AS second, rnd(second - first, 6) AS difference,
  rnd(coalesce((second - first) / nullif(first, 0) * 100, 0), 5) AS pct_change, first = second AS same, rnd(first / nullif(second, 0), 6) AS ratio FROM st""")
def compare_predictions(spark, sf):
    c = mp.compare_predictions(last_scores(spark, sf), "algo_score", "ml_score", "sec")
    return c.withColumns({x: rnd(x) for x in ["first", "second", "difference", "ratio"]}).withColumn("pct_change", rnd("pct_change", 5))


BINS = list(zip(PREDICTION_EDGES[:-1], PREDICTION_EDGES[1:]))


@query("prediction_histogram", " UNION ALL ".join(f"""
SELECT {lo}E0 AS low, {hi}E0 AS high, count(CASE WHEN s >= {lo} AND s < {hi} THEN 1 END) AS n,
  rnd(count(CASE WHEN s >= {lo} AND s < {hi} THEN 1 END) / count(s) * 100, 6) AS pct FROM (SELECT 10 * algo_score AS s FROM scored) q""" for lo, hi in BINS))
def prediction_histogram(spark, sf):
    s = v.scored(spark, sf).select((10 * F.col("algo_score")).alias("s"))
    return mp.prediction_histogram(s, "s").withColumn("pct", rnd("pct"))


@query("prediction_outlook", f"""WITH {LAST_SQL}, t AS (SELECT avg(ml_score) AS t FROM (SELECT ml_score FROM ls ORDER BY ml_score DESC, sec LIMIT 5) q),
a AS (SELECT avg(ml_score) AS mean, stddev_pop(ml_score) AS std, (SELECT t FROM t) AS t FROM ls), c AS (SELECT *, CASE WHEN std > 0 THEN t / std ELSE 0 END AS confidence FROM a)
SELECT rnd(mean, 6) AS mean, rnd(std, 6) AS std, rnd(confidence, 6) AS confidence,
  CASE WHEN mean > 0.1 THEN 'BULLISH' WHEN mean < -0.1 THEN 'BEARISH' ELSE 'NEUTRAL' END AS outlook,
  CASE WHEN confidence > 1 THEN 'HIGH' WHEN confidence > 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_band FROM c""")
def prediction_outlook(spark, sf):
    return mp.prediction_outlook(last_scores(spark, sf), "ml_score", "sec").withColumns({c: rnd(c) for c in ["mean", "std", "confidence"]})
