"""Queries: backtest, risk, turnover and holdings."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions.expr import month_index, rnd
from panelspark.operators import holdings as ho, performance as pe, risk as ri
from panelspark.plans import views as v
from panelspark.plans.portfolio import BUILD_SQL, full_portfolios
from panelspark.plans.registry import query


@query("monthly_book", """SELECT yr, mo, make_date(yr, mo, 1) AS date, count(*) AS total_positions,
  count(CASE WHEN side = 'long' THEN 1 END) AS long_count, count(CASE WHEN side = 'short' THEN 1 END) AS short_count
FROM positions GROUP BY yr, mo""")
def monthly_book(spark, sf):
    return pe.monthly_book(v.positions(spark, sf))


@query("portfolio_returns", f"""{BUILD_SQL},
rz AS (SELECT sec, CAST(ym // 100 AS BIGINT) * 12 + ym % 100 - 1 AS m, close / open - 1 AS r FROM ohlc),
hd AS (SELECT pt.*, rz.r, CASE WHEN rz.r IS NOT NULL THEN abs(weight) END AS w FROM pt LEFT JOIN rz ON pt.sec = rz.sec AND rz.m = pt.m + 1),
lg AS (SELECT m, coalesce(sum(CASE WHEN side = 'long' THEN w * r END) / nullif(sum(CASE WHEN side = 'long' THEN w END), 0), 0) AS long_return,
  coalesce(-sum(CASE WHEN side = 'short' THEN w * r END) / nullif(sum(CASE WHEN side = 'short' THEN w END), 0), 0) AS short_return,
  count(r) AS positions_count, count(*) - count(r) AS unpriced_count FROM hd GROUP BY m)
SELECT m, rnd(long_return, 6) AS long_return, rnd(short_return, 6) AS short_return, positions_count, unpriced_count,
  CASE WHEN positions_count > 0 THEN rnd((long_return + short_return) / 2, 6) END AS portfolio_return FROM lg""")
def portfolio_returns(spark, sf):
    m = month_index(F.floor(F.col("ym") / 100), F.col("ym") % 100)
    p = v.stored_panel(spark, sf)
    realized = v.ohlc(spark, sf, p).select("sec", m.alias("m"), (F.col("close") / F.col("open") - 1).alias("r"))
    out = pe.portfolio_returns(full_portfolios(spark, sf, p), realized, "sec")
    return out.withColumns({c: rnd(c) for c in ["long_return", "short_return", "portfolio_return"]})


DD_SQL = """
eq AS (SELECT *, product(1 + portfolio_return) OVER (ORDER BY ym ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM monthly),
pk AS (SELECT *, max(equity) OVER (ORDER BY ym ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM eq),
dd AS (SELECT *, (equity - peak) / peak AS drawdown, portfolio_return - bench_return AS x,
  avg(portfolio_return - bench_return) OVER () AS mx FROM pk)"""

METRICS_LIST = pe.METRICS
METRIC_SQL = """avg(portfolio_return) AS avg_monthly_return, avg(portfolio_return) * 12 AS avg_annual_return,
  product(1 + portfolio_return) - 1 AS total_return, stddev_samp(portfolio_return) AS monthly_volatility,
  stddev_samp(portfolio_return) * sqrt(12) AS annual_volatility,
  avg(portfolio_return) / stddev_samp(portfolio_return) * sqrt(12) AS sharpe_ratio,
  avg(x) / stddev_samp(x) * sqrt(12) AS information_ratio, stddev_samp(x) * sqrt(12) AS tracking_error,
  1 - sum(x * x) / sum(portfolio_return * portfolio_return) AS oos_r2_vs_bench,
  1 - sum((x - mx) * (x - mx)) / sum(x * x) AS oos_r2_excess_returns,
  avg(bench_return) AS bench_avg_monthly_return, avg(bench_return) * 12 AS bench_avg_annual_return,
  stddev_samp(bench_return) * sqrt(12) AS bench_annual_volatility, product(1 + bench_return) - 1 AS bench_total_return,
  avg(x) AS monthly_alpha, avg(x) * 12 AS annual_alpha, avg(CASE WHEN portfolio_return > 0 THEN 1.0E0 ELSE 0 END) AS win_rate,
  CAST(count(*) AS DOUBLE) AS months_tracked, max(portfolio_return) AS max_monthly_return,
  min(portfolio_return) AS min_monthly_return, min(drawdown) AS max_drawdown"""


def metrics(spark, sf):
    return pe.performance_metrics(v.monthly(spark, sf), "ym", "portfolio_return", "bench_return")


@query("performance_metrics", f"WITH {DD_SQL}, mt AS (SELECT {METRIC_SQL} FROM dd) SELECT "
       + ", ".join(f"rnd({c}, 6) AS {c}" for c in pe.METRICS) + " FROM mt")
def performance_metrics(spark, sf):
    return metrics(spark, sf).select(*[rnd(c).alias(c) for c in pe.METRICS])


@query("metrics_long", f"WITH {DD_SQL}, mt AS (SELECT {METRIC_SQL} FROM dd) " + " UNION ALL ".join(
    f"SELECT '{c}' AS metric, rnd({c}, 6) AS value FROM mt" for c in pe.METRICS))
def metrics_long(spark, sf):
    return pe.metrics_long(metrics(spark, sf)).select("metric", rnd("value").alias("value"))


def curve(spark, sf):
    return pe.drawdowns(v.monthly(spark, sf), "ym", "portfolio_return")


@query("max_drawdown", f"WITH {DD_SQL} SELECT rnd(min(drawdown), 6) AS max_drawdown FROM dd")
def max_drawdown(spark, sf):
    return curve(spark, sf).agg(rnd(F.min("drawdown")).alias("max_drawdown"))


@query("oos_r2", f"""WITH {DD_SQL} SELECT rnd(1 - sum(x * x) / sum(portfolio_return * portfolio_return), 6) AS oos_r2,
  rnd(1 - sum((x - mx) * (x - mx)) / sum(x * x), 6) AS oos_r2_excess FROM dd""")
def oos_r2(spark, sf):
    return metrics(spark, sf).select(rnd("oos_r2_vs_bench").alias("oos_r2"), rnd("oos_r2_excess_returns").alias("oos_r2_excess"))


@query("drawdown_curve", f"WITH {DD_SQL} SELECT ym, rnd(equity, 6) AS equity, rnd(peak, 6) AS peak, rnd(drawdown, 6) AS drawdown FROM dd")
def drawdown_curve(spark, sf):
    return curve(spark, sf).select("ym", *[rnd(c).alias(c) for c in ["equity", "peak", "drawdown"]])


@query("drawdown_low", f"""WITH {DD_SQL}, lo AS (SELECT min(drawdown) AS md FROM dd)
SELECT rnd(md, 6) AS max_drawdown, CASE WHEN md < 0 THEN (SELECT min(ym) FROM dd WHERE drawdown = md) END AS max_drawdown_date FROM lo""")
def drawdown_low(spark, sf):
    return ri.drawdown_low(curve(spark, sf), "ym").withColumn("max_drawdown", rnd("max_drawdown"))


RISK_COLS = ["max_monthly_loss", "max_monthly_loss_pct", "max_monthly_gain", "max_monthly_gain_pct", "mean_monthly_return",
             "monthly_volatility", "annual_volatility", "downside_volatility", "negative_months_pct", "var_5pct", "var_1pct",
             "max_drawdown", "max_drawdown_pct", "sharpe_ratio"]
RISK_SQL = f"""{DD_SQL}, rk AS (SELECT min(portfolio_return) AS max_monthly_loss, min(portfolio_return) * 100 AS max_monthly_loss_pct,
  (SELECT min(ym) FROM dd WHERE portfolio_return = (SELECT min(portfolio_return) FROM dd)) AS max_loss_date,
  max(portfolio_return) AS max_monthly_gain, max(portfolio_return) * 100 AS max_monthly_gain_pct, avg(portfolio_return) AS mean_monthly_return,
  stddev_pop(portfolio_return) AS monthly_volatility, stddev_pop(portfolio_return) * sqrt(12) AS annual_volatility,
  coalesce(sqrt(avg(CASE WHEN portfolio_return < 0 THEN portfolio_return * portfolio_return END)), 0) AS downside_volatility,
  count(CASE WHEN portfolio_return < 0 THEN 1 END) AS negative_months,
  count(CASE WHEN portfolio_return < 0 THEN 1 END) / count(*) * 100 AS negative_months_pct,
  quantile_cont(portfolio_return, 0.05) AS var_5pct, quantile_cont(portfolio_return, 0.01) AS var_1pct,
  min(drawdown) AS max_drawdown, min(drawdown) * 100 AS max_drawdown_pct,
  avg(portfolio_return) / stddev_pop(portfolio_return) * sqrt(12) AS sharpe_ratio FROM dd)"""


def risk(spark, sf):
    return ri.risk_metrics(v.monthly(spark, sf), "ym", "portfolio_return")


@query("risk_metrics", f"WITH {RISK_SQL} SELECT max_loss_date, negative_months, " + ", ".join(
    f"rnd({c}, 6) AS {c}" for c in RISK_COLS) + " FROM rk")
def risk_metrics(spark, sf):
    return risk(spark, sf).select("max_loss_date", "negative_months", *[rnd(c).alias(c) for c in RISK_COLS])


@query("extreme_months", """
WITH r AS (SELECT *, row_number() OVER (ORDER BY portfolio_return, ym) AS lo, row_number() OVER (ORDER BY portfolio_return DESC, ym) AS hi FROM monthly)
SELECT 'worst' AS kind, ym AS "month", rnd(portfolio_return, 6) AS value, rnd(bench_return, 6) AS bench_return, positions_count FROM r WHERE lo = 1
UNION ALL SELECT 'best', ym, rnd(portfolio_return, 6), rnd(bench_return, 6), positions_count FROM r WHERE hi = 1""")
def extreme_months(spark, sf):
    out = ri.extreme_months(v.monthly(spark, sf), "ym", "portfolio_return", ["bench_return", "positions_count"])
    return out.withColumns({"value": rnd("value"), "bench_return": rnd("bench_return")})


@query("loss_stats", """SELECT count(*) AS negative_months, rnd(avg(portfolio_return), 6) AS avg_loss,
  rnd(median(portfolio_return), 6) AS median_loss FROM monthly WHERE portfolio_return < 0""")
def loss_stats(spark, sf):
    return ri.loss_stats(v.monthly(spark, sf), "portfolio_return").withColumns(
        {"avg_loss": rnd("avg_loss"), "median_loss": rnd("median_loss")})


@query("worst_months", "SELECT ym, rnd(portfolio_return, 6) AS portfolio_return FROM monthly ORDER BY monthly.portfolio_return, ym LIMIT 5")
def worst_months(spark, sf):
    return ri.worst_months(v.monthly(spark, sf), "ym", "portfolio_return").withColumn("portfolio_return", rnd("portfolio_return"))


TURN_SQL = """
ps AS (SELECT DISTINCT yr, mo, CASE WHEN side = 'long' THEN 'L_' ELSE 'S_' END || company_id AS position FROM positions),
mi AS (SELECT yr, mo, row_number() OVER (ORDER BY yr, mo) AS i FROM (SELECT DISTINCT yr, mo FROM ps) q),
pi AS (SELECT ps.position, mi.i FROM ps JOIN mi ON ps.yr = mi.yr AND ps.mo = mi.mo),
sz AS (SELECT i, count(*) AS n FROM pi GROUP BY i),
fj AS (SELECT coalesce(a.i, b.i + 1) AS i, a.i AS cur, b.i AS prev FROM pi a FULL OUTER JOIN pi b ON a.position = b.position AND a.i = b.i + 1),
ch AS (SELECT i, count(CASE WHEN prev IS NULL THEN 1 END) AS entered, count(CASE WHEN cur IS NULL THEN 1 END) AS exited FROM fj GROUP BY i),
tv AS (SELECT mi.yr, mi.mo, mi.yr * 12 + mi.mo - pm.yr * 12 - pm.mo AS gap_months, ch.entered AS positions_entered,
  ch.exited AS positions_exited, sz.n AS total_positions, ch.entered - ch.exited AS net_change,
  (ch.entered + ch.exited) / ((sz.n + pz.n) / 2.0E0) AS turnover_rate
  FROM mi JOIN mi pm ON pm.i = mi.i - 1 JOIN sz ON sz.i = mi.i JOIN sz pz ON pz.i = mi.i - 1 JOIN ch ON ch.i = mi.i)"""


def sets(spark, sf):
    return ri.position_sets(v.positions(spark, sf))


@query("position_sets", f"WITH {TURN_SQL} SELECT yr, mo, position FROM ps")
def position_sets(spark, sf):
    return sets(spark, sf)


@query("turnover", f"""WITH {TURN_SQL} SELECT yr, mo, gap_months, positions_entered, positions_exited, total_positions, net_change,
  rnd(turnover_rate, 6) AS turnover_rate FROM tv""")
def turnover(spark, sf):
    return ri.turnover(sets(spark, sf)).withColumn("turnover_rate", rnd("turnover_rate"))


@query("turnover_stats", f"""WITH {TURN_SQL} SELECT rnd(avg(turnover_rate), 6) AS avg_monthly_turnover, rnd(median(turnover_rate), 6) AS median_monthly_turnover,
  rnd(max(turnover_rate), 6) AS max_monthly_turnover, rnd(min(turnover_rate), 6) AS min_monthly_turnover,
  rnd(stddev_samp(turnover_rate), 6) AS turnover_volatility, rnd(avg(total_positions), 6) AS avg_positions_per_month,
  rnd(avg(turnover_rate) * 12, 6) AS annual_turnover, min(total_positions) AS min_positions, max(total_positions) AS max_positions FROM tv""")
def turnover_stats(spark, sf):
    s = ri.turnover_stats(ri.turnover(sets(spark, sf)))
    return s.select(*[c if c in ("min_positions", "max_positions") else rnd(c).alias(c) for c in s.columns])


@query("turnover_top", f"""WITH {TURN_SQL}, r AS (SELECT yr, mo, positions_entered, positions_exited, round(turnover_rate, 9) AS tr FROM tv)
SELECT yr, mo, positions_entered, positions_exited, rnd(tr, 6) AS turnover_rate FROM r ORDER BY tr DESC, yr, mo LIMIT 5""")
def turnover_top(spark, sf):
    t = ri.turnover(sets(spark, sf)).withColumn("turnover_rate", F.round("turnover_rate", 9))
    return ri.turnover_top(t).select("yr", "mo", "positions_entered", "positions_exited", rnd("turnover_rate").alias("turnover_rate"))


@query("risk_bands", f"""WITH {RISK_SQL}, {TURN_SQL.strip()}, an AS (SELECT avg(turnover_rate) * 12 AS a FROM tv)
SELECT CASE WHEN abs(max_monthly_loss_pct) > 20 THEN 'HIGH RISK' WHEN abs(max_monthly_loss_pct) > 10 THEN 'MODERATE-HIGH RISK'
    WHEN abs(max_monthly_loss_pct) > 5 THEN 'MODERATE RISK' ELSE 'LOW RISK' END AS risk_level,
  CASE WHEN negative_months_pct > 50 THEN 'HIGH FREQUENCY' ELSE 'REASONABLE FREQUENCY' END AS negative_share,
  CASE WHEN abs(max_monthly_loss) < 0.01 THEN 'VERY LOW' WHEN abs(max_monthly_loss) < 0.05 THEN 'MODERATE' ELSE 'HIGH' END AS loss_level,
  (SELECT CASE WHEN a > 5 THEN 'VERY HIGH' WHEN a > 3 THEN 'HIGH' WHEN a > 2 THEN 'MODERATE' ELSE 'LOW' END FROM an) AS turnover_level,
  (SELECT CASE WHEN a > 4 THEN 'VERY HIGH' WHEN a > 2 THEN 'HIGH' ELSE 'MODERATE' END FROM an) AS turnover_summary FROM rk""")
def risk_bands(spark, sf):
    annual = ri.turnover_stats(ri.turnover(sets(spark, sf))).select("annual_turnover")
    return risk(spark, sf).withColumn("annual", annual.scalar()).select(
        ri.risk_band(F.col("max_monthly_loss_pct")).alias("risk_level"),
        ri.negative_share_band(F.col("negative_months_pct")).alias("negative_share"),
        ri.loss_band(F.col("max_monthly_loss")).alias("loss_level"),
        ri.turnover_band(F.col("annual")).alias("turnover_level"),
        ri.turnover_summary_band(F.col("annual")).alias("turnover_summary"))


HS_SQL = """
hs AS (SELECT company_id, count(*) AS appearances, sum(abs(weight)) AS total_weight, avg(abs(weight)) AS avg_weight, avg(score) AS avg_score,
  max(score) AS max_score, min(score) AS min_score, CASE WHEN count(*) > 1 THEN stddev_pop(score) ELSE 0 END AS score_std,
  CASE WHEN count(*) > 1 THEN stddev_pop(abs(weight)) ELSE 0 END AS weight_std, count(CASE WHEN side = 'long' THEN 1 END) AS long_count,
  count(CASE WHEN side = 'short' THEN 1 END) AS short_count, min(yr) AS first_year, max(yr) AS last_year FROM positions GROUP BY company_id),
sm AS (SELECT company_id, sector, row_number() OVER (PARTITION BY company_id ORDER BY count(*) DESC, sector) AS rn FROM positions GROUP BY company_id, sector),
dm AS (SELECT company_id, side, row_number() OVER (PARTITION BY company_id ORDER BY count(*) DESC, side) AS rn FROM positions GROUP BY company_id, side),
md AS (SELECT sm.company_id, sm.sector AS primary_sector, dm.side AS primary_side FROM sm JOIN dm ON sm.company_id = dm.company_id WHERE sm.rn = 1 AND dm.rn = 1),
v1 AS (SELECT hs.*, md.primary_sector, md.primary_side, CASE WHEN score_std > 0 THEN avg_score / score_std ELSE avg_score END AS risk_adjusted_score,
  1 / (1 + score_std) AS consistency_score, avg_score * 0.4E0 + CASE WHEN score_std > 0 THEN avg_score / score_std ELSE avg_score END * 0.3E0
  + appearances / 100 * 0.2E0 + 1 / (1 + score_std) * 0.1E0 AS overall_score FROM hs JOIN md ON hs.company_id = md.company_id),
v2 AS (SELECT hs.*, CASE WHEN score_std > 1e-10 THEN avg_score / score_std ELSE avg_score * 1000 END AS sharpe_like_ratio,
  CASE WHEN score_std > 0 THEN 1 / (1 + score_std) ELSE 1 END AS consistency, last_year - first_year + 1 AS time_span, long_count / appearances AS long_ratio,
  least(avg_score * 50, 40) + least(appearances / 10, 20) + CASE WHEN score_std > 0 THEN 1 / (1 + score_std) ELSE 1 END * 20
  + least((last_year - first_year + 1) / 5, 20) AS overall_score FROM hs)"""


def held(spark, sf):
    return v.positions(spark, sf)


def with_mode(spark, sf):
    p = held(spark, sf)
    return ho.holding_stats(p).join(ho.holding_mode(p), "company_id")


@query("holding_stats", f"WITH {HS_SQL} SELECT company_id, appearances, long_count, short_count, first_year, last_year, " + ", ".join(
    f"rnd({c}, 6) AS {c}" for c in ["total_weight", "avg_weight", "avg_score", "max_score", "min_score", "score_std", "weight_std"]) + " FROM hs")
def holding_stats(spark, sf):
    return ho.holding_stats(held(spark, sf)).select(
        "company_id", "appearances", "long_count", "short_count", "first_year", "last_year",
        *[rnd(c).alias(c) for c in ["total_weight", "avg_weight", "avg_score", "max_score", "min_score", "score_std", "weight_std"]])


@query("holding_mode", f"WITH {HS_SQL} SELECT company_id, primary_sector, primary_side FROM md")
def holding_mode(spark, sf):
    return ho.holding_mode(held(spark, sf))


@query("holding_score_v1", f"""WITH {HS_SQL} SELECT company_id, rnd(risk_adjusted_score, 6) AS risk_adjusted_score,
  rnd(consistency_score, 6) AS consistency_score, rnd(overall_score, 6) AS overall_score FROM v1""")
def holding_score_v1(spark, sf):
    return ho.score_v1(ho.holding_stats(held(spark, sf))).select(
        "company_id", *[rnd(c).alias(c) for c in ["risk_adjusted_score", "consistency_score", "overall_score"]])


@query("holding_score_v2", f"""WITH {HS_SQL} SELECT company_id, time_span, rnd(sharpe_like_ratio, 6) AS sharpe_like_ratio,
  rnd(consistency, 6) AS consistency, rnd(long_ratio, 6) AS long_ratio, rnd(overall_score, 6) AS overall_score FROM v2""")
def holding_score_v2(spark, sf):
    return ho.score_v2(ho.holding_stats(held(spark, sf))).select(
        "company_id", "time_span", *[rnd(c).alias(c) for c in ["sharpe_like_ratio", "consistency", "long_ratio", "overall_score"]])


TOP_ROUND = {"avg_score": 4, "max_score": 4, "avg_weight": 4, "sharpe_like_ratio": 2, "consistency": 3, "overall_score": 2,
             "long_ratio": 2, "score_std": 4}


@query("top_holdings", f"""WITH {HS_SQL}, r AS (SELECT company_id, appearances, time_span, first_year, last_year, """ + ", ".join(
    f"round_even(round({c}, 10), {d}) AS {c}" for c, d in TOP_ROUND.items()) + """ FROM v2 WHERE appearances >= 3)
SELECT * FROM r ORDER BY overall_score DESC, company_id LIMIT 10""")
def top_holdings(spark, sf):
    top = ho.top_holdings(ho.score_v2(ho.holding_stats(held(spark, sf))), "overall_score", 10, rounding=TOP_ROUND)
    return top.select("company_id", "appearances", "time_span", "first_year", "last_year", *TOP_ROUND)


CRITERIA = ["overall_score", "avg_score", "risk_adjusted_score", "appearances", "consistency_score"]


@query("top_holdings_multi", f"WITH {HS_SQL}, u AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS criterion, company_id, round(CAST({c} AS DOUBLE), 9) AS value, appearances FROM v1 WHERE appearances >= 3" for c in CRITERIA)
    + """), r AS (SELECT *, row_number() OVER (PARTITION BY criterion ORDER BY value DESC, company_id) AS place FROM u)
SELECT criterion, company_id, rnd(value, 6) AS value, appearances, place FROM r WHERE place <= 10""")
def top_holdings_multi(spark, sf):
    top = ho.top_holdings_multi(ho.score_v1(ho.holding_stats(held(spark, sf))), CRITERIA, 10)
    return top.withColumn("value", rnd("value"))


@query("sector_performance", f"""WITH {HS_SQL} SELECT primary_sector, count(*) AS companies, sum(appearances)::BIGINT AS total_appearances,
  rnd(avg(avg_score), 6) AS avg_score, rnd(avg(avg_weight), 6) AS avg_weight,
  rnd(CASE WHEN count(*) > 1 THEN stddev_pop(avg_score) ELSE 0 END, 6) AS score_std FROM v1 WHERE appearances >= 3 GROUP BY primary_sector""")
def sector_performance(spark, sf):
    return ho.sector_performance(with_mode(spark, sf)).withColumns({c: rnd(c) for c in ["avg_score", "avg_weight", "score_std"]})


@query("recent_average", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY yr DESC, mo DESC, sector DESC, side DESC) AS rn FROM positions)
SELECT company_id, rnd(avg(score), 6) AS recent_avg_score, count(*) AS entries FROM r WHERE rn <= 12 GROUP BY company_id""")
def recent_average(spark, sf):
    return ho.recent_average(held(spark, sf)).withColumn("recent_avg_score", rnd("recent_avg_score"))


@query("holding_breakdown", """WITH c AS (SELECT company_id, sector, count(*) AS n,
  row_number() OVER (PARTITION BY company_id ORDER BY count(*) DESC, sector) AS rn FROM positions GROUP BY company_id, sector),
t AS (SELECT company_id, string_agg(sector || '(' || n || ')', ', ' ORDER BY rn) AS sectors_appeared,
  string_agg(sector || '(' || n || ')', ', ' ORDER BY rn) FILTER (rn <= 3) AS top_sectors FROM c GROUP BY company_id),
p AS (SELECT company_id, 'Long: ' || count(CASE WHEN side = 'long' THEN 1 END) || ', Short: ' || count(CASE WHEN side = 'short' THEN 1 END) AS position_breakdown,
  min(yr) AS first_appearance, max(yr) AS last_appearance FROM positions GROUP BY company_id)
SELECT t.company_id, sectors_appeared, top_sectors, position_breakdown, first_appearance, last_appearance FROM t JOIN p ON t.company_id = p.company_id""")
def holding_breakdown(spark, sf):
    return ho.holding_breakdown(held(spark, sf))


@query("holding_totals", """WITH c AS (SELECT company_id, count(*) AS n FROM positions GROUP BY company_id)
SELECT count(*) AS companies, count(CASE WHEN n >= 3 THEN 1 END) AS significant_companies,
  (SELECT count(*) FROM (SELECT DISTINCT yr, mo, sector FROM positions) f) AS files FROM c""")
def holding_totals(spark, sf):
    return ho.holding_totals(held(spark, sf))
