"""Queries: the whole chain from indicators to metrics, each step fed by the one before."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.constants import ALGO_WEIGHT, ML_WEIGHT, PAD
from panelspark.functions.expr import month_index, ratio, rnd
from panelspark.operators import indicators as ind, performance as pe, portfolio as pf
from panelspark.plans import models, signals, views as v
from panelspark.plans.models import SEQ_SQL
from panelspark.plans.portfolio import BY, M, N, PORT_SQL
from panelspark.plans.registry import query
from panelspark.plans.reports import DD_SQL, METRIC_SQL
from panelspark.plans.signals import SELECT_SQL
from panelspark.sources import sinks, tables
from panelspark.storage import scratch_path

CHAIN_SQL = f"""WITH {SELECT_SQL},
{SEQ_SQL},
cand AS (SELECT sec, sector AS prefix, CAST(year(mon) AS BIGINT) * 12 + month(mon) - 1 AS m, round(avg(composite_score), 9) AS algo_score
  FROM picked GROUP BY 1, 2, 3),
ml AS (SELECT sv.sec, CAST(cal.ym // 100 AS BIGINT) * 12 + cal.ym % 100 - 1 AS m, (sv.pred - sv.base) / sv.base AS ml_score
  FROM sv JOIN cal ON cal.date_idx = sv.day + {PAD} WHERE sv.valid),
hc AS (SELECT sec, CAST(year(dt) AS BIGINT) * 12 + month(dt) - 1 AS hm, count(*) AS n FROM panel GROUP BY 1, 2),
chained AS (SELECT s.*, ml.ml_score FROM cand s LEFT JOIN ml ON ml.sec = s.sec AND ml.m = s.m
  WHERE (SELECT sum(n) FROM hc WHERE hc.sec = s.sec AND hc.hm BETWEEN s.m - 36 AND s.m - 1) >= 30),
{PORT_SQL.replace("FROM scored)", "FROM chained)").replace("FROM nm)", "FROM nm WHERE ml_score IS NOT NULL)")}"""

RETURNS_SQL = """
rz AS (SELECT sec, CAST(ym // 100 AS BIGINT) * 12 + ym % 100 - 1 AS m, close / open - 1 AS r FROM ohlc),
hd AS (SELECT pt.*, rz.r FROM pt JOIN rz ON pt.sec = rz.sec AND rz.m = pt.m + 1),
lg AS (SELECT m, coalesce(sum(CASE WHEN side = 'long' THEN abs(weight) * r END) / nullif(sum(CASE WHEN side = 'long' THEN abs(weight) END), 0), 0) AS long_return,
  coalesce(-sum(CASE WHEN side = 'short' THEN abs(weight) * r END) / nullif(sum(CASE WHEN side = 'short' THEN abs(weight) END), 0), 0) AS short_return FROM hd GROUP BY m),
bn AS (SELECT m - 1 AS m, avg(r) AS bench_return FROM rz GROUP BY m),
chain_month AS (SELECT lg.m AS ym, (long_return + short_return) / 2 AS portfolio_return, bench_return FROM lg JOIN bn ON lg.m = bn.m)"""


def portfolios(spark, sf, p):
    """Candidates, history rule, model score, combination and weights over one stored panel."""
    month = month_index(F.year("mon"), F.month("mon"))
    picked = signals.candidates(spark, sf).groupBy("sec", F.col("sector").alias("prefix"), month.alias("m")).agg(
        F.round(F.avg("composite_score"), 9).alias("algo_score"))
    bars = v.ohlc(spark, sf, p)
    known = bars.groupBy("sec").agg(F.count("*").alias("_n")).filter("_n >= 30").drop("_n")
    calendar = ind.trading_calendar(bars.join(known, "sec", "left_semi"), "ym")
    steps = calendar.select((F.col("date_idx") - PAD).alias("day"), month_index(F.floor(F.col("ym") / 100), F.col("ym") % 100).alias("m"))
    predicted = models.predicted(spark, sf).filter("valid").join(steps, "day").select(
        "sec", "m", ratio(F.col("pred") - F.col("base"), F.col("base")).alias("ml_score"))
    kept = pf.enough_history(picked, p, "sec").join(predicted, ["sec", "m"], "left")
    return pf.build_portfolios(kept, BY, "sec", N, M)


@query("pipeline_portfolios", f"""{CHAIN_SQL} SELECT sec, m, prefix, side, rnd(algo_norm, 6) AS algo_norm, rnd(ml_norm, 6) AS ml_norm,
  rnd(combined_score, 6) AS combined_score, rnd(weight, 6) AS weight FROM pt""")
def pipeline_portfolios(spark, sf):
    done = portfolios(spark, sf, v.stored_panel(spark, sf))
    return done.select("sec", "m", "prefix", "side", *[rnd(c).alias(c) for c in ("algo_norm", "ml_norm", "combined_score", "weight")])


# The compounded totals of these invented prices have 28 digits, more than engines agree on; their logarithms do not.
TOTALS = ["total_return", "bench_total_return"]
SHOWN = [c for c in pe.METRICS if c not in TOTALS]


@query("pipeline_metrics", f"""{CHAIN_SQL}, {RETURNS_SQL}, {DD_SQL.replace("monthly", "chain_month")}, mt AS (SELECT {METRIC_SQL} FROM dd) SELECT """
       + ", ".join([f"rnd({c}, 6) AS {c}" for c in SHOWN] + [f"rnd(ln(1 + {c}), 6) AS log_{c}" for c in TOTALS]) + " FROM mt")
def pipeline_metrics(spark, sf):
    p = v.stored_panel(spark, sf)
    m = month_index(F.floor(F.col("ym") / 100), F.col("ym") % 100)
    realized = v.ohlc(spark, sf, p).select("sec", m.alias("m"), (F.col("close") / F.col("open") - 1).alias("r"))
    monthly = pe.portfolio_returns(portfolios(spark, sf, p), realized, "sec").filter("positions_count > 0")
    bench = realized.groupBy((F.col("m") - 1).alias("m")).agg(F.avg("r").alias("bench_return"))
    both = monthly.join(bench, "m").select(F.col("m").alias("ym"), "portfolio_return", "bench_return")
    done = pe.performance_metrics(both, "ym", "portfolio_return", "bench_return")
    return done.select(*[rnd(c).alias(c) for c in SHOWN], *[rnd(F.log1p(c)).alias(f"log_{c}") for c in TOTALS])


@query("pipeline_documents", f"""{CHAIN_SQL} SELECT CAST(m // 12 AS INTEGER) AS yr, CAST(m % 12 + 1 AS INTEGER) AS mo, prefix AS sector, side,
  concat('comp_', lpad(CAST(sec AS VARCHAR), 6, '0'), '_01') AS company_id, CAST(sec AS BIGINT) AS gvkey, '01' AS iid,
  rnd(algo_score, 6) AS algo_score_raw, rnd(algo_norm, 6) AS algo_score_normalized, rnd(ml_score, 6) AS ml_score_raw,
  rnd(ml_norm, 6) AS ml_score_normalized, rnd(combined_score, 6) AS combined_score, side AS candidate_type, rnd(weight, 6) AS portfolio_weight FROM pt""")
def pipeline_documents(spark, sf):
    """The chain's portfolios written as documents and read back with all ten fields of a position."""
    done = portfolios(spark, sf, v.stored_panel(spark, sf)).select(
        "*", F.floor(F.col("m") / 12).cast("int").alias("yr"), (F.col("m") % 12 + 1).cast("int").alias("mo"), F.col("prefix").alias("sector"),
        F.concat(F.lit("comp_"), F.lpad(F.col("sec").cast("string"), 6, "0"), F.lit("_01")).alias("company_id"),
        F.col("sec").alias("gvkey"), F.lit("01").alias("iid"))
    path = scratch_path(spark, "documents")
    sinks.write_portfolios(done, path, {"longs": N, "shorts": M, "algo_weight": ALGO_WEIGHT, "ml_weight": ML_WEIGHT})
    back = tables.read_portfolios(spark, path)
    scores = ("algo_score_raw", "algo_score_normalized", "ml_score_raw", "ml_score_normalized", "combined_score", "portfolio_weight")
    return back.select("yr", "mo", "sector", "side", "company_id", "gvkey", "iid", "candidate_type", *[rnd(c).alias(c) for c in scores])
