"""Queries: point-in-time selection and portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.constants import SECTORS
from panelspark.functions.expr import rnd
from panelspark.operators import portfolio as pf
from panelspark.plans import views as v
from panelspark.plans.registry import query
from panelspark.storage import cut_lineage

BY = ["m", "prefix"]
N, M = 10, 5

ID_SQL = """CASE WHEN c_nationkey % 9 = 0 THEN 'nan' ELSE concat(CAST(c_custkey AS VARCHAR), '.0') END"""


@query("company_id", f"""WITH g AS (SELECT c_custkey, {ID_SQL} AS gvkey, concat(CAST(1 + c_nationkey % 3 AS VARCHAR), '.0') AS iid FROM customer)
SELECT c_custkey, concat('comp_', CASE WHEN length(replace(gvkey, '.0', '')) < 6 THEN lpad(replace(gvkey, '.0', ''), 6, '0') ELSE replace(gvkey, '.0', '') END,
  '_', replace(iid, '.0', '')) AS company_id FROM g WHERE gvkey NOT IN ('nan', 'None', '', 'NaN')""")
def company_id(spark, sf):
    k = F.col("c_nationkey")
    g = v.table(spark, sf, "customer").select(
        "c_custkey", F.when(k % 9 == 0, "nan").otherwise(F.concat(F.col("c_custkey").cast("string"), F.lit(".0"))).alias("gvkey"),
        F.concat((1 + k % 3).cast("string"), F.lit(".0")).alias("iid"))
    named = g.select("c_custkey", pf.company_id(F.col("gvkey"), F.col("iid")).alias("company_id"))
    return named.filter(F.col("company_id").isNotNull())


HIST_SQL = """
hc AS (SELECT sec, CAST(year(dt) AS BIGINT) * 12 + month(dt) - 1 AS hm, count(*) AS n FROM panel GROUP BY 1, 2),
hist AS (SELECT s.*, (SELECT sum(n) FROM hc WHERE hc.sec = s.sec AND hc.hm BETWEEN s.m - 36 AND s.m - 1) AS seen FROM scored s)"""


@query("history_semi_join", f"""WITH {HIST_SQL}
SELECT sec, m, prefix, rnd(algo_score, 6) AS algo_score FROM hist WHERE seen >= 30""")
def history_semi_join(spark, sf):
    p = v.stored_panel(spark, sf)
    kept = pf.enough_history(v.scored(spark, sf, p), p, "sec")
    return kept.select("sec", "m", "prefix", rnd("algo_score").alias("algo_score"))


@query("asof_cutoff", """
WITH c AS (SELECT sec, make_date(CAST(ym // 100 AS BIGINT), CAST(ym % 100 AS BIGINT), 1) AS month_start FROM scored)
SELECT c.sec, c.month_start, max(p.dt) AS last_date, rnd(max_by(p.prc, p.dt), 6) AS last_value, count(p.dt) AS bars_known
FROM c LEFT JOIN panel p ON p.sec = c.sec AND p.dt < c.month_start GROUP BY c.sec, c.month_start""")
def asof_cutoff(spark, sf):
    p = v.stored_panel(spark, sf)
    c = v.scored(spark, sf, p).select("sec", F.make_date(F.floor(F.col("ym") / 100).cast("int"), (F.col("ym") % 100).cast("int"), F.lit(1)).alias("month_start"))
    return pf.as_of_cutoff(c, p, "sec", "month_start").select(
        "sec", "month_start", "last_date", rnd("last_value").alias("last_value"), "bars_known")


TB_SQL = f"""
tb AS (SELECT *, row_number() OVER (PARTITION BY m, prefix ORDER BY algo_score DESC, sec) AS up,
  row_number() OVER (PARTITION BY m, prefix ORDER BY algo_score, sec DESC) AS down, count(*) OVER (PARTITION BY m, prefix) AS n FROM scored),
sel AS (SELECT sec, m, prefix, algo_score, ml_score, 'long' AS side, up AS pos FROM tb WHERE up <= {N}
  UNION ALL SELECT sec, m, prefix, algo_score, ml_score, 'short', down FROM tb WHERE down <= least({M}, greatest(0, n - {N})))"""
W = "OVER (PARTITION BY m, prefix, side)"


def norm_sql(c):
    return (f"coalesce(CASE WHEN side = 'long' THEN ({c} - min({c}) {W}) ELSE (max({c}) {W} - {c}) END "
            f"/ nullif(max({c}) {W} - min({c}) {W}, 0), 0)")


PORT_SQL = f"""{TB_SQL},
nm AS (SELECT *, {norm_sql("algo_score")} AS algo_norm, {norm_sql("ml_score")} AS ml_norm FROM sel),
cb AS (SELECT *, 0.6E0 * algo_norm + 0.4E0 * ml_norm AS combined_score FROM nm),
pt AS (SELECT *, CASE WHEN side = 'long' THEN 1 ELSE -1 END * CASE WHEN sum(combined_score) {W} > 0
  THEN combined_score / sum(combined_score) {W} ELSE 1.0E0 / count(*) {W} END AS weight FROM cb)"""


@query("top_bottom_n", f"WITH {TB_SQL} SELECT sec, m, prefix, side, pos, rnd(algo_score, 6) AS algo_score FROM sel")
def top_bottom_n(spark, sf):
    stored = cut_lineage(v.scored(spark, sf), "scored")
    return pf.top_bottom(stored, BY, "algo_score", "sec", N, M).select(
        "sec", "m", "prefix", "side", "pos", rnd("algo_score").alias("algo_score"))


@query("minmax_side", f"WITH {PORT_SQL} SELECT sec, m, prefix, side, rnd(algo_norm, 6) AS algo_norm FROM nm")
def minmax_side(spark, sf):
    return portfolios(spark, sf).select("sec", "m", "prefix", "side", rnd("algo_norm").alias("algo_norm"))


@query("combine_scores", f"""WITH {PORT_SQL} SELECT sec, m, prefix, side, rnd(ml_norm, 6) AS ml_norm,
  rnd(combined_score, 6) AS combined_score FROM cb""")
def combine_scores(spark, sf):
    return portfolios(spark, sf).select("sec", "m", "prefix", "side", rnd("ml_norm").alias("ml_norm"),
                                        rnd("combined_score").alias("combined_score"))


def portfolios(spark, sf):
    return pf.build_portfolios(v.scored(spark, sf), BY, "sec", N, M)


@query("portfolio_weights", """SELECT yr, mo, sector, side, company_id, rnd(CASE WHEN side = 'long' THEN 1 ELSE -1 END *
  score / sum(score) OVER (PARTITION BY yr, mo, sector, side), 8) AS weight FROM positions""")
def portfolio_weights(spark, sf):
    p = v.positions(spark, sf).drop("weight")
    return pf.score_weights(p, ["yr", "mo", "sector"], "score").select(
        "yr", "mo", "sector", "side", "company_id", rnd("weight", 8).alias("weight"))


@query("portfolio_summary", f"""WITH {PORT_SQL}
SELECT m, prefix, count(CASE WHEN side = 'long' THEN 1 END) AS total_long_positions,
  count(CASE WHEN side = 'short' THEN 1 END) AS total_short_positions, count(*) AS total_positions,
  coalesce(string_agg(printf('%.6f', round(combined_score, 6)), ',' ORDER BY combined_score DESC) FILTER (side = 'long'), '') AS long_combined_scores,
  coalesce(string_agg(printf('%.6f', round(combined_score, 6)), ',' ORDER BY combined_score DESC) FILTER (side = 'short'), '') AS short_combined_scores,
  rnd(coalesce(sum(CASE WHEN side = 'long' THEN weight END), 0), 6) AS long_weights_sum,
  rnd(coalesce(sum(CASE WHEN side = 'short' THEN weight END), 0), 6) AS short_weights_sum
FROM pt GROUP BY m, prefix""")
def portfolio_summary(spark, sf):
    s = pf.portfolio_summary(portfolios(spark, sf), BY)
    return s.withColumns({"long_weights_sum": rnd("long_weights_sum"), "short_weights_sum": rnd("short_weights_sum")})


@query("prediction_stats", """SELECT m, prefix, count(ml_score) AS n, rnd(avg(ml_score), 6) AS mean, rnd(stddev_pop(ml_score), 6) AS std,
  rnd(min(ml_score), 6) AS lo, rnd(max(ml_score), 6) AS hi FROM scored GROUP BY m, prefix""")
def prediction_stats(spark, sf):
    s = pf.prediction_stats(v.scored(spark, sf), BY, "ml_score")
    return s.select(*BY, "n", *[rnd(c).alias(c) for c in ["mean", "std", "lo", "hi"]])


@query("period_grid", f"""WITH mm AS (SELECT unnest(generate_series(min(date_trunc('month', o_orderdate)), max(date_trunc('month', o_orderdate)), INTERVAL 1 MONTH)) AS ms FROM orders)
SELECT year(ms) AS "year", month(ms) AS "month", s.sector FROM mm, (VALUES {", ".join(f"('{s[0]}')" for s in SECTORS)}) s(sector)""")
def period_grid(spark, sf):
    span = v.table(spark, sf, "orders").agg(F.min(F.to_date("o_orderdate")), F.max(F.to_date("o_orderdate"))).first()
    return pf.period_grid(spark, f"{span[0]:%Y-%m}-01", f"{span[1]:%Y-%m}-01", [s[0] for s in SECTORS])


BUILD_SQL = f"""WITH {HIST_SQL},
{PORT_SQL.replace("FROM scored)", "FROM hist WHERE seen >= 30)")}"""


@query("build_portfolios", f"""{BUILD_SQL} SELECT sec, m, prefix, side, rnd(combined_score, 6) AS combined_score, rnd(weight, 6) AS weight FROM pt""")
def build_portfolios(spark, sf):
    return full_portfolios(spark, sf).select("sec", "m", "prefix", "side", rnd("combined_score").alias("combined_score"),
                                             rnd("weight").alias("weight"))


def full_portfolios(spark, sf, p=None):
    p = v.stored_panel(spark, sf) if p is None else p
    kept = pf.enough_history(v.scored(spark, sf, p), p, "sec")
    return pf.build_portfolios(kept, BY, "sec", N, M)


TOPK_SQL = """
tk AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY algo_score DESC, sec) AS pos FROM scored),
tp AS (SELECT k, m, sec, pos, algo_score FROM tk, (VALUES (1), (5), (10)) ks(k) WHERE pos <= k),
tw AS (SELECT *, CASE WHEN sum(greatest(algo_score, 0)) OVER (PARTITION BY k, m) > 0
  THEN greatest(algo_score, 0) / sum(greatest(algo_score, 0)) OVER (PARTITION BY k, m)
  ELSE 1.0E0 / count(*) OVER (PARTITION BY k, m) END AS weight FROM tp)"""


@query("topk_portfolios", f"WITH {TOPK_SQL} SELECT k, m, sec, pos, rnd(weight, 6) AS weight FROM tw")
def topk_portfolios(spark, sf):
    return topk(spark, sf).select("k", "m", "sec", "pos", rnd("weight").alias("weight"))


def topk(spark, sf):
    return pf.topk_portfolios(v.scored(spark, sf), ["m"], "algo_score", "sec", [1, 5, 10])


@query("cap_weights", f"""WITH {TOPK_SQL} SELECT k, m, sec, rnd(least(weight, 0.1E0) / sum(least(weight, 0.1E0)) OVER (PARTITION BY k, m), 6) AS capped_weight FROM tw""")
def cap_weights(spark, sf):
    return pf.cap_weights(topk(spark, sf), ["k", "m"]).select("k", "m", "sec", rnd("capped_weight").alias("capped_weight"))
