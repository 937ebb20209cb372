"""Queries: sources, sinks and the cleaning stream. Sinks write the given tables to the shared
folder and return what a reader gets back."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions.expr import rnd
from panelspark.operators import indicators as ind
from panelspark.plans import views as v
from panelspark.plans.cleaning import FACTORS, PROF_SQL, each, profile, scale_sql, trans_sql, wins_sql
from panelspark.plans.registry import query
from panelspark.plans.reports import METRICS_LIST, METRIC_SQL, DD_SQL, metrics
from panelspark.plans.signals import FEATURES_SQL, SELECT_SQL, candidates
from panelspark.sources import sinks, tables
from panelspark.storage import scratch_path
from panelspark.streaming import cleaning as stream


def stored(df, spark, name, fmt="csv"):
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if fmt == "csv" else writer.parquet(path)
    return path


PANEL_SQL = "SELECT sec, dt, rnd(prc, 6) AS prc, vol, gics FROM panel"


@query("src_panel_csv", PANEL_SQL)
def src_panel_csv(spark, sf):
    p = v.panel(spark, sf)
    path = stored(p, spark, "panel_csv")
    return tables.read_panel_csv(spark, path, p.schema).select("sec", "dt", rnd("prc").alias("prc"), "vol", "gics")


@query("src_feature_dim", """SELECT 'acronyms' AS layout, lower(trim(p_brand)) AS feature, 'other' AS theme FROM part GROUP BY p_brand
UNION ALL SELECT 'themes', lower(p_brand), lower(min(p_type)) FROM part GROUP BY p_brand""")
def src_feature_dim(spark, sf):
    brands = v.table(spark, sf, "part").groupBy("p_brand").agg(F.min("p_type").alias("p_type"))
    one = stored(brands.select(F.col("p_type").alias("Feature"), F.col("p_brand").alias("Acronym")), spark, "dim_acronyms")
    two = stored(brands.select(F.col("p_brand").alias("feature"), F.col("p_type").alias("theme")), spark, "dim_themes")
    read = lambda path, layout: tables.read_feature_dim(spark, path).select(F.lit(layout).alias("layout"), "*")
    return read(one, "acronyms").unionByName(read(two, "themes"))


INFO = """SELECT CAST(sec AS VARCHAR) AS id, sec AS gvkey, '01' AS iid, 'USA' AS excntry,
  CASE WHEN day(max(dt)) = 17 THEN NULL ELSE CAST(min(gics) AS DOUBLE) END AS gics, 100.0E0 + sec % 7 AS sic, CAST(NULL AS DOUBLE) AS naics,
  CAST(year(max(dt)) AS SMALLINT) AS "year", CAST(month(max(dt)) AS TINYINT) AS "month", max(dt) AS date, last_day(max(dt)) AS eom
FROM panel GROUP BY sec, date_trunc('month', dt)"""


def sectorinfo(spark, sf):
    last = F.max("dt")
    return v.panel(spark, sf).groupBy("sec", F.trunc("dt", "MM").alias("mon")).agg(last.alias("date"), F.min("gics").cast("double").alias("g")).select(
        F.col("sec").cast("string").alias("id"), F.col("sec").alias("gvkey"), F.lit("01").alias("iid"), F.lit("USA").alias("excntry"),
        F.when(F.dayofmonth("date") != 17, F.col("g")).alias("gics"), (100.0 + F.col("sec") % 7).alias("sic"), F.lit(None).cast("double").alias("naics"),
        F.year("date").alias("year"), F.month("date").alias("month"), "date", F.last_day("date").alias("eom"))


@query("src_sectorinfo", INFO)
def src_sectorinfo(spark, sf):
    return tables.read_sectorinfo(spark, stored(sectorinfo(spark, sf), spark, "sectorinfo"))


@query("sink_parquet_cache", INFO)
def sink_parquet_cache(spark, sf):
    csv, parquet = stored(sectorinfo(spark, sf), spark, "sectorinfo"), scratch_path(spark, "sectorinfo_parquet")
    tables.parquet_of_csv(spark, csv, parquet, tables.SECTORINFO_SCHEMA)
    return tables.parquet_of_csv(spark, csv, parquet, tables.SECTORINFO_SCHEMA)


@query("src_pruned", "SELECT l_suppkey, CAST(l_shipdate AS DATE) AS dt, l_extendedprice FROM lineitem")
def src_pruned(spark, sf):
    return v.table(spark, sf, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("dt"), "l_extendedprice")


CAND_SQL = f"""WITH {SELECT_SQL} SELECT sec, dt, sector, candidate_type, selection_rank, rnd(composite_score, 6) AS composite_score,
  year(dt) AS "year", month(dt) AS "month" FROM picked"""
CAND_COLS = ["sec", "dt", "sector", "candidate_type", "selection_rank", "composite_score", "year", "month"]


def stored_candidates(spark, sf):
    path = scratch_path(spark, "candidates")
    sinks.write_partitioned(candidates(spark, sf).select(*CAND_COLS), path)
    return path


@query("sink_partitioned", CAND_SQL)
def sink_partitioned(spark, sf):
    out = spark.read.parquet(stored_candidates(spark, sf))
    return out.select(*CAND_COLS).withColumn("composite_score", rnd("composite_score"))


@query("src_partition_pruned", CAND_SQL + " WHERE year(dt) = 1997 AND month(dt) = 6")
def src_partition_pruned(spark, sf):
    out = tables.read_month(spark, stored_candidates(spark, sf), 1997, 6)
    return out.select(*CAND_COLS).withColumn("composite_score", rnd("composite_score"))


OHLC_COLS = ["open", "high", "low", "close"]


@query("sink_company_csv", "SELECT concat('comp_', lpad(CAST(sec AS VARCHAR), 6, '0'), '_01') AS company_id, ym, "
       + ", ".join(f"rnd({c}, 4) AS {c}" for c in OHLC_COLS) + ", volume FROM ohlc")
def sink_company_csv(spark, sf):
    bars = v.ohlc(spark, sf).select(
        F.concat(F.lit("comp_"), F.lpad(F.col("sec").cast("string"), 6, "0"), F.lit("_01")).alias("company_id"), "ym", *OHLC_COLS, "volume")
    path = scratch_path(spark, "company_csv")
    sinks.write_company_csv(bars, path)
    back = tables.read_company_csv(spark, path, "ym int, open double, high double, low double, close double, volume double")
    return back.select("company_id", "ym", *[rnd(c, 4).alias(c) for c in OHLC_COLS], "volume")


@query("sink_portfolio_json", """SELECT concat('portfolio_', yr, '_', lpad(CAST(mo AS VARCHAR), 2, '0'), '_', sector) AS doc,
  sector, yr, mo, count(CASE WHEN side = 'long' THEN 1 END) AS total_long, count(CASE WHEN side = 'short' THEN 1 END) AS total_short,
  rnd(max(CASE WHEN side = 'long' THEN score END), 6) AS best_long FROM positions GROUP BY yr, mo, sector""")
def sink_portfolio_json(spark, sf):
    path = scratch_path(spark, "portfolios")
    sinks.write_portfolios(v.positions(spark, sf), path)
    item = "array<struct<company_id:string,combined_score:double,candidate_type:string,portfolio_weight:double>>"
    docs = spark.read.schema(f"long_positions {item}, short_positions {item}, "
                             "metadata struct<sector:string,target_year:int,target_month:int>, doc string").json(path)
    return docs.select("doc", "metadata.sector", F.col("metadata.target_year").alias("yr"), F.col("metadata.target_month").alias("mo"),
                       F.size("long_positions").alias("total_long"), F.size("short_positions").alias("total_short"),
                       rnd(F.get("long_positions", F.lit(0))["combined_score"]).alias("best_long"))


@query("src_portfolio_json", "SELECT yr, mo, sector, side, company_id, rnd(score, 6) AS combined_score, rnd(weight, 6) AS portfolio_weight FROM positions")
def src_portfolio_json(spark, sf):
    path = scratch_path(spark, "portfolios")
    sinks.write_portfolios(v.positions(spark, sf), path)
    back = tables.read_portfolios(spark, path)
    return back.select("yr", "mo", "sector", "side", "company_id", rnd("combined_score").alias("combined_score"),
                       rnd("portfolio_weight").alias("portfolio_weight"))


@query("sink_metrics", f"WITH {DD_SQL}, mt AS (SELECT {METRIC_SQL} FROM dd) SELECT " + ", ".join(f"rnd({c}, 6) AS {c}" for c in METRICS_LIST) + " FROM mt")
def sink_metrics(spark, sf):
    path = scratch_path(spark, "metrics")
    sinks.write_metrics(metrics(spark, sf), path)
    back = spark.read.schema(", ".join(f"{c} double" for c in METRICS_LIST)).json(path)
    return back.select(*[rnd(c).alias(c) for c in METRICS_LIST])


RET_SQL = "SELECT ym, rnd(portfolio_return, 6) AS portfolio_return, rnd(bench_return, 6) AS bench_return, positions_count FROM monthly"


@query("sink_csv", RET_SQL)
def sink_csv(spark, sf):
    path = scratch_path(spark, "returns_csv")
    sinks.write_csv(v.monthly(spark, sf), path)
    back = spark.read.schema("ym int, portfolio_return double, bench_return double, positions_count bigint").csv(path, header=True)
    return back.select("ym", rnd("portfolio_return").alias("portfolio_return"), rnd("bench_return").alias("bench_return"), "positions_count")


@query("sink_text_lines", r"""SELECT doc_id || chr(9) || regexp_replace(text, '[\r\n\t]+', ' ', 'g') AS value FROM documents""")
def sink_text_lines(spark, sf):
    path = scratch_path(spark, "text_lines")
    sinks.write_text_lines(v.table(spark, sf, "documents"), path, "doc_id")
    return spark.read.text(path)


@query("src_filings_union", "SELECT doc_id, gvkey, date, file_type, rf, mgmt, text, yr FROM filings")
def src_filings_union(spark, sf):
    f = v.filings(spark, sf)
    layout = {2023: ["rf", "mgmt"], 2024: ["text"], 2025: ["rf", "mgmt"]}
    paths = {y: stored(f.filter(F.col("yr") == y).select("doc_id", "gvkey", "date", "file_type", *cols), spark, f"text_{y}", "parquet")
             for y, cols in layout.items()}
    return tables.read_filings(spark, paths, range(2022, 2026)).select("doc_id", "gvkey", "date", "file_type", "rf", "mgmt", "text", "yr")


@query("sink_features", f"WITH {FEATURES_SQL} SELECT sec, day, " + ", ".join(f"rnd(coalesce({c}, -1234), 8) AS {c}" for c in ind.feature_names()) + " FROM feat")
def sink_features(spark, sf):
    path = scratch_path(spark, "features")
    o = v.bars(spark, sf)
    sinks.write_features(ind.feature_grid(o), ind.trading_calendar(o, "ym"), path, ind.feature_names())
    back = spark.read.parquet(f"{path}/features")
    return back.select("sec", "day", *[rnd(c, 8).alias(c) for c in ind.feature_names()])


@query("src_returns", """SELECT make_date(CAST(ym // 100 AS BIGINT), CAST(ym % 100 AS BIGINT), 1) AS date, rnd(portfolio_return, 6) AS monthly_return FROM monthly""")
def src_returns(spark, sf):
    m = v.monthly(spark, sf).select(F.floor(F.col("ym") / 100).alias("year"), (F.col("ym") % 100).alias("month"), "portfolio_return")
    path = stored(m, spark, "monthly_returns")
    return tables.read_returns(spark, [scratch_path(spark, "absent"), path]).withColumn("monthly_return", rnd("monthly_return"))


STREAM_SQL = f"""WITH {PROF_SQL},
cw AS (SELECT f.sec, f.dt, date_trunc('month', f.dt) AS mon, {each(lambda c: wins_sql(c))} FROM factors f, pw),
ct AS (SELECT cw.sec, cw.dt, cw.mon, {each(lambda c: f"coalesce({trans_sql(c, 'cw.' + c)}, pw.{c}_median, 0)")} FROM cw, pw),
{scale_sql("ct")} SELECT sec, dt, {each(lambda c: f"rnd({c}, 5)")} FROM sc"""


@query("clean_stream", STREAM_SQL)
def clean_stream(spark, sf):
    f = v.factors(spark, sf).withColumn("mon", F.trunc("dt", "MM")).drop("gics")
    arriving = stored(f, spark, "arriving", "parquet")
    base = scratch_path(spark, "stream")
    rows = stream.read_arriving(spark, arriving, spark.read.parquet(arriving).schema)
    run = stream.clean_stream(rows, profile(spark.read.parquet(arriving)), FACTORS, f"{base}/staging", f"{base}/out", f"{base}/state")
    run.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("sec", "dt", *[rnd(c, 5).alias(c) for c in FACTORS])
