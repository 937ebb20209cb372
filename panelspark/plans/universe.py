"""Queries: sector mapping and universe."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.constants import SECTORS
from panelspark.functions.expr import rnd
from panelspark.operators import universe as u
from panelspark.plans import views as v
from panelspark.plans.registry import query
from panelspark.plans.signals import SECTOR_CASE, sector_name
from panelspark.sources import sinks
from panelspark.storage import scratch_path

# Sector file stand-in: one row per panel row, some keys and codes missing by rule.
INFO_SQL = """
info AS (SELECT CASE WHEN (sec + day(dt)) % 31 = 0 THEN NULL ELSE CAST(sec AS VARCHAR) END AS id, dt AS date, sec AS gvkey,
  CASE WHEN day(dt) = 17 THEN NULL ELSE CAST(gics AS DOUBLE) END AS gics FROM panel),
good AS (SELECT *, CASE WHEN gics IS NULL THEN '' ELSE CAST(CAST(gics AS BIGINT) AS VARCHAR) END AS gics_str
  FROM info WHERE id IS NOT NULL AND date IS NOT NULL AND gvkey IS NOT NULL)"""


def info(spark, sf):
    d = F.dayofmonth("dt")
    return v.panel(spark, sf).select(
        F.when((F.col("sec") + d) % 31 != 0, F.col("sec").cast("string")).alias("id"),
        F.col("dt").alias("date"), F.col("sec").alias("gvkey"),
        F.when(d != 17, F.col("gics").cast("double")).alias("gics"))


def good(spark, sf):
    return u.drop_invalid(info(spark, sf)).withColumn("gics_str", u.gics_text(F.col("gics")))


@query("drop_invalid", f"WITH {INFO_SQL} SELECT id, date, gvkey, gics FROM good")
def drop_invalid(spark, sf):
    return u.drop_invalid(info(spark, sf))


@query("gics_text", f"WITH {INFO_SQL} SELECT id, date, gics_str FROM good")
def gics_text(spark, sf):
    return good(spark, sf).select("id", "date", "gics_str")


@query("sector_prefix_filter", f"WITH {INFO_SQL} SELECT id, date, gics_str FROM good WHERE gics_str LIKE '20%'")
def sector_prefix_filter(spark, sf):
    return good(spark, sf).filter(u.in_sector(F.col("gics_str"), "20")).select("id", "date", "gics_str")


@query("sector_lookup", f"""WITH {INFO_SQL}, s AS (SELECT *, {SECTOR_CASE.replace("left(gics, 2)", "left(gics_str, 2)")} AS sector_name FROM good)
SELECT id, date, gvkey, gics, gics_str, sector_name, left(gics_str, 2) AS gics_prefix FROM s WHERE sector_name IS NOT NULL""")
def sector_lookup(spark, sf):
    return u.sector_lookup(good(spark, sf)).select(
        "id", "date", "gvkey", "gics", "gics_str", "sector_name", "gics_prefix")


@query("sector_semi_join", f"""WITH {INFO_SQL}
SELECT sec, dt, rnd(prc, 6) AS prc FROM panel WHERE CAST(sec AS VARCHAR) IN (SELECT id FROM good WHERE gics_str LIKE '20%')""")
def sector_semi_join(spark, sf):
    ids = good(spark, sf).filter(u.in_sector(F.col("gics_str"), "20"))
    p = v.panel(spark, sf).withColumn("id", F.col("sec").cast("string"))
    return u.keep_sector(p, ids).select("sec", "dt", rnd("prc").alias("prc"))


LEFT_SQL = f"""WITH {INFO_SQL}, l AS (SELECT id, date, min(gics) AS gics FROM good GROUP BY id, date)
SELECT p.sec, p.dt, l.gics FROM panel p LEFT JOIN l ON CAST(p.sec AS VARCHAR) = l.id AND p.dt = l.date"""


@query("sector_left_join", LEFT_SQL)
def sector_left_join(spark, sf):
    p = v.panel(spark, sf).select("sec", "dt", F.col("sec").cast("string").alias("id"), F.col("dt").alias("date"))
    return u.attach_codes(p, good(spark, sf)).select("sec", "dt", "gics")


def bucketed(spark, sf, buckets=16):
    """Panel and lookup written by (security, date) into as many buckets."""
    p = v.panel(spark, sf).select("sec", "dt", F.col("sec").cast("string").alias("id"), F.col("dt").alias("date"))
    write = lambda df, name: sinks.write_bucketed(df, scratch_path(spark, name), ["id", "date"], buckets)
    return write(p, "panel_buckets"), write(good(spark, sf), "lookup_buckets")


@query("sector_left_join_bucketed", LEFT_SQL)
def sector_left_join_bucketed(spark, sf):
    """The same join of two stored tables, without an exchange."""
    return u.attach_codes(*bucketed(spark, sf)).select("sec", "dt", "gics")


@query("gics_counts", f"""WITH {INFO_SQL}
SELECT gics_str, count(*) AS n FROM good GROUP BY gics_str ORDER BY n DESC, gics_str LIMIT 10""")
def gics_counts(spark, sf):
    return u.code_counts(good(spark, sf), "gics_str")


@query("sector_validation", f"""WITH {INFO_SQL}, mine AS (SELECT * FROM good WHERE gics_str LIKE '20%'),
h AS (SELECT count(CASE WHEN CAST(sec AS VARCHAR) IN (SELECT id FROM mine) THEN 1 END) AS hits, count(*) AS n FROM panel)
SELECT count(DISTINCT id) AS companies, count(*) AS observations, min(date) AS start_date, max(date) AS end_date,
  (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT DISTINCT gics_str AS c FROM mine) q) AS codes,
  (SELECT hits FROM h) AS covered_rows, rnd((SELECT hits / n FROM h), 6) AS coverage FROM mine""")
def sector_validation(spark, sf):
    p = v.panel(spark, sf).select(F.col("sec").cast("string").alias("id"), F.col("dt").alias("date"))
    return u.sector_validation(good(spark, sf), p, "20", "id", "date", "gics_str").withColumn("coverage", rnd("coverage"))


RAW_SQL = """
raw AS (SELECT l_suppkey AS sec, CAST(l_shipdate AS DATE) AS date, l_orderkey, l_linenumber,
  CASE WHEN l_orderkey % 29 = 0 THEN 'bad' ELSE CAST(CAST(l_extendedprice * 100 AS BIGINT) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS VARCHAR) END AS prc,
  CASE WHEN l_linenumber % 5 = 0 THEN 'C' ELSE CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) END AS stock_ret FROM lineitem)"""


def raw(spark, sf):
    k = F.col("l_orderkey")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return v.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("sec"), F.to_date("l_shipdate").alias("date"), "l_orderkey", "l_linenumber",
        F.when(k % 29 == 0, "bad").otherwise((cents * F.when(F.col("l_returnflag") == "R", -1).otherwise(1)).cast("string")).alias("prc"),
        F.when(F.col("l_linenumber") % 5 == 0, "C").otherwise(F.round(F.col("l_discount") * 100).cast("bigint").cast("string")).alias("stock_ret"))


@query("panel_prepare", f"""WITH {RAW_SQL.replace("CAST(l_extendedprice * 100 AS BIGINT)", "CAST(round(l_extendedprice * 100) AS BIGINT)")},
n AS (SELECT *, abs(TRY_CAST(prc AS DOUBLE)) AS p FROM raw),
r AS (SELECT *, row_number() OVER (PARTITION BY sec, date ORDER BY l_orderkey, l_linenumber) AS rn FROM n WHERE p IS NOT NULL)
SELECT sec, date, p AS prc, TRY_CAST(stock_ret AS DOUBLE) AS stock_ret, year(date) AS "year", month(date) AS "month" FROM r WHERE rn = 1""")
def panel_prepare(spark, sf):
    return u.prepare_panel(raw(spark, sf), ["sec"], ["l_orderkey", "l_linenumber"], "date", "prc", ["stock_ret"], ["stock_ret"])


@query("returns_rebuild", """
WITH s AS (SELECT sec, dt, prc, ret * 100 AS stock_ret FROM panel_ret),
q AS (SELECT quantile_cont(abs(stock_ret), 0.5) > 0.5 OR quantile_cont(abs(stock_ret), 0.99) > 5 AS bad FROM s)
SELECT sec, dt, rnd(CASE WHEN (SELECT bad FROM q) THEN prc / lag(prc) OVER (PARTITION BY sec ORDER BY dt) - 1 ELSE stock_ret END, 6) AS stock_ret FROM s""")
def returns_rebuild(spark, sf):
    s = v.panel_ret(spark, sf).select("sec", "dt", "prc", (F.col("ret") * 100).alias("stock_ret"))
    return u.rebuild_returns(s, ["sec"], "dt", "prc", "stock_ret").select("sec", "dt", rnd("stock_ret").alias("stock_ret"))


@query("sector_params", f"""
WITH s AS (SELECT s_suppkey, CASE WHEN s_nationkey = 0 THEN 'unknown' ELSE {SECTOR_CASE} END AS sector
  FROM supplier JOIN secdim ON s_suppkey = sec)
SELECT s_suppkey, sector, CASE sector {" ".join(f"WHEN '{n}' THEN {w}" for n, _, w, _ in SECTORS)} ELSE 60 END AS ma_window,
  CASE sector {" ".join(f"WHEN '{n}' THEN {m}" for n, _, _, m in SECTORS)} ELSE 120 END AS mom_lag,
  CASE sector {" ".join(f"WHEN '{n}' THEN '{p}'" for n, p, _, _ in SECTORS)} ELSE '55' END AS gics_prefix FROM s""")
def sector_params(spark, sf):
    s = v.secdim(spark, sf).join(v.table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("sec"))
    named = s.select("s_suppkey", F.when(F.col("s_nationkey") == 0, "unknown").otherwise(sector_name()).alias("sector"))
    return u.sector_params(named)


@query("sector_members", f"""WITH s AS (SELECT DISTINCT {SECTOR_CASE} AS sector, sec FROM panel)
SELECT sector, sec, row_number() OVER (PARTITION BY sector ORDER BY sec) AS position FROM s""")
def sector_members(spark, sf):
    return u.sector_members(v.panel(spark, sf).withColumn("sector", sector_name()), "sector", "sec")


@query("top_by_history", "SELECT sec, count(*) AS n FROM panel GROUP BY sec HAVING count(*) >= 100 ORDER BY n DESC, sec LIMIT 10")
def top_by_history(spark, sf):
    return u.top_by_history(v.panel(spark, sf), "sec", 100, 10)


@query("calendar_slice", """
WITH d AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS i FROM (SELECT DISTINCT dt FROM panel) q),
n AS (SELECT count(*) AS n FROM d), lo AS (SELECT CASE WHEN n > 200 THEN n // 2 ELSE greatest(0, n - 100) END AS lo FROM n)
SELECT p.sec, p.dt, rnd(p.prc, 6) AS prc FROM panel p JOIN d ON p.dt = d.dt, lo WHERE d.i >= lo.lo AND d.i < lo.lo + 100""")
def calendar_slice(spark, sf):
    return u.calendar_slice(v.stored_panel(spark, sf), "dt", 100).select("sec", "dt", rnd("prc").alias("prc"))
