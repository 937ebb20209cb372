"""Queries: profiling and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark import constants as C
from panelspark.functions.expr import log1p_positive, rnd, signed_log
from panelspark.operators import cleaning as cl
from panelspark.plans import views as v
from panelspark.plans.registry import query
from panelspark.plans.views import FACTORS
from panelspark.sources import sinks, tables
from panelspark.storage import cut_lineage, scratch_path

CAT = {c: cl.infer_category(c) for c in FACTORS}

PROF_SQL = "prof AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, " + ", ".join(
        f"quantile_cont({c}, {p}) AS {n}" for n, p in C.PROFILE_PROBS.items()) + " FROM factors"
    for c in FACTORS) + "), pw AS (SELECT " + ", ".join(
    f"max(CASE WHEN feature = '{c}' THEN {n} END) AS {c}_{n}" for c in FACTORS for n in C.PROFILE_PROBS) + " FROM prof)"


def wins_sql(c, src=None, cat=CAT):
    src = src or f"f.{c}"
    lo, hi = ("q0005", "q995") if cat[c] == "returns" else ("q01", "q99")
    return f"CASE WHEN {src} IS NOT NULL THEN greatest(pw.{c}_{lo}, least(pw.{c}_{hi}, {src})) END"


def log1p_sql(x):
    return f"CASE WHEN {x} > 0 THEN ln(1 + {x}) ELSE {x} END"


def slog_sql(x):
    return f"sign({x}) * ln(1 + abs({x}))"


def trans_sql(c, x, cat=CAT):
    if cat[c] in C.LOG1P_CATEGORIES:
        return log1p_sql(x)
    if cat[c] in C.SIGNED_LOG_CATEGORIES:
        return slog_sql(x)
    return x


def each(make):
    return ", ".join(f"{make(c)} AS {c}" for c in FACTORS)


def factors(spark, sf):
    """The factor panel as a stored table, which is what the profile and the cleaning read."""
    return cut_lineage(v.factors(spark, sf), "factors")


def profile(f):
    return cl.to_profile(cl.profile_table(f, FACTORS))


@query("profile_quantiles", f"WITH {PROF_SQL} SELECT feature, " + ", ".join(
    f"rnd({n}, 6) AS {n}" for n in C.PROFILE_PROBS) + " FROM prof")
def profile_quantiles(spark, sf):
    return cl.profile_table(factors(spark, sf), FACTORS).select(
        "feature", *[rnd(n).alias(n) for n in C.PROFILE_PROBS])


STATS = list(C.PROFILE_PROBS)


@query("profile_approx", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n, count(DISTINCT date_trunc('month', CASE WHEN {c} IS NOT NULL THEN dt END)) AS sketches, "
    + ", ".join(f"TRUE AS {n}_within" for n in STATS) + " FROM factors" for c in FACTORS))
def profile_approx(spark, sf):
    """Sketches per month, merged: whether each value's true rank lies within the stated error."""
    f = factors(spark, sf)
    sketches = cut_lineage(cl.profile_sketches(f.withColumn("mon", F.trunc("dt", "MM")), ["mon"], FACTORS), "sketches")
    merged = cut_lineage(cl.merged_profile(sketches), "merged")
    ranks = cl.profile_ranks(f, cl.to_profile(merged))
    p, e = F.create_map(*[F.lit(x) for n in STATS for x in (n, C.PROFILE_PROBS[n])])[F.col("stat")], cl.sketch_error()
    within = ranks.withColumn("ok", (F.col("below") <= p + e) & (F.col("upto") >= p - e))
    wide = within.groupBy("feature").agg(*[F.max(F.when(F.col("stat") == n, F.col("ok"))).alias(f"{n}_within") for n in STATS])
    counts = sketches.groupBy("feature").agg(F.sum("n").alias("n"), F.count("*").alias("sketches"))
    return counts.join(wide, "feature").select("feature", "n", "sketches", *[f"{n}_within" for n in STATS])


SAMPLE_SQL = f"""sc AS (SELECT *, ('0x' || left(md5(concat_ws('|', sec, dt, '{C.SAMPLE_SEED}')), 8))::BIGINT
  % CAST(greatest(1, ceil((SELECT count(*) FROM factors) / 10000)) AS BIGINT) AS chunk FROM factors),
sl AS ({" UNION ALL ".join(f"SELECT chunk, sec, dt, '{c}' AS feature, {c} AS value FROM sc WHERE {c} IS NOT NULL" for c in FACTORS)}),
sp AS (SELECT *, row_number() OVER (PARTITION BY chunk, feature ORDER BY md5(concat_ws('|', feature, sec, dt, '{C.SAMPLE_SEED}')), sec, dt) AS pick FROM sl)"""


@query("profile_sampled", f"WITH {SAMPLE_SQL} SELECT feature, " + ", ".join(
    f"rnd(quantile_cont(value, {p}), 6) AS {n}" for n, p in C.PROFILE_PROBS.items()) + " FROM sp WHERE pick <= 4000 GROUP BY feature")
def profile_sampled(spark, sf):
    """Sampling is the feature here; the cleaning reads the exact profile."""
    cells = cl.profile_sample(factors(spark, sf), ["sec", "dt"], FACTORS, chunk_rows=10000, per_chunk=4000)
    picked = cells.select(*[F.when(F.col("feature") == c, F.col("value")).alias(c) for c in FACTORS])
    return cl.profile_table(cut_lineage(picked, "sampled"), FACTORS).select("feature", *[rnd(n).alias(n) for n in C.PROFILE_PROBS])


@query("feature_category", "SELECT p_partkey, p_name, CASE " + " ".join(
    f"WHEN contains(lower(p_name), '{w}') THEN '{c}'"
    for w, c in [*[(t, 'returns') for t in C.RETURN_TAGS], *C.CATEGORY_KEYWORDS]) + " ELSE 'other' END AS category FROM part")
def feature_category(spark, sf):
    return v.table(spark, sf, "part").select("p_partkey", "p_name", cl.category_of(F.col("p_name")).alias("category"))


@query("winsorize", f"WITH {PROF_SQL} SELECT f.sec, f.dt, " + each(lambda c: f"rnd({wins_sql(c)}, 6)") + " FROM factors f, pw")
def winsorize(spark, sf):
    f = factors(spark, sf)
    prof = profile(f)
    return f.select("sec", "dt", *[
        rnd(cl.winsorized(F.col(c), CAT[c], prof[c])).alias(c) for c in FACTORS])


@query("log1p_positive", "SELECT sec, dt, " + each(lambda c: f"rnd({log1p_sql(c)}, 6)") + " FROM factors")
def log1p_positive_q(spark, sf):
    return v.factors(spark, sf).select("sec", "dt", *[rnd(log1p_positive(F.col(c))).alias(c) for c in FACTORS])


@query("signed_log", "SELECT sec, dt, " + each(lambda c: f"rnd({slog_sql(c)}, 6)") + " FROM factors")
def signed_log_q(spark, sf):
    return v.factors(spark, sf).select("sec", "dt", *[rnd(signed_log(F.col(c))).alias(c) for c in FACTORS])


@query("transform_by_category", "SELECT sec, dt, " + each(lambda c: f"rnd({trans_sql(c, c)}, 6)") + " FROM factors")
def transform_by_category(spark, sf):
    return v.factors(spark, sf).select("sec", "dt", *[
        rnd(cl.transformed(F.col(c), CAT[c])).alias(c) for c in FACTORS])


@query("impute_median", f"WITH {PROF_SQL} SELECT f.sec, f.dt, "
       + each(lambda c: f"rnd(coalesce(f.{c}, pw.{c}_median, 0), 6)") + " FROM factors f, pw")
def impute_median(spark, sf):
    f = factors(spark, sf)
    prof = profile(f)
    return f.na.fill({c: prof[c]["median"] or 0.0 for c in FACTORS}).select("sec", "dt", *[rnd(c).alias(c) for c in FACTORS])


@query("missing_flags", "SELECT sec, dt, " + ", ".join(
    f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS {c}_was_missing" for c in FACTORS) + " FROM factors")
def missing_flags(spark, sf):
    done = cl.rowwise(v.factors(spark, sf), FACTORS, {}, flags=True)
    return done.select("sec", "dt", *[f"{c}_was_missing" for c in FACTORS])


def scale_sql(src):
    """Scaled columns of the CTE ``src`` that has sec, dt, mon and the factors."""
    return f"""
md AS (SELECT mon, {", ".join(f"median({c}) AS {c}_med" for c in FACTORS)} FROM {src} GROUP BY mon),
dv AS (SELECT x.mon, {", ".join(f"abs(x.{c} - md.{c}_med) AS {c}" for c in FACTORS)} FROM {src} x JOIN md ON x.mon = md.mon),
ma AS (SELECT mon, {", ".join(f"median({c}) AS {c}_mad" for c in FACTORS)} FROM dv GROUP BY mon),
sc AS (SELECT x.sec, x.dt, {", ".join(
    f"CASE WHEN x.{c} IS NOT NULL THEN greatest(-8, least(8, (x.{c} - md.{c}_med) / CASE WHEN ma.{c}_mad = 0 THEN 1e-9 ELSE ma.{c}_mad END)) END AS {c}"
    for c in FACTORS)} FROM {src} x JOIN md ON x.mon = md.mon JOIN ma ON x.mon = ma.mon)"""


@query("robust_scale_month", "WITH fm AS (SELECT *, date_trunc('month', dt) AS mon FROM factors), "
       + scale_sql("fm") + " SELECT sec, dt, " + each(lambda c: f"rnd({c}, 5)") + " FROM sc")
def robust_scale_month(spark, sf):
    f = v.factors(spark, sf).withColumn("mon", F.trunc("dt", "MM"))
    return cl.robust_scale(f, "mon", FACTORS).select("sec", "dt", *[rnd(c, 5).alias(c) for c in FACTORS])


CLEAN_SQL = f"""{PROF_SQL},
cw AS (SELECT f.sec, f.dt, date_trunc('month', f.dt) AS mon, {each(lambda c: wins_sql(c))} FROM factors f, pw),
ct AS (SELECT cw.sec, cw.dt, cw.mon, {each(lambda c: f"coalesce({trans_sql(c, 'cw.' + c)}, pw.{c}_median, 0)")} FROM cw, pw),
{scale_sql("ct")}"""


def cleaned(spark, sf):
    f = factors(spark, sf)
    return cl.clean_panel(f.withColumn("mon", F.trunc("dt", "MM")), "mon", FACTORS, profile(f))


@query("clean_panel", f"WITH {CLEAN_SQL} SELECT sec, dt, " + each(lambda c: f"rnd({c}, 5)") + " FROM sc")
def clean_panel(spark, sf):
    return cleaned(spark, sf).select("sec", "dt", *[rnd(c, 5).alias(c) for c in FACTORS])


QA_SQL = f"WITH {PROF_SQL} " + " UNION ALL ".join(f"""
SELECT '{c}' AS feature, count(CASE WHEN {wins_sql(c)} <> f.{c} THEN 1 END) AS clipped,
  rnd(count(CASE WHEN {wins_sql(c)} <> f.{c} THEN 1 END) / count(f.{c}), 6) AS clipped_pct_non_null,
  count(*) - count(f.{c}) AS missing, rnd((count(*) - count(f.{c})) / count(f.{c}), 6) AS missing_rate
FROM factors f, pw""" for c in FACTORS)


@query("clean_qa", QA_SQL)
def clean_qa(spark, sf):
    f = factors(spark, sf)
    return cl.clean_qa(f, FACTORS, profile(f)).select(
        "feature", "clipped", rnd("clipped_pct_non_null").alias("clipped_pct_non_null"), "missing",
        rnd("missing_rate").alias("missing_rate"))


@query("clean_report", f"WITH qa AS ({QA_SQL}), su AS (SELECT count(DISTINCT date_trunc('month', dt)) AS months_processed, count(*) AS total_rows FROM factors) SELECT qa.*, su.* FROM qa, su")
def clean_report(spark, sf):
    """QA and summary of the pass that writes the panel."""
    f = factors(spark, sf)
    _, qa, summary = cl.clean_with_report(f.withColumn("mon", F.trunc("dt", "MM")), "mon", FACTORS, profile(f))
    rates = {c: rnd(c) for c in ("clipped_pct_non_null", "missing_rate")}
    return qa.withColumns({**rates, **{c: summary.select(c).scalar() for c in ("months_processed", "total_rows")}})


@query("clean_summary", f"""SELECT count(DISTINCT date_trunc('month', dt)) AS months_processed,
  {len(FACTORS)} AS n_features, count(*) AS total_rows FROM factors""")
def clean_summary(spark, sf):
    f = v.factors(spark, sf).withColumn("mon", F.trunc("dt", "MM"))
    return cl.clean_summary(f, "mon", FACTORS)


def strings(spark, sf):
    k = F.col("o_orderkey")
    return v.table(spark, sf, "orders").select(
        k, F.when(k % 20 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("mostly_num"),
        F.when(k % 5 == 0, "-").otherwise(F.col("o_custkey").cast("string")).alias("often_text"))


@query("coerce_numeric", """
WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 20 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS mostly_num,
  CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE CAST(o_custkey AS VARCHAR) END AS often_text FROM orders)
SELECT o_orderkey, CASE WHEN (SELECT avg(CASE WHEN TRY_CAST(mostly_num AS DOUBLE) IS NULL THEN 0 ELSE 1 END) FROM s) >= 0.9
  THEN TRY_CAST(mostly_num AS DOUBLE) END AS mostly_num, often_text FROM s""")
def coerce_numeric(spark, sf):
    return cl.coerce_numeric(strings(spark, sf), ["mostly_num", "often_text"])


COVERED = {g: [c for c in FACTORS if any(__import__("re").search(p, c) for p in pats)]
           for g, pats in cl.COVERAGE_GROUPS.items()}


@query("column_coverage", " UNION ALL ".join(f"""
SELECT '{g}' AS name_group, '{c}' AS feature, count({c}) AS known, rnd(count({c}) / count(*) * 100, 6) AS pct,
  rnd(avg({c}), 4) AS mean, rnd(stddev_samp({c}), 4) AS std, rnd(min({c}), 5) AS lo, rnd(max({c}), 5) AS hi FROM factors"""
    for g, cs in COVERED.items() for c in cs))
def column_coverage(spark, sf):
    return cl.column_coverage(v.factors(spark, sf), FACTORS).select(
        "name_group", "feature", "known", rnd("pct").alias("pct"), rnd("mean", 4).alias("mean"),
        rnd("std", 4).alias("std"), rnd("lo", 5).alias("lo"), rnd("hi", 5).alias("hi"))


@query("profile_stored", f"WITH {PROF_SQL} SELECT feature, " + ", ".join(f"rnd({n}, 6) AS {n}" for n in C.PROFILE_PROBS) + " FROM prof")
def profile_stored(spark, sf):
    """The profile written to its file and loaded from there."""
    path = scratch_path(spark, "profile")
    sinks.write_profile(cl.profile_table(factors(spark, sf), FACTORS), path)
    return tables.read_profile(spark, path).select("feature", *[rnd(n).alias(n) for n in C.PROFILE_PROBS])


# A theme file that overrules two of the keyword categories.
THEMES = {"beta_60m": "returns", "sale_gr1": "value"}
THEMED = {c: cl.infer_category(c, THEMES) for c in FACTORS}
RAW_SQL = f"""{PROF_SQL},
cw AS (SELECT f.sec, f.dt, date_trunc('month', f.dt) AS mon, {each(lambda c: wins_sql(c, cat=THEMED))} FROM factors f, pw),
ct AS (SELECT cw.sec, cw.dt, cw.mon, {each(lambda c: f"coalesce({trans_sql(c, 'cw.' + c, THEMED)}, pw.{c}_median, 0)")} FROM cw, pw),
{scale_sql("ct")}"""


def raw_rows(spark, sf):
    """The factors as a raw file has them: everything text, missing cells spelled out, a name given twice."""
    f = v.factors(spark, sf)
    text = [F.coalesce(F.col(c).cast("string"), F.lit("" if i % 2 else "NaN")).alias(c) for i, c in enumerate(FACTORS)]
    return f.select(F.col("sec").alias("id"), F.col("dt").cast("string").alias("date"), *text, F.lit("again").alias(FACTORS[0]))


@query("clean_raw", f"WITH {RAW_SQL} SELECT CAST(sec AS VARCHAR) AS id, dt AS date, " + each(lambda c: f"rnd(CAST(CAST({c} AS FLOAT) AS DOUBLE), 4)") + " FROM sc")
def clean_raw(spark, sf):
    """The whole chain from raw text: unique names, typed keys, numbers, theme file, stored profile, float output."""
    themes_path, profile_path = scratch_path(spark, "themes"), scratch_path(spark, "profile")
    sinks.write_csv(spark.createDataFrame(list(THEMES.items()), "feature string, theme string"), themes_path)
    themes = {r["feature"]: r["theme"] for r in tables.read_feature_dim(spark, themes_path).collect()}  # one row per feature
    raw = cut_lineage(cl.standard_columns(raw_rows(spark, sf)), "raw")  # read twice: the shares that convert, then the numbers
    typed = cut_lineage(cl.coerce_numeric(raw, FACTORS, share=0.5), "typed")
    sinks.write_profile(cl.profile_table(typed, FACTORS), profile_path)
    profile = cl.to_profile(tables.read_profile(spark, profile_path))
    done = cl.clean_panel(typed, "month_key", FACTORS, profile, themes, as_float=True)
    return done.select("id", "date", *[rnd(F.col(c).cast("double"), 4).alias(c) for c in FACTORS])
