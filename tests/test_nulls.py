"""NULL keys are groups, NaN is a missing value, and nothing is cut or dropped on the way."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from panelspark.functions.expr import same_key
from panelspark.operators import cleaning as cl, indicators as ind, performance as pe, portfolio as pf, selection as sel, text as tx, universe as u
from panelspark.plans import views as v
from panelspark.storage import application_dir, release, scratch_path
from panelspark.sources import sinks
from panelspark.sources.tables import path_exists, read_portfolios

NAN = float("nan")
DAY = datetime.date


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def filings(spark, data):
    return spark.createDataFrame(data, "doc_id long, gvkey string, date int, file_type string, text string, rf string, mgmt string")


def test_filings_view_keeps_every_character(spark, sf):
    whole = spark.read.parquet(f"{sf}/documents.parquet").agg(F.sum(F.length("text"))).first()[0]
    kept = v.filings(spark, sf).agg(F.sum(F.length(F.concat_ws("", "rf", "mgmt", "text")))).first()[0]
    assert kept == whole


def test_text_rows_with_null_keys(spark):
    f = filings(spark, [(1, None, 20230101, "10K", "a" * 60, None, None), (2, "k", 20230101, None, "b" * 3000, None, None),
                        (3, "k", 20230102, "10Q", "c" * 70, None, None)])
    texts = tx.text_rows(f)
    done = tx.text_format(texts, ["gvkey", "doc_id", "filing_type"])
    assert rows(done, "doc_id", "text_length") == [(1, 60), (2, 3000), (3, 70)]
    cut = tx.text_format(texts, ["gvkey", "doc_id", "filing_type"], max_chars=2000)
    assert rows(cut, "doc_id", "text_length", "full_length") == [(1, 60, 60), (2, 2003, 3000), (3, 70, 70)]
    assert tx.text_inputs(f).count() == 3


def test_chosen_entities_do_not_move_texts_by_entity(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        f = filings(spark, [(i, "hot", 20230101, "10K", "t" * 60, None, None) for i in range(5)] + [(9, "cold", 1, "10K", "t" * 60, None, None)])
        out = tx.text_rows(f, f.filter("gvkey = 'hot'"))
        plan = out._jdf.queryExecution().sparkPlan().toString()
        executed = out._jdf.queryExecution().executedPlan().toString()
        assert rows(out, "doc_id") == [(i,) for i in range(5)]
        assert "hashpartitioning(gvkey" not in "".join(x for x in executed.splitlines() if "text" in x), plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_null_sector_and_month(spark):
    members = u.sector_members(spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "sector string, sec int"), "sector", "sec")
    assert rows(members, "sector", "sec", "position") == [("a", 1, 1), (None, 2, 1), (None, 3, 2)]
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, 3.0), ("a", 3, NAN), ("a", 4, 2.0), ("a", 5, 4.0)], "sector string, sec int, x double")
    z = {r["sec"]: r["z"] for r in sel.zscore(df, ["sector"], "x", "z").collect()}
    assert z[1] == pytest.approx(-math.sqrt(0.5)) and z[2] == pytest.approx(math.sqrt(0.5))
    assert z[3] == 0 and z[4] == pytest.approx(-math.sqrt(0.5))
    score = {r["sec"]: r["vol_score"] for r in sel.volatility_score(df, ["sector"], "x", ["sec"]).collect()}
    assert score == {1: 1.0, 2: 0.0, 3: 0.5, 4: 1.0, 5: 0.0}
    scaled = cl.robust_scale(spark.createDataFrame([(None, 1.0), (None, 3.0), (None, 5.0), ("m", NAN), ("m", 2.0)], "mon string, x double"), "mon", ["x"])
    assert rows(scaled, "mon", "x") == sorted([(None, -1.0), (None, 0.0), (None, 1.0), ("m", None), ("m", 0.0)], key=repr)


def test_candidates_of_null_sector(spark):
    scored = spark.createDataFrame([(None, 1, i, DAY(2024, 1, 2), float(i)) for i in range(10)], "sector string, mon int, sec int, dt date, composite_score double")
    got = sel.select_candidates(scored, ["sector", "mon"], ["sec", "dt"])
    assert rows(got, "sec", "candidate_type", "selection_rank") == [(0, "short", 1), (9, "long", 1)]


def test_portfolios_of_null_sector(spark, tmp_path):
    scored = spark.createDataFrame([(s, 24181, i, float(i), float(i % 3)) for s in (None, "a") for i in range(4)],
                                   "prefix string, m long, sec int, algo_score double, ml_score double")
    by = ["m", "prefix"]
    got = rows(pf.top_bottom(scored, by, "algo_score", "sec", 2, 3), "prefix", "sec", "side", "pos")
    sides = [(3, "long", 1), (2, "long", 2), (0, "short", 1), (1, "short", 2)]
    assert got == sorted([(s, *x) for s in (None, "a") for x in sides], key=repr)
    built = pf.build_portfolios(scored, by, "sec", 2, 3)
    columns = ("sec", "side", "combined_score", "weight")
    assert len(rows(built, *columns)) == 8
    assert rows(built.filter("prefix IS NULL"), *columns) == rows(built.filter("prefix = 'a'"), *columns)
    named = built.select("*", F.lit(2015).alias("yr"), F.lit(2).alias("mo"), F.col("prefix").alias("sector"), F.col("sec").cast("string").alias("company_id"))
    sinks.write_portfolios(named, str(tmp_path / "out"))
    back = rows(read_portfolios(spark, str(tmp_path / "out")), "yr", "mo", "sector", "company_id", "side")
    assert back == sorted([(2015, 2, s, str(i), side) for s in (None, "a") for i, side, _ in sides], key=repr)


def test_nan_is_missing_when_cleaned(spark):
    profile = {"x": {"median": 7.0, "q01": 0.0, "q99": 10.0, "q0005": 0.0, "q995": 10.0}}
    df = spark.createDataFrame([(1, NAN), (2, 50.0), (3, None)], "sec int, x double")
    done = cl.rowwise(df, ["x"], profile, flags=True)
    assert rows(done, "sec", "x", "x_was_missing") == [(1, 7.0, 1), (2, 10.0, 0), (3, 7.0, 1)]


def test_prepared_returns_are_numbers(spark):
    raw = spark.createDataFrame([("s", DAY(2024, 1, 2), 1, "-5", "0.1"), ("s", DAY(2024, 1, 3), 1, "4", "C"), ("s", DAY(2024, 1, 4), 1, "NaN", "1")],
                                "sec string, date date, k int, prc string, ret string")
    got = u.prepare_panel(raw, ["sec"], ["k"], "date", "prc", ["ret"], ["ret"])
    assert rows(got, "date", "prc", "ret") == [(DAY(2024, 1, 2), 5.0, 0.1), (DAY(2024, 1, 3), 4.0, None)]


def test_validation_covers_the_whole_panel(spark):
    info = spark.createDataFrame([("1", DAY(2024, 1, 1), "20x"), (None, DAY(2024, 1, 1), "20y")], "id string, date date, code string")
    panel = spark.range(30000).select(F.when(F.col("id") % 3 == 0, "1").when(F.col("id") % 3 == 1, "2").alias("id"), F.lit(DAY(2024, 1, 1)).alias("date"))
    got = u.sector_validation(info, panel, "20", "id", "date", "code").first()
    assert got["covered_rows"] == 10000 and got["coverage"] == pytest.approx(1 / 3)


def test_unpriced_positions_are_counted(spark):
    held = spark.createDataFrame([(1, 1, "long", 0.5), (2, 1, "long", 0.5), (3, 2, "short", -1.0)], "sec int, m long, side string, weight double")
    realized = spark.createDataFrame([(1, 2, 0.1)], "sec int, m long, r double")
    got = rows(pe.portfolio_returns(held, realized, "sec"), "m", "positions_count", "unpriced_count", "portfolio_return")
    assert got == [(1, 1, 1, 0.05), (2, 0, 1, None)]


def test_same_key_joins_null_with_null(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, w int")
    assert rows(same_key(a, b, ["k"]), "k", "v", "w") == sorted([(None, 1, 10), ("x", 2, 20)], key=repr)


def test_no_list_is_gathered_over_a_sliding_frame(spark, sf):
    p = v.panel_ret(spark, sf)
    for method in ("rolling", "ewma"):
        plan = ind.volatility_forecast(p, method, min_rows=60, max_rows=250)._jdf.queryExecution().optimizedPlan().toString()
        assert not any("collect_list" in line and "windowspecdefinition" in line for line in plan.splitlines())
        assert "RowFrame, -249" not in plan


def test_release_removes_the_tables(spark):
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert path_exists(spark, path)
    release(spark)
    assert not path_exists(spark, application_dir(spark))


def test_indicators_sort_the_panel_once(spark, sf):
    from panelspark.plans import signals
    plan = signals.indicators(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1
