"""Invariants on the driver tables, round trips and the stream."""

import datetime as dt

from pyspark.sql import functions as F

from panelspark.operators import cleaning as cl, performance as pe, portfolio as pf, risk as ri, text as tx
from panelspark.plans import cleaning as pc, signals, storage as st, texts as pt, views as v
from panelspark.sources import sinks, tables
from panelspark.storage import scratch_path, shared_dir
from panelspark.streaming import cleaning as stream


def test_weights_sum_to_one_per_side(spark, sf):
    p = pf.build_portfolios(v.scored(spark, sf), ["m", "prefix"], "sec", 3, 2)
    for r in p.groupBy("m", "prefix", "side").agg(F.sum("weight").alias("w")).collect():
        assert abs(r.w - (1 if r.side == "long" else -1)) < 1e-12


def test_scaled_values_stay_within_the_clip(spark, sf):
    row = pc.cleaned(spark, sf).agg(*[F.max(F.abs(F.col(c))).alias(c) for c in v.FACTORS]).first()
    assert all(row[c] <= 8.0 for c in v.FACTORS)


def test_normalizers_sum_to_one(spark, sf):
    e = pt.entities(spark, sf)
    for m in ("minmax", "softmax", "linear"):
        assert abs(tx.normalize(e, "net_sentiment", m, "w").agg(F.sum("w")).first()[0] - 1) < 1e-9


def test_turnover_and_drawdown_ranges(spark, sf):
    t = ri.turnover(ri.position_sets(v.positions(spark, sf))).agg(F.min("turnover_rate"), F.max("turnover_rate")).first()
    assert 0 <= t[0] <= t[1] <= 2
    assert pe.drawdowns(v.monthly(spark, sf), "ym", "portfolio_return").filter("drawdown > 0").isEmpty()


def test_later_bars_change_no_earlier_portfolio(spark, sf):
    """Bars dated after the cutoff must not reach the history rule or the as-of value."""
    bars = v.panel(spark, sf)
    cut = dt.date(1997, 1, 1)
    asked = v.scored(spark, sf).filter(F.col("ym") == 199701)
    few = bars.filter(F.col("dt") < cut)
    a, b = (pf.enough_history(asked, x, "sec").select("sec").orderBy("sec").collect() for x in (bars, few))
    assert a == b and a
    c = asked.select("sec").withColumn("month_start", F.lit(cut))
    x, y = (pf.as_of_cutoff(c, z, "sec", "month_start").select("sec", "last_date", "bars_known").orderBy("sec").collect() for z in (bars, few))
    assert x == y and all(r.last_date < cut for r in x)


def test_indicator_windows_share_one_exchange(spark, sf):
    plan = signals.indicator_panel(spark, sf)._jdf.queryExecution().executedPlan().toString()
    by_sec = [line for line in plan.splitlines() if "Exchange hashpartitioning(sec" in line]
    # one for the (security, day) aggregate, one for the series, and the join to the security table
    series = [line for line in by_sec if "dt" not in line.split("),")[0]]
    assert len([line for line in plan.splitlines() if "Window [" in line]) >= 4
    assert len(series) <= 2, by_sec


def test_one_month_reads_one_directory(spark, sf):
    path = scratch_path(spark, "t")
    d = v.panel(spark, sf).select("sec", "dt", F.year("dt").alias("year"), F.month("dt").alias("month"))
    sinks.write_partitioned(d, path)
    plan = tables.read_month(spark, path, 1997, 6)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_rewriting_one_month_keeps_the_others(spark):
    path = scratch_path(spark, "t")
    one = spark.createDataFrame([(1, 2020, 1), (2, 2020, 2)], "x int, year int, month int")
    sinks.write_partitioned(one, path)
    sinks.write_partitioned(spark.createDataFrame([(9, 2020, 2)], "x int, year int, month int"), path)
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [1, 9]


def test_portfolio_file_names(spark, tmp_path):
    doc = '{"long_positions": [{"company_id": "comp_1_01", "portfolio_weight": 1.0}], "short_positions": []}'
    (tmp_path / "portfolio_2015_01_cons_staples.json").write_text(doc)
    rows = tables.read_portfolios(spark, str(tmp_path)).collect()
    assert [(r.yr, r.mo, r.sector, r.side, r.company_id) for r in rows] == [(2015, 1, "cons_staples", "long", "comp_1_01")]


def test_feature_dim_of_unknown_layout_is_empty(spark, tmp_path):
    (tmp_path / "d.csv").write_text("a,b\n1,2\n")
    assert tables.read_feature_dim(spark, str(tmp_path / "d.csv")).isEmpty()
    assert tables.read_feature_dim(spark, str(tmp_path / "none.csv")).isEmpty()


def test_cleaning_in_many_batches_equals_one_batch(spark, sf):
    f = v.factors(spark, sf).withColumn("mon", F.trunc("dt", "MM")).drop("gics")
    base = scratch_path(spark, "stream")
    f.repartition(3).write.parquet(f"{base}/in")
    given = spark.read.parquet(f"{base}/in")
    prof = pc.profile(given)
    rows = stream.read_arriving(spark, f"{base}/in", given.schema, files_per_batch=1)
    run = stream.clean_stream(rows, prof, v.FACTORS, f"{base}/staging", f"{base}/out", f"{base}/state")
    run.awaitTermination()
    assert run.lastProgress["batchId"] >= 2
    cols = ["sec", "dt", *[F.round(c, 6).alias(c) for c in v.FACTORS]]
    got = spark.read.parquet(f"{base}/out").select(*cols)
    want = cl.clean_panel(given, "mon", v.FACTORS, prof).select(*cols)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def stream_rows(spark, rows):
    return spark.createDataFrame(rows, "sec int, mon date, x double, y double")


def files_of(path):
    return {str(p.relative_to(path)) for p in path.rglob("*.parquet")}


def test_a_repeated_batch_changes_nothing_and_quiet_months_keep_their_files(spark, tmp_path):
    jan, feb = dt.date(2020, 1, 1), dt.date(2020, 2, 1)
    batches = [
        [(i, jan, float(i), 1.0) for i in range(9)] + [(i, feb, float(i * i), None) for i in range(5)] + [(1, None, 3.0, 2.0)],
        [(20, jan, 4.0, 1.0)],  # moves neither median nor MAD of January
        [(21, feb, 1000.0, 5.0), (22, None, 8.0, 2.0)],
        [(23, jan, 50.0, 1.0), (24, jan, 51.0, None)],
    ]
    run = stream.clean_batch(str(tmp_path / "staging"), str(tmp_path / "out"), ["x", "y"])
    jan_files = lambda: {f for f in files_of(tmp_path / "out") if f.startswith("mon=2020-01-01")}
    cols = ["sec", "mon", F.round("x", 9), F.round("y", 9)]
    for k, rows in enumerate(batches):
        first, feb_before = jan_files(), files_of(tmp_path / "out")
        for _ in range(1 + (k > 0)):  # every later batch is repeated
            run(stream_rows(spark, rows), k)
        seen = stream_rows(spark, [r for b in batches[: k + 1] for r in b])
        got = spark.read.schema(seen.schema).parquet(str(tmp_path / "out")).select(*cols)
        want = cl.robust_scale(seen, "mon", ["x", "y"]).select(*cols)
        assert got.count() == want.count() and got.exceptAll(want).isEmpty()
        if k == 1:
            assert first < jan_files()  # the month only got a file more
        if k == 3:
            assert not first & jan_files()  # the month was scaled again
            assert {f for f in feb_before if "02-01" in f} == {f for f in files_of(tmp_path / "out") if "02-01" in f}
    state = files_of(tmp_path / "staging" / "histogram")
    assert {f.split("/")[1] for f in state if f.startswith("mon=2020-01-01")} == {"batch=1", "batch=3"}


def test_float_output_and_flags(spark, sf):
    f = v.factors(spark, sf).withColumn("mon", F.trunc("dt", "MM"))
    out = cl.clean_panel(f, "mon", ["prc"], {}, as_float=True)
    assert dict(out.dtypes)["prc"] == "float"


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == named.rstrip("/") if named else shared_dir(spark)
    assert st.scratch_path(spark, "x") != st.scratch_path(spark, "x")


def test_release_removes_only_this_application(spark, monkeypatch, tmp_path):
    from panelspark import storage
    monkeypatch.setattr(storage, "application_dir", lambda s: str(tmp_path / "app"))
    (tmp_path / "other").mkdir()
    kept = storage.cut_lineage(spark.range(3))
    assert kept.count() == 3 and (tmp_path / "app").exists()
    storage.release(spark)
    assert not (tmp_path / "app").exists() and (tmp_path / "other").exists()
