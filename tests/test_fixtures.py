"""Hand-computed cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelspark.functions.expr import clip, log1p_positive, signed_log
from panelspark.functions.ordered import with_average_rank
from panelspark.operators import (bars as ba, cleaning as cl, garch, indicators as ind, modelprep as mp, performance as pe,
                                  portfolio as pf, risk as ri, selection as sel, text as tx)
from panelspark.operators.universe import sector_params


def months(spark, returns):
    return spark.createDataFrame([(i + 1, float(r)) for i, r in enumerate(returns)], "m int, r double")


def test_drawdown(spark):
    rows = pe.drawdowns(months(spark, [.10, -.20, .30]), "m", "r").orderBy("m").collect()
    assert [round(r.equity, 6) for r in rows] == [1.1, .88, 1.144]
    assert min(r.drawdown for r in rows) == pytest.approx(-.2)


def test_first_month_loss_is_no_drawdown_unless_asked(spark):
    m = months(spark, [-.10, .05])
    assert pe.drawdowns(m, "m", "r").agg(F.min("drawdown")).first()[0] == 0
    assert pe.drawdowns(m, "m", "r", include_start=True).agg(F.min("drawdown")).first()[0] == pytest.approx(-.1)


def test_turnover(spark):
    p = spark.createDataFrame([(2020, 1, "long", "A"), (2020, 1, "long", "B"), (2020, 3, "long", "B"), (2020, 3, "long", "C"),
                               (2020, 3, "long", "D"), (2020, 3, "long", "D")], "yr int, mo int, side string, company_id string")
    row = ri.turnover(ri.position_sets(p)).first()
    assert (row.positions_entered, row.positions_exited, row.turnover_rate, row.gap_months) == (2, 1, 1.2, 2)


def test_average_rank(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1., 2., 2., 4., None])], "g int, id int, v double")
    rows = with_average_rank(df, ["g"], "v", ["id"], "rank", "n").orderBy("id").collect()
    assert [r["rank"] for r in rows] == [1, 2.5, 2.5, 4, None]
    scores = sel.volatility_score(df, ["g"], "v", ["id"]).orderBy("id").collect()
    assert [r.vol_score for r in scores] == [1, .5, .5, 0, .5]


def test_null_clip(spark):
    df = spark.createDataFrame([(None,), (5.0,), (-5.0,)], "x double").select(clip(F.col("x"), 0.0, 1.0).alias("y"))
    assert [r.y for r in df.collect()] == [None, 1.0, 0.0]


def test_transforms(spark):
    row = spark.createDataFrame([(-1.0,)], "x double").select(log1p_positive(F.col("x")), signed_log(F.col("x"))).first()
    assert row[0] == -1.0 and row[1] == pytest.approx(-0.6931472)


def test_zero_mad(spark):
    df = spark.createDataFrame([(1, v) for v in (5., 5., 5., 9.)], "mon int, x double")
    assert sorted(r.x for r in cl.robust_scale(df, "mon", ["x"]).collect()) == [0, 0, 0, 8]


def test_score_weights(spark):
    df = spark.createDataFrame([(1, "long", .6), (1, "long", .2), (1, "long", .2), (1, "short", 0.), (1, "short", 0.)],
                               "m int, side string, combined_score double")
    rows = pf.score_weights(df, ["m"]).collect()
    assert sorted(round(r.weight, 6) for r in rows) == [-.5, -.5, .2, .2, .6]


def test_equal_scores_scale_to_zero(spark):
    df = spark.createDataFrame([(1, "long", 2.0, .3), (1, "long", 2.0, .3)], "m int, side string, algo_score double, ml_score double")
    assert [r.combined_score for r in pf.combine_scores(df, ["m"]).collect()] == [0, 0]
    with pytest.raises(ValueError):
        pf.combine_scores(df, ["m"], algo_weight=0.9)


def test_longs_go_first_when_short_of_rows(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(4)], "m int, id int, s double")
    rows = pf.top_bottom(df, ["m"], "s", "id", 3, 3).collect()
    assert sorted((r.side, r.id) for r in rows) == [("long", 1), ("long", 2), ("long", 3), ("short", 0)]


def test_label_expansion(spark):
    df = spark.createDataFrame([("Positive", .8), ("neutral", .6)], "sentiment_label string, confidence_score double")
    a, b = tx.expand_labels(df).collect()
    assert [round(x, 6) for x in (a.positive_score, a.neutral_score, a.negative_score)] == [.8, .12, .08]
    assert [round(x, 6) for x in (b.positive_score, b.neutral_score, b.negative_score)] == [.2, .6, .2]


def test_sum_to_one(spark):
    df = spark.createDataFrame([(1.,), (2.,), (3.,)], "s double")
    share = lambda m, **k: [round(r.w, 4) for r in tx.normalize(df, "s", m, "w", **k).orderBy("s").collect()]
    assert share("minmax") == [0, .3333, .6667]
    assert share("softmax") == [.09, .2447, .6652]
    same = spark.createDataFrame([(2.,), (2.,)], "s double")
    assert [r.w for r in tx.normalize(same, "s", "linear", "w").collect()] == [.5, .5]


def test_calendar_average(spark):
    df = spark.createDataFrame([(1, 0, 1.), (1, 1, 2.), (1, 5, 6.)], "sec int, date_idx int, x double")
    rows = df.select("date_idx", ind.calendar_average(F.col("x"), 5).alias("a")).orderBy("date_idx").collect()
    assert [r.a for r in rows] == [1, 1.5, 4]


def test_company_id(spark):
    df = spark.createDataFrame([("1004.0", "1.0"), ("nan", "1"), (None, "1"), ("1234567", "02")], "g string, i string")
    assert [r[0] for r in df.select(pf.company_id(F.col("g"), F.col("i"))).collect()] == ["comp_001004_1", None, None, "comp_1234567_02"]


def test_quality_score(spark):
    stats = spark.createDataFrame([(100, 1, .5, 20.0, 0, 0, 10, 1.0, 30)],
                                  "total_days int, ohlc_violations int, min_price double, max_price double, zero_volume_days int, "
                                  "extreme_returns int, n_returns int, volatility_preservation double, days_no_range int")
    row = ba.quality(stats).first()
    assert row.warnings == ["very_low_prices", "no_range"] and row.quality_score == 80


def test_moving_average_needs_enough_values(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(8)], "sec int, dt int, p double")
    rows = df.select("dt", ind.moving_average(F.col("p"), 6, ind.series()).alias("a")).orderBy("dt").collect()
    assert [r.a for r in rows] == [None] * 4 + [2.0, 2.5, 3.5, 4.5]


def test_sector_average_equals_one_frame_per_sector(spark):
    df = spark.createDataFrame([(s, i, float((i * 7 + s) % 11), "a" if s == 1 else "b") for s in (1, 2) for i in range(40)],
                               "sec int, dt int, p double, sector string")
    out = ind.moving_average_by_sector(df, "p", [("a", 25), ("b", 12)], "sector", "sec", "dt", "m")
    for name, w in (("a", 25), ("b", 12)):
        plain = df.filter(F.col("sector") == name).select("dt", ind.moving_average(F.col("p"), w, ind.series()).alias("m"))
        assert sorted(map(tuple, out.filter(F.col("sector") == name).select("dt", "m").collect())) == sorted(map(tuple, plain.collect()))


def test_month_end_and_forward_fill(spark):
    df = spark.createDataFrame([(1, dt.date(2020, 1, 30), 1.), (1, dt.date(2020, 1, 31), None), (1, dt.date(2020, 2, 3), None)],
                               "sec int, dt date, x double")
    rows = df.select("dt", ind.month_end("dt", ind.series()).alias("e"), ind.forward_fill(F.col("x"), ind.series()).alias("f")).orderBy("dt").collect()
    assert [r.e for r in rows] == [False, True, True] and [r.f for r in rows] == [1, 1, 1]


def test_categories():
    got = {c: cl.infer_category(c) for c in ["ret_1_0", "be_me", "prc", "turnover_126d", "sale_gr1", "beta_60m", "xyz"]}
    assert got == {"ret_1_0": "returns", "be_me": "size", "prc": "price", "turnover_126d": "liquidity",
                   "sale_gr1": "growth", "beta_60m": "risk", "xyz": "other"}
    assert cl.infer_category("xyz", {"xyz": "value"}) == "value"
    assert cl.infer_category("prc", {"prc": "other"}) == "price"


def test_repeated_columns_and_standard_form(spark):
    df = spark.createDataFrame([(1, "2020-05-17", 2.0, 3.0)], "gvkey int, date string, x double, y double").toDF("gvkey", "date", "x", "x")
    out = cl.standard_columns(df)
    assert out.columns == ["gvkey", "date", "x", "month_key"]
    row = out.first()
    assert (row.gvkey, row.x, row.month_key) == ("1", 2.0, dt.date(2020, 5, 1))
    with pytest.raises(KeyError):
        cl.date_column(df.select("gvkey"))


def test_unknown_sector_gets_default(spark):
    row = sector_params(spark.createDataFrame([("nowhere",)], "sector string")).first()
    assert (row.gics_prefix, row.ma_window, row.mom_lag) == ("55", 60, 120)


def test_extreme_and_edge_r2(spark):
    zero = spark.createDataFrame([(0., 0.)], "a double, b double")
    assert zero.agg(pe.oos_r2(F.col("a"), F.col("b"))).first()[0] == 1.0
    off = spark.createDataFrame([(0., 1.)], "a double, b double")
    assert off.agg(pe.oos_r2(F.col("a"), F.col("b"))).first()[0] == 0.0


def test_window_is_padded_and_sparse_ones_skipped(spark):
    g = spark.createDataFrame([(1, 0, 1.0), (1, 1, None), (2, 0, None), (2, 1, None)], "sec int, day int, f double")
    rows = mp.latest_window(g, ["f"], days=3).collect()
    assert [(r.sec, r.x) for r in rows] == [(1, [[0.0], [1.0], [0.0]])]


def test_garch_tracks_the_last_shocks():
    import numpy as np
    rng = np.random.default_rng(1)
    calm = rng.normal(0, 0.01, 300)
    wild = np.concatenate([calm[:280], rng.normal(0, 0.05, 20)])
    a, b, c = garch.fit_many([calm, wild, np.zeros(10)])
    assert 0.005 < a < 0.02 < b and np.isnan(c)
    assert garch.fit_many([calm[:100], calm])[1] == pytest.approx(a)
