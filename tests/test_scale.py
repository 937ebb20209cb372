"""Operators that replace whole-group windows: hot groups, ties, both quantile paths, whole texts."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window, functions as F

from panelspark import constants as C
from panelspark.functions import ordered as od, quantile as qt
from panelspark.functions.ordered import SLICE, place, running_sums, with_average_rank, with_row_number
from panelspark.operators import cleaning as cl, indicators as ind, modelprep as mp, portfolio as pf, selection as sel, text as tx, textmodel as tm
from panelspark.plans import cleaning as cl_plans, models, texts as tx_plans, universe as pu, views as v


@pytest.fixture(autouse=True)
def many_slices(spark):
    """Small test tables would otherwise be joined into one slice."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


def hot(spark, n=3000):
    """One group and one value hold most rows."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 50).cast("int").alias("g"), "id",
        F.when(F.col("id") % 4 > 0, 0.5).otherwise(F.sin("id")).alias("v"))


def test_running_sums_equal_a_window(spark):
    df = hot(spark)
    order = [F.col("v").asc(), F.col("id").asc()]
    got = running_sums(df, ["g"], order, {"n": F.lit(1).cast("long"), "s": F.col("id")}, {"n": "size"})
    w = Window.partitionBy("g").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.count("*").over(w).alias("n"), F.sum("id").over(w).alias("s"),
                     F.count("*").over(Window.partitionBy("g")).alias("size"))
    assert got.count() == 3000 and got.exceptAll(want.select(got.columns)).isEmpty()


def test_a_hot_group_is_spread(spark):
    placed = place(hot(spark), ["g"], [F.col("v").asc(), F.col("id").asc()])
    tied = placed.filter("g = 1 AND v = 0.5").groupBy(SLICE).count().collect()
    assert len(tied) >= 3 and max(r["count"] for r in tied) < 0.6 * sum(r["count"] for r in tied)


def test_average_rank_of_ties_across_slices(spark):
    df = hot(spark, 6000).withColumn("v", F.when(F.col("id") % 7 == 0, None).otherwise(F.round("v", 1)))
    got = with_average_rank(df, ["g"], "v", ["id"], "r", "n").toPandas().sort_values("id")
    want = got.groupby("g")["v"].rank(method="average")
    assert (got["r"].fillna(-1) == want.fillna(-1)).all() and len(got) == 6000
    assert (got["n"] == got.groupby("g")["v"].transform("count")).all()


def test_row_number_over_everything(spark):
    rows = with_row_number(hot(spark).select("id"), [], [F.col("id").desc()], "n").orderBy("n").collect()
    assert [r.n for r in rows] == list(range(1, 3001)) and rows[0].id == 2999


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_quantiles(spark, monkeypatch, limit):
    monkeypatch.setattr(qt, "WINDOW_ROWS", limit)
    rng = np.random.default_rng(0)
    data = {1: rng.normal(0, 1, 501), 2: np.concatenate([np.full(400, 7.25), rng.lognormal(3, 2, 100)]), 3: np.array([-0.0])}
    df = spark.createDataFrame([(g, float(x)) for g, xs in data.items() for x in xs] + [(1, None)], "g int, x double")
    probs = {"lo": 0.01, "mid": 0.5, "hi": 0.995}
    for r in qt.exact_quantiles(df, ["g"], ["x"], probs).collect():
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(data[r.g], p), abs=1e-12)


def mad_groups():
    rng = np.random.default_rng(8)
    inf = float("inf")
    return {1: rng.normal(0, 1, 501), 2: np.concatenate([np.full(400, 7.25), rng.lognormal(3, 2, 100)]), 3: np.array([-0.0]), 4: rng.normal(1000, 1e-3, 300),
            5: np.array([1.0, 2.0]), 6: rng.lognormal(0, 4, 400) * rng.choice([-1, 1], 400), 7: np.array([1e300, -1e300, 5.0, 1e-300]),
            8: np.repeat([1.0, 2.0, 9.0], [3, 3, 1]), 9: np.array([inf, inf, 3.0]), 10: np.array([3.0, inf, 4.0, 5.0]), 11: np.arange(1000.0) ** 3}


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_median_and_mad(spark, monkeypatch, limit):
    monkeypatch.setattr(qt, "WINDOW_ROWS", limit)
    data = mad_groups()
    rows = [(g, float(x), float(x) / 3) for g, xs in data.items() for x in xs] + [(1, None, None), (12, None, None), (None, 2.0, None), (None, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, x double, y double").repartition(5)
    got = {(r.g, r.feature): (r.median, r.mad) for r in qt.median_and_mad(df, ["g"], ["x", "y"]).collect()}
    assert (12, "x") not in got and got.pop((None, "x")) == (3.5, 1.5) and got.pop((None, "y")) == (1.0, 0.0)
    for (g, feature), (median, mad) in got.items():
        x = data[g] / (3 if feature == "y" else 1)
        m = np.quantile(x, 0.5) if g != 9 else np.inf
        with np.errstate(invalid="ignore"):
            d = np.where(x == m, 0, np.abs(x - m))
        assert median == pytest.approx(m, rel=1e-15) and mad == pytest.approx(np.quantile(d, 0.5) if g != 9 else 0.0, rel=1e-12)
    assert len(got) == 2 * len(data)


def test_mad_reads_few_buckets_again(spark):
    """The second pass takes the middle buckets and those a median distance away, not all values."""
    df = spark.range(200_000).select(F.lit(1).alias("g"), (F.exp(F.randn(3) * 2)).alias("x"))
    cells = qt.known_cells(df, ["g"], ["x"])
    hist = cells.groupBy("g", "feature", "bucket").agg(F.count("*").alias("c"), F.min("value").alias("a"), F.max("value").alias("b"))
    chosen = qt.mad_buckets(hist, ["g", "feature"])
    assert chosen.agg(F.sum("c")).first()[0] < 70_000 and chosen.filter("middle").count() <= 2


def test_pairwise_loss_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(d, i, *map(float, rng.uniform(0.5, 1.5, 3)), True) for d in range(3) for i in range(40)] + [(0, 99, 1., 1., 1., False)]
    df = spark.createDataFrame(rows, "day int, sec int, pred double, base double, target double, valid boolean")
    for r in mp.pairwise_rank_loss(df).collect():
        day = np.array([x[2:5] for x in rows if x[0] == r.day and x[5]])
        p, o = day[:, 0] / day[:, 1] - 1, day[:, 2] / day[:, 1] - 1
        want = np.maximum(0, (p[:, None] - p[None, :]) * (p[None, :] - o[:, None])).mean()
        assert r.rank_loss == pytest.approx(want) and r.n == 40


@pytest.mark.parametrize("largest", [od.GROUP_ROWS, 10])
def test_symmetric_loss_equals_brute_force(spark, monkeypatch, largest):
    """Ties, a large day, a single row, and rows without returns, which count in n only. No table it writes outgrows the
    rows (before, one had a row per row and bit of the largest rank)."""
    monkeypatch.setattr(od, "GROUP_ROWS", largest)
    plain, written = od.cut_lineage, []

    def cut(df, name="cut"):
        stored = plain(df, name)
        written.append(stored.count())
        return stored

    for module in (mp, od):
        monkeypatch.setattr(module, "cut_lineage", cut)
    rng = np.random.default_rng(4)
    rows = [(d, i, *map(float, np.round(rng.uniform(0.5, 1.5, 3), digits)), True) for d, n, digits in ((0, 400, 9), (1, 90, 1), (2, 1, 9)) for i in range(n)]
    rows += [(d, 1000 + i, 1.0, 0.0, 2.0, True) for d in (0, 3) for i in range(20)] + [(0, 2000, 1.0, 1.0, 1.0, False)]
    df = spark.createDataFrame(rows, "day int, sec int, pred double, base double, target double, valid boolean")
    found = {r.day: r for r in mp.pairwise_rank_loss(df, symmetric=True).collect()}
    assert sorted(found) == [0, 1, 2, 3] and max(written) <= len(rows)
    for d, r in found.items():
        day = np.array([x[2:5] for x in rows if x[0] == d and x[5] and x[3]]).reshape(-1, 3)
        p, o = day[:, 0] / day[:, 1] - 1, day[:, 2] / day[:, 1] - 1
        n = sum(x[0] == d and x[5] for x in rows)
        want = np.maximum(0, -(p[:, None] - p[None, :]) * (o[:, None] - o[None, :])).sum() / n**2
        assert r.rank_loss == pytest.approx(want, abs=1e-12) and r.n == n


def test_whole_texts_are_scored(spark):
    seen = spark.createDataFrame([(1, "x" * 1000 + "good " * 200), (2, ""), (3, "good")], "text_id int, text string")
    label = lambda texts: [("positive", .9) if "good" in t else ("neutral", .6) for t in texts]
    rows = {r.text_id: r for r in tx.score_texts(seen, label).collect()}
    assert len(rows) == 3 and rows[1].sentiment_label == "positive" and rows[3].confidence_score == pytest.approx(.9)


def test_text_inputs_keep_whole_texts(spark):
    f = spark.createDataFrame([(1, "g", 20230105, "10K", "r" * 60000, None, None)],
                              "doc_id int, gvkey string, date int, file_type string, rf string, mgmt string, text string")
    row = tx.text_inputs(f).first()
    assert len(row.text) == 60000 and row.text_id == "REAL_g_01_rf_20230105_0001"
    assert len(tx.text_inputs(f, max_chars=50000).first().text) == 50000


def test_random_mask_hides_the_same_number_everywhere(spark):
    s = spark.createDataFrame([(1, d, [[1.0, 1.0]] * 8) for d in range(5)], "sec int, day int, x array<array<double>>")
    once = mp.random_mask(s, ["a", "b"], 8, 0.3, 7).orderBy("day").collect()
    again = mp.random_mask(s.repartition(3), ["a", "b"], 8, 0.3, 7).orderBy("day").collect()
    assert [r.masked_x for r in once] == [r.masked_x for r in again]
    assert all(sum(row[j] for row in r.masked_x) == 6 for r in once for j in (0, 1))


def test_random_mask_draws_once_per_sample(spark, sf):
    """Windows of other lengths stay as long; the plan names each draw once, outside lambdas and filters."""
    s = spark.createDataFrame([(n, n, [[1.0]] * n) for n in (0, 3, 8, 11)] + [(12, 12, None)], "sec int, day int, x array<array<double>>")
    got = {r.sec: r.masked_x for r in mp.random_mask(s, ["a"], 8, 0.3, 7).collect()}
    assert {k: len(x) for k, x in got.items() if x is not None} == {0: 0, 3: 3, 8: 8, 11: 11} and got[12] is None
    assert sum(r[0] for r in got[8]) == 6 and sum(r[0] for r in got[11]) == 9
    plan = models.random_mask(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == models.L * len(models.CLOSE)


def test_universe_thresholds_are_off_unless_asked_for(spark):
    df = spark.createDataFrame([(1, i, float(i), 50.0 * i) for i in range(101)] + [(1, 200, None, None)], "mon int, sec int, vol_fc double, cap double")
    assert sel.apply_thresholds(df, ["mon"]).count() == 102
    assert sel.apply_thresholds(df, ["mon"], vol_band=(0.05, 0.95)).count() == 92
    assert sel.apply_thresholds(df, ["mon"], market_cap="cap").count() == 100


def test_selection_does_not_depend_on_partitioning(spark, sf):
    p = v.scored(spark, sf)
    a = pf.build_portfolios(p.repartition(1), ["m", "prefix"], "sec", 3, 2)
    b = pf.build_portfolios(p.repartition(16), ["m", "prefix"], "sec", 3, 2)
    cols = ["sec", "m", "prefix", "side", F.round("weight", 9)]
    assert a.select(*cols).exceptAll(b.select(*cols)).isEmpty() and a.count() == b.count()


def test_tiny_groups_keep_one_row_per_side(spark):
    df = spark.createDataFrame([("s", 1, 1, .5), ("s", 1, 2, .1)], "sector string, mon int, sec int, composite_score double")
    rows = sel.select_candidates(df.withColumn("dt", F.lit(1)), ["sector", "mon"], ["sec"]).collect()
    assert sorted((r.candidate_type, r.sec) for r in rows) == [("long", 1), ("short", 2)]


def test_sketches_of_months_answer_for_any_span(spark):
    df = spark.range(60_000).select((F.col("id") % 6).alias("mon"), F.exp(F.randn(5) * 3).alias("x"), F.when(F.col("id") % 6 > 0, F.col("id") % 100).alias("y"),
                                    F.lit(None).cast("double").alias("z"), F.lit(float("nan")).alias("w"))
    few = cl.profile_sketches(df, ["mon"], ["x", "y", "z", "w"], k=200).cache()
    assert {(r.feature, r["count"]) for r in few.groupBy("feature").count().collect()} == {("x", 6), ("y", 5)}
    assert few.agg(F.max(F.length("sketch"))).first()[0] < 3 * 200 * 8 + 200
    for months in ([0, 1, 2, 3, 4, 5], [2, 3]):
        merged = cl.merged_profile(few.filter(F.col("mon").isin(months))).cache()
        assert merged.filter("feature = 'x'").first().n == 10_000 * len(months)
        for r in cl.profile_ranks(df.filter(F.col("mon").isin(months)), cl.to_profile(merged)).collect():
            p = C.PROFILE_PROBS[r.stat]
            assert r.below <= p + cl.sketch_error(200) and r.upto >= p - cl.sketch_error(200), r


def test_normal_equations(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(1e4, 1, (900, 30)) * rng.lognormal(0, 2, 30)
    x[:, 7] = 4.0  # constant
    y = x @ rng.normal(size=30) + rng.normal(size=900)
    rows = [(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows + [(-1, None, 1.0), (-2, x[0].tolist(), None), (-3, [None] * 30, 1.0)], "id int, inputs array<double>, target double").repartition(7)
    terms = {r.term: r.coefficient for r in mp.fit_baseline(df).collect()}
    c = x - x.mean(axis=0)
    used = [j for j in range(30) if j != 7]
    inner = c[:, used].T @ c[:, used] / 900
    want = np.linalg.solve(inner + np.diag(mp.RIDGE * np.diag(inner)), c[:, used].T @ (y - y.mean()) / 900)
    assert terms[7] == 0.0 and np.allclose([terms[j] for j in used], want, rtol=1e-6)
    got = {r.id: r.pred for r in mp.predict(df, mp.fit_baseline(df)).collect()}
    assert got[-1] is None and got[-3] is None and got[5] == pytest.approx(y.mean() + want @ c[5, used], rel=1e-6)
    assert mp.fit_baseline(df.filter("false")).count() == 0


def sentiment(spark, n=240):
    rng = np.random.default_rng(6)
    words, marks = [f"w{i}" for i in range(400)], {"bad": ["awful"], "good": ["fine", "bright"], "plain": ["***"]}
    rows = []
    for i in range(n):
        label = ("good", "good", "bad", "plain")[i % 4]
        body = list(rng.choice(words, 60)) + list(rng.choice(marks[label], 2)) * (label != "good" or i % 8 > 0)
        rows.append((i, " ".join(rng.permutation(body)), label))
    return spark.createDataFrame(rows, "doc_id int, text string, label string").repartition(5)


def test_text_model_learns_words_that_go_with_a_label(spark):
    known = sentiment(spark)
    model = tm.train(known.filter("doc_id % 3 > 0"), "label")
    assert model.classes == ["bad", "good", "plain"] and len(model.features) < 40
    odd = known.select("doc_id", "text", F.lit(1).alias("_row"), F.lit("old").alias("sentiment_label"))
    got = tm.classify(odd.unionByName(odd.limit(2).select(F.lit(-1).alias("doc_id"), F.lit(None).cast("string").alias("text"), "_row", "sentiment_label")), model)
    assert got.columns == ["doc_id", "text", "_row", "sentiment_label", "confidence_score"]
    rows = {r.doc_id: r for r in got.collect()}
    truth = {r.doc_id: r.label for r in known.collect()}
    test = [i for i in truth if i % 3 == 0]
    assert sum(rows[i].sentiment_label == truth[i] for i in test) >= 0.95 * len(test)
    assert rows[-1].sentiment_label == "good" and all(0.3 < r.confidence_score <= 1 for r in rows.values())
    assert tm.train(known.filter("false"), "label") is None and tm.classify(known.filter("false"), model).count() == 0


def test_text_model_gradient_and_places(spark, monkeypatch):
    monkeypatch.setattr(tm, "CHUNK", 5)
    rng = np.random.default_rng(0)
    rows = [(int(rng.integers(0, 3)), sorted(map(int, rng.choice(6, rng.integers(0, 5), replace=False)))) for _ in range(50)]
    stored = spark.createDataFrame(rows, "y long, f array<int>").repartition(4)
    w = rng.normal(size=(3, 7))
    loss, gradient = tm.loss_and_gradient(stored, w, 50)
    for k, j in ((0, 0), (1, 3), (2, 6)):
        up, down = w.copy(), w.copy()
        up[k, j] += 1e-5
        down[k, j] -= 1e-5
        assert gradient[k, j] == pytest.approx((tm.loss_and_gradient(stored, up, 50)[0] - tm.loss_and_gradient(stored, down, 50)[0]) / 2e-5, rel=1e-4)
    assert loss > 0


def test_word_pairs_do_not_cross_texts():
    f, edges = tm.ngrams(np.array([5, 6, 5, 6], np.int64), np.array([0, 1, 3, 4]), 1 << 20)
    assert np.diff(edges).tolist() == [1, 3, 1]
    place, at = tm.kept_only(f, edges, np.array([5]))
    assert place.tolist() == [0, 0] and at.tolist() == [0, 1, 2, 2]


class CountedModel:
    """Notes in a folder each load of itself and each batch it scores."""

    def __init__(self, folder):
        self.folder = folder

    def __reduce__(self):
        return loaded_model, (self.folder,)

    def __call__(self, x):
        note(self.folder, "scored")
        return x[:, -1, 0] + x.shape[1] * 100 + x.shape[2] * 1000


def note(folder, what):
    import os
    import uuid
    open(f"{folder}/{what}-{os.getpid()}-{uuid.uuid4().hex}", "w").close()


def loaded_model(folder):
    note(folder, "load")
    return CountedModel(folder)


def test_text_model_workers_take_bounded_parts(spark, sf, monkeypatch):
    monkeypatch.setattr(tm, "HELD", 50)
    lists = [list(range(n)) for n in (3, 0, 49, 120, 7, 7, 0, 40, 30)]
    batch = pa.RecordBatch.from_pydict({"f": pa.array(lists, pa.list_(pa.int64()))})
    cut = [p.column("f").to_pylist() for p in tm.parts([batch, batch.slice(2, 0), batch.slice(4)], "f")]
    assert [x for p in cut for x in p] == lists + lists[4:]
    assert all(len(p) == 1 or sum(map(len, p)) < 2 * tm.HELD + 120 for p in cut) and len(cut) > 5

    known = tx_plans.sentiment_texts(spark, sf)
    model = tm.train(known, "label", rounds=2)
    whole, narrow = tm.classify(known, model), tm.classify(known, model, keep=["doc_id"])
    assert narrow.columns == ["doc_id", "sentiment_label", "confidence_score"]
    assert sorted(map(tuple, whole.select(narrow.columns).collect())) == sorted(map(tuple, narrow.collect()))
    assert "_row#" in (plan := narrow._jdf.queryExecution().optimizedPlan().toString()) and "struct(doc_id, doc_id#" in plan and "text, text#" not in plan


def test_a_worker_loads_the_model_once(spark, tmp_path):
    windows = spark.range(64).select("id", F.array(*[F.array(F.col("id") * 1.0 + j, F.lit(0.0)) for j in range(3)]).alias("x")).repartition(32)
    rows = mp.score_windows(windows, CountedModel(str(tmp_path)), key="id").collect()
    assert {r.id: r.ml_score for r in rows} == {i: i + 2 + 300 + 2000 for i in range(64)}
    notes = [p.name.split("-") for p in tmp_path.iterdir()]
    loads = [pid for what, pid, _ in notes if what == "load"]
    scored = [pid for what, pid, _ in notes if what == "scored"]
    assert len(loads) == len(set(loads)) and set(loads) == set(scored) and len(scored) >= 2 * len(loads)
    odd = windows.withColumn("x", F.when(F.col("id") == 5, F.slice("x", 1, 2)).otherwise(F.col("x"))).repartition(1)
    with pytest.raises(Exception, match="differ in size"):
        mp.score_windows(odd, CountedModel(str(tmp_path)), key="id").collect()
    assert mp.score_windows(windows.filter("false"), CountedModel(str(tmp_path)), key="id").count() == 0


@pytest.mark.parametrize("days", [1, 8, 500])
def test_the_latest_steps_need_no_whole_grid(spark, days):
    rng = np.random.default_rng(days)
    rows = [(s, t, *map(float, rng.uniform(1, 9, 5))) for s in range(6) for t in range(90) if rng.random() < (0.9, 0.5, 1.0, 0.7, 0.4, 0.2)[s] and (s != 3 or t < 50)]
    bars = spark.createDataFrame(rows, "sec int, ym int, open double, high double, low double, close double, volume double").cache()
    whole = ind.feature_grid(bars)
    begin = max(0, 90 - C.PAD - days)
    has_bar = bars.filter(F.col("ym") >= begin + C.PAD).select("sec").distinct()
    want = whole.filter(F.col("day") >= begin).join(has_bar, "sec", "left_semi")
    got = ind.latest_grid(bars, days)
    cols = ["sec", "day", *[F.round(c, 9).alias(c) for c in ind.feature_names()]]
    assert got.count() == want.count() > 0 and got.select(*cols).exceptAll(want.select(*cols)).isEmpty()


def test_bucketed_tables_join_without_an_exchange(spark, sf):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, right = pu.bucketed(spark, sf, 4)
        done = pu.u.attach_codes(left, right)
        plan = done._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        plain = pu.u.attach_codes(left.select("*"), pu.good(spark, sf))
        assert done.count() == left.count() and done.exceptAll(plain.select(done.columns)).isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_one_scan_gives_panel_qa_and_summary(spark):
    rows = [(i, None if i == 3 else dt.date(2020, 1 + i % 3, 1), None if i % 7 == 0 else float(i * i), float("nan") if i == 5 else 1.0 / (i + 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "sec int, mon date, x double, y double")
    profile = {c: {"median": 5.0, "q0005": 0.0, "q01": 0.01, "q99": 900.0, "q995": 1000.0} for c in ("x", "y")}
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    panel, qa, summary = cl.clean_with_report(df.mapInArrow(counted, df.schema), "mon", ["x", "y"], profile)
    assert read.value == 60
    want = cl.clean_panel(df, "mon", ["x", "y"], profile)
    assert panel.count() == 60 and panel.select(want.columns).exceptAll(want).isEmpty()
    assert qa.exceptAll(cl.clean_qa(df, ["x", "y"], profile)).isEmpty() and qa.count() == 2
    assert summary.collect() == cl.clean_summary(df, "mon", ["x", "y"]).collect()
    assert read.value == 60


def test_a_sample_exchanges_slightly_more_than_it_keeps(spark, monkeypatch):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 3 > 0, F.sin("id")).alias("x"), F.when(F.col("id") % 500 == 0, 1.0).alias("y")).cache()
    drawn, cut = [], cl.cut_lineage
    monkeypatch.setattr(cl, "cut_lineage", lambda d, name="cut": drawn.append((name, cut(d, name))) or drawn[-1][1])
    got = cl.profile_sample(df, ["id"], ["x", "y"], per_chunk=300, chunk_rows=5000)
    counts = {(r.chunk, r.feature): r["count"] for r in got.groupBy("chunk", "feature").count().collect()}
    assert len(counts) == 8 and all(n == (300 if f == "x" else n) and n <= 300 for (_, f), n in counts.items())
    assert sum(n for (_, f), n in counts.items() if f == "y") == 40
    assert sum(d.count() for name, d in drawn if name == "drawn") < 4 * (300 + 150) + 40
    cells = got.select("chunk", "id", "feature").collect()
    again = cl.profile_sample(df.repartition(7), ["id"], ["x", "y"], per_chunk=300, chunk_rows=5000).select("chunk", "id", "feature").collect()
    assert sorted(cells) == sorted(again)


def test_a_sample_widens_thresholds_that_were_too_low(spark, monkeypatch):
    df = spark.range(4000).select("id", F.sin("id").alias("x")).cache()
    want = cl.profile_sample(df, ["id"], ["x"], per_chunk=100, chunk_rows=1000).select("chunk", "id").collect()
    monkeypatch.setattr(cl, "DRAW_MARGIN", -5)
    rounds, cut = [], cl.cut_lineage
    monkeypatch.setattr(cl, "cut_lineage", lambda d, name="cut": rounds.append(name) or cut(d, name))
    got = cl.profile_sample(df, ["id"], ["x"], per_chunk=100, chunk_rows=1000).select("chunk", "id").collect()
    assert rounds.count("drawn") >= 2 and sorted(got) == sorted(want)


@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_candidates_by_windows_and_by_slices(spark, sf, monkeypatch, rows):
    monkeypatch.setattr(od, "GROUP_ROWS", rows)
    made = spark.range(900).select(
        F.when(F.col("id") % 5 > 0, "s").otherwise(F.when(F.col("id") % 2 == 0, "t")).alias("sector"), (F.col("id") % 3).alias("mon"), "id", (F.col("id") % 40).alias("dt"),
        *[F.when(F.col("id") % 11 != k, F.round(F.sin(F.col("id") * (k + 1)), 1)).alias(c) for k, c in enumerate(("ma", "ma_slope", "mom", "vol_fc"))])
    scored = sel.score_universe(made, ["sector", "mon"], ["id"])
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert ("Join" in plan) == (rows == 0)
    got = sel.select_candidates(scored, ["sector", "mon"], ["id"])
    data = scored.toPandas()
    data["k"] = data["composite_score"].round(9)
    want = set()
    for (s, m), g in data.groupby(["sector", "mon"], dropna=False):
        g = g.sort_values(["k", "id"], ascending=[False, True])["id"].tolist()
        n = max(1, int(len(g) * 0.15))
        want |= {("long", i, r + 1) for r, i in enumerate(g[:n])} | {("short", i, r + 1) for r, i in enumerate(g[-n:])}
    assert {(r.candidate_type, r.id, r.selection_rank) for r in got.collect()} == want and data["sector"].isna().any()
    ranks = data.groupby(["sector", "mon"], dropna=False)["vol_fc"].rank()
    assert (data["vol_rank"].astype(float).fillna(-1) == ranks.fillna(-1)).all()


def test_windows_of_more_rows_get_more_tasks(spark, monkeypatch):
    rows = [(g, s, float((s * 7 + g) % 50), 1.0, 0.1, float(s % 9)) for g in range(40) for s in range(20)]
    df = spark.createDataFrame(rows, "mon int, sec int, mom double, ma double, ma_slope double, vol_fc double").withColumn("dt", F.lit(1))
    picked = lambda: sel.select_candidates(sel.score_universe(df, ["mon"], ["sec"]), ["mon"], ["sec"])
    assert "REPARTITION_BY_NUM" not in (plan := lambda x: x._jdf.queryExecution().executedPlan().toString())(picked())
    want = sorted(map(tuple, picked().collect()))
    monkeypatch.setattr(od, "TASK_ROWS", 40)
    dealt = picked()
    assert plan(dealt).count("Exchange hashpartitioning") == 1 and "20), REPARTITION_BY_NUM" in plan(dealt)
    assert sorted(map(tuple, dealt.collect())) == want


def test_series_are_dealt_by_rows(spark, sf, monkeypatch):
    """Windows over securities get tasks by the rows of lineitem and no further exchange."""
    monkeypatch.setattr(od, "TASK_ROWS", 500)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before, tasks = spark.conf.get(key), od.tasks_for(v.table(spark, sf, "lineitem"))
    spark.conf.set(key, "-1")  # the test's panel would be broadcast
    plan = v.panel_ret(spark, sf)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set(key, before)
    above = plan[:plan.index("SortMergeJoin")]
    assert tasks > 8 and f", {tasks}), REPARTITION_BY_NUM" in plan and "Window" in above and "Exchange" not in above


def test_raw_text_is_stored_before_it_is_typed(spark, sf, monkeypatch):
    seen, real = [], cl.coerce_numeric
    monkeypatch.setattr(cl, "coerce_numeric", lambda df, *a, **k: seen.append(df) or real(df, *a, **k))
    cl_plans.clean_raw(spark, sf)
    assert len(seen) == 1 and hasattr(seen[0], "stored_at")


@pytest.mark.parametrize("margin", [6, 0])
def test_sample_sorts_only_around_the_threshold(spark, monkeypatch, margin):
    """Values surely in are not sorted; where more than wanted lie below the second threshold, all are. Same picks."""
    df = spark.range(20000).withColumn("x", F.col("id").cast("double"))
    want = {tuple(r) for r in df.select((F.conv(F.left(F.md5(F.concat_ws("|", "id", F.lit(str(C.SAMPLE_SEED)))), F.lit(8)), 16, 10).cast("bigint") % 4).alias("chunk"), "id",
            F.md5(F.concat_ws("|", F.lit("x"), "id", F.lit(str(C.SAMPLE_SEED)))).alias("h")).withColumn(
            "p", F.row_number().over(Window.partitionBy("chunk").orderBy("h", "id"))).filter("p <= 2000").select("chunk", "id").collect()}
    tables, real = [], cl.cut_lineage
    monkeypatch.setattr(cl, "cut_lineage", lambda d, name="cut": tables.append((name, real(d, name))) or tables[-1][1])
    monkeypatch.setattr(cl, "DRAW_MARGIN", margin)
    got = [tuple(r) for r in cl.profile_sample(df, ["id"], ["x"], per_chunk=2000, chunk_rows=5000).select("chunk", "id").collect()]
    assert len(got) == len(want) == 8000 and set(got) == want
    drawn = next(t for name, t in tables if name == "drawn")
    assert drawn.filter("NOT _low").count() < 0.4 * drawn.count()


def test_ranks_of_small_groups_are_windows(spark, sf, monkeypatch):
    from panelspark.plans import signals
    monkeypatch.setattr(sel, "with_average_rank", None)
    assert signals.cs_rank_score(spark, sf).count() > 0


def test_all_partitions_write_company_files(spark, tmp_path):
    """Few bytes are not joined into one writing task; the listing limit is as before afterwards."""
    from panelspark.sources import sinks, tables
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    limit = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    df = spark.range(120).select((F.col("id") % 60).cast("string").alias("company_id"), (F.col("id") % 2).cast("int").alias("ym"))
    sinks.write_company_csv(df, str(tmp_path / "csv"))
    assert len({f.name.split("-")[1] for f in tmp_path.glob("csv/*/part-*.csv")}) > 4
    back = tables.read_company_csv(spark, str(tmp_path / "csv"), "ym int")
    assert back.count() == 120 and back.select("company_id").distinct().count() == 60
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == limit
