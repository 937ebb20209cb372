"""Model input windows, labels, masks, scoring plug point and evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.constants import PREDICTION_EDGES
from panelspark.functions.expr import ratio, same_key
from panelspark.functions.ordered import dealt_by_size, fits_window, running_sums, with_row_number
from panelspark.storage import cut_lineage

RIDGE = 1e-3


def sequences(grid: DataFrame, length: int, features: list[str], close: str = "close_raw", key: str = "sec",
              day: str = "day", check: list[str] | None = None) -> DataFrame:
    """For day i the window i-length..i-1, the labels (close at i-1, close at i) and a validity flag.

    A sample is valid when no cell of ``check`` (default: ``features``) in the window and no label
    is missing. The last day of the grid yields no sample. Windows hold ``length`` rows at most.
    """
    win = Window.partitionBy(key).orderBy(day)
    back = win.rowsBetween(-length, -1)
    checked = check or features
    whole = F.lit(True)
    for c in checked:
        whole = whole & F.col(c).isNotNull()
    rows = grid.withColumn("_ok", whole.cast("int"))
    rows = rows.withColumn("_last", F.max(day).over(Window.partitionBy(key)))
    made = rows.select(
        key, day, "_last",
        F.collect_list(F.array(*[F.col(c) for c in features])).over(back).alias("x"),
        F.count(F.lit(1)).over(back).alias("_n"), F.sum("_ok").over(back).alias("_sum"),
        F.lag(close).over(win).alias("base"), F.col(close).alias("target"),
        F.avg(close).over(back).alias("window_mean"))
    made = made.filter((F.col("_n") == length) & (F.col(day) < F.col("_last")))
    valid = (F.col("_sum") == length) & F.col("base").isNotNull() & F.col("target").isNotNull()
    return made.select(key, day, "x", "base", "target", valid.alias("valid"), "window_mean")


def time_split(index: Column, valid_start: int, test_start: int) -> Column:
    return F.when(index < valid_start, "train").when(index < test_start, "valid").otherwise("test")


def label_encode(df: DataFrame, key: str, sector: str) -> DataFrame:
    """Dense labels from 0 for security and sector; missing or n/a sectors get -1."""
    keys = with_row_number(df.select(key).distinct(), [], [F.col(key).asc()], "_k").select(
        key, (F.col("_k") - 1).alias("key_label"))
    known = df.select(sector).distinct().filter(F.col(sector).isNotNull() & (F.col(sector) != "n/a"))
    sectors = with_row_number(known, [], [F.col(sector).asc()], "_s").select(
        sector, (F.col("_s") - 1).alias("sector_label"))
    out = df.select(key, sector).distinct().join(keys, key).join(sectors, sector, "left")
    return out.withColumn("sector_label", F.coalesce("sector_label", F.lit(-1)))


def random_mask(samples: DataFrame, features: list[str], length: int, rate: float, seed: int, key: str = "sec",
                day: str = "day") -> DataFrame:
    """Set round(length * rate) steps of every feature and sample to 0.

    The steps come from hashes of sample, feature, step and seed, so a rerun masks the same cells.
    """
    k = round(length * abs(rate))

    def hidden(j):
        named = lambda s: F.concat_ws("|", *[c.cast("string") for c in (F.col(key), F.col(day), F.lit(j), F.lit(s), F.lit(seed))])
        drawn = F.sort_array(F.array(*[F.struct(F.md5(named(s)).alias("h"), F.lit(s).alias("s")) for s in range(length)]))
        return F.slice(drawn, 1, k).getField("s") if k else F.array().cast("array<int>")

    # Spelled out per step, not as a lambda: the draws are then made once per sample, not once per step, and compiled.
    drawn = samples.withColumns({f"_m{j}": hidden(j) for j in range(len(features))})
    row = lambda s: F.get("x", F.lit(s))
    value = lambda s, j: F.when(F.array_contains(F.col(f"_m{j}"), F.lit(s)), 0.0).otherwise(row(s)[j])
    steps = F.array(*[F.array(*[value(s, j) for j in range(len(features))]) for s in range(length)])
    whole = F.slice(F.concat(steps, F.slice("x", length + 1, F.size("x"))), F.lit(1), F.size("x"))  # windows of other lengths stay as long
    return drawn.withColumn("masked_x", F.when(F.col("x").isNotNull(), whole)).drop(*[f"_m{j}" for j in range(len(features))])


def latest_window(grid: DataFrame, features: list[str], days: int = 32, key: str = "sec", day: str = "day",
                  max_missing: float = 0.75) -> DataFrame:
    """The last ``days`` rows per security, missing cells 0, padded with zero rows on the left.

    Securities with more than ``max_missing`` of the cells missing are skipped.
    """
    newest = Window.partitionBy(key).orderBy(F.col(day).desc())
    last = grid.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= days)
    gaps = sum([F.col(c).isNull().cast("int") for c in features[1:]], F.col(features[0]).isNull().cast("int"))
    row = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in features])
    per = last.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(day, row.alias("r")))), lambda s: s["r"]).alias("x"),
        (F.sum(gaps) / (F.count("*") * len(features))).alias("missing_share"))
    zeros = F.array_repeat(F.lit(0.0), len(features))
    pad = F.array_repeat(zeros, F.greatest(F.lit(0), F.lit(days) - F.size("x")))
    return per.filter(F.col("missing_share") <= max_missing).withColumn("x", F.concat(pad, F.col("x")))


def score_windows(windows: DataFrame, model: Callable, key: str = "sec", name: str = "ml_score") -> DataFrame:
    """Plug point: ``model`` gets an array [rows, days, features] and returns one score per row.

    The model is a broadcast: an executor fetches it once, and a Python worker loads it once for all
    its tasks. Windows must be equally long; their cells arrive as one buffer and are not copied.
    """
    import pyarrow as pa

    key_type = windows.schema[key].dataType.simpleString()
    shared = windows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = shared.value
        for b in batches:
            if b.num_rows:
                steps = b.column("x").flatten()
                days, width = len(steps) // b.num_rows, len(steps.flatten()) // max(1, len(steps))
                sizes = {*b.column("x").value_lengths().unique().to_pylist(), *[days]}, {*steps.value_lengths().unique().to_pylist(), *[width]}
                if sizes != ({days}, {width}):
                    raise ValueError(f"windows differ in size: {sizes}")
                x = steps.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, days, width)
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(score(x), pa.float64())], names=[key, name])

    return windows.select(key, "x").mapInArrow(run, f"{key} {key_type}, {name} double")


def moments(samples: DataFrame, inputs: str, target: str):
    """Count, means and covariance matrix of the inputs (an array column) followed by the target.

    Two passes: means first, then sums of outer products of what is left, which loses no digits to
    large means. A task returns one row per input; the matrix that reaches the driver has the size
    of the model, whatever the number of samples.
    """
    import numpy as np
    import pyarrow as pa

    rows = samples.filter(F.col(inputs).isNotNull() & F.col(target).isNotNull() & ~F.exists(inputs, lambda v: v.isNull() | F.isnan(v)))
    rows = rows.select(F.concat(F.col(inputs).cast("array<double>"), F.array(F.col(target).cast("double"))).alias("v"))
    means = rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.count("*").alias("n")).orderBy("i").collect()
    if not means:
        return 0, np.zeros(0), np.zeros((0, 0))
    centre = np.array([r["m"] for r in means])

    def outer(batches):
        total = np.zeros((len(centre), len(centre)))
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(centre)) - centre
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centre), dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "s"])

    sums = rows.mapInArrow(outer, "i int, s array<double>").select("i", F.posexplode("s").alias("j", "s"))
    matrix = np.zeros((len(centre), len(centre)))
    for r in sums.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        matrix[r["i"], r["j"]] = r["s"] / means[0]["n"]
    return means[0]["n"], centre, matrix


def fit_baseline(samples: DataFrame, inputs: str = "inputs", target: str = "target", ridge: float = RIDGE) -> DataFrame:
    """Linear regression of ``target`` on the array ``inputs``: rows (term, coefficient), term -1 the intercept.

    Normal equations of the centred values, solved by Cholesky factors. ``ridge`` times an input's
    variance is added to the diagonal, so the scale of an input does not matter and dependent
    inputs share their weight. Constant inputs get 0; no samples give no rows.
    """
    import numpy as np

    n, centre, cov = moments(samples, inputs, target)
    beta = np.zeros(max(0, len(centre) - 1))
    used = np.flatnonzero(np.diag(cov)[:-1] > 0)
    if len(used):
        inner = cov[np.ix_(used, used)] + np.diag(ridge * np.diag(cov)[used])
        root = np.linalg.cholesky(inner)
        beta[used] = np.linalg.solve(root.T, np.linalg.solve(root, cov[used, -1]))
    terms = [(i, float(b)) for i, b in enumerate(beta)] + ([(-1, float(centre[-1] - beta @ centre[:-1]))] if n else [])
    return samples.sparkSession.createDataFrame(terms, "term int, coefficient double")


def predict(samples: DataFrame, terms: DataFrame, inputs: str = "inputs", name: str = "pred") -> DataFrame:
    """Adds the regression's value, NULL where an input is missing."""
    fitted = {r["term"]: r["coefficient"] for r in terms.collect()}  # one row per input
    weights = F.array(*[F.lit(fitted[i]) for i in range(len(fitted) - 1)]).cast("array<double>")
    dot = F.aggregate(F.zip_with(F.col(inputs), weights, lambda x, w: x * w), F.lit(fitted.get(-1, 0.0)), lambda a, b: a + b)
    return samples.withColumn(name, dot)


def masked_return_mse(df: DataFrame, by: str = "day") -> DataFrame:
    """Mean squared difference of predicted and true return ratios over valid rows."""
    err = ratio(F.col("pred") - F.col("base"), F.col("base")) - ratio(F.col("target") - F.col("base"), F.col("base"))
    return df.filter("valid").groupBy(by).agg(F.avg(err * err).alias("reg_loss"), F.count("*").alias("n"))


def pairwise_rank_loss(df: DataFrame, by: str = "day", key: str = "sec", symmetric: bool = False) -> DataFrame:
    """sum over i, j of max(0, (p_i - p_j)(p_j - o_i)) / n^2 with p predicted and o true return ratio.

    The product is positive exactly for p_j between o_i and p_i, where it equals
    -p_j^2 + (p_i + o_i) p_j - p_i o_i. So running counts, sums and square sums of p in value
    order, read at both ends of each interval, replace all pairs.

    ``symmetric`` gives sum over i, j of max(0, -(p_i - p_j)(o_i - o_j)) / n^2 instead, the pairs that
    both returns order differently.
    """
    if symmetric:
        return symmetric_rank_loss(df, by, key)
    p = ratio(F.col("pred") - F.col("base"), F.col("base"))
    o = ratio(F.col("target") - F.col("base"), F.col("base"))
    rows = df.filter("valid").select(by, key, p.alias("p"), o.alias("o"))
    point = F.struct(F.lit(0).alias("kind"), F.col("p").alias("v"), F.lit(1.0).alias("c"), F.lit(0.0).alias("sign"))
    edge = lambda k, v, s: F.struct(F.lit(k).alias("kind"), v.alias("v"), F.lit(0.0).alias("c"), F.lit(s).alias("sign"))
    marks = rows.select(by, key, "p", "o", F.explode(F.array(
        point, edge(1, F.least("p", "o"), -1.0), edge(2, F.greatest("p", "o"), 1.0))).alias("e"))
    marks = marks.select(by, key, "p", "o", "e.*")
    v, c = F.col("v"), F.col("c")
    run = running_sums(marks, [by], [v.asc(), F.col("kind").asc(), F.col(key).asc()],
                       {"n0": c, "n1": c * v, "n2": c * v * v})
    part = F.col("sign") * (-F.col("n2") + (F.col("p") + F.col("o")) * F.col("n1") - F.col("p") * F.col("o") * F.col("n0"))
    n = F.sum("c")
    return run.groupBy(by).agg((F.sum(part) / (n * n)).alias("rank_loss"), n.cast("bigint").alias("n"))


def symmetric_rank_loss(df: DataFrame, by: str, key: str) -> DataFrame:
    """Sum of (p_i - p_j)(o_j - o_i) over the pairs in opposite order, without pairs.

    A group of m rows is cut into about m^(1/3) blocks of equal size by the rank of ``o``, and again by the
    rank of ``p``. Two rows lie in one block of ``o``; or only in one block of ``p``; or in none, and then
    their blocks settle the order, so the sums of their cells (block of ``o``, block of ``p``) do. A row goes
    to its two blocks and a group's cells to a third kind of block. All have about m^(2/3) rows at most.
    Rows without returns count in ``n`` only.
    """
    p = ratio(F.col("pred") - F.col("base"), F.col("base"))
    o = ratio(F.col("target") - F.col("base"), F.col("base"))
    rows = cut_lineage(df.filter("valid").select(by, key, p.alias("p"), o.alias("o")), "returns")
    known = rows.filter("p IS NOT NULL AND o IS NOT NULL")
    if fits_window(known, [by]):
        day = Window.partitionBy(by)
        ranked = dealt_by_size(known, [by]).withColumns({
            "m": F.count(F.lit(1)).over(day), **{f"r{c}": F.row_number().over(day.orderBy(c, key)) for c in ("o", "p")}})
    else:
        one = F.lit(1).cast("bigint")
        ranked = running_sums(known, [by], [F.col("o").asc(), F.col(key).asc()], {"ro": one}, {"ro": "m"}, stored=True)
        ranked = running_sums(ranked, [by], [F.col("p").asc(), F.col(key).asc()], {"rp": one})
    block = lambda r: F.floor((F.col(r) - 1) * F.ceil(F.cbrt("m")) / F.col("m"))
    ranked = cut_lineage(ranked.select(by, "p", "o", "ro", block("ro").alias("bo"), block("rp").alias("bp")), "ranks")
    sums = [F.lit(1.0).alias("n"), F.col("p").alias("sp"), F.col("o").alias("so"), (F.col("p") * F.col("o")).alias("spo")]
    place = lambda kind, b, at, g: F.struct(F.lit(kind).alias("kind"), F.col(b).alias("block"), F.col(at).cast("double").alias("at"), F.col(g).cast("long").alias("g"))
    placed = ranked.select(by, F.explode(F.array(place(0, "bo", "p", "ro"), place(1, "bp", "p", "bo"))).alias("e"), *sums)
    cells = ranked.groupBy(by, "bo", "bp").agg(*[F.sum(x).alias(c) for x, c in zip(sums, ("n", "sp", "so", "spo"), strict=True)])
    cells = cells.select(by, F.struct(F.lit(2).alias("kind"), F.lit(0).cast("long").alias("block"), F.col("bp").cast("double").alias("at"), F.col("bo").alias("g")).alias("e"), "n", "sp", "so", "spo")
    whole = placed.unionByName(cells).select(by, "e.*", "n", "sp", "so", "spo")
    found = whole.groupBy(by, "kind", "block").applyInArrow(lambda t: inverted(t, by), f"{by} {df.schema[by].dataType.simpleString()}, s double")
    total = found.groupBy(by).agg(F.sum("s").alias("s"))
    n = rows.groupBy(by).agg(F.count("*").alias("n"))
    return same_key(n, total, [by], "left").select(by, (2 * F.coalesce("s", F.lit(0.0)) / (F.col("n") * F.col("n"))).alias("rank_loss"), "n")


def inverted(block, by: str):
    """The sum of (p_j - p_i)(o_i - o_j) over i before j in the order of ``at`` where ``g`` falls.

    Two numbers differ first in one bit: for each bit, rows that agree above it are one run, and running sums
    over those with the bit meet those without. Rows may stand for several: ``n`` and their sums.
    """
    import numpy as np
    import pyarrow as pa

    at, g, n, sp, so, spo = (block.column(c).to_numpy() for c in ("at", "g", "n", "sp", "so", "spo"))
    order = np.lexsort((g, at))
    g, sums, total = g[order] - g.min(), np.stack([n, sp, so, spo])[:, order], 0.0
    for bit in range(int(g.max()).bit_length()):
        line = np.argsort(g >> (bit + 1), kind="stable")
        run, high = g[line] >> (bit + 1), (g[line] >> bit & 1).astype(bool)
        first = np.searchsorted(run, run)  # where each row's run starts
        here = sums[:, line]
        before = np.cumsum(np.pad(np.where(high, here, 0.0), ((0, 0), (1, 0))), axis=1)
        cn, cp, co, cpo = (before[:, :-1] - before[:, first])[:, ~high]
        n_j, p_j, o_j, po_j = here[:, ~high]
        total += float((p_j * co - po_j * cn - n_j * cpo + o_j * cp).sum())
    return pa.table({by: block.column(by).slice(0, 1), "s": [total]})


def topk_pnl(df: DataFrame, ks: list[int], by: str = "day", key: str = "sec") -> DataFrame:
    """Mean true return of the K best predictions per day: its sum over days and mean over deviation.

    The deviation is the population one.
    """
    p = ratio(F.col("pred") - F.col("base"), F.col("base"))
    o = ratio(F.col("target") - F.col("base"), F.col("base"))
    best = Window.partitionBy(by).orderBy(F.col("p").desc(), F.col(key).asc())
    top = df.filter("valid").select(by, key, F.round(p, 9).alias("p"), o.alias("o")).withColumn(
        "pos", F.row_number().over(best)).filter(F.col("pos") <= max(ks))
    daily = top.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter(F.col("pos") <= F.col("k")) \
        .groupBy("k", by).agg(F.avg("o").alias("r"))
    return daily.groupBy("k").agg(F.sum("r").alias("pnl"), F.coalesce(
        ratio(F.avg("r"), F.stddev_pop("r")), F.lit(0.0)).alias("sharpe"), F.count("*").alias("days"))


def shuffle_samples(df: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Rows in a random order that a rerun repeats."""
    return df.orderBy(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)), *keys)


def compare_predictions(df: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Statistics of two prediction columns side by side, with difference and percent change."""
    both = df.agg(*[e for c, s in ((a, "a"), (b, "b")) for e in (
        F.count("*").cast("double").alias(f"total_{s}"), F.count(c).cast("double").alias(f"valid_{s}"),
        F.avg(c).alias(f"mean_{s}"), F.max(c).alias(f"max_{s}"), F.min(c).alias(f"min_{s}"),
        F.stddev_pop(c).alias(f"std_{s}"),
        F.max_by(key, F.struct(F.col(c), -F.col(key))).cast("double").alias(f"top_{s}"))])
    names = ["total", "valid", "mean", "max", "min", "std", "top"]
    rows = both.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(f"{n}_a").alias("first"), F.col(f"{n}_b").alias("second")) for n in names])))
    diff = F.col("second") - F.col("first")
    return rows.select("metric", "first", "second", diff.alias("difference"),
                       F.coalesce(ratio(diff, F.col("first")) * 100, F.lit(0.0)).alias("pct_change"),
                       (F.col("first") == F.col("second")).alias("same"),
                       ratio(F.col("first"), F.col("second")).alias("ratio"))


def prediction_histogram(df: DataFrame, score: str, edges: list[float] = PREDICTION_EDGES) -> DataFrame:
    """Count and percent per bin [low, high)."""
    x = F.col(score)
    bins = list(zip(edges[:-1], edges[1:]))
    counts = df.agg(F.count(x).alias("n"), *[
        F.count(F.when((x >= lo) & (x < hi), 1)).alias(f"b{i}") for i, (lo, hi) in enumerate(bins)])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(lo).alias("low"), F.lit(hi).alias("high"), F.col(f"b{i}").alias("n"),
                 F.coalesce(ratio(F.col(f"b{i}").cast("double"), F.col("n").cast("double")) * 100, F.lit(0.0)).alias("pct"))
        for i, (lo, hi) in enumerate(bins)])))


def prediction_outlook(df: DataFrame, score: str, key: str, top: int = 5) -> DataFrame:
    """Outlook from the mean score, confidence from the mean of the best over the deviation."""
    best = df.filter(F.col(score).isNotNull()).orderBy(F.col(score).desc(), key).limit(top).agg(F.avg(score).alias("t"))
    m, c = F.col("mean"), F.col("confidence")
    return df.agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std")).withColumn("top_mean", best.scalar()) \
        .withColumn("confidence", F.when(F.col("std") > 0, F.col("top_mean") / F.col("std")).otherwise(0.0)) \
        .select("mean", "std", "confidence",
                F.when(m > 0.1, "BULLISH").when(m < -0.1, "BEARISH").otherwise("NEUTRAL").alias("outlook"),
                F.when(c > 1.0, "HIGH").when(c > 0.5, "MEDIUM").otherwise("LOW").alias("confidence_band"))
