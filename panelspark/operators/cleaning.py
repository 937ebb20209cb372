"""Profiling and cleaning of a wide factor panel.

Every step is a list of column expressions applied in one ``select``. The profile has one
entry per feature, so it is fetched to the driver and its numbers become literals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F, types as T

from panelspark import constants as C
from panelspark.functions.expr import clip, log1p_positive, month_of, nan_to_null, same_key, signed_log, without_nan
from panelspark.functions.quantile import exact_quantiles, median_and_mad, wide
from panelspark.storage import cut_lineage

Profile = dict[str, dict[str, float]]
DRAW_MARGIN = 6  # deviations by which a sample's first threshold lies above the wanted number


def infer_category(column: str, themes: dict[str, str] | None = None) -> str:
    """Explicit theme, else return tags, else the first keyword contained, else other."""
    name = column.lower()
    theme = (themes or {}).get(name)
    if theme in C.CATEGORIES and theme != "other":
        return theme
    if any(tag in name for tag in C.RETURN_TAGS):
        return "returns"
    return next((cat for word, cat in C.CATEGORY_KEYWORDS if word in name), "other")


def category_of(name: Column) -> Column:
    """The same rules as an expression over a column of names."""
    low = F.lower(name)
    out = None
    for word, cat in [*[(t, "returns") for t in C.RETURN_TAGS], *C.CATEGORY_KEYWORDS]:
        hit = F.contains(low, F.lit(word))
        out = F.when(hit, cat) if out is None else out.when(hit, cat)
    return out.otherwise("other")


def feature_columns(df: DataFrame, exclude: list[str] = ()) -> list[str]:
    """Numeric columns that are no identifier, target, flag or excluded column."""
    skip = {*C.ID_COLUMNS, C.TARGET_COLUMN, *exclude}
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in skip
            and not f.name.endswith("_was_missing")]


def date_column(df: DataFrame) -> str:
    """The first accepted date column."""
    found = next((c for c in C.DATE_COLUMNS if c in df.columns), None)
    if found is None:
        raise KeyError(f"no date column among {df.columns[:20]}")
    return found


def first_of_repeated(df: DataFrame) -> DataFrame:
    """Keep the first of columns with equal names."""
    names = df.columns
    kept = [i for i, n in enumerate(names) if n not in names[:i]]
    unique = df.toDF(*[f"_{i}" for i in range(len(names))])
    return unique.select(*[F.col(f"_{i}").alias(names[i]) for i in kept])


def standard_columns(df: DataFrame) -> DataFrame:
    """Unique names, identifiers as strings, a parsed date and a month key."""
    df = first_of_repeated(df)
    day = date_column(df)
    out = [F.col(c).cast("string").alias(c) if c in C.ID_COLUMNS
           else F.to_date(c).alias(c) if c == day else F.col(c) for c in df.columns]
    return without_nan(df.select(*out, month_of(F.to_date(day)).alias("month_key")))


def coerce_numeric(df: DataFrame, candidates: list[str], share: float = C.NUMERIC_SHARE) -> DataFrame:
    """Turn string columns into numbers where at least ``share`` of the rows convert."""
    if not candidates:
        return df
    rates = df.agg(*[F.avg(F.expr(f"try_cast(`{c}` AS double)").isNotNull().cast("double")).alias(c)
                     for c in candidates]).first()
    numeric = {c for c in candidates if rates[c] is not None and rates[c] >= share}
    return df.select(*[nan_to_null(F.expr(f"try_cast(`{c}` AS double)")).alias(c) if c in numeric else F.col(c)
                       for c in df.columns])


def to_profile(rows: DataFrame) -> Profile:
    return {r["feature"]: {s: r[s] for s in C.PROFILE_PROBS} for r in rows.collect()}


def profile_table(df: DataFrame, features: list[str]) -> DataFrame:
    """Median and tail quantiles per feature over all rows of a stored table."""
    return exact_quantiles(df, [], features, C.PROFILE_PROBS)


def profile_sketches(df: DataFrame, by: list[str], features: list[str], k: int = C.SKETCH_SIZE) -> DataFrame:
    """One mergeable quantile sketch per group and feature: rows (group, feature, sketch, n).

    Written as a table, it answers for any span of groups later without the rows. A sketch holds
    about ``3 k`` numbers however many values it has seen; groups without known values have no row.
    """
    each = df.groupBy(*by).agg(*[F.kll_sketch_agg_double(nan_to_null(F.col(c).cast("double")), F.lit(k)).alias(c) for c in features])
    long = each.unpivot(by, features, "feature", "sketch").withColumn("n", F.kll_sketch_get_n_double("sketch"))
    return long.filter("n > 0")


def merged_profile(sketches: DataFrame, by: list[str] = ()) -> DataFrame:
    """The profile table of any span of groups, and ``n``, the number of values behind it."""
    merged = sketches.groupBy(*by, "feature").agg(F.kll_merge_agg_double("sketch").alias("s"), F.sum("n").alias("n"))
    q = F.kll_sketch_get_quantile_double("s", F.array(*map(F.lit, C.PROFILE_PROBS.values())))
    named = merged.withColumn("q", q).select(*by, "feature", "n", *[F.col("q")[i].alias(c) for i, c in enumerate(C.PROFILE_PROBS)])
    return named


def sketch_error(k: int = C.SKETCH_SIZE) -> float:
    """Rank error that a quantile of a sketch keeps to: twice the one stated for 99 of 100 answers."""
    return 2 * 2.296 / k ** 0.9021


def profile_approx(df: DataFrame, features: list[str], k: int = C.SKETCH_SIZE) -> DataFrame:
    """The profile table from bounded sketches, in one pass."""
    return merged_profile(profile_sketches(df, [], features, k)).drop("n")


def profile_ranks(df: DataFrame, profile: Profile) -> DataFrame:
    """Where the values of a profile truly stand: rows (feature, stat, below, upto), shares of the known values."""
    features = [c for c in profile if c in df.columns]
    stats = [(c, n, profile[c][n]) for c in features for n in C.PROFILE_PROBS if profile[c][n] is not None]
    x = {c: nan_to_null(F.col(c).cast("double")) for c in features}
    row = df.agg(*[F.struct(F.avg((x[c] < v).cast("double")).alias("below"), F.avg((x[c] <= v).cast("double")).alias("upto")).alias(f"{c}|{n}")
                   for c, n, v in stats])
    long = row.unpivot([], [f"{c}|{n}" for c, n, _ in stats], "at", "q")
    return long.select(F.substring_index("at", "|", 1).alias("feature"), F.substring_index("at", "|", -1).alias("stat"), "q.below", "q.upto")


def profile_sample(df: DataFrame, keys: list[str], features: list[str], per_chunk: int = C.SAMPLE_ROWS_PER_CHUNK,
                   chunk_rows: int = C.CHUNK_ROWS, seed: int = C.SAMPLE_SEED) -> DataFrame:
    """Per hash chunk of about ``chunk_rows`` rows and feature, up to ``per_chunk`` known values.

    The chunk and the drawing order are hashes of the row key and the seed, so chunks are even
    and a rerun draws the same rows. The first ``per_chunk`` values by hash are wanted: counts tell below
    which hash slightly more lie, and only those are exchanged. Where fewer lie there, the threshold is
    raised for that chunk and feature and the rest is drawn again. Those below a second threshold, slightly
    fewer than wanted, are in; only the others are sorted, and all where it is not below. The result does
    not depend on the thresholds. ``df`` is read several times, so it should be a stored table.
    """
    row = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    number = lambda h: F.conv(F.left(h, F.lit(8)), 16, 10).cast("bigint")
    chunks = F.greatest(F.lit(1), F.ceil(df.agg(F.count("*").alias("n")).scalar() / chunk_rows))
    cells = (
        df.withColumn("_row", row).withColumn("chunk", F.pmod(number(F.md5("_row")), chunks))
        .select("chunk", "_row", *keys, *[F.col(c).cast("double").alias(c) for c in features])
        .unpivot(["chunk", "_row", *keys], features, "feature", "value").filter(F.col("value").isNotNull())
    )

    def digits(share):
        """A share of all hashes as the first eight digits of the first one beyond; "g" lies above every digit."""
        beyond = F.ceil(share * 2.0**32).cast("bigint")
        return F.when(beyond >= 2**32, "g").otherwise(F.lpad(F.lower(F.hex(beyond)), 8, "0"))

    margin, n = DRAW_MARGIN * per_chunk ** 0.5, F.col("n")
    share, sure = F.least(F.lit(1.0), (per_chunk + margin) / n), F.least(F.lit(1.0), F.lit(max(0.0, per_chunk - margin)) / n)
    limits = cut_lineage(cells.groupBy("chunk", "feature").agg(F.count("*").alias("n")).withColumns({"share": share, "sure": digits(sure)}), "draw_limits")
    parts = []
    while True:
        at = limits.select("chunk", "feature", "sure", digits(F.col("share")).alias("_limit"))
        hashed = cells.withColumn("_h", F.md5(F.concat_ws("|", "feature", "_row"))).drop("_row")
        found = hashed.join(at, ["chunk", "feature"]).filter(F.col("_h") < F.col("_limit"))
        found = cut_lineage(found.withColumn("_low", F.col("_h") < F.col("sure")).drop("sure", "_limit"), "drawn")
        held = found.groupBy("chunk", "feature").agg(F.count("*").alias("held"), F.count(F.when(F.col("_low"), 1)).alias("low"))
        state = limits.join(held, ["chunk", "feature"], "left").withColumn(
            "short", F.coalesce("held", F.lit(0)) < F.least(F.col("n"), F.lit(per_chunk)))
        state = cut_lineage(state, "draw_state")  # its size is known then, so the drawn rows are not exchanged to meet it
        # the places left for the others; all are sorted where more than wanted lie below
        left = F.when(F.col("low") <= per_chunk, per_chunk - F.col("low"))
        parts.append(found.join(state.filter("NOT short").select("chunk", "feature", left.alias("_left")), ["chunk", "feature"]))
        limits = cut_lineage(state.filter("short").select("chunk", "feature", "n", F.least(F.lit(1.0), F.col("share") * 2).alias("share"), "sure"), "draw_limits")
        if limits.isEmpty():
            break
    drawn = reduce(DataFrame.unionByName, parts)
    inside = F.col("_low") & F.col("_left").isNotNull()
    draw = Window.partitionBy("chunk", "feature").orderBy("_h", *keys)
    ranked = drawn.filter(~inside).withColumn("pick", F.row_number().over(draw)).filter(F.col("pick") <= F.coalesce("_left", F.lit(per_chunk)))
    return drawn.filter(inside).unionByName(ranked.drop("pick")).select("chunk", *keys, "feature", "value")


def winsorized(c: Column, category: str, stats: dict[str, float] | None) -> Column:
    """Clip at the category's tail quantiles; unchanged without a profile."""
    lo, hi = ("q0005", "q995") if category == "returns" else ("q01", "q99")
    if not stats or stats.get(lo) is None or stats.get(hi) is None:
        return c
    return clip(c, stats[lo], stats[hi])


def transformed(c: Column, category: str) -> Column:
    if category in C.LOG1P_CATEGORIES:
        return log1p_positive(c)
    if category in C.SIGNED_LOG_CATEGORIES:
        return signed_log(c)
    return c


def rowwise(df: DataFrame, features: list[str], profile: Profile, themes=None, flags: bool = False,
            impute: bool = True) -> DataFrame:
    """Winsorize, transform and impute; optional 0/1 flags taken before imputation."""
    done, marks = {}, []
    for c in features:
        cat = infer_category(c, themes)
        raw = nan_to_null(F.col(c).cast("double"))
        stats = profile.get(c, {})
        value = transformed(winsorized(raw, cat, stats), cat)
        if flags:
            marks.append(value.isNull().cast("int").alias(f"{c}_was_missing"))
        if impute:
            value = F.coalesce(value, F.lit(float(stats.get("median") or 0.0)))
        done[c] = value
    return df.select(*[done[c].alias(c) if c in done else F.col(c) for c in df.columns], *marks)


def robust_scale(df: DataFrame, month: str, features: list[str], cap: float | None = C.FINAL_CLIP) -> DataFrame:
    """(x - month median) / month MAD, a zero MAD counts as 1e-9, then clipped.

    Medians and MADs are one row per month; a NULL month is a month, a month without values has none.
    The rows are stored first, as the quantile passes read them several times and must see the
    same values.
    """
    df = cut_lineage(without_nan(df, features), "unscaled")
    return scaled_by(df, month, features, cut_lineage(median_and_mad(df, [month], features), "month_stats"), cap)


def scaled_by(df: DataFrame, month: str, features: list[str], stats: DataFrame, cap: float | None = C.FINAL_CLIP) -> DataFrame:
    """Scale by ``stats``, which has rows (month, feature, median, mad)."""
    each = wide(stats, [month], features, {"median": "_med", "mad": "_mad"})
    both = same_key(df, each, [month], "left")

    def scaled(c):
        width = F.when(F.col(f"{c}_mad") == 0, C.MAD_FLOOR).otherwise(F.col(f"{c}_mad"))
        z = (F.col(c) - F.col(f"{c}_med")) / width
        return clip(z, -cap, cap) if cap else z

    return both.select(*[scaled(c).alias(c) if c in features else F.col(c) for c in df.columns])


def clean_panel(df: DataFrame, month: str, features: list[str], profile: Profile, themes=None,
                as_float: bool = False) -> DataFrame:
    """The whole chain; ``as_float`` narrows the features for storage."""
    out = robust_scale(rowwise(df, features, profile, themes), month, features)
    if as_float:
        out = out.select(*[F.col(c).cast("float").alias(c) if c in features else F.col(c) for c in out.columns])
    return out


def qa_sums(features: list[str], profile: Profile, themes=None) -> dict[str, Column]:
    """Three sums per feature over the raw rows: values changed by clipping, missing values, known values."""
    sums = {}
    for c in features:
        raw = nan_to_null(F.col(c).cast("double"))
        clipped = winsorized(raw, infer_category(c, themes), profile.get(c))
        sums[f"{c}|clipped"] = F.coalesce(F.sum((clipped != raw).cast("long")), F.lit(0))
        sums[f"{c}|missing"] = F.coalesce(F.sum(raw.isNull().cast("long")), F.lit(0))
        sums[f"{c}|known"] = F.count(raw)
    return sums


def qa_shares(long: DataFrame) -> DataFrame:
    """Counts and shares per feature from rows (feature, clipped, missing, known)."""
    known = F.greatest(F.col("known"), F.lit(1))
    return long.select("feature", "clipped", (F.col("clipped") / known).alias("clipped_pct_non_null"),
                       "missing", (F.col("missing") / known).alias("missing_rate"))


def clean_qa(df: DataFrame, features: list[str], profile: Profile, themes=None) -> DataFrame:
    """Per feature: values changed by clipping, missing values, and both over the known count."""
    sums = qa_sums(features, profile, themes)
    row = df.agg(*[F.struct(*[sums[f"{c}|{n}"].alias(n) for n in ("clipped", "missing", "known")]).alias(c) for c in features])
    return qa_shares(row.unpivot([], features, "feature", "q").select("feature", "q.*"))


def clean_summary(df: DataFrame, month: str, features: list[str]) -> DataFrame:
    return df.agg(F.countDistinct(month).alias("months_processed"),
                  F.lit(len(features)).alias("n_features"), F.count("*").alias("total_rows"))


def clean_with_report(df: DataFrame, month: str, features: list[str], profile: Profile, themes=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The cleaned panel, the QA of ``clean_qa`` and the summary of ``clean_summary`` from one scan of ``df``.

    The pass that stores the row-wise cleaned values also observes the raw ones; ``month`` is a date.
    Months are counted as bits of a map with a place for each month before the year 2730.
    """
    seen = Observation("clean")
    place = (F.year(month) * 12 + F.month(month)).cast("bigint")
    months = F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(place)))
    sums = {**qa_sums(features, profile, themes), "months": months, "rows": F.count(F.lit(1))}
    observed = df.observe(seen, *[c.alias(n) for n, c in sums.items()])
    unscaled = cut_lineage(without_nan(rowwise(observed, features, profile, themes), features), "unscaled")
    panel = scaled_by(unscaled, month, features, cut_lineage(median_and_mad(unscaled, [month], features), "month_stats"))
    got, spark = seen.get, df.sparkSession
    qa = spark.createDataFrame([(c, *(got[f"{c}|{n}"] for n in ("clipped", "missing", "known"))) for c in features],
                               "feature string, clipped long, missing long, known long")
    summary = spark.createDataFrame([(got["months"], len(features), got["rows"])], "months_processed long, n_features int, total_rows long")
    return panel, qa_shares(qa), summary


# Name patterns of the coverage report (fixed values).
COVERAGE_GROUPS = {
    "PRICE_COLUMNS": ["^prc$", "^stock_ret$", "^prc_highprc_252d$"],
    "VOLUME_COLUMNS": ["turn"],
    "MARKET_VALUE": ["^me$", "^market_equity$"],
    "VOLATILITY_INDICATORS": ["vol", "beta", "std"],
    "MOMENTUM_INDICATORS": ["mom", "ret", "momentum"],
}


def column_coverage(df: DataFrame, features: list[str]) -> DataFrame:
    """Known count, percent, mean, sample std, min and max per feature and name group."""
    import re
    stats = [F.struct(F.count(c).alias("known"), (F.count(c) / F.count(F.lit(1)) * 100).alias("pct"),
                      F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                      F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c)
             for c in features]
    long = df.agg(*stats).unpivot([], features, "feature", "q")
    groups = F.array_compact(F.array(*[
        F.when(F.col("feature").isin([c for c in features if any(re.search(p, c.lower()) for p in pats)] or [""]), g)
        for g, pats in COVERAGE_GROUPS.items()]))
    return long.select(F.explode(groups).alias("name_group"), "feature", "q.*")
