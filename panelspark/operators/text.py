"""Text preparation, scoring and entity sentiment. Whole texts are processed; a cut happens only
where a caller asks for one."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from panelspark import constants as C
from panelspark.functions.expr import bands, half_even, ratio, same_key
from panelspark.functions.ordered import with_row_number

BLANKS = " \t\r\n\f\v"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def filled(c: Column) -> Column:
    return c.isNotNull() & (F.length(strip(c)) > 0)


def text_entities(filings: DataFrame, entity="gvkey", year="yr") -> DataFrame:
    """Entities per year and over all years, one row each."""
    per = filings.filter(F.col(entity).isNotNull()).select(F.col(year).cast("string").alias("period"), entity).distinct()
    return per.unionByName(per.select(F.lit("combined").alias("period"), entity).distinct())


def text_rows(filings: DataFrame, chosen: DataFrame | None = None, entity="gvkey", date="date", kind="file_type",
              keep=("doc_id",), min_chars: int = C.MIN_TEXT) -> DataFrame:
    """One row per text: the whole-text column, and each section longer than ``min_chars``."""
    kept = filings
    if chosen is not None:
        # a busy entity is met by narrow rows; texts move by (keep, entity)
        keys = [*keep, entity]
        mine = filings.select(*keys).distinct().join(chosen.select(entity).distinct(), entity, "left_semi")
        kept = filings.join(mine, [filings[c].eqNullSafe(mine[c]) for c in keys], "left_semi")
    part = lambda c, suffix, hit: F.when(hit, F.struct(
        F.col(c).alias("text"), F.concat(F.col(kind), F.lit(suffix)).alias("filing_type"), F.length(c).alias("length")))
    long = lambda c: filled(F.col(c)) & (F.length(c) > min_chars)
    parts = F.array_compact(F.array(part("text", "", filled(F.col("text"))),
                                    part("rf", "_RF", long("rf")), part("mgmt", "_MGMT", long("mgmt"))))
    return kept.select(*keep, entity, date, F.explode(parts).alias("p")).select(*keep, entity, date, "p.*")


def running_number(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number rows 1, 2, ... in ``order``, which must be a key. Only the key is ranked, so long
    columns are not moved twice."""
    numbers = with_row_number(df.select(*order), [], [F.col(c).asc() for c in order], name)
    return same_key(df, numbers, order)


def padded(n: Column, width: int) -> Column:
    s = n.cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def text_format(texts: DataFrame, order: list[str], entity="gvkey", min_chars: int = C.MIN_TEXT,
                max_chars: int | None = None) -> DataFrame:
    """Trimmed texts of at least ``min_chars``; with ``max_chars``, longer ones end in ``...`` there.

    The running id counts short texts too. ``full_length`` keeps the length before the cut.
    """
    clean = strip(F.col("text"))
    name = F.col(entity)
    category = (F.when(name.startswith("TOP_"), "top_performer")
                .when(name.startswith("BOT_"), "bottom_performer").otherwise("unknown"))
    cut = F.col("_t")
    if max_chars:
        cut = F.when(F.length("_t") > max_chars, F.concat(F.substring("_t", 1, max_chars), F.lit("..."))).otherwise(cut)
    rows = running_number(texts, order, "_n").withColumn("_t", clean).filter(F.length("_t") >= min_chars)
    done = rows.select(*[c for c in texts.columns if c not in ("text", "length")],
                       F.concat(name, F.lit("_"), padded(F.col("_n"), 3)).alias("text_id"),
                       category.alias("category"), F.length("_t").alias("full_length"), cut.alias("text"))
    return done.withColumn("text_length", F.length("text"))


def text_metadata(formatted: DataFrame, entity="gvkey") -> DataFrame:
    per = lambda c: F.countDistinct(F.when(F.col("category") == c, F.col(entity))).alias(f"stocks_{c}")
    return formatted.agg(
        F.count("*").alias("total_texts"), F.countDistinct(entity).alias("total_stocks"),
        F.coalesce(F.avg("text_length"), F.lit(0.0)).alias("average_text_length"),
        per("top_performer"), per("bottom_performer"), per("unknown"))


def split_identifier(c: Column) -> list[Column]:
    """``GVKEY:IID`` into both parts and the number of the first, NULL if it is none."""
    parts = F.split(c, ":")
    key = F.get(parts, F.lit(0))
    return [key.alias("gvkey"), F.get(parts, F.lit(1)).alias("iid"), key.try_cast("bigint").alias("gvkey_number")]


def text_inputs(filings: DataFrame, entity="gvkey", iid: str = "01", date="date", kind="file_type",
                key: str = "doc_id", max_chars: int | None = None) -> DataFrame:
    """Scoring input: a row for each filled section and whole text, with typed running ids."""
    cut = lambda c: F.substring(c, 1, max_chars) if max_chars else F.col(c)
    part = lambda c, t: F.when(filled(F.col(c)), F.struct(F.lit(t).alias("text_type"), cut(c).alias("text")))
    parts = F.array_compact(F.array(part("rf", "rf"), part("mgmt", "mgmt"), part("text", "general")))
    rows = filings.withColumn("_iid", F.lit(iid)).select(
        key, entity, F.col("_iid").alias("iid"), F.concat(F.col(entity), F.lit(":"), "_iid").alias("stock_identifier"),
        date, F.floor(F.col(date) / 10000).alias("year"), F.coalesce(F.col(kind), F.lit("10K")).alias("filing_type"),
        F.explode(parts).alias("p"))
    rows = rows.select("*", "p.text_type", "p.text").drop("p")
    tag = F.when(F.col("text_type") == "general", "text").otherwise(F.col("text_type"))
    return running_number(rows, [entity, key, "text_type"], "_n").withColumn("text_id", F.concat_ws(
        "_", F.lit("REAL"), entity, "iid", tag, F.col(date).cast("string"), padded(F.col("_n"), 4))).withColumn(
        "source", F.lit("real_textdata")).drop("_n")


def lexicon_counts(text: Column, words: list[str]) -> Column:
    """How many words of the text are in the list. Words are runs of a-z, set apart by two blanks
    so that neighbours can both match."""
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z]+", "  "), F.lit(" "))
    return F.regexp_count(spaced, F.lit(f" ({'|'.join(words)}) "))


def score_lexicon(texts: DataFrame, text: str = "text", positive=C.POSITIVE_WORDS, negative=C.NEGATIVE_WORDS,
                  band: float = 0.1) -> DataFrame:
    """Label and confidence from word counts over the whole text, in built-in expressions."""
    counted = texts.withColumns({"n_positive": lexicon_counts(F.col(text), positive),
                                 "n_negative": lexicon_counts(F.col(text), negative)})
    net = F.coalesce(ratio((F.col("n_positive") - F.col("n_negative")).cast("double"),
                           (F.col("n_positive") + F.col("n_negative")).cast("double")), F.lit(0.0))
    return counted.withColumn("net", net).withColumns({
        "sentiment_label": F.when(F.col("net") > band, "positive").when(F.col("net") < -band, "negative").otherwise("neutral"),
        "confidence_score": 0.5 + 0.5 * F.abs("net")})


def score_texts(texts: DataFrame, classify: Callable, key: str = "text_id", text: str = "text",
                segment: int = C.SEGMENT_CHARS) -> DataFrame:
    """Plug point for a classifier with a bounded input.

    ``classify`` maps a list of strings to (label, confidence) pairs. A text is cut into segments of
    ``segment`` characters that cover all of it; the label with the largest confidence, weighted by
    segment length, wins. Segments are rows, so a long text does not slow one task.
    """
    @F.pandas_udf("label string, confidence double")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(classify(list(s)), columns=["label", "confidence"])

    last = F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / segment).cast("int")
    cut = texts.select(key, F.posexplode(F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substring(F.col(text), i * segment + 1, F.lit(segment)))).alias("part", "s"))
    scored = cut.withColumn("r", run(F.col("s"))).select(
        key, F.length("s").cast("double").alias("w"), "r.label", "r.confidence")
    per = scored.groupBy(key, "label").agg(F.sum(F.col("w") * F.col("confidence")).alias("m"), F.sum("w").alias("w"))
    return per.groupBy(key).agg(
        F.min_by("label", F.struct(-F.round("m", 6), F.col("label"))).alias("sentiment_label"),
        F.coalesce(ratio(F.max("m"), F.sum("w")), F.lit(0.5)).alias("confidence_score"))


def expand_labels(df: DataFrame, label="sentiment_label", score="confidence_score") -> DataFrame:
    """Three scores from label and confidence: the rest is split 0.6/0.4, or evenly for neutral."""
    name, s = F.lower(F.col(label)), F.coalesce(F.col(score), F.lit(0.5))
    rest = 1 - s
    pick = lambda pos, neg, other: F.when(name == "positive", pos).when(name == "negative", neg).otherwise(other)
    return df.withColumns({
        "positive_score": pick(s, rest * 0.4, rest * 0.5), "negative_score": pick(rest * 0.4, s, rest * 0.5),
        "neutral_score": pick(rest * 0.6, rest * 0.6, s)}).withColumns({
            "net_sentiment": F.col("positive_score") - F.col("negative_score"),
            "sentiment_strength": F.greatest("positive_score", "negative_score")})


def by_entity(expanded: DataFrame, entity="stock_identifier", text_id="text_id", kind="text_type", year="yr",
              score="confidence_score") -> DataFrame:
    """Entity means to 4 places, text count, first identifiers in text order, and the short lists of
    text types and years. The numeric score of a label is 1, 0 or -1."""
    mean = lambda c: half_even(F.avg(c), 4)
    name = F.lower("sentiment_label")
    numeric = F.when(name == "positive", 1.0).when(name == "negative", -1.0).otherwise(0.0)
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(F.col(c).cast("string"))), ",")
    return expanded.groupBy(entity).agg(
        mean("positive_score").alias("avg_positive"), mean("negative_score").alias("avg_negative"),
        mean("neutral_score").alias("avg_neutral"), mean("net_sentiment").alias("net_sentiment"),
        mean(numeric).alias("numeric_sentiment"), *[F.min_by(c, F.struct(F.col(c).isNull(), F.col(text_id))).alias(c)
                                                          for c in ("gvkey", "iid") if c in expanded.columns],
        mean(score).alias("avg_confidence"), mean("sentiment_strength").alias("avg_strength"),
        F.count(text_id).alias("text_count"), listed(kind).alias("text_types"), listed(year).alias("years"))


def weighted(entities: DataFrame) -> DataFrame:
    """Net sentiment weighted by confidence and log count, and by strength."""
    return entities.withColumns({
        "weighted_sentiment": F.col("net_sentiment") * F.col("avg_confidence") * F.log1p("text_count"),
        "strength_sentiment": F.col("net_sentiment") * F.col("avg_strength")})


def normalize(df: DataFrame, score: str, method: str, name: str, offset: float = 0.001) -> DataFrame:
    """Scores that sum to 1: ``minmax``, ``softmax`` or ``linear``; equal shares when all are equal.

    Totals come in as one-row scalar subqueries, so entities stay distributed.
    """
    x = F.col(score)
    ends = df.agg(F.struct(F.min(score).alias("lo"), F.max(score).alias("hi"), F.count("*").alias("n")).alias("s"))
    lo, hi = ends.scalar()["lo"], ends.scalar()["hi"]
    if method == "softmax":
        part = F.exp(x - hi)
    elif method == "minmax":
        part = x - lo
    elif method == "linear":
        part = x - lo + offset
    else:
        raise ValueError(f"unknown method {method}")
    parts = df.withColumn("_p", part)
    total = parts.agg(F.sum("_p").alias("t")).scalar()
    share = F.col("_p") / total
    if method != "softmax":
        share = F.when(hi == lo, 1.0 / ends.scalar()["n"]).otherwise(F.try_divide(F.col("_p"), total))
    return parts.withColumn(name, share).drop("_p")


def sentiment_band(net: Column) -> Column:
    return bands(net, C.SENTIMENT_BANDS, C.SENTIMENT_FLOOR)


def rank_entities(entities: DataFrame, score: str = "weighted_sentiment", entity="stock_identifier", digits: int = 9) -> DataFrame:
    keyed = entities.withColumn("_k", F.round(score, digits))
    return with_row_number(keyed, [], [F.col("_k").desc(), F.col(entity).asc()], "sentiment_rank").drop("_k")


def by_type(expanded: DataFrame, entity="stock_identifier", kind="text_type", score="confidence_score") -> DataFrame:
    return expanded.groupBy(entity, kind).agg(
        half_even(F.avg("net_sentiment"), 4).alias("net_sentiment"), half_even(F.avg(score), 4).alias("confidence"),
        F.count("*").alias("texts"))


def sentiment_summary(entities: DataFrame, expanded: DataFrame, entity="stock_identifier") -> DataFrame:
    """Totals, mean, range, extremes, and the distributions of bands and labels as name-value rows."""
    best = lambda sign: F.min_by(entity, F.struct(sign * F.round("weighted_sentiment", 9), F.col(entity)))
    n_texts = expanded.agg(F.count("*").alias("n")).scalar()
    head = entities.agg(F.count("*").alias("n"), F.avg("net_sentiment").alias("mean"), F.min("net_sentiment").alias("lo"),
                        F.max("net_sentiment").alias("hi"), best(-1).alias("top"), best(1).alias("low"))
    num = lambda c: F.format_string("%.4f", c)
    row = lambda n, c: F.struct(F.lit(n).alias("name"), c.cast("string").alias("value"))
    first = head.select(F.inline(F.array(
        row("total_stocks_analyzed", F.col("n")), row("total_texts_processed", n_texts),
        row("avg_sentiment", num(half_even(F.col("mean"), 4))), row("min_sentiment", num(F.col("lo"))), row("max_sentiment", num(F.col("hi"))),
        row("most_positive", F.col("top")), row("most_negative", F.col("low")))))
    spread = entities.groupBy(sentiment_band(F.col("net_sentiment")).alias("b")).agg(F.count("*").alias("n")).select(
        F.concat(F.lit("stocks: "), "b").alias("name"), F.col("n").cast("string").alias("value"))
    labels = expanded.groupBy(F.lower("sentiment_label").alias("l")).agg(F.count("*").alias("n")).select(
        F.concat(F.lit("texts: "), "l").alias("name"), F.col("n").cast("string").alias("value"))
    return first.unionByName(spread).unionByName(labels)


def join_scores(scores: DataFrame, inputs: DataFrame, text_id: str = "text_id", columns=("stock_identifier",)) -> DataFrame:
    return scores.join(inputs.select(text_id, *columns), text_id)
