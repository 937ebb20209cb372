"""Queries: text preparation and sentiment."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from panelspark.functions.expr import rnd
from panelspark.operators import text as tx, textmodel as tm
from panelspark.plans import views as v
from panelspark.plans.registry import query
from panelspark.storage import cut_lineage

WS = "' ' || chr(9) || chr(13) || chr(10) || chr(12) || chr(11)"


@query("text_entities", """SELECT DISTINCT CAST(yr AS VARCHAR) AS period, gvkey FROM filings
UNION ALL SELECT DISTINCT 'combined', gvkey FROM filings""")
def text_entities(spark, sf):
    return tx.text_entities(v.filings(spark, sf))


NAMED = "CASE WHEN gvkey LIKE '%1' THEN 'TOP_' || gvkey WHEN gvkey LIKE '%2' THEN 'BOT_' || gvkey ELSE gvkey END"
ROWS_SQL = f"""
fl AS (SELECT * REPLACE ({NAMED} AS gvkey) FROM filings),
chosen AS (SELECT DISTINCT gvkey FROM fl WHERE text IS NOT NULL),
tr AS (SELECT doc_id, gvkey, date, file_type AS filing_type, text FROM fl WHERE length(trim(text, {WS})) > 0 AND gvkey IN (SELECT gvkey FROM chosen)
  UNION ALL SELECT doc_id, gvkey, date, file_type || '_RF', rf FROM fl WHERE length(trim(rf, {WS})) > 0 AND length(rf) > 50 AND gvkey IN (SELECT gvkey FROM chosen)
  UNION ALL SELECT doc_id, gvkey, date, file_type || '_MGMT', mgmt FROM fl WHERE length(trim(mgmt, {WS})) > 0 AND length(mgmt) > 50 AND gvkey IN (SELECT gvkey FROM chosen))"""


def named(spark, sf):
    g = F.col("gvkey")
    tag = F.when(g.endswith("1"), F.concat(F.lit("TOP_"), g)).when(g.endswith("2"), F.concat(F.lit("BOT_"), g)).otherwise(g)
    return v.filings(spark, sf).withColumn("gvkey", tag)


def rows(spark, sf):
    fl = named(spark, sf)
    return tx.text_rows(fl, fl.filter(F.col("text").isNotNull()))


@query("text_unpivot", f"WITH {ROWS_SQL} SELECT doc_id, gvkey, date, filing_type, text, length(text) AS length FROM tr")
def text_unpivot(spark, sf):
    return rows(spark, sf)


FORMAT_SQL = f"""{ROWS_SQL},
tn AS (SELECT *, row_number() OVER (ORDER BY gvkey, doc_id, filing_type) AS n, trim(text, {WS}) AS t FROM tr),
tf AS (SELECT doc_id, gvkey, date, filing_type, gvkey || '_' || CASE WHEN length(CAST(n AS VARCHAR)) < 3 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS text_id,
  CASE WHEN starts_with(gvkey, 'TOP_') THEN 'top_performer' WHEN starts_with(gvkey, 'BOT_') THEN 'bottom_performer' ELSE 'unknown' END AS category,
  length(t) AS full_length, t AS text FROM tn WHERE length(t) >= 50)"""


def formatted(spark, sf):
    return tx.text_format(rows(spark, sf), ["gvkey", "doc_id", "filing_type"])


@query("text_format", f"WITH {FORMAT_SQL} SELECT *, length(text) AS text_length FROM tf")
def text_format(spark, sf):
    return formatted(spark, sf)


@query("text_metadata", f"""WITH {FORMAT_SQL} SELECT count(*) AS total_texts, count(DISTINCT gvkey) AS total_stocks, rnd(avg(length(text)), 6) AS average_text_length,
  count(DISTINCT CASE WHEN category = 'top_performer' THEN gvkey END) AS stocks_top_performer,
  count(DISTINCT CASE WHEN category = 'bottom_performer' THEN gvkey END) AS stocks_bottom_performer,
  count(DISTINCT CASE WHEN category = 'unknown' THEN gvkey END) AS stocks_unknown FROM tf""")
def text_metadata(spark, sf):
    return tx.text_metadata(formatted(spark, sf)).withColumn("average_text_length", rnd("average_text_length"))


IDENT_SQL = "CASE WHEN c_nationkey = 3 THEN 'TOP_' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END || ':' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0')"


@query("identifier_split", f"""WITH i AS (SELECT c_custkey, {IDENT_SQL} AS ident FROM customer)
SELECT c_custkey, split_part(ident, ':', 1) AS gvkey, split_part(ident, ':', 2) AS iid, TRY_CAST(split_part(ident, ':', 1) AS BIGINT) AS gvkey_number FROM i""")
def identifier_split(spark, sf):
    key = F.col("c_custkey").cast("string")
    left = F.when(F.col("c_nationkey") == 3, F.concat(F.lit("TOP_"), key)).otherwise(key)
    ident = F.concat(left, F.lit(":"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"))
    return v.table(spark, sf, "customer").select("c_custkey", *tx.split_identifier(ident))


INPUT_SQL = f"""
ti AS (SELECT doc_id, gvkey, date, file_type, 'rf' AS text_type, rf AS text FROM filings WHERE length(trim(rf, {WS})) > 0
  UNION ALL SELECT doc_id, gvkey, date, file_type, 'mgmt', mgmt FROM filings WHERE length(trim(mgmt, {WS})) > 0
  UNION ALL SELECT doc_id, gvkey, date, file_type, 'general', text FROM filings WHERE length(trim(text, {WS})) > 0),
tj AS (SELECT *, CAST(row_number() OVER (ORDER BY gvkey, doc_id, text_type) AS VARCHAR) AS n FROM ti),
tk AS (SELECT doc_id, gvkey, '01' AS iid, gvkey || ':01' AS stock_identifier, date, date // 10000 AS "year", file_type AS filing_type, text_type, text,
  'REAL_' || gvkey || '_01_' || CASE WHEN text_type = 'general' THEN 'text' ELSE text_type END || '_' || date || '_' ||
  CASE WHEN length(n) < 4 THEN lpad(n, 4, '0') ELSE n END AS text_id, 'real_textdata' AS source FROM tj)"""


@query("text_inputs", f"WITH {INPUT_SQL} SELECT * FROM tk")
def text_inputs(spark, sf):
    return tx.text_inputs(v.filings(spark, sf))


# Word lists for the invented prose of the driver tables.
POS, NEG = ["the", "la", "and", "der"], ["of", "le", "des", "in"]


def lex_sql(src, text):
    count = lambda ws: (f"len(regexp_extract_all(' ' || regexp_replace(lower({text}), '[^a-z]+', '  ', 'g') || ' ', ' ({'|'.join(ws)}) '))")
    return f"""
lc AS (SELECT *, {count(POS)} AS n_positive, {count(NEG)} AS n_negative FROM {src}),
ln AS (SELECT *, coalesce((n_positive - n_negative) / nullif(n_positive + n_negative, 0)::DOUBLE, 0) AS net FROM lc),
lx AS (SELECT *, CASE WHEN net > 0.1E0 THEN 'positive' WHEN net < -0.1E0 THEN 'negative' ELSE 'neutral' END AS sentiment_label, 0.5E0 + 0.5E0 * abs(net) AS confidence_score FROM ln)"""


@query("score_lexicon", f"""WITH {lex_sql("documents", "text")} SELECT doc_id, CAST(n_positive AS INTEGER) AS n_positive, CAST(n_negative AS INTEGER) AS n_negative,
  sentiment_label, rnd(confidence_score, 6) AS confidence_score FROM lx""")
def score_lexicon(spark, sf):
    return tx.score_lexicon(v.table(spark, sf, "documents"), positive=POS, negative=NEG).select(
        "doc_id", "n_positive", "n_negative", "sentiment_label", rnd("confidence_score").alias("confidence_score"))


def ratio_classifier(texts):
    """Stand-in classifier: share of the two lists' words among the a-z words of a segment."""
    out = []
    for t in texts:
        words = re.findall("[a-z]+", t.lower())
        p, n = sum(w in POS for w in words), sum(w in NEG for w in words)
        net = (p - n) / (p + n) if p + n else 0.0
        out.append(("positive" if net > 0.1 else "negative" if net < -0.1 else "neutral", 0.5 + 0.5 * abs(net)))
    return out


SEGMENT_SQL = f"""
sg AS (SELECT doc_id, unnest(range(0, (greatest(length(text) - 1, 0) // 512) + 1)) AS i, text FROM documents),
ss AS (SELECT doc_id, substring(text, CAST(i * 512 + 1 AS BIGINT), 512) AS s FROM sg),
{lex_sql("ss", "s")},
lp AS (SELECT doc_id, sentiment_label, sum(length(s) * confidence_score) AS m, sum(length(s)) AS w FROM lx GROUP BY doc_id, sentiment_label),
lr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(m, 6) DESC, sentiment_label) AS rn, sum(w) OVER (PARTITION BY doc_id) AS tw FROM lp)"""


@query("score_texts", f"""WITH {SEGMENT_SQL}
SELECT doc_id AS text_id, sentiment_label, rnd(coalesce(m / nullif(tw, 0)::DOUBLE, 0.5), 6) AS confidence_score FROM lr WHERE rn = 1""")
def score_texts(spark, sf):
    docs = v.table(spark, sf, "documents").withColumnRenamed("doc_id", "text_id")
    return tx.score_texts(docs, ratio_classifier).withColumn("confidence_score", rnd("confidence_score"))


HELD_OUT = 4  # one text in four is kept from training


def sentiment_texts(spark, sf):
    """Labelled whole texts: toxic ones negative, others of good quality positive, the rest neutral."""
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    labels = v.table(spark, sf, "labels").select("doc_id", label.alias("label"))
    return v.table(spark, sf, "documents").select("doc_id", "text").join(labels, "doc_id")


def trained(spark, sf):
    known = cut_lineage(sentiment_texts(spark, sf), "labelled")
    return known, tm.train(known.filter(F.col("doc_id") % HELD_OUT != 0), "label")


@query("text_classifier")
def text_classifier(spark, sf):
    """Label and confidence of every document by a model trained on three quarters of the labelled ones."""
    done = tm.classify(v.table(spark, sf, "documents").select("doc_id", "text"), trained(spark, sf)[1], keep=["doc_id"])
    return done.select("doc_id", "sentiment_label", rnd("confidence_score").alias("confidence_score"))


@query("text_classifier_held_out", f"""
WITH st AS (SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
lt AS (SELECT label, count(*) AS n FROM st WHERE doc_id % {HELD_OUT} <> 0 GROUP BY label)
SELECT count(CASE WHEN doc_id % {HELD_OUT} <> 0 THEN 1 END) AS trained_on, count(CASE WHEN doc_id % {HELD_OUT} = 0 THEN 1 END) AS held_out,
  count(CASE WHEN doc_id % {HELD_OUT} = 0 AND label = (SELECT max_by(label, n) FROM lt) THEN 1 END) AS of_largest_class,
  TRUE AS three_of_four_found, TRUE AS above_lexicon FROM st""")
def text_classifier_held_out(spark, sf):
    """Texts trained on and held out, and whether the model finds three of four held-out labels (few texts train the smallest tables) and more than word lists."""
    known, model = trained(spark, sf)
    lexicon = tx.score_lexicon(known, positive=POS, negative=NEG).withColumnRenamed("sentiment_label", "by_lexicon").drop("confidence_score")
    test = F.col("doc_id") % HELD_OUT == 0
    largest = known.filter(~test).groupBy("label").count().orderBy(F.desc("count"), "label").first()["label"]
    hits = lambda hit: F.count(F.when(test & hit, 1))
    found, label = F.col("sentiment_label") == F.col("label"), F.col("label")
    return tm.classify(lexicon, model, keep=["doc_id", "label", "by_lexicon"]).agg(
        F.count(F.when(~test, 1)).alias("trained_on"), F.count(F.when(test, 1)).alias("held_out"), hits(label == largest).alias("of_largest_class"),
        (hits(found) >= 0.75 * F.count(F.when(test, 1))).alias("three_of_four_found"), (hits(found) > hits(F.col("by_lexicon") == label)).alias("above_lexicon"))


EXP_SQL = """
ex AS (SELECT *, CASE sentiment_label WHEN 'positive' THEN confidence_score WHEN 'negative' THEN (1 - confidence_score) * 0.4E0 ELSE (1 - confidence_score) * 0.5E0 END AS positive_score,
  CASE sentiment_label WHEN 'positive' THEN (1 - confidence_score) * 0.4E0 WHEN 'negative' THEN confidence_score ELSE (1 - confidence_score) * 0.5E0 END AS negative_score,
  CASE sentiment_label WHEN 'neutral' THEN confidence_score ELSE (1 - confidence_score) * 0.6E0 END AS neutral_score FROM sentiment_results),
ey AS (SELECT *, positive_score - negative_score AS net_sentiment, greatest(positive_score, negative_score) AS sentiment_strength FROM ex)"""
R4 = lambda c, n: f"round_even(round(avg({c}), 10), 4) + 0.0 AS {n}"
ENT_SQL = f"""{EXP_SQL},
en AS (SELECT stock_identifier, {R4("positive_score", "avg_positive")}, {R4("negative_score", "avg_negative")}, {R4("neutral_score", "avg_neutral")},
  {R4("net_sentiment", "net_sentiment")}, min_by(gvkey, text_id) AS gvkey, min_by(iid, text_id) AS iid,
  {R4("CASE lower(sentiment_label) WHEN 'positive' THEN 1E0 WHEN 'negative' THEN -1E0 ELSE 0E0 END", "numeric_sentiment")}, {R4("confidence_score", "avg_confidence")}, {R4("sentiment_strength", "avg_strength")},
  count(text_id) AS text_count, string_agg(DISTINCT text_type, ',' ORDER BY text_type) AS text_types,
  string_agg(DISTINCT CAST(yr AS VARCHAR), ',' ORDER BY CAST(yr AS VARCHAR)) AS years FROM ey GROUP BY stock_identifier),
ew AS (SELECT *, net_sentiment * avg_confidence * ln(1 + text_count) AS weighted_sentiment, net_sentiment * avg_strength AS strength_sentiment FROM en)"""


def expanded(spark, sf):
    return tx.expand_labels(v.sentiment_results(spark, sf))


def entities(spark, sf):
    return tx.weighted(tx.by_entity(expanded(spark, sf)))


SCORES = ["positive_score", "negative_score", "neutral_score", "net_sentiment", "sentiment_strength"]


@query("label_expand", f"WITH {EXP_SQL} SELECT text_id, {', '.join(f'rnd({c}, 6) AS {c}' for c in SCORES)} FROM ey")
def label_expand(spark, sf):
    return expanded(spark, sf).select("text_id", *[rnd(c).alias(c) for c in SCORES])


@query("sentiment_by_entity", f"""WITH {ENT_SQL} SELECT * FROM en""")
def sentiment_by_entity(spark, sf):
    return tx.by_entity(expanded(spark, sf))


@query("sentiment_weighted", f"""WITH {ENT_SQL} SELECT stock_identifier, rnd(weighted_sentiment, 6) AS weighted_sentiment, rnd(strength_sentiment, 6) AS strength_sentiment FROM ew""")
def sentiment_weighted(spark, sf):
    return entities(spark, sf).select("stock_identifier", rnd("weighted_sentiment").alias("weighted_sentiment"), rnd("strength_sentiment").alias("strength_sentiment"))


def normalized(spark, sf, method, offset=0.1):
    return tx.normalize(entities(spark, sf), "net_sentiment", method, "normalized_score", offset).select(
        "stock_identifier", rnd("normalized_score", 8).alias("normalized_score"))


@query("normalize_minmax", f"""WITH {ENT_SQL}, r AS (SELECT *, min(net_sentiment) OVER () AS lo, max(net_sentiment) OVER () AS hi, count(*) OVER () AS n FROM ew)
SELECT stock_identifier, rnd(CASE WHEN hi = lo THEN 1.0E0 / n ELSE (net_sentiment - lo) / sum(net_sentiment - lo) OVER () END, 8) AS normalized_score FROM r""")
def normalize_minmax(spark, sf):
    return normalized(spark, sf, "minmax")


@query("normalize_softmax", f"""WITH {ENT_SQL}, r AS (SELECT *, exp(net_sentiment - max(net_sentiment) OVER ()) AS e FROM ew)
SELECT stock_identifier, rnd(e / sum(e) OVER (), 8) AS normalized_score FROM r""")
def normalize_softmax(spark, sf):
    return normalized(spark, sf, "softmax")


@query("normalize_linear", f"""WITH {ENT_SQL}, r AS (SELECT *, min(net_sentiment) OVER () AS lo, max(net_sentiment) OVER () AS hi, count(*) OVER () AS n FROM ew)
SELECT stock_identifier, rnd(CASE WHEN hi = lo THEN 1.0E0 / n ELSE (net_sentiment - lo + 0.1E0) / sum(net_sentiment - lo + 0.1E0) OVER () END, 8) AS normalized_score FROM r""")
def normalize_linear(spark, sf):
    return normalized(spark, sf, "linear")


BAND_SQL = """CASE WHEN net_sentiment > 0.2 THEN 'Strong Positive' WHEN net_sentiment > 0.05 THEN 'Positive' WHEN net_sentiment > -0.05 THEN 'Neutral'
  WHEN net_sentiment > -0.2 THEN 'Negative' ELSE 'Strong Negative' END"""


@query("sentiment_band", f"WITH {ENT_SQL} SELECT stock_identifier, {BAND_SQL} AS sentiment_category FROM ew")
def sentiment_band(spark, sf):
    return entities(spark, sf).select("stock_identifier", tx.sentiment_band(F.col("net_sentiment")).alias("sentiment_category"))


@query("sentiment_rank", f"""WITH {ENT_SQL} SELECT stock_identifier, rnd(weighted_sentiment, 6) AS weighted_sentiment,
  row_number() OVER (ORDER BY round(weighted_sentiment, 9) DESC, stock_identifier) AS sentiment_rank FROM ew""")
def sentiment_rank(spark, sf):
    return tx.rank_entities(entities(spark, sf)).select("stock_identifier", rnd("weighted_sentiment").alias("weighted_sentiment"), "sentiment_rank")


@query("sentiment_by_type", f"""WITH {EXP_SQL} SELECT stock_identifier, text_type, {R4("net_sentiment", "net_sentiment")},
  {R4("confidence_score", "confidence")}, count(*) AS texts FROM ey GROUP BY stock_identifier, text_type""")
def sentiment_by_type(spark, sf):
    return tx.by_type(expanded(spark, sf))


@query("sentiment_summary", f"""WITH {ENT_SQL}, s AS (SELECT count(*) AS n, avg(net_sentiment) AS mean, min(net_sentiment) AS lo, max(net_sentiment) AS hi FROM ew)
SELECT 'total_stocks_analyzed' AS name, CAST(n AS VARCHAR) AS value FROM s
UNION ALL SELECT 'total_texts_processed', CAST(count(*) AS VARCHAR) FROM ey
UNION ALL SELECT 'avg_sentiment', printf('%.4f', round_even(round(mean, 10), 4) + 0.0) FROM s
UNION ALL SELECT 'min_sentiment', printf('%.4f', lo) FROM s UNION ALL SELECT 'max_sentiment', printf('%.4f', hi) FROM s
UNION ALL SELECT 'most_positive', (SELECT stock_identifier FROM ew ORDER BY round(weighted_sentiment, 9) DESC, stock_identifier LIMIT 1)
UNION ALL SELECT 'most_negative', (SELECT stock_identifier FROM ew ORDER BY round(weighted_sentiment, 9), stock_identifier LIMIT 1)
UNION ALL SELECT 'stocks: ' || {BAND_SQL}, CAST(count(*) AS VARCHAR) FROM ew GROUP BY {BAND_SQL}
UNION ALL SELECT 'texts: ' || sentiment_label, CAST(count(*) AS VARCHAR) FROM ey GROUP BY sentiment_label""")
def sentiment_summary(spark, sf):
    return tx.sentiment_summary(entities(spark, sf), expanded(spark, sf))


@query("sentiment_join", """SELECT s.text_id, s.sentiment_label, s.confidence_score, d.source AS entity, d.n_chars
FROM sentiment_results s JOIN documents d ON s.text_id = d.doc_id""")
def sentiment_join(spark, sf):
    inputs = v.table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), F.col("source").alias("entity"), "n_chars")
    scores = v.sentiment_results(spark, sf).select("text_id", "sentiment_label", "confidence_score")
    return tx.join_scores(scores, inputs, columns=("entity", "n_chars"))
