"""The adapter views as DataFrames: driver tables shaped like the panel, bars, portfolios and filings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelspark.functions.expr import ratio
from panelspark.functions.ordered import tasks_for
from panelspark.storage import cut_lineage


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def secdim(spark, sf):
    nation = F.broadcast(table(spark, sf, "nation"))  # fixed 25 rows
    gics = F.concat((10 + 5 * F.col("n_regionkey")).cast("string"),
                    F.lpad(F.col("n_nationkey").cast("string"), 4, "0"))
    return (
        table(spark, sf, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("s_suppkey").alias("sec"), gics.alias("gics"))
    )


def panel(spark, sf, series=False):
    """Daily rows of the securities; for ``series`` they lie dealt by security to as many tasks as ``lineitem`` asks for."""
    # Grouping by (security, day) first: a busy security shrinks to one row per day before any
    # shuffle that places a whole series in one task.
    daily = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("sec"), F.to_date("l_shipdate").alias("dt"))
        .agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("prc"),
             F.sum("l_quantity").alias("vol"))
    )
    if series:  # before the join, so that the windows need no other exchange whichever join it is
        daily = daily.repartition(tasks_for(table(spark, sf, "lineitem")), "sec")
    return daily.join(secdim(spark, sf), "sec").select("sec", "dt", "prc", "vol", "gics")


def by_sec(order="dt"):
    return Window.partitionBy("sec").orderBy(order)


def panel_ret(spark, sf):
    gap = (F.col("sec") * 7 + F.dayofmonth("dt")) % 23 == 0
    return panel(spark, sf, series=True).select(
        "sec", "dt", "gics", "vol",
        F.when(~gap, F.col("prc")).alias("prc"),
        (ratio(F.col("prc"), F.lag("prc").over(by_sec())) - 1).alias("ret"),
    )


def factors(spark, sf):
    return panel_ret(spark, sf).select(
        "sec", "dt", "gics", "prc", F.col("ret").alias("ret_1_0"), F.col("vol").alias("turnover_126d"),
        ratio(F.col("vol"), F.col("prc")).alias("be_me"),
        (F.col("vol") - F.lag("vol").over(by_sec())).alias("sale_gr1"),
        (F.col("ret") * F.col("ret")).alias("beta_60m"),
    )


FACTORS = ["prc", "ret_1_0", "turnover_126d", "be_me", "sale_gr1", "beta_60m"]


def ym_of(c):
    return F.year(c) * 100 + F.month(c)


def stored_panel(spark, sf):
    """The panel as a table, for plans that read it more than once."""
    return cut_lineage(panel(spark, sf), "panel")


def ohlc(spark, sf, p=None):
    p = panel(spark, sf) if p is None else p
    return p.groupBy("sec", ym_of(F.col("dt")).alias("ym")).agg(
        F.min_by("prc", "dt").alias("open"), F.max("prc").alias("high"), F.min("prc").alias("low"),
        F.max_by("prc", "dt").alias("close"), F.sum("vol").alias("volume"), F.count("*").alias("n_days"),
    )


def bars(spark, sf):
    """The bars as a table, for plans that read them more than once."""
    return cut_lineage(ohlc(spark, sf), "bars")


def positions(spark, sf):
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    held = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(
            F.year("o_orderdate").alias("yr"), F.month("o_orderdate").alias("mo"),
            F.col("c_mktsegment").alias("sector"),
            F.when(F.col("o_orderkey") % 5 < 3, "long").otherwise("short").alias("side"),
            F.concat(F.lit("comp_"), F.lpad((F.col("o_custkey") % 40).cast("string"), 6, "0"),
                     F.lit("_01")).alias("company_id"),
        )
        .agg((F.max("o_totalprice") / 500000).alias("score"))
    )
    # at most 40 companies per month, sector and side
    book = Window.partitionBy("yr", "mo", "sector", "side")
    sign = F.when(F.col("side") == "long", 1).otherwise(-1)
    return held.withColumn("weight", sign * F.col("score") / F.sum("score").over(book))


def monthly(spark, sf):
    r = (F.col("close") - F.col("open")) / (F.col("close") + F.col("open"))
    return ohlc(spark, sf).select("sec", "ym", r.alias("r")).groupBy("ym").agg(
        F.avg(F.when(F.col("sec") % 2 == 0, F.col("r"))).alias("portfolio_return"),
        F.avg("r").alias("bench_return"), F.count("*").alias("positions_count"),
    )


def filings(spark, sf):
    k = F.col("doc_id") % 3
    return table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("gvkey"), (2023 + k).alias("yr"),
        ((2023 + k) * 10000 + 101 + F.col("doc_id") % 28).alias("date"),
        F.when(F.col("doc_id") % 2 == 0, "10K").otherwise("10Q").alias("file_type"),
        F.when(k == 0, F.substring("text", 1, 1500)).when(k == 2, F.col("text")).alias("rf"),
        F.when(k == 0, F.expr("substring(text, 1501)")).alias("mgmt"),
        F.when(k == 1, F.col("text")).alias("text"),
    )


def sentiment_results(spark, sf):
    label = (F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive")
             .otherwise("neutral"))
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        F.col("doc_id").alias("text_id"), F.col("source").alias("stock_identifier"),
        F.col("lang").alias("text_type"), (2023 + F.col("doc_id") % 3).alias("yr"), F.col("source").alias("gvkey"),
        F.concat(F.lit("0"), (F.col("doc_id") % 3 + 1).cast("string")).alias("iid"),
        label.alias("sentiment_label"),
        (F.lit(0.5) + (F.col("doc_id") % 50) / F.lit(100.0)).alias("confidence_score"),
    )


def scored(spark, sf, p=None):
    m = F.floor(F.col("ym") / 100) * 12 + F.col("ym") % 100 - 1
    return ohlc(spark, sf, p).filter("n_days >= 2").join(secdim(spark, sf), "sec").select(
        "sec", "ym", m.alias("m"), F.left("gics", F.lit(2)).alias("prefix"),
        (ratio(F.col("close"), F.col("open")) - 1).alias("algo_score"),
        ratio(F.col("high") - F.col("low"), F.col("high") + F.col("low")).alias("ml_score"),
    )
