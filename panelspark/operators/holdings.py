"""Holdings analysis: company statistics, scores and top lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from panelspark.functions.expr import half_even


def holding_stats(p: DataFrame, key="company_id", score="score", weight="weight", year="yr", side="side") -> DataFrame:
    w = F.abs(F.col(weight))
    sd = lambda c: F.when(F.count(F.lit(1)) > 1, F.stddev_pop(c)).otherwise(0.0)
    return p.filter(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(
        F.count("*").alias("appearances"), F.sum(w).alias("total_weight"), F.avg(w).alias("avg_weight"),
        F.avg(score).alias("avg_score"), F.max(score).alias("max_score"), F.min(score).alias("min_score"),
        sd(score).alias("score_std"), sd(w).alias("weight_std"),
        F.count(F.when(F.col(side) == "long", 1)).alias("long_count"),
        F.count(F.when(F.col(side) == "short", 1)).alias("short_count"),
        F.min(year).alias("first_year"), F.max(year).alias("last_year"))


def mode_of(p: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Most frequent value per key, the smaller name on ties; counted first, so a busy key is small."""
    counted = p.groupBy(key, value).agg(F.count("*").alias("_n"))
    return counted.groupBy(key).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(name))


def holding_mode(p: DataFrame, key="company_id", sector="sector", side="side") -> DataFrame:
    return mode_of(p, key, sector, "primary_sector").join(mode_of(p, key, side, "primary_side"), key)


def score_v1(stats: DataFrame) -> DataFrame:
    """Mean score, score per deviation, frequency and consistency, weighted 0.4/0.3/0.2/0.1."""
    mean, sd = F.col("avg_score"), F.col("score_std")
    per_risk = F.when(sd > 0, mean / sd).otherwise(mean)
    steady = 1 / (1 + sd)
    return stats.withColumns({
        "risk_adjusted_score": per_risk, "consistency_score": steady,
        "overall_score": mean * 0.4 + per_risk * 0.3 + F.col("appearances") / 100 * 0.2 + steady * 0.1})


def score_v2(stats: DataFrame) -> DataFrame:
    """Score out of 100 from capped performance, frequency, consistency and time span."""
    mean, sd, n = F.col("avg_score"), F.col("score_std"), F.col("appearances")
    span = F.col("last_year") - F.col("first_year") + 1
    steady = F.when(sd > 0, 1 / (1 + sd)).otherwise(1.0)
    return stats.withColumns({
        "sharpe_like_ratio": F.when(sd > 1e-10, mean / sd).otherwise(mean * 1000),
        "consistency": steady, "time_span": span, "long_ratio": F.col("long_count") / n,
        "overall_score": F.least(mean * 50, F.lit(40.0)) + F.least(n / 10, F.lit(20.0)) + steady * 20
        + F.least(span / 5, F.lit(20.0))})


def top_holdings(scored: DataFrame, criterion: str, n: int, key="company_id", min_appearances: int = 3,
                 rounding: dict[str, int] | None = None) -> DataFrame:
    """Best ``n`` by a criterion among companies seen often enough; ``rounding`` applies first."""
    kept = scored.filter(F.col("appearances") >= min_appearances)
    kept = kept.withColumns({c: half_even(F.col(c), d) for c, d in (rounding or {}).items()})
    return kept.orderBy(F.col(criterion).desc(), key).limit(n)


def top_holdings_multi(scored: DataFrame, criteria: list[str], n: int, key="company_id",
                       min_appearances: int = 3, digits: int = 9) -> DataFrame:
    """Top ``n`` for each criterion; each list is an ordered limit, which needs no wide shuffle."""
    kept = scored.filter(F.col("appearances") >= min_appearances)
    lists = []
    for c in criteria:
        one = kept.select(F.lit(c).alias("criterion"), key, F.round(F.col(c).cast("double"), digits).alias("value"),
                          "appearances")
        top = one.orderBy(F.col("value").desc(), key).limit(n)
        place = Window.partitionBy("criterion").orderBy(F.col("value").desc(), key)
        lists.append(top.withColumn("place", F.row_number().over(place)))
    return reduce(DataFrame.unionByName, lists)


def sector_performance(scored: DataFrame, min_appearances: int = 3) -> DataFrame:
    """Company figures gathered by primary sector."""
    return scored.filter(F.col("appearances") >= min_appearances).groupBy("primary_sector").agg(
        F.count("*").alias("companies"), F.sum("appearances").alias("total_appearances"),
        F.avg("avg_score").alias("avg_score"), F.avg("avg_weight").alias("avg_weight"),
        F.when(F.count("*") > 1, F.stddev_pop("avg_score")).otherwise(0.0).alias("score_std"))


def recent_average(p: DataFrame, rows: int = 12, key="company_id", score="score", year="yr", month="mo",
                   tie_break=("sector", "side")) -> DataFrame:
    """Mean score of the latest entries per company. The row limit is applied before the shuffle."""
    latest = Window.partitionBy(key).orderBy(F.col(year).desc(), F.col(month).desc(), *[F.col(c).desc() for c in tie_break])
    kept = p.withColumn("_rn", F.row_number().over(latest)).filter(F.col("_rn") <= rows)
    return kept.groupBy(key).agg(F.avg(score).alias("recent_avg_score"), F.count("*").alias("entries"))


def holding_breakdown(p: DataFrame, key="company_id", sector="sector", side="side", year="yr", top: int = 3) -> DataFrame:
    """``sector(count)`` strings by falling count, side counts and year range."""
    per = p.groupBy(key, sector).agg(
        F.count("*").alias("_n"), F.count(F.when(F.col(side) == "long", 1)).alias("_l"),
        F.count(F.when(F.col(side) == "short", 1)).alias("_s"), F.min(year).alias("_a"), F.max(year).alias("_b"))
    # one entry per sector
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col(sector).alias("s"))))
    text = lambda a: F.array_join(F.transform(
        a, lambda x: F.concat(x["s"], F.lit("("), (-x["n"]).cast("string"), F.lit(")"))), ", ")
    return per.groupBy(key).agg(ordered.alias("_o"), F.sum("_l").alias("_l"), F.sum("_s").alias("_s"),
                                F.min("_a").alias("first_appearance"), F.max("_b").alias("last_appearance")).select(
        key, text(F.col("_o")).alias("sectors_appeared"), text(F.slice("_o", 1, top)).alias("top_sectors"),
        F.concat(F.lit("Long: "), F.col("_l").cast("string"), F.lit(", Short: "), F.col("_s").cast("string")).alias("position_breakdown"),
        "first_appearance", "last_appearance")


def holding_totals(p: DataFrame, key="company_id", file_keys=("yr", "mo", "sector"), min_appearances: int = 3) -> DataFrame:
    """Companies, companies seen often enough, and portfolio files."""
    files = p.select(*file_keys).distinct().agg(F.count("*").alias("n"))
    return p.groupBy(key).agg(F.count("*").alias("_n")).agg(
        F.count("*").alias("companies"),
        F.count(F.when(F.col("_n") >= min_appearances, 1)).alias("significant_companies"),
    ).select("*", files.scalar().alias("files"))
