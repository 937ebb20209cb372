"""Exact interpolated quantiles per (group, feature) in two light passes.

``percentile`` keeps every distinct value of a group in one buffer. Here pass one counts
rows per logarithmic value bucket, which combines on the map side to a small histogram.
The histogram tells in which bucket a wanted position lies, so pass two shuffles only the
values of these buckets. The histogram also says how many rows the largest of them holds: up to
a limit a window ranks each bucket, beyond it the ranks are spread over slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.functions.expr import same_key
from panelspark.functions.ordered import running_sums
from panelspark.storage import cut_lineage

RESOLUTION = 128  # buckets per factor e: small histograms, each bucket under 1% wide
GROUPED_RESOLUTION = 8  # with groups, coarse enough that a task meets a bucket of a group more than once
WINDOW_ROWS = 2_000_000  # largest bucket that one window task may rank


def value_bucket(c: Column, resolution: int = RESOLUTION) -> Column:
    """Whole number that never falls as the value rises."""
    offset = 760 * resolution  # above the logarithm range of a double
    size = F.floor(F.least(F.log(F.abs(c)), F.lit(750.0)) * resolution) + offset  # infinity: last bucket
    return F.when(c > 0, size).when(c < 0, -size).otherwise(F.lit(0).cast("long"))


def known_cells(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Rows (group, feature, value, bucket) of the values that are neither NULL nor NaN."""
    return (
        df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
        .unpivot(by, columns, "feature", "value")
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
        .withColumn("bucket", value_bucket(F.col("value"), GROUPED_RESOLUTION if by else RESOLUTION))
    )


def counted_up_to(counts: DataFrame, keys: list[str], value: str, largest: int) -> DataFrame:
    """``upto``: rows of the group with at most this value; ``counts`` has ``c`` rows of each value."""
    if largest <= WINDOW_ROWS:
        return counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys).orderBy(value)))
    return running_sums(counts, keys, [F.col(value).asc()], {"upto": F.col("c")})


def value_at(rank: str, value: str, before) -> Column:
    """The value that holds position ``rank`` of its group; ``before`` rows come ahead of all shown ones."""
    upto = before + F.col("upto")
    return F.max(F.when((F.col(rank) >= upto - F.col("c")) & (F.col(rank) < upto), F.col(value))).alias(rank)


def difference(a: Column, b: Column) -> Column:
    """a - b, 0 for equal infinities."""
    return F.when(a == b, 0.0).otherwise(a - b)


def between(lo: str, hi: str, frac) -> Column:
    return F.col(lo) + difference(F.col(hi), F.col(lo)) * frac


def exact_quantiles(df: DataFrame, by: list[str], columns: list[str],
                    probs: dict[str, float]) -> DataFrame:
    """One row per group and feature, one column per entry of ``probs``.

    The target list has two rows per group, feature and probability at most; adaptive execution
    broadcasts it while it is small. NULL is a group. ``df`` is read twice, so it should be a stored table.
    """
    cells = known_cells(df, by, columns)
    keys = [*by, "feature"]
    up = Window.partitionBy(*keys).orderBy("bucket")
    hist = (
        cells.groupBy(*keys, "bucket").agg(F.count("*").alias("c"))
        .withColumn("upto", F.sum("c").over(up))
        .withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    )
    wanted = F.array(*[
        F.struct(F.lit(n).alias("prob"),
                 F.floor((F.col("n") - 1) * p).alias("lo"),
                 F.ceil((F.col("n") - 1) * p).alias("hi"),
                 ((F.col("n") - 1) * p).alias("pos"))
        for n, p in probs.items()
    ])
    before = F.col("upto") - F.col("c")
    inside = lambda r: (r >= before) & (r < F.col("upto"))
    # Written once: both passes below must aim at the same buckets.
    targets = cut_lineage(
        hist.select(*keys, "bucket", before.alias("before"), "c", "upto", F.explode(wanted).alias("w"))
        .filter(inside(F.col("w.lo")) | inside(F.col("w.hi")))
        .select(*keys, "bucket", "before", F.col("c").alias("rows"),
                F.when(inside(F.col("w.lo")), F.col("w.lo")).alias("lo"),
                F.when(inside(F.col("w.hi")), F.col("w.hi")).alias("hi"),
                F.col("w.prob").alias("prob"),
                (F.col("w.pos") - F.col("w.lo")).alias("frac")), "quantile_targets")
    largest = targets.agg(F.max("rows")).first()[0]
    near = same_key(cells, targets.select(*keys, "bucket").distinct(), [*keys, "bucket"], "left_semi")
    counts = near.groupBy(*keys, "bucket", "value").agg(F.count("*").alias("c"))
    placed = counted_up_to(counts, [*keys, "bucket"], "value", largest or 0)
    hits = same_key(placed, targets, [*keys, "bucket"])
    picked = hits.groupBy(*keys, "prob").agg(
        value_at("lo", "value", F.col("before")), value_at("hi", "value", F.col("before")), F.max("frac").alias("frac"))
    value = between("lo", "hi", F.col("frac"))
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("prob") == n, value)).alias(n) for n in probs]
    )


def mad_buckets(hist: DataFrame, keys: list[str]) -> DataFrame:
    """The buckets that can hold a median or a median distance from it, with what is known of the others.

    ``hist`` has rows (group, feature, bucket, c, a, b): count, smallest and largest value. The
    buckets at the middle position bound the median; with it every bucket's distances from the
    median lie between ``near`` and ``far``. Values on either side of the median are two runs ordered
    by their distance, and the median distance is the middle element of their merge: counted by
    ``near`` it cannot lie below ``least``, counted by ``far`` not above ``most``. Buckets outside
    need no second look; those wholly below are the ``closer`` rows.
    """
    group = Window.partitionBy(*keys)
    run = lambda c: group.orderBy(c).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    c, a, b = F.col("c"), F.col("a"), F.col("b")
    hist = hist.select("*", F.sum(c).over(run("bucket")).alias("upto"), F.sum(c).over(group).alias("n"))
    lo, hi, before = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2), F.col("upto") - c
    inside = lambda r: (r >= before) & (r < F.col("upto"))
    hist = hist.select("*", before.alias("before"), lo.alias("lo"), hi.alias("hi"), (inside(lo) | inside(hi)).alias("middle"))
    hist = hist.select("*", F.min(F.when(F.col("middle"), a)).over(group).alias("_m1"), F.max(F.when(F.col("middle"), b)).over(group).alias("_m2"))
    hist = hist.select("*", F.greatest(F.lit(0.0), difference(a, F.col("_m2")), difference(F.col("_m1"), b)).alias("near"),
                       F.greatest(difference(b, F.col("_m1")), difference(F.col("_m2"), a)).alias("far"))
    hist = hist.select("*", F.sum(c).over(run("near")).alias("_n"), F.sum(c).over(run("far")).alias("_f"))
    hist = hist.select("*", F.min(F.when(F.col("_n") > F.col("lo"), F.col("near"))).over(group).alias("least"),
                       F.min(F.when(F.col("_f") > F.col("hi"), F.col("far"))).over(group).alias("most"))
    looked_at = F.col("middle") | ((F.col("far") >= F.col("least")) & (F.col("near") <= F.col("most")))
    closer = F.sum(F.when(~looked_at & (F.col("far") < F.col("least")), c).otherwise(0)).over(group)
    hist = hist.select("*", looked_at.alias("_look"), closer.alias("closer"))
    return hist.filter("_look").select(*keys, "bucket", "c", "middle", "before", "lo", "hi", "closer")


def histogram(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Rows (group, feature, bucket, c, a, b): count, smallest and largest value of each value bucket."""
    return known_cells(df, by, columns).groupBy(*by, "feature", "bucket").agg(
        F.count("*").alias("c"), F.min("value").alias("a"), F.max("value").alias("b"))


def median_and_mad(df: DataFrame, by: list[str], columns: list[str], hist: DataFrame | None = None) -> DataFrame:
    """``median`` and ``mad`` (median distance from the median) per group and feature, both exact.

    One histogram serves both, and one narrow second pass reads the values of the few buckets that
    can hold either. NULL is a group. ``df`` is read twice, or once when its ``hist`` is known, so it
    should be a stored table.
    """
    cells, keys = known_cells(df, by, columns), [*by, "feature"]
    chosen = cut_lineage(mad_buckets(histogram(df, by, columns) if hist is None else hist, keys), "mad_buckets")
    largest = chosen.groupBy(*keys).agg(F.sum("c").alias("rows")).agg(F.max("rows")).first()[0] or 0
    near = same_key(cells, chosen.select(*keys, "bucket"), [*keys, "bucket"], "left_semi")
    values = cut_lineage(near.groupBy(*keys, "bucket", "value").agg(F.count("*").alias("c")), "mad_values")

    middle = chosen.filter("middle").select(*keys, "bucket", "before", "lo", "hi")
    central = same_key(values, middle.select(*keys, "bucket"), [*keys, "bucket"], "left_semi")
    placed = same_key(counted_up_to(central, [*keys, "bucket"], "value", largest), middle, [*keys, "bucket"])
    at = placed.groupBy(*keys).agg(value_at("lo", "value", F.col("before")), value_at("hi", "value", F.col("before")))
    median = at.select(*keys, between("lo", "hi", F.lit(0.5)).alias("median"))
    known = chosen.select(*keys, "lo", "hi", "closer").distinct()
    median = cut_lineage(same_key(median, known, keys), "medians")

    apart = same_key(values, median.select(*keys, "median"), keys).groupBy(
        *keys, F.abs(difference(F.col("value"), F.col("median"))).alias("d")).agg(F.sum("c").alias("c"))
    ranked = same_key(counted_up_to(apart, keys, "d", largest), median, keys)
    at = ranked.groupBy(*keys, "median").agg(value_at("lo", "d", F.col("closer")), value_at("hi", "d", F.col("closer")))
    return at.select(*keys, "median", between("lo", "hi", F.lit(0.5)).alias("mad"))


def wide(profile: DataFrame, by: list[str], columns: list[str], stats: dict[str, str]) -> DataFrame:
    """One row per group with a column ``<feature><suffix>`` for each feature and entry of ``stats`` (name: suffix)."""
    return profile.groupBy(*by).agg(
        *[F.max(F.when(F.col("feature") == c, F.col(stat))).alias(f"{c}{suffix}") for c in columns for stat, suffix in stats.items()]
    )
