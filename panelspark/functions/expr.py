"""Column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL for a zero divisor."""
    return F.try_divide(a, b)


def nudge(digits: int) -> float:
    """Offset far below the last kept digit and far above summation noise: exact halves then
    round the same way in every engine."""
    return 3.7 * 10.0 ** -(digits + 4)


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Round for output; -0.0 becomes 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(nudge(digits)), digits) + F.lit(0.0)


def half_even(c: Column, digits: int) -> Column:
    """Round half to even; the first rounding removes summation noise."""
    return F.bround(F.round(c, 10), digits) + F.lit(0.0)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def without_nan(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NaN becomes NULL in the float columns (or those of ``columns``); tables enter through this."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    chosen = [c for c in floats if columns is None or c in columns]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in chosen}) if chosen else df


def same_key(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL meets NULL; columns of ``left``, then the others of ``right``."""
    if not keys:
        return left.join(right, how=how)
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    hit = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys])
    return left.join(renamed, hit, how).drop(*[f"_right_{k}" for k in keys])


def clip(c: Column, lo, hi) -> Column:
    """Clip that keeps NULL (greatest and least would skip it) and takes NaN for missing."""
    return F.when(c.isNotNull() & ~F.isnan(c), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def log1p_positive(c: Column) -> Column:
    return F.when(c > 0, F.log1p(c)).otherwise(c)


def signed_log(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def bands(c: Column, steps: list[tuple[float, str]], floor: str, inclusive: bool = False) -> Column:
    """First label whose bound lies below the value, else ``floor``."""
    out = None
    for bound, label in steps:
        hit = (c >= bound) if inclusive else (c > bound)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(floor)


def month_of(c: Column) -> Column:
    return F.trunc(c, "MM")


def month_index(year: Column, month: Column) -> Column:
    """Consecutive number of a calendar month."""
    return year * 12 + month - 1
