"""Column helpers whose edge cases are fixed: finite values, guarded correlation, average ranks, clipping.

Missing is NULL throughout: NaN and infinities become NULL before they can meet an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

EPS = 1e-8


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_finite(x: str | Column) -> Column:
    return c(x).isNotNull() & ~F.isnan(c(x)) & (F.abs(c(x)) < float("inf"))


def finite(x: str | Column) -> Column:
    """x, or NULL where it is NaN or infinite."""
    return F.when(is_finite(x), c(x))


def clip(x: str | Column, lo: float, hi: float) -> Column:
    return F.when(is_finite(x), F.greatest(F.lit(lo), F.least(F.lit(hi), c(x))))


def guarded(cov: Column, a: Column, b: Column, least_std: float = 1e-12) -> Column:
    """A correlation from a covariance and two deviations; NULL if either side is (almost) constant."""
    return F.when((a > least_std) & (b > least_std), F.try_divide(cov, a * b))


def corr(x: str | Column, y: str | Column, over: WindowSpec | None = None, least_std: float = 1e-12) -> Column:
    """Pearson correlation over pairs without NULL; NULL if either side is (almost) constant."""
    both = c(x).isNotNull() & c(y).isNotNull()
    a, b = F.when(both, c(x)), F.when(both, c(y))
    parts = [F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b)]
    return guarded(*[p.over(over) for p in parts] if over is not None else parts, least_std)


def average_rank(x: str, *keys: str) -> Column:
    """1-based rank of x within keys, ties get the mean of their ranks."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(x)) + (F.count("*").over(Window.partitionBy(*keys, x)) - 1) / 2


def normal_text(x: str | Column) -> Column:
    """White space trimmed and each run of it one blank."""
    return F.trim(F.regexp_replace(c(x), r"\s+", " "))
