"""Window helpers: every frame has an order and counts its non-null values before it answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def by_ticker() -> WindowSpec:
    """Each ticker's rows by date.  A function: windows need a session, importing this module does not."""
    return Window.partitionBy("ticker").orderBy("date")


def frame(n: int, last: int = 0, over: WindowSpec | None = None) -> WindowSpec:
    """The n rows up to ``last`` rows after the current one."""
    return (over or by_ticker()).rowsBetween(last - n + 1, last)


def rolling(x: Column, n: int, fn: Callable[[Column], Column], min_periods: int | None = None, last: int = 0, over: WindowSpec | None = None) -> Column:
    """fn over the frame, null until ``min_periods`` (n, unless given) values are not null."""
    w = frame(n, last, over)
    return F.when(F.count(x).over(w) >= (min_periods or n), fn(x).over(w))


def lag(x: Column, n: int = 1) -> Column:
    return F.lag(x, n).over(by_ticker())


def lead(x: Column, n: int = 1) -> Column:
    return F.lead(x, n).over(by_ticker())


def running(x: Column, fn: Callable[[Column], Column] = F.sum, over: WindowSpec | None = None) -> Column:
    return fn(x).over((over or by_ticker()).rowsBetween(Window.unboundedPreceding, 0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def cross_sectional_rank(df: DataFrame, col: str, out: str, by: str = "date", min_names: int = 5) -> DataFrame:
    """(average rank - 0.5) / n - 0.5 among the non-null values of each group; null under ``min_names``."""
    x = F.col(col)
    n = F.count(x).over(Window.partitionBy(by))
    first = F.rank().over(Window.partitionBy(by).orderBy(x.asc_nulls_last()))
    tied = F.count(x).over(Window.partitionBy(by, col))
    return df.withColumn(out, F.when(x.isNotNull() & (n >= min_names), (first + (tied - 1) / 2 - 0.5) / n - 0.5))
