"""Column expressions used across operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.constants import MONTH


def ratio(num: Column, den: Column) -> Column:
    """num / den, null where den is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


STEADY = "decimal(38,18)"
STEADY_BELOW = 1e14


def steady_sum(x: Column, over=None) -> Column:
    """The sum of doubles, the same in every order of the rows: whole multiples of 1e-18 are added without rounding.

    Partial sums combine on the map side like any sum. Values of 1e14 and more,
    for which the multiples have no room, infinities and NaN are added as
    doubles beside it. Null where there is no value, as with ``sum``.
    """
    return steady_total(*[p if over is None else p.over(over) for p in steady_parts(x)])


def steady_parts(x: Column) -> tuple[Column, Column]:
    """The two sums that ``steady_total`` makes a steady sum of; sums of them over parts of the rows give the same."""
    x = x.cast("double")
    small = F.abs(x) < STEADY_BELOW
    return F.sum(F.when(small, x).cast(STEADY)), F.sum(F.when(~small, x))


def steady_total(exact: Column, large: Column) -> Column:
    exact = exact.cast("double")
    return F.when(exact.isNull(), large).otherwise(exact + F.coalesce(large, F.lit(0.0)))


def steady_avg(x: Column, over=None) -> Column:
    """The mean of doubles, the same in every order of the rows."""
    n = F.count(x).over(over) if over is not None else F.count(x)
    return F.try_divide(steady_sum(x, over), n)


def flag(cond: Column) -> Column:
    """1 where cond holds, 0 where it is false or null."""
    return F.when(cond, 1).otherwise(0)


def clip(x: Column, low, high) -> Column:
    """Clip to [low, high]; a null stays null, a null or None bound does nothing."""
    bounded = x
    if low is not None:
        bounded = F.greatest(bounded, low if isinstance(low, Column) else F.lit(float(low)))
    if high is not None:
        bounded = F.least(bounded, high if isinstance(high, Column) else F.lit(float(high)))
    return F.when(x.isNotNull(), bounded)


def month_between(low: int, high: int) -> Column:
    return F.col(MONTH).between(low, high)


def window_id(windows, month: Column | None = None) -> Column:
    """Position of the first (low, high) window that holds the month, else null."""
    month = F.col(MONTH) if month is None else month
    pairs = [(F.when(month.between(lo, hi), F.lit(i))) for i, (lo, hi) in enumerate(windows)]
    return F.coalesce(*pairs)


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column; the added zero turns -0.0 into 0.0."""
    return df.select(*[
        (F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def one_row(df: DataFrame) -> Column:
    """A one-row aggregate as a struct-valued scalar subquery, so no join is needed to attach it."""
    return df.select(F.struct(*[F.col(c) for c in df.columns])).scalar()


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def attach(df: DataFrame, small: DataFrame, prefix: str = "_one") -> DataFrame:
    """Attach the columns of a one-row aggregate to every row."""
    return df.withColumn(prefix, one_row(small)).select(
        *[F.col(c) for c in df.columns], *[F.col(f"{prefix}.{c}").alias(c) for c in small.columns])
