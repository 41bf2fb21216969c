"""Closed-form forecasts over (country, brand_name, avg_vol [, bucket])."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.constants import MONTH, ROW_KEY, SERIES, require
from panelspark.functions.expr import attach, clip, ratio
from panelspark.functions.stage import stage


def each_month(aux: DataFrame, months) -> DataFrame:
    """One row per series and month; the months are a literal array, so this is a projection, not a join."""
    return aux.withColumn(MONTH, F.explode(F.array(*[F.lit(int(m)) for m in months])))


def _forecast(aux: DataFrame, months, volume: Column, volume_col: str) -> DataFrame:
    require(aux, [*SERIES, volume_col], "aux")
    return each_month(aux, months).select(*ROW_KEY, volume.alias("volume"))


def naive_persistence(aux: DataFrame, months, volume_col: str = "avg_vol") -> DataFrame:
    return _forecast(aux, months, F.col(volume_col), volume_col)


def linear_decay(aux: DataFrame, months, rate: float = 0.03, volume_col: str = "avg_vol") -> DataFrame:
    left = F.greatest(F.lit(0.0), 1 - F.lit(float(rate)) * F.col(MONTH))
    return _forecast(aux, months, F.col(volume_col) * left, volume_col)


def exponential_decay(aux: DataFrame, months, rate: float = 0.05, volume_col: str = "avg_vol") -> DataFrame:
    return _forecast(aux, months, F.col(volume_col) * F.exp(F.lit(-float(rate)) * F.col(MONTH)), volume_col)


def bucket_specific_decay(aux: DataFrame, months, rates: Mapping[int, float], volume_col: str = "avg_vol",
                          bucket_col: str = "bucket") -> DataFrame:
    rate = F.coalesce(*[F.when(F.col(bucket_col) == b, F.lit(float(x))) for b, x in rates.items()], F.lit(0.05))
    return _forecast(aux, months, F.col(volume_col) * F.exp(-rate * F.col(MONTH)), volume_col)


# Decay rates tried by default.
DECAY_RATES = [0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.1, 0.12, 0.15]


def decay_rate_table(actual: DataFrame, aux: DataFrame, decay: str = "exponential", rates=None,
                     volume_col: str = "avg_vol") -> DataFrame:
    """Errors of every rate; each actual row meets the literal array of rates, so one join serves the whole grid."""
    rates = DECAY_RATES if rates is None else rates
    if decay not in ("linear", "exponential"):
        raise ValueError(f"unknown decay {decay!r}")
    grid = F.array(*[F.lit(float(x)) for x in rates])
    rows = actual.join(aux.select(*SERIES, F.col(volume_col).alias("_base")), SERIES).withColumn(
        "decay_rate", F.explode(grid))
    step = F.col("decay_rate") * F.col(MONTH)
    shape = F.greatest(F.lit(0.0), 1 - step) if decay == "linear" else F.exp(-step)
    e = F.col("volume") - F.col("_base") * shape
    share = F.when(F.col("volume") > 0, F.abs(ratio(e, F.col("volume"))))
    return rows.groupBy("decay_rate").agg(
        F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (F.avg(share) * 100).alias("mape"))


def best_decay_rate(table: DataFrame) -> DataFrame:
    """The rate with the least rmse; the smaller rate on a tie."""
    return table.agg(F.min(F.struct("rmse", "decay_rate")).alias("b")).select(
        F.col("b.decay_rate").alias("decay_rate"), F.col("b.rmse").alias("rmse"))


def flat(df: DataFrame) -> DataFrame:
    return df.withColumn("prediction", F.lit(1.0))


def month_curve(train: DataFrame, target: str = "y_norm") -> DataFrame:
    """Mean target per month: at most one row per month of the panel."""
    return stage(train.groupBy(MONTH).agg(F.avg(target).alias("curve")))


def global_mean(train: DataFrame, df: DataFrame, target: str = "y_norm") -> DataFrame:
    """Mean target of the row's month, else the overall mean."""
    overall = train.agg(F.avg(target).alias("_overall"))
    return (attach(df.join(month_curve(train, target), MONTH, "left"), overall)
            .withColumn("prediction", F.coalesce("curve", "_overall")).drop("curve", "_overall"))


def trend(train: DataFrame, df: DataFrame, target: str = "y_norm", factor: float = 0.95) -> DataFrame:
    """1 + month x mean step of the month curve x factor, clipped to 0..2.

    The mean of successive differences is (last - first) / (months - 1).
    """
    curve = month_curve(train, target)
    steps = curve.agg(
        F.max(F.struct(MONTH, "curve"))["curve"].alias("_b"), F.min(F.struct(MONTH, "curve"))["curve"].alias("_a"),
        F.count(F.lit(1)).alias("_n"))
    slope = F.coalesce(ratio(F.col("_b") - F.col("_a"), F.col("_n") - 1), F.lit(0.0))
    return attach(df, steps).withColumn(
        "prediction", clip(1.0 + F.col(MONTH) * slope * factor, 0, 2)).drop("_a", "_b", "_n")
