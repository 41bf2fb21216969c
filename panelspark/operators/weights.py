"""Sample weights and target transforms."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.constants import MONTH, SERIES
from panelspark.functions.expr import attach, clip, ratio
from panelspark.functions.order_stats import average_rank
from panelspark.operators.metrics import scenario_number

# Weights by month window (0-5, 6-11, 12-23) and by bucket.
MONTH_WEIGHTS = {1: (3.0, 1.5, 1.0), 2: (1.0, 2.5, 1.0)}
BUCKET_WEIGHTS = {1: 2.0, 2: 1.0}
# Share of the metric that falls on one row of each month window.
METRIC_WEIGHTS = {1: (0.0917, 0.0417, 0.0167), 2: (0.0, 0.0944, 0.0361)}


def _by_month(weights) -> Column:
    early, mid, late = weights
    m = F.col(MONTH)
    return F.when(m <= 5, early).when(m <= 11, mid).otherwise(late)


def base_weights(df: DataFrame, scenario, months: tuple | None = None,
                 buckets: Mapping[int, float] | None = None) -> DataFrame:
    """Month-window x bucket weights with mean 1, as column ``weight``."""
    months = MONTH_WEIGHTS[scenario_number(scenario)] if months is None else months
    buckets = BUCKET_WEIGHTS if buckets is None else buckets
    factor = F.coalesce(*[F.when(F.col("bucket") == b, F.lit(float(w))) for b, w in buckets.items()], F.lit(1.0))
    weighted = df.withColumn("weight", _by_month(months) * factor)
    mean = weighted.agg(F.avg("weight").alias("_mean"))
    return attach(weighted, mean).withColumn("weight", F.col("weight") / F.col("_mean")).drop("_mean")


def sample_weights(df: DataFrame, scenario, metric_aligned: bool = False, transform: str = "identity",
                   months: tuple | None = None, buckets: Mapping[int, float] | None = None) -> DataFrame:
    raw = metric_aligned_weights(df, scenario) if metric_aligned else base_weights(df, scenario, months, buckets)
    return transform_weights(raw, transform)


def metric_aligned_weights(df: DataFrame, scenario, avg_vol: str = "avg_vol_12m") -> DataFrame:
    """Weights that follow the official metric: month share / avg_vol x bucket factor, mean 1, at least 0.01."""
    inverse = 1.0 / F.greatest(F.col(avg_vol), F.lit(1.0))
    rows = df.withColumns({"_inv": inverse, "_share": _by_month(METRIC_WEIGHTS[scenario_number(scenario)])})
    series = df.select(*SERIES, "bucket").distinct()
    counts = series.agg(F.count(F.when(F.col("bucket") == 1, 1)).alias("_n1"),
                        F.count(F.when(F.col("bucket") == 2, 1)).alias("_n2"))
    rows = attach(attach(rows, counts), rows.agg(F.avg("_inv").alias("_mean_inv")))
    n1, n2 = F.col("_n1"), F.col("_n2")
    factor = (F.when(F.col("bucket") == 1, ratio(F.lit(2.0), n1) * (n1 + n2) / 3)
              .when(F.col("bucket") == 2, ratio(F.lit(1.0), n2) * (n1 + n2) / 3).otherwise(1.0))
    raw = rows.withColumn("weight", F.col("_share") * F.col("_inv") / F.col("_mean_inv") * factor)
    level = raw.agg(F.sum("weight").alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    scaled = attach(raw, level).withColumn(
        "weight", F.greatest(F.col("weight") * F.col("_rows") / (F.col("_sum") + F.lit(1e-8)), F.lit(0.01)))
    return scaled.select(*df.columns, "weight")


def transform_weights(df: DataFrame, kind: str = "identity", low: float = 0.01, high: float = 100.0) -> DataFrame:
    """Transform the column ``weight``, clip it and bring its mean back to 1.

    Totals come from one-row aggregates; nothing runs over a global window.
    """
    w = F.col("weight")
    if kind == "identity":
        out = df
    elif kind == "sqrt":
        out = df.withColumn("weight", F.sqrt(w))
    elif kind == "log":
        out = df.withColumn("weight", F.log1p(w))
    elif kind == "softmax":
        top = attach(df, df.agg(F.max("weight").alias("_top")))
        shifted = top.withColumn("weight", F.exp(w - F.col("_top"))).drop("_top")
        out = attach(shifted, shifted.agg(F.sum("weight").alias("_all"))).withColumn(
            "weight", w / F.col("_all")).drop("_all")
    elif kind == "rank":
        ranked = average_rank(df, "weight", "_rank")
        out = attach(ranked, df.agg(F.count(F.lit(1)).alias("_rows"))).withColumn(
            "weight", F.col("_rank") / F.col("_rows")).select(*df.columns)
    else:
        raise ValueError(f"unknown weight transformation {kind!r}")
    out = out.withColumn("weight", clip(w, low, high))
    level = out.agg(F.sum("weight").alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    return attach(out, level).withColumn(
        "weight", w * F.col("_rows") / (F.col("_sum") + F.lit(1e-8))).select(*df.columns)


def transform_target(y: Column, kind: str = "none", eps: float = 1e-6, power: float = 0.5) -> Column:
    if kind == "none":
        return y
    up = F.greatest(y, F.lit(0.0)) + F.lit(eps)
    if kind == "log1p":
        return F.log1p(up)
    if kind == "power":
        return F.pow(up, F.lit(power))
    raise ValueError(f"unknown target transform {kind!r}")


def inverse_transform_target(y: Column, kind: str = "none", eps: float = 1e-6, power: float = 0.5) -> Column:
    if kind == "none":
        return y
    if kind == "log1p":
        back = F.expm1(y) - F.lit(eps)
    elif kind == "power":
        back = F.pow(F.greatest(y, F.lit(0.0)), F.lit(1.0 / power)) - F.lit(eps)
    else:
        raise ValueError(f"unknown target transform {kind!r}")
    return F.greatest(back, F.lit(0.0))
