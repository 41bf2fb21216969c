"""Experiment-log analytics: parameter grids, best runs, score gaps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.constants import SERIES
from panelspark.functions.expr import flag


def grid_runs(values: DataFrame) -> DataFrame:
    """All combinations of a one-row table of arrays, one column per parameter, with a config id.

    The arrays are exploded in turn; the result has as many rows as the grid
    has points, which is what the caller asks for.
    """
    out = values
    for c in values.columns:
        out = out.withColumn(c, F.explode(F.array_sort(c)))
    label = F.concat_ws("_", *[F.concat(F.lit(c), F.lit("="), F.col(c).cast("string")) for c in values.columns])
    return out.withColumn("config_id", label)


def grid_from(spark: SparkSession, grid: Mapping[str, Sequence]) -> DataFrame:
    return spark.range(1).select(*[F.array(*[F.lit(v) for v in vs]).alias(n) for n, vs in grid.items()])


def best_run(results: DataFrame, metric: str, higher_is_better: bool = False) -> DataFrame:
    """The row with the best metric; ties go to the first remaining columns in order."""
    rows = results.where(F.col(metric).isNotNull())
    order = F.col(metric).desc() if higher_is_better else F.col(metric)
    return rows.orderBy(order, *[c for c in results.columns if c != metric]).limit(1)


def summarize_runs(results: DataFrame, metric: str, model: str = "model", run: str = "run_id") -> DataFrame:
    """Best run of every model and the overall best, by the lowest metric.

    A grouped minimum of (metric, run) keeps one row per model with map-side
    combine, so no model's runs are sorted in one task.
    """
    rows = results.where(F.col(metric).isNotNull())
    best = rows.groupBy(model).agg(F.min(F.struct(metric, run)).alias("b")).select(
        F.col(model).alias("scope"), F.col(f"b.{run}").alias(run), F.col(f"b.{metric}").alias(metric))
    top = rows.agg(F.min(F.struct(metric, run)).alias("b")).select(
        F.lit("overall").alias("scope"), F.col(f"b.{run}").alias(run), F.col(f"b.{metric}").alias(metric))
    return best.unionByName(top)


def gap(cv: str = "cv_score", lb: str = "lb_score"):
    return F.col(lb) - F.col(cv)


def cv_lb_variance(submissions: DataFrame) -> DataFrame:
    """Mean and population deviation of the gap, correlation, overfitting flag, best scores and worst gap."""
    rows = submissions.where(F.col("cv_score").isNotNull() & F.col("lb_score").isNotNull()).withColumn("_gap", gap())
    return rows.agg(
        F.count(F.lit(1)).alias("n_submissions"), F.avg("_gap").alias("mean_gap"), F.stddev_pop("_gap").alias("std_gap"),
        F.corr("cv_score", "lb_score").alias("correlation"), F.min("cv_score").alias("best_cv"),
        F.min("lb_score").alias("best_lb"),
        F.max(F.struct(F.round("_gap", 9), "submission_id"))["submission_id"].alias("worst_gap_submission")
    ).withColumn("overfitting_warning", flag((F.col("mean_gap") > 0.05) & (F.col("n_submissions") >= 3)))


def best_submission(submissions: DataFrame, by: str = "lb_score") -> DataFrame:
    return best_run(submissions.select("submission_id", "cv_score", "lb_score"), by)


def overfitting_submissions(submissions: DataFrame, threshold: float = 0.1) -> DataFrame:
    return submissions.where(gap() > threshold)


def experiment_metadata(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and series of the panel and of each part of a split."""
    out = None
    for name, df in parts.items():
        line = df.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n")).agg(
            F.lit(name).alias("part"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_series"))
        out = line if out is None else out.unionByName(line)
    return out
