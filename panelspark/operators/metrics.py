"""Bucket-weighted accumulated-error metric and error analyses.

``actual`` and ``pred`` carry (country, brand_name, months_postgx, volume),
``aux`` carries (country, brand_name, avg_vol, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.constants import MONTH, REPORT_WINDOWS, ROW_KEY, SERIES, require
from panelspark.functions.expr import clip, flag, one_row, ratio
from panelspark.functions.order_stats import column_medians, quantiles

# Per scenario the first month, the weight and length of the row-wise term,
# and (weight, first month, last month, length) of the accumulated terms.
TERMS = {
    1: (0, 0.2, 24, [(0.5, 0, 5, 6), (0.2, 6, 11, 6), (0.1, 12, 23, 12)]),
    2: (6, 0.2, 18, [(0.5, 6, 11, 6), (0.3, 12, 23, 12)]),
}


def scenario_number(scenario) -> int:
    return int(str(scenario).removeprefix("scenario"))


def matched(actual: DataFrame, pred: DataFrame, aux: DataFrame | None = None) -> DataFrame:
    """Inner join on the row key as columns ``actual`` and ``pred``, with aux attached where given."""
    for name, df in (("actual", actual), ("pred", pred)):
        require(df, [*ROW_KEY, "volume"], name)
    a = actual.select(*ROW_KEY, F.col("volume").alias("actual"))
    p = pred.select(*ROW_KEY, F.col("volume").alias("pred"))
    both = a.join(p, ROW_KEY)
    if aux is None:
        return both
    require(aux, [*SERIES, "avg_vol", "bucket"], "aux")
    return both.join(aux.select(*SERIES, "avg_vol", "bucket"), SERIES, "left")


def series_errors(actual: DataFrame, pred: DataFrame, aux: DataFrame, scenario) -> DataFrame:
    """One ``pe`` per series: a row-wise term plus accumulated terms, each over avg_vol.

    Only series whose first matched month is the scenario's first month count.
    A series without avg_vol, or with 0, has a null pe and still counts.
    """
    return errors_of_rows(matched(actual, pred, aux), scenario)


def errors_of_rows(rows: DataFrame, scenario) -> DataFrame:
    """``series_errors`` of rows that hold actual, pred, avg_vol and bucket side by side: one aggregate and no join."""
    first, weight, length, parts = TERMS[scenario_number(scenario)]
    gap = F.col("actual") - F.col("pred")
    last = max(hi for _, _, hi, _ in parts)
    inside = F.col(MONTH).between(first, last)
    base = F.max("avg_vol")

    def accumulated(lo: int, hi: int) -> Column:
        return F.abs(F.coalesce(F.sum(F.when(F.col(MONTH).between(lo, hi), gap)), F.lit(0.0)))

    pe = ratio(weight * F.coalesce(F.sum(F.when(inside, F.abs(gap))), F.lit(0.0)), length * base)
    for w, lo, hi, n in parts:
        pe = pe + ratio(w * accumulated(lo, hi), n * base)
    return (rows.groupBy(*SERIES, "bucket")
            .agg(F.min(MONTH).alias("_first"), pe.alias("pe"))
            .where(F.col("_first") == first).drop("_first"))


def weighted_metric() -> Column:
    """Aggregate over series errors: 2/n1 of bucket 1 plus 1/n2 of bucket 2; one bucket alone gives its mean term."""
    one, two = F.col("bucket") == 1, F.col("bucket") == 2
    n1, n2 = F.count(F.when(one, 1)), F.count(F.when(two, 1))
    s1, s2 = F.sum(F.when(one, F.col("pe"))), F.sum(F.when(two, F.col("pe")))
    zero = F.lit(0.0)
    both = ratio(2 * F.coalesce(s1, zero), n1) + ratio(F.coalesce(s2, zero), n2)
    alone1, alone2 = 2 * F.avg(F.when(one, F.col("pe"))), F.avg(F.when(two, F.col("pe")))
    return F.when((n1 > 0) & (n2 > 0), both).when(n1 > 0, alone1).when(n2 > 0, alone2)


def official_metric(actual: DataFrame, pred: DataFrame, aux: DataFrame, scenario) -> DataFrame:
    """One row, rounded to 4 digits."""
    return series_errors(actual, pred, aux, scenario).agg(F.round(weighted_metric(), 4).alias("metric"))


def compute_metric1(actual, pred, aux) -> DataFrame:
    return official_metric(actual, pred, aux, 1)


def compute_metric2(actual, pred, aux) -> DataFrame:
    return official_metric(actual, pred, aux, 2)


def bucket_metrics(actual: DataFrame, pred: DataFrame, aux: DataFrame, scenario) -> DataFrame:
    """The metric overall and per bucket from one pass over the series errors."""
    errors = series_errors(actual, pred, aux, scenario).where(F.col("bucket").isin(1, 2))
    copies = F.array(F.lit("overall"), F.concat(F.lit("bucket"), F.col("bucket").cast("string")))
    return (errors.withColumn("scope", F.explode(copies)).groupBy("scope")
            .agg(F.round(weighted_metric(), 4).alias("metric"), F.count(F.lit(1)).alias("n_series")))


def create_aux(panel: DataFrame) -> DataFrame:
    require(panel, [*SERIES, "avg_vol_12m", "bucket"], "panel")
    return panel.select(*SERIES, F.col("avg_vol_12m").alias("avg_vol"), "bucket").distinct()


def point_errors(df: DataFrame, y_true: str = "actual", y_pred: str = "pred") -> DataFrame:
    """RMSE, MAE and MAPE in one aggregate."""
    e = F.col(y_pred) - F.col(y_true)
    mape = F.abs((F.col(y_true) - F.col(y_pred)) / (F.col(y_true) + F.lit(1e-8)))
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (F.avg(mape) * 100).alias("mape"))


def per_series_error(actual: DataFrame, pred: DataFrame, aux: DataFrame, scenario) -> DataFrame:
    first = TERMS[scenario_number(scenario)][0]
    rows = matched(actual, pred, aux).where(F.col(MONTH) >= first)
    e = F.col("pred") - F.col("actual")
    stats = rows.groupBy(*SERIES).agg(
        F.max("bucket").alias("bucket"), F.coalesce(F.max("avg_vol"), F.avg("actual")).alias("avg_vol"),
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.abs(e) / (F.abs("actual") + F.lit(1e-8))) * 100).alias("mape"),
        F.sum("actual").alias("total_actual"), F.sum("pred").alias("total_pred"),
        F.count(F.lit(1)).alias("n_months"))
    total = F.abs(F.col("total_actual") - F.col("total_pred"))
    return stats.withColumns({"total_error": total,
                              "normalized_total_error": total / (F.col("avg_vol") + F.lit(1e-8))})


def worst_series(errors: DataFrame, metric: str = "mae", top_k: int = 10, bucket: int | None = None) -> DataFrame:
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    require(errors, [metric], "errors")
    rows = errors if bucket is None else errors.where(F.col("bucket") == bucket)
    return rows.orderBy(F.col(metric).desc_nulls_last(), *SERIES).limit(top_k)


def errors_by_bucket(errors: DataFrame) -> DataFrame:
    """Moments and medians of the series errors per bucket and overall; the spread is the population one."""
    rows = errors.withColumn("scope", F.explode(F.filter(
        F.array(F.lit("overall"), F.concat(F.lit("bucket"), F.col("bucket").cast("string"))),
        lambda s: s.isNotNull())))
    moments = rows.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n_series"), F.avg("mae").alias("mean_mae"), F.stddev_pop("mae").alias("std_mae"),
        F.avg("rmse").alias("mean_rmse"), F.stddev_pop("rmse").alias("std_rmse"), F.avg("mape").alias("mean_mape"),
        F.max("mae").alias("max_mae"), F.avg("normalized_total_error").alias("mean_normalized_error"))
    mae = quantiles(rows, ["scope"], "mae", {"median_mae": 0.5})
    rmse = quantiles(rows, ["scope"], "rmse", {"median_rmse": 0.5})
    return moments.join(mae, "scope", "left").join(rmse, "scope", "left")


def errors_by_time_window(actual: DataFrame, pred: DataFrame, scenario) -> DataFrame:
    windows = REPORT_WINDOWS[scenario_number(scenario)]
    label = F.coalesce(*[F.when(F.col(MONTH).between(lo, hi), F.lit(n)) for n, lo, hi in windows])
    months = F.coalesce(*[F.when(F.col(MONTH).between(lo, hi), F.lit(f"{lo}-{hi}")) for _, lo, hi in windows])
    e = F.col("pred") - F.col("actual")
    return (matched(actual, pred).withColumns({"window": label, "months": months}).where("window IS NOT NULL")
            .groupBy("window", "months").agg(
                F.count(F.lit(1)).alias("n_rows"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                F.avg(e).alias("mean_error"), F.stddev_samp(e).alias("std_error")))


def systematic_bias(actual: DataFrame, pred: DataFrame) -> DataFrame:
    rows = matched(actual, pred).withColumn("error", F.col("pred") - F.col("actual"))
    e = F.col("error")
    middle = one_row(column_medians(rows, ["error"]))["error"]
    return rows.agg(
        F.avg(e).alias("mean_error"), (F.avg(flag(e > 0)) * 100).alias("pct_overprediction"),
        (F.avg(flag(e < 0)) * 100).alias("pct_underprediction"),
        (F.abs(F.avg(e)) / (F.avg("actual") + F.lit(1e-8))).alias("bias_magnitude"),
        F.count(F.lit(1)).alias("n_rows")).withColumn("median_error", middle)


def metric_by_group(actual: DataFrame, pred: DataFrame, aux: DataFrame, scenario, groups: DataFrame,
                    group: str) -> DataFrame:
    """Official metric and error moments per group of series; ``groups`` maps the series key to the group."""
    by_series = groups.select(*dict.fromkeys([*SERIES, group])).distinct()
    errors = series_errors(actual, pred, aux, scenario).join(by_series, SERIES, "inner")
    metric = errors.groupBy(group).agg(F.round(weighted_metric(), 4).alias("metric"))
    e = F.col("pred") - F.col("actual")
    rows = matched(actual, pred).join(by_series, SERIES).groupBy(group).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(e).alias("mean_error"), F.stddev_samp(e).alias("std_error"),
        F.avg(F.abs(e)).alias("mean_abs_error"))
    sizes = by_series.groupBy(group).agg(F.count(F.lit(1)).alias("n_series"))
    return sizes.join(rows, group).join(metric, group, "left")


def metric_by_ther_area(actual, pred, aux, panel, scenario) -> DataFrame:
    return metric_by_group(actual, pred, aux, scenario, panel, "ther_area")


def metric_by_country(actual, pred, aux, scenario) -> DataFrame:
    return metric_by_group(actual, pred, aux, scenario, actual.select(*SERIES), "country")


def evaluation_frame(actual: DataFrame, pred: DataFrame, aux: DataFrame, panel: DataFrame | None = None,
                     scenario: int | None = None) -> DataFrame:
    """Row-level errors with series id and, where a panel is given, its static columns."""
    rows = matched(actual, pred, aux).withColumnsRenamed({"actual": "y_true", "pred": "y_pred"})
    e = F.col("y_pred") - F.col("y_true")
    out = rows.withColumns({"error": e, "abs_error": F.abs(e), "pct_error": e / (F.col("y_true") + F.lit(1e-8)) * 100,
                            "series_id": F.concat_ws("_", *SERIES)})
    if scenario is not None:
        out = out.withColumn("scenario", F.lit(scenario_number(scenario)))
    if panel is not None:
        meta = [c for c in ("ther_area", "main_package", "biological") if c in panel.columns]
        out = out.join(panel.select(*SERIES, *meta).distinct(), SERIES, "left")
    return out


def per_series_records(errors: DataFrame, scenario, run_id: str, model: str = "unknown") -> DataFrame:
    """Per-series errors as long records; a value that is no finite number becomes null."""
    metrics = [m for m in ("mae", "rmse", "mape", "normalized_total_error") if m in errors.columns]
    long = errors.unpivot([*SERIES, "bucket"], metrics, "metric", "value")
    finite = F.when(~F.isnan("value") & (F.abs("value") != F.lit(float("inf"))), F.col("value"))
    return long.select(
        F.lit(run_id).alias("run_id"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.lit(scenario_number(scenario)).alias("scenario"), F.lit(model).alias("model"),
        F.concat_ws("_", *SERIES).alias("series_id"), *SERIES, "bucket", "metric", finite.alias("value"))


def diagnostic_metrics(pred: DataFrame, column: str = "volume") -> DataFrame:
    middle = one_row(column_medians(pred, [column]))[column]
    c = F.col(column)
    return pred.agg(
        F.avg(c).alias("pred_mean"), F.stddev_samp(c).alias("pred_std"), F.min(c).alias("pred_min"),
        F.max(c).alias("pred_max"), F.count(F.lit(1)).alias("pred_count"),
        F.sum(flag(c.isNull())).alias("pred_null_count")).withColumn("pred_median", middle)


def _shortfall(actual: DataFrame, pred: DataFrame) -> DataFrame:
    gap = F.col("actual") - F.col("pred")
    return matched(actual, pred).withColumns({"error": gap, "error_pct": gap / (F.col("actual") + F.lit(1e-6))})


def resilience(actual: DataFrame, pred: DataFrame, threshold: float = 0.0, critical: float = 0.1) -> DataFrame:
    """Per series: how often and how far the forecast falls short, and how long it takes to recover.

    Months of a series fit in one array of at most 48 entries, which gives the
    offset of the first uncritical month at or after the worst one.
    """
    pct = F.col("error_pct")
    # a shortfall in the last digits of a double is none
    under = (F.col("error") > threshold) & (F.coalesce(pct, F.lit(1.0)) > 1e-12)
    crit = pct > critical
    stats = _shortfall(actual, pred).groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n_months"), F.sum(flag(under)).alias("under_forecast_count"),
        F.coalesce(F.max(F.when(under, pct)), F.lit(0.0)).alias("max_under_forecast"),
        F.coalesce(F.avg(F.when(under, pct)), F.lit(0.0)).alias("avg_under_forecast"),
        F.sum(flag(crit)).alias("_critical"), F.max(pct).alias("_worst"),
        F.array_sort(F.collect_list(F.struct(MONTH, "error_pct"))).alias("_path"))
    n = F.col("n_months")
    worst_at = F.expr("array_position(transform(_path, x -> x.error_pct), _worst)").cast("int")
    after = F.expr("slice(_path, _at, n_months)")
    stats = stats.withColumn("_at", worst_at).withColumns({
        "_after": after, "under_forecast_pct": F.col("under_forecast_count") / n})
    first_ok = F.expr(f"array_position(transform(_after, x -> x.error_pct > {critical}), false)")
    recovery = F.when(F.col("max_under_forecast") > critical,
                      F.when(first_ok > 0, first_ok - 1).otherwise(F.size("_after"))).otherwise(0).cast("int")
    risk = 0.6 * F.col("under_forecast_pct") + 0.4 * (F.col("_critical") / n)
    scored = stats.withColumns({"recovery_time": recovery, "stock_out_risk_score": risk})
    score = 1.0 - (0.4 * F.col("under_forecast_pct") + 0.3 * F.least("max_under_forecast", F.lit(1.0))
                   + 0.2 * F.col("stock_out_risk_score")
                   + 0.1 * F.least(F.col("recovery_time") / 12, F.lit(1.0)))
    return scored.withColumn("resilience_score", clip(score, 0, 1)).select(
        *SERIES, "n_months", "under_forecast_count", "under_forecast_pct", "max_under_forecast", "avg_under_forecast",
        "stock_out_risk_score", "recovery_time", "resilience_score")


def resilience_overall(per_series: DataFrame) -> DataFrame:
    return per_series.agg(
        F.count(F.lit(1)).alias("total_series"), F.sum("under_forecast_count").alias("total_under_forecasts"),
        F.avg("under_forecast_pct").alias("avg_under_forecast_pct"),
        F.avg("stock_out_risk_score").alias("avg_stock_out_risk"),
        F.avg("resilience_score").alias("avg_resilience_score"), F.min("resilience_score").alias("min_resilience_score"),
        F.avg(flag(F.col("stock_out_risk_score") > 0.3)).alias("pct_high_risk_series"))


def under_forecast_patterns(actual: DataFrame, pred: DataFrame, threshold: float = 0.1) -> DataFrame:
    under, pct = flag(F.col("error_pct") > threshold), F.col("error_pct")
    return _shortfall(actual, pred).groupBy(MONTH).agg(
        F.sum(under).alias("under_forecast_count"), F.avg(under).alias("under_forecast_rate"),
        F.avg(pct).alias("mean_error_pct"), F.stddev_samp(pct).alias("std_error_pct"),
        F.max(pct).alias("max_error_pct"), F.avg("error").alias("mean_error"))


def high_risk_series(per_series: DataFrame, threshold: float = 0.3, top_n: int | None = None) -> DataFrame:
    rows = per_series.where(F.col("stock_out_risk_score") >= threshold).select(*SERIES, "stock_out_risk_score")
    if top_n is None:
        return rows
    return rows.orderBy(F.col("stock_out_risk_score").desc(), *SERIES).limit(top_n)


def forecast_bias(actual: DataFrame, pred: DataFrame) -> DataFrame:
    e = F.col("actual") - F.col("pred")
    under, over = F.avg(flag(e > 0)), F.avg(flag(e < 0))
    out = matched(actual, pred).agg(
        F.avg(e).alias("mean_error"), (F.avg(e) / (F.avg("actual") + F.lit(1e-6))).alias("mean_bias_ratio"),
        under.alias("pct_under_forecast"), over.alias("pct_over_forecast"), (1 - under - over).alias("pct_exact"))
    r = F.col("mean_bias_ratio")
    return out.withColumn("bias_direction", F.when(r > 0.01, "under").when(r < -0.01, "over")
                          .when(r.isNotNull(), "balanced").otherwise("unknown"))


def submission_statistics(submission: DataFrame) -> DataFrame:
    """One row: volume moments, series per scenario, zero and high counts."""
    marks = one_row(quantiles(submission, [], "volume", {"m": 0.5, "p99": 0.99}))
    series = submission.groupBy(*SERIES).agg(F.min(MONTH).alias("first")).agg(
        F.sum(flag(F.col("first") == 0)).alias("n_scenario1_series"),
        F.sum(flag(F.col("first") > 0)).alias("n_scenario2_series"))
    v = F.col("volume")
    out = submission.withColumn("_q", marks).agg(
        F.avg(v).alias("volume_mean"), F.stddev_samp(v).alias("volume_std"), F.min(v).alias("volume_min"),
        F.max(v).alias("volume_max"), F.max("_q.m").alias("volume_median"), F.count(F.lit(1)).alias("total_rows"),
        F.sum(flag(v == 0)).alias("n_zero_volume"), F.sum(flag(v > F.col("_q.p99"))).alias("n_high_volume"))
    s = one_row(series)
    return out.withColumn("_s", s).select(
        *out.columns, F.col("_s.n_scenario1_series").alias("n_scenario1_series"),
        F.col("_s.n_scenario2_series").alias("n_scenario2_series"),
        (F.col("_s.n_scenario1_series") + F.col("_s.n_scenario2_series")).alias("total_series"))


def volume_by_month(submission: DataFrame) -> DataFrame:
    return submission.groupBy(MONTH).agg(F.avg("volume").alias("volume_mean"))


def auxiliary_file(submission: DataFrame, panel: DataFrame) -> DataFrame:
    require(panel, [*SERIES, "avg_vol_12m", "bucket"], "panel")
    meta = panel.groupBy(*SERIES).agg(F.max("avg_vol_12m").alias("avg_vol"), F.max("bucket").alias("bucket"))
    return submission.select(*SERIES).distinct().join(meta, SERIES, "left")
