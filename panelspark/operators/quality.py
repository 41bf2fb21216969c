"""Data-quality and leakage checks. Each returns violations or statistics as a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.constants import MONTH, ROW_KEY, SERIES, VALUE_RANGES, scenario_window
from panelspark.functions.expr import flag, numeric_columns, one_row, ratio
from panelspark.functions.order_stats import quantiles


def _rows(df: DataFrame, names: list[str], build: Callable[[str], dict[str, Column]]) -> DataFrame:
    """Turn a one-row aggregate into one row per name."""
    return df.select(F.explode(F.array(*[
        F.struct(*[v.alias(k) for k, v in build(n).items()]) for n in names])).alias("r")).select("r.*")


def value_range_violations(df: DataFrame, ranges: dict | None = None) -> DataFrame:
    """Per column how many values lie below and above its range; nulls do not count."""
    known = {c: r for c, r in (ranges or VALUE_RANGES).items() if c in df.columns}
    aggs = []
    for c, (low, high) in known.items():
        aggs.append(F.struct(
            (F.sum(flag(F.col(c) < low)) if low is not None else F.lit(0)).cast("long").alias("below"),
            (F.sum(flag(F.col(c) > high)) if high is not None else F.lit(0)).cast("long").alias("above")).alias(c))
    return _rows(df.agg(*aggs), list(known), lambda c: {
        "column": F.lit(c), "below_min": F.col(c)["below"], "above_max": F.col(c)["above"]})


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1").withColumnRenamed("count", "n_rows")


def data_statistics(df: DataFrame) -> DataFrame:
    """One row per column: rows, null share, plus the series count and month range of the table."""
    total = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct(*SERIES)).alias("series"),
                   F.min(MONTH).alias("lo"), F.max(MONTH).alias("hi"),
                   *[F.avg(flag(F.col(c).isNull())).alias(f"m_{c}") for c in df.columns])
    return _rows(total, df.columns, lambda c: {
        "column": F.lit(c), "n_rows": F.col("n"), "n_series": F.col("series"), "min_month": F.col("lo"),
        "max_month": F.col("hi"), "missing_pct": F.col(f"m_{c}") * 100})


def future_leakage(panel: DataFrame, scenario, build: Callable[[DataFrame], DataFrame],
                   columns: list[str] | None = None) -> DataFrame:
    """Rows whose features change once the volume at and after the cutoff is hidden.

    ``build`` makes features from a panel. Rows are compared by key with a
    rounding that is far below any real difference.
    """
    cutoff, _, _ = scenario_window(scenario)
    hidden = panel.withColumn("volume", F.when(F.col(MONTH) < cutoff, F.col("volume")))
    whole, blind = build(panel), build(hidden)
    names = columns or [c for c in numeric_columns(whole)
                        if c not in (*ROW_KEY, "volume", "y_norm", "mean_erosion", "bucket")]
    def view(df):
        return df.select(*ROW_KEY, F.xxhash64(*[F.round(F.col(c).cast("double"), 6) for c in names]).alias("_h"))
    a, b = view(whole), view(blind)
    return a.join(b.withColumnRenamed("_h", "_h2"), ROW_KEY, "full").where(~F.col("_h").eqNullSafe(F.col("_h2"))).select(
        *ROW_KEY)


def feature_matrix_violations(df: DataFrame, features: list[str], target: str | None = "y_norm") -> DataFrame:
    """All-null feature columns, and a target whose count differs from the rows."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in [*features, *([target] if target else [])]])
    empties = _rows(counts, features, lambda c: {"check": F.lit("all_null"), "column": F.lit(c), "n": F.col(c),
                                                 "bad": (F.col(c) == 0)})
    if target:
        parity = counts.select(F.lit("target_missing").alias("check"), F.lit(target).alias("column"),
                               F.col(target).alias("n"), (F.col(target) < F.col("_rows")).alias("bad"))
        empties = empties.unionByName(parity)
    return empties.where("bad").drop("bad")


def date_continuity(panel: DataFrame, expected: tuple[int, int] | None = None) -> DataFrame:
    """Series with missing months, inside their own range or clipped to an expected one."""
    own = panel.groupBy(*SERIES).agg(F.min(MONTH).alias("min_month"), F.max(MONTH).alias("max_month"),
                                     F.collect_set(MONTH).alias("_have"))
    low, high = F.col("min_month"), F.col("max_month")
    short = F.lit(False)
    if expected is not None:
        lo, hi = expected
        short = (low > lo) | (high < hi)
        low, high = F.greatest(low, F.lit(lo)), F.least(high, F.lit(hi))
    wanted = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    gaps = own.withColumn("missing_months", F.array_sort(F.array_except(wanted, "_have")))
    return (gaps.withColumn("gap_count", F.size("missing_months")).where((F.col("gap_count") > 0) | short)
            .withColumn("actual_count", F.size("_have")).drop("_have"))


def month_coverage(panel: DataFrame) -> DataFrame:
    m = F.col(MONTH)
    out = panel.groupBy(*SERIES).agg(
        F.min(m).alias("min_month"), F.max(m).alias("max_month"),
        F.count_distinct(F.when(m.between(-12, -1), m)).alias("pre_entry_months"),
        F.count_distinct(F.when(m.between(0, 23), m)).alias("post_entry_months"),
        F.count_distinct(m).alias("total_months"))
    return out.withColumns({"has_full_pre_entry": flag(F.col("pre_entry_months") == 12),
                            "has_full_post_entry": flag(F.col("post_entry_months") == 24)})


def training_data_checks(train: DataFrame, val: DataFrame, min_train_rows: int = 100, min_val_rows: int = 20,
                         min_train_series: int = 3, min_val_series: int = 1) -> DataFrame:
    """Rows and series of both parts against their minimum."""
    def part(df, name, rows, series):
        counts = df.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n")).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("series"))
        return _rows(counts, ["rows", "series"], lambda c: {
            "check": F.lit(f"{name}_{c}"), "actual": F.col(c), "required": F.lit(rows if c == "rows" else series).cast("long"),
            "passed": flag(F.col(c) >= (rows if c == "rows" else series))})
    return part(train, "train", min_train_rows, min_train_series).unionByName(
        part(val, "val", min_val_rows, min_val_series))


def split_violations(original: DataFrame, train: DataFrame, val: DataFrame) -> DataFrame:
    """Series in both parts, lost from both, or not in the original.

    One grouped pass over the three key sets replaces several semi and anti joins.
    """
    def keys(df, name):
        return df.select(*SERIES, F.lit(name).alias("part"))
    seen = keys(original, "original").unionByName(keys(train, "train")).unionByName(keys(val, "val"))
    marks = seen.groupBy(*SERIES).agg(*[F.max(flag(F.col("part") == p)).alias(p) for p in ("original", "train", "val")])
    kind = (F.when((F.col("train") == 1) & (F.col("val") == 1), "overlap")
            .when((F.col("original") == 1) & (F.col("train") + F.col("val") == 0), "lost")
            .when(F.col("original") == 0, "added"))
    return marks.withColumn("violation", kind).where("violation IS NOT NULL").select(*SERIES, "violation")


def scenario_violations(train: DataFrame, val: DataFrame, scenario, allow_overlap: bool = False) -> DataFrame:
    """Named violations with their counts: shared series, months outside the scenario, shared rows."""
    _, low, high = scenario_window(scenario)
    span = val.agg(F.sum(flag(F.col(MONTH) < low)).alias("early"), F.sum(flag(F.col(MONTH) > high)).alias("late"))
    out = _rows(span, ["early", "late"], lambda c: {"violation": F.lit(f"months_too_{c}"),
                                                    "n": F.coalesce(F.col(c), F.lit(0)).cast("long")})
    if not allow_overlap:
        shared = train.select(*SERIES).distinct().join(val.select(*SERIES), SERIES, "left_semi")
        rows = train.select(*ROW_KEY).join(val.select(*ROW_KEY), ROW_KEY, "left_semi")
        for name, df in (("series_overlap", shared), ("row_overlap", rows)):
            out = out.unionByName(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("violation"), "n"))
    return out.where("n > 0")


def _key_counts(submission: DataFrame, template: DataFrame) -> DataFrame:
    s = submission.select(*ROW_KEY, F.lit(1).alias("s"), F.lit(0).alias("t"))
    t = template.select(*ROW_KEY, F.lit(0).alias("s"), F.lit(1).alias("t"))
    return s.unionByName(t).groupBy(*ROW_KEY).agg(F.sum("s").alias("s"), F.sum("t").alias("t"))


def submission_violations(submission: DataFrame, template: DataFrame) -> DataFrame:
    """Each format check with its count; a clean submission has only zeros."""
    keys = _key_counts(submission, template).agg(
        (F.sum("s") - F.sum("t")).alias("row_count_difference"),
        F.sum(flag(F.col("s") == 0)).alias("missing_keys"), F.sum(flag(F.col("t") == 0)).alias("extra_keys"),
        F.sum(F.greatest(F.col("s") - 1, F.lit(0))).alias("duplicate_keys"))
    v = F.col("volume")
    infinite = F.abs(v) == F.lit(float("inf"))
    values = submission.agg(
        F.sum(flag(v.isNull() | F.isnan(v))).alias("missing_volume"), F.sum(flag(v < 0)).alias("negative_volume"),
        F.sum(flag(infinite)).alias("infinite_volume"),
        F.sum(flag(~F.col(MONTH).between(0, 23))).alias("invalid_months"))
    out = None
    for df in (keys, values):
        part = _rows(df, df.columns, lambda c: {"check": F.lit(c), "n": F.col(c).cast("long")})
        out = part if out is None else out.unionByName(part)
    return out


def submission_completeness(submission: DataFrame, template: DataFrame) -> DataFrame:
    """Missing and extra keys, and how many series and months they touch."""
    counts = _key_counts(submission, template)
    missing, extra = F.col("s") == 0, F.col("t") == 0
    return counts.agg(
        F.sum(flag(missing)).alias("missing_rows"), F.sum(flag(extra)).alias("extra_rows"),
        F.count_distinct(F.when(missing, F.struct(*SERIES))).alias("missing_series"),
        F.concat_ws(",", F.transform(F.array_sort(F.collect_set(F.when(missing, F.col(MONTH)))),
                                     lambda x: x.cast("string"))).alias("missing_months")
    ).withColumn("is_complete", flag(F.col("missing_rows") == 0))


def prediction_sanity(pred: DataFrame, column: str = "volume") -> DataFrame:
    v = F.col(column)
    high = one_row(quantiles(pred, [], column, {"p": 0.99}))["p"] * 10
    monthly = pred.groupBy(MONTH).agg(F.avg(column).alias("m"))
    edges = one_row(monthly.agg(F.array_sort(F.collect_list(F.struct(MONTH, "m"))).alias("c")))
    stats = pred.withColumn("_high", high).agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        (F.avg(flag(v == 0)) * 100).alias("pct_zero"), (F.avg(flag(v < 0)) * 100).alias("pct_negative"),
        (F.avg(flag(v > F.col("_high"))) * 100).alias("pct_extreme"),
        F.sum(flag(v.isNull() | F.isnan(v))).alias("n_missing"))
    curve = stats.withColumn("_c", edges["c"])

    def mean_of(part: str) -> Column:
        return F.expr(f"aggregate({part}, 0D, (a, x) -> a + x.m) / nullif(size({part}), 0)")

    early = mean_of("filter(slice(_c, 1, 6), x -> x.m IS NOT NULL)")
    late = mean_of("filter(slice(_c, greatest(size(_c) - 5, 1), 6), x -> x.m IS NOT NULL)")
    return curve.withColumns({"early_mean": early, "late_mean": late}).withColumns({
        "is_sane": flag((F.col("pct_negative") == 0) & (F.col("n_missing") == 0)),
        "late_above_early": flag((F.size("_c") > 6) & (F.col("late_mean") > 1.5 * F.col("early_mean")))}).drop("_c")


def submission_checklist(submission: DataFrame, template: DataFrame) -> DataFrame:
    """Named pass/fail checks and a last row that sums them up."""
    complete = submission_completeness(submission, template)
    sane = prediction_sanity(submission)
    parts = [
        complete.select(F.lit("completeness").alias("check"), F.col("is_complete").alias("passed")),
        sane.select(F.lit("sanity").alias("check"), F.col("is_sane").alias("passed")),
        submission.sparkSession.range(1).select(
            F.lit("columns_match").alias("check"),
            F.lit(int(submission.columns == template.columns)).alias("passed")),
    ]
    checks = reduce(DataFrame.unionByName, parts)
    return checks.unionByName(checks.agg(F.lit("all_passed").alias("check"), F.min("passed").alias("passed")))


def inverse_transform_error(df: DataFrame, y: str = "y_norm", base: str = "avg_vol_12m",
                            volume: str = "volume") -> DataFrame:
    expected = F.col(y) * F.col(base)
    rel = F.abs(F.col(volume) - expected) / (F.abs(expected) + F.lit(1e-10))
    return df.agg(F.max(rel).alias("max_error"), F.avg(rel).alias("mean_error"))


def weights_correlation(df: DataFrame, weight: str = "weight", actual: str = "actual", pred: str = "pred") -> DataFrame:
    """Weighted and plain RMSE overall, by bucket and month window, and corr(weight, absolute error)."""
    w, e2 = F.col(weight), F.pow(F.col(actual) - F.col(pred), F.lit(2.0))

    def rmse(cond: Column | None = None) -> Column:
        def keep(x):
            return x if cond is None else F.when(cond, x)
        return F.sqrt(ratio(F.sum(keep(w * e2)), F.sum(keep(w))))

    m = F.col(MONTH)
    out = df.agg(
        F.count(F.lit(1)).alias("n_samples"), F.min(w).alias("weight_min"), F.max(w).alias("weight_max"),
        F.avg(w).alias("weight_mean"), F.stddev_samp(w).alias("weight_std"), rmse().alias("weighted_rmse"),
        F.sqrt(F.avg(e2)).alias("unweighted_rmse"),
        *[rmse(F.col("bucket") == b).alias(f"bucket{b}_weighted_rmse") for b in (1, 2)],
        *[rmse(m.between(lo, hi)).alias(f"window_{lo}_{hi}_weighted_rmse") for lo, hi in ((0, 5), (6, 11), (12, 23))],
        F.corr(w, F.sqrt(e2)).alias("weight_error_correlation"))
    c = F.col("weight_error_correlation")
    return out.withColumns({
        "rmse_ratio": F.col("weighted_rmse") / (F.col("unweighted_rmse") + F.lit(1e-8)),
        "interpretation": F.when(c < 0, "Good").when(F.abs(c) < 0.1, "Neutral").otherwise("Review weights")})
