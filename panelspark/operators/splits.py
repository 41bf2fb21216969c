"""Series-level splits and folds as tag columns, and fold statistics.

Draws are ranks of md5(seed|series key), so a split repeats in any engine. Ranks
are counted over hash prefixes: a stratum that holds most series is still
ranked by many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.constants import MONTH, SERIES
from panelspark.functions.expr import flag, one_row, ratio
from panelspark.functions.order_stats import hash_bucket, order_hash, spread_rank
from panelspark.functions.stage import stage


def series_table(panel: DataFrame, columns: list[str]) -> DataFrame:
    """One row per series with the given columns (smallest value where a series has several)."""
    return panel.groupBy(*SERIES).agg(*[F.min(c).alias(c) for c in columns])


def stratum(columns: list[str]) -> Column:
    if not columns:
        return F.lit("all")
    return F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns])


def ranked_series(series: DataFrame, seed, group: str = "_stratum", out: str = "_place") -> DataFrame:
    hashed = series.withColumn("_h", order_hash(seed, *[F.col(k) for k in SERIES]))
    order = [F.col("_h"), *[F.col(k) for k in SERIES]]
    return spread_rank(hashed, group, order, hash_bucket(F.col("_h")), out).drop("_h")


def series_split(panel: DataFrame, val_fraction: float = 0.2, stratify_by=("bucket",), seed: int = 42) -> DataFrame:
    """One row per series with ``split`` 'train' or 'val'; rare strata are drawn together as OTHER.

    A stratum is rare below max(3, half the validation share of all series).
    """
    by = [stratify_by] if isinstance(stratify_by, str) else list(stratify_by or [])
    series = series_table(panel, by).withColumn("_stratum", stratum(by))
    sizes = series.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_n"))
    total = one_row(sizes.agg(F.sum("_n").alias("t")))["t"]
    rare = F.col("_n") < F.greatest(F.lit(3), F.floor(total * val_fraction * 0.5))
    named = sizes.withColumn("_name", F.when(rare, F.lit("OTHER")).otherwise(F.col("_stratum")))
    groups = named.groupBy("_name").agg(F.sum("_n").alias("_size"))
    lookup = stage(named.join(groups, "_name").select("_stratum", "_name", "_size"))
    tagged = series.join(lookup, "_stratum").drop("_stratum")
    ranked = ranked_series(tagged, seed, "_name")
    return ranked.select(*SERIES, F.when(F.col("_place") <= F.round(F.col("_size") * val_fraction), "val")
                         .otherwise("train").alias("split"))


def tag(panel: DataFrame, series: DataFrame) -> DataFrame:
    """Carry series-level tags to the rows."""
    return panel.join(series, SERIES)


def validation_split(panel: DataFrame, val_fraction: float = 0.2, stratify_by=("bucket",), seed: int = 42) -> DataFrame:
    return tag(panel, series_split(panel, val_fraction, stratify_by, seed))


def holdout_set(panel: DataFrame, holdout_fraction: float = 0.1, stratify_by=("bucket",), seed: int = 42) -> DataFrame:
    return validation_split(panel, holdout_fraction, stratify_by, seed)


def fold_series(panel: DataFrame, n_folds: int = 5, stratify_by: str | None = "bucket", seed: int = 42,
                out: str = "fold") -> DataFrame:
    """One row per series with its stratified fold."""
    by = [stratify_by] if stratify_by and stratify_by in panel.columns else []
    series = series_table(panel, by).withColumn("_stratum", stratum(by))
    return ranked_series(series, seed).select(*SERIES, ((F.col("_place") - 1) % n_folds).cast("int").alias(out))


def grouped_folds(panel: DataFrame, n_folds: int = 5, group_by: str = "ther_area") -> DataFrame:
    """One row per series; all series of a group share a fold, groups dealt out by size, back and forth.

    The group table is one row per area; dealing in alternating direction keeps
    the folds balanced without a sequential pass.
    """
    if group_by not in panel.columns:
        return fold_series(panel, n_folds)
    series = series_table(panel, [group_by])
    sizes = series.groupBy(group_by).agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(0))
    # larger groups first: the bucket falls as the size grows, so it rises along the order
    bucket = -F.floor(F.log2(F.col("_n")) * 16)
    ranked = spread_rank(sizes, "_all", [F.col("_n").desc(), F.col(group_by)], bucket, "_place")
    at = F.col("_place") - 1
    k = F.least(F.lit(n_folds).cast("long"), F.col("_groups"))
    turn, pos = F.floor(at / k), at % k
    folds = ranked.withColumn("_groups", one_row(sizes.agg(F.count(F.lit(1)).alias("g")))["g"]).withColumn(
        "fold", F.when(turn % 2 == 0, pos).otherwise(k - 1 - pos).cast("int"))
    return series.join(stage(folds.select(group_by, "fold")), group_by).select(*SERIES, group_by, "fold")


def temporal_cutoffs(months: list[int], n_folds: int = 5, min_train_months: int = 12) -> list[int]:
    """Cutoffs spread evenly over the sorted post-event months."""
    post = sorted(m for m in months if m >= 0)
    if not post:
        return []
    folds = max(1, min(n_folds, len(post)))
    places = [math.floor(i * (len(post) - 1) / folds) for i in range(folds + 1)][1:-1]
    cutoffs = [max(post[i], max(min_train_months, 0)) for i in places]
    if len(cutoffs) < folds - 1:
        cutoffs.append(max(months) - 1)
    return cutoffs


def temporal_cv(panel: DataFrame, n_folds: int = 5, min_train_months: int = 12, gap_months: int = 0) -> DataFrame:
    """Rows per fold with ``part``: train up to cutoff - gap, validation after the cutoff, series with train rows only.

    The months of a panel are a set of at most 48 integers, so the cutoffs are
    worked out on the driver and laid on the rows as a literal array.
    """
    months = [r[0] for r in panel.select(MONTH).distinct().collect()]
    cutoffs = temporal_cutoffs(months, n_folds, min_train_months)
    grid = F.array(*[F.struct(F.lit(i).alias("fold"), F.lit(c).alias("cutoff")) for i, c in enumerate(cutoffs)])
    first = F.min(MONTH).over(Window.partitionBy(*SERIES))
    rows = panel.withColumn("_first", first).withColumn("_f", F.explode(grid)).select(
        *panel.columns, "_first", "_f.fold", "_f.cutoff")
    train = F.col(MONTH) <= F.col("cutoff") - gap_months
    val = (F.col(MONTH) > F.col("cutoff")) & (F.col("_first") <= F.col("cutoff") - gap_months)
    return rows.withColumn("part", F.when(train, "train").when(val, "val")).where("part IS NOT NULL").drop("_first")


def purged_cv(panel: DataFrame, n_folds: int = 5, gap_months: int = 3, min_train_months: int = -6,
              stratify_by: str | None = "bucket", seed: int = 42, target_from: int = 0, min_train_rows: int = 100,
              min_val_rows: int = 50) -> DataFrame:
    """Series folds with a purge in time: training months end ``gap_months`` before the fold's first validation month.

    Validation holds the target months only. Folds that are too small are left out.
    """
    tagged = tag(panel, fold_series(panel, n_folds, stratify_by, seed, "_own"))
    folds = F.array(*[F.lit(i) for i in range(n_folds)])
    first = stage(tagged.where(F.col(MONTH) >= target_from).groupBy(F.col("_own").alias("fold"))
                  .agg(F.min(MONTH).alias("_start")))
    rows = tagged.withColumn("fold", F.explode(folds)).join(first, "fold")
    m = F.col(MONTH)
    val = (F.col("_own") == F.col("fold")) & (m >= target_from)
    train = (F.col("_own") != F.col("fold")) & m.between(F.lit(min_train_months), F.col("_start") - gap_months)
    parts = rows.withColumn("part", F.when(val, "val").when(train, "train")).where("part IS NOT NULL").drop("_own", "_start")
    sizes = stage(parts.groupBy("fold").agg(F.sum(flag(F.col("part") == "train")).alias("_t"),
                                            F.sum(flag(F.col("part") == "val")).alias("_v")))
    kept = sizes.where((F.col("_t") >= min_train_rows) & (F.col("_v") >= min_val_rows)).select("fold")
    return parts.join(kept, "fold")


def nested_cv(panel: DataFrame, outer_folds: int = 5, inner_folds: int = 3, stratify_by: str = "bucket",
              seed: int = 42) -> DataFrame:
    """One row per series and outer fold: 'val', or the inner fold of its training part.

    Inner folds are ranked within (outer fold, stratum) with a seed of their own.
    """
    outer = fold_series(panel, outer_folds, stratify_by, seed, "_own")
    base = series_table(panel, [stratify_by]).join(outer, SERIES)
    spread = base.withColumn("outer_fold", F.explode(F.array(*[F.lit(i) for i in range(outer_folds)])))
    val = spread.where(F.col("_own") == F.col("outer_fold")).select(*SERIES, "outer_fold", F.lit("val").alias("part"),
                                                                   F.lit(None).cast("int").alias("inner_fold"))
    train = spread.where(F.col("_own") != F.col("outer_fold")).withColumns({
        "_stratum": F.concat_ws("|", F.col("outer_fold").cast("string"), stratum([stratify_by])),
        "_h": order_hash(seed, "inner", F.col("outer_fold").cast("string"), *[F.col(k) for k in SERIES])})
    ranked = spread_rank(train, "_stratum", [F.col("_h"), *[F.col(k) for k in SERIES]], hash_bucket(F.col("_h")), "_place")
    inner = ranked.select(*SERIES, "outer_fold", F.lit("train").alias("part"),
                          ((F.col("_place") - 1) % inner_folds).cast("int").alias("inner_fold"))
    return val.unionByName(inner)


# --- fold statistics ----------------------------------------------------------------------------

# Two-sided 95% quantiles of Student's t for 1 to 30 degrees of freedom.
T_95 = [12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139,
        2.200985, 2.178813, 2.160369, 2.144787, 2.131450, 2.119905, 2.109816, 2.100922, 2.093024, 2.085963,
        2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.051831, 2.048407, 2.045230, 2.042272]
Z_95 = 1.959964


def t_quantile(df: Column) -> Column:
    """95% quantile by degrees of freedom; above 30 a second-order expansion around the normal one."""
    z = Z_95
    tail = F.lit(z) + F.lit((z ** 3 + z) / 4) / df + F.lit((5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96) / (df * df)
    table = F.array(*[F.lit(x) for x in T_95])
    return F.when(df <= len(T_95), F.element_at(table, F.greatest(df, F.lit(1)).cast("int"))).otherwise(tail)


def aggregate_scores(scores: DataFrame, by=("metric",), value: str = "value") -> DataFrame:
    """Mean, sample deviation, t-interval, extremes and count per metric; null and NaN scores are left out."""
    rows = scores.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    stats = rows.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n_folds"))
    half = F.when(F.col("n_folds") > 1, t_quantile(F.col("n_folds") - 1) * F.col("std") / F.sqrt("n_folds")).otherwise(0.0)
    return stats.withColumns({"ci_lower": F.col("mean") - half, "ci_upper": F.col("mean") + half})


def comparison_table(scores: DataFrame, primary: str, ascending: bool = True, additional_metrics=()) -> DataFrame:
    """Models ranked by their mean primary metric; the best one is flagged. One row per model.

    ``additional_metrics`` add {metric}_mean and {metric}_std, null where a model
    has no such score.
    """
    wanted = list(dict.fromkeys([primary, *additional_metrics]))
    every = aggregate_scores(scores.where(F.col("metric").isin(wanted)), ["model", "metric"])
    more = [F.max(F.when(F.col("metric") == m, F.col(k))).alias(f"{m}_{k}") for m in additional_metrics for k in ("mean", "std")]
    own = [F.max(F.when(F.col("metric") == primary, F.col(k))).alias(k) for k in ("mean", "std", "min", "max", "n_folds", "ci_lower", "ci_upper")]
    table = every.groupBy("model").agg(*own, *more)
    table = stage(table.withColumns({"n_folds": F.coalesce("n_folds", F.lit(0).cast("long")), "_all": F.lit(0)}))
    order = F.col("mean").asc_nulls_last() if ascending else F.col("mean").desc_nulls_last()
    bucket = F.lit(0)
    ranked = spread_rank(table, "_all", [order, F.col("model")], bucket, "rank").drop("_all")
    return ranked.withColumn("is_best", flag((F.col("rank") == 1) & F.col("mean").isNotNull()))


def paired_t_test(scores: DataFrame, a: str, b: str, metric: str, alpha: float = 0.05) -> DataFrame:
    """t statistic, mean difference and interval at 1 - ``alpha`` of paired fold scores of two models; pairs with a gap are left out.

    Fewer than two pairs give nulls and no significance.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")

    def of(model, name):
        return scores.where((F.col("model") == model) & (F.col("metric") == metric)).select("fold", F.col("value").alias(name))
    d = F.col("_a") - F.col("_b")
    stats = of(a, "_a").join(of(b, "_b"), "fold").where(d.isNotNull() & ~F.isnan(d)).agg(
        F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("_sd"), F.count(F.lit(1)).alias("n_valid_pairs"))
    err = F.col("_sd") / F.sqrt("n_valid_pairs")
    t = ratio(F.col("mean_diff"), err)
    df = F.col("n_valid_pairs") - 1
    q = t_quantile(df) if alpha == 0.05 else F.when(df > 0, t_quantile_at(df, alpha))
    return stats.withColumns({
        "t_statistic": t, "ci_diff_lower": F.col("mean_diff") - q * err, "ci_diff_upper": F.col("mean_diff") + q * err,
        "p_value": p_value(t, df), "is_significant": flag(F.abs(t) > q)}).drop("_sd")


def t_quantile_at(df: Column, alpha: float, steps: int = 2000, halvings: int = 40) -> Column:
    """The value that a |t| with ``df`` degrees of freedom exceeds with probability alpha.

    With x = sqrt(df) tan(a) the density becomes cos(a)^(df - 1); the angle is
    found by halving on its integral.
    """
    half = F.lit(math.pi / 2)

    def integral(top: Column) -> Column:
        step = top / steps
        return step * F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0),
                                  lambda acc, i: acc + F.pow(F.cos((i - 0.5) * step), df - 1))
    goal = (1 - alpha) * integral(half)

    def halve(state, i):
        middle = (state["lo"] + state["hi"]) / 2
        return F.when(integral(middle) < goal, F.struct(middle.alias("lo"), state["hi"].alias("hi"))).otherwise(
            F.struct(state["lo"].alias("lo"), middle.alias("hi")))

    start = F.struct(F.lit(0.0).alias("lo"), half.alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), start, halve)
    return F.sqrt(df) * F.tan((found["lo"] + found["hi"]) / 2)


def p_value(t: Column, df: Column, steps: int = 2000) -> Column:
    """Two-sided p-value of Student's t; null where t is.

    With x = sqrt(df) tan(a) the density becomes cos(a)^(df - 1), so the p-value
    is one minus the ratio of two integrals over an angle, taken by midpoints.
    """
    def integral(top: Column) -> Column:
        step = top / steps
        return step * F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0),
                                  lambda acc, i: acc + F.pow(F.cos((i - 0.5) * step), df - 1))
    angle = F.atan(F.abs(t) / F.sqrt(df))
    return F.when(t.isNotNull(), F.greatest(1 - integral(angle) / integral(F.lit(math.pi / 2)), F.lit(0.0)))
