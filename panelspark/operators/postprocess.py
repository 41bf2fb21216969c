"""Corrections of forecasts: fallbacks, clips, calibration, smoothing and bias."""

from __future__ import annotations

import sys
from collections.abc import Mapping

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.constants import CALIBRATION_WINDOWS, MONTH, RESIDUAL_WINDOWS, SERIES, require
from panelspark.functions.expr import clip, one_row, window_id
from panelspark.functions.order_stats import median, quantiles
from panelspark.functions.stage import stage
from panelspark.operators.panel import by_month

# the pooling of blocks runs in workers; it travels with its helpers
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def series_columns(panel: DataFrame, *columns: str) -> DataFrame:
    """One row per series; the columns are constant within a series."""
    return panel.groupBy(*SERIES).agg(*[F.max(c).alias(c) for c in columns])


def apply_edge_case_fallback(pred: DataFrame, panel: DataFrame, curve: DataFrame | None = None) -> DataFrame:
    """Series below the 5% level of avg_vol_12m or above the 95% level of volatility follow the median erosion curve.

    ``curve`` has one row per month (months_postgx, curve); by default the median
    y_norm of the other series. A month without a curve value keeps its forecast.
    """
    stats = stage(series_columns(panel, "avg_vol_12m", "pre_entry_volatility"))
    low = one_row(quantiles(stats, [], "avg_vol_12m", {"q": 0.05}))["q"]
    high = one_row(quantiles(stats, [], "pre_entry_volatility", {"q": 0.95}))["q"]
    edge = stage(stats.withColumns({"_low": low, "_high": high}).where(
        (F.col("avg_vol_12m") < F.col("_low")) | (F.col("pre_entry_volatility") > F.col("_high")))
        .select(*SERIES, F.col("avg_vol_12m").alias("_base")))
    if curve is None:
        normal = panel.join(edge.select(*SERIES), SERIES, "left_anti")
        curve = stage(median(normal, [MONTH], "y_norm", "curve"))
    out = pred.join(edge, SERIES, "left").join(curve.select(MONTH, F.col("curve").alias("_curve")), MONTH, "left")
    return out.withColumn("volume", F.coalesce(F.col("_curve") * F.col("_base"), F.col("volume"))).select(*pred.columns)


def handle_zero_volume_series(pred: DataFrame, panel: DataFrame, strategy: str = "global_erosion") -> DataFrame:
    """Series with avg_vol_12m = 0 get a small decaying share of the median volume, or 1."""
    zero = series_columns(panel, "avg_vol_12m").where(F.col("avg_vol_12m") == 0).select(*SERIES, F.lit(1).alias("_zero"))
    out = pred.join(zero, SERIES, "left")
    if strategy == "global_erosion":
        middle = median(panel.where(F.col("avg_vol_12m") > 0), [], "avg_vol_12m", "_m").agg(
            F.coalesce(F.max("_m"), F.lit(1000.0)).alias("_m"))
        level = one_row(middle)["_m"] * F.greatest(F.lit(0.01), 0.1 * (1 - 0.02 * F.col(MONTH)))
    elif strategy == "small_constant":
        level = F.lit(1.0)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return out.withColumn("volume", F.when(F.col("_zero") == 1, level).otherwise(F.col("volume"))).select(*pred.columns)


def handle_extreme_predictions(pred: DataFrame, panel: DataFrame, max_ratio: float = 2.0,
                               min_ratio: float = 0.0) -> DataFrame:
    """Clip each forecast to [min, max] x avg_vol_12m of its series; unknown series stay as they are."""
    out = pred.join(series_columns(panel, "avg_vol_12m"), SERIES, "left")
    base = F.col("avg_vol_12m")
    return out.withColumn("volume", clip(F.col("volume"), base * min_ratio, base * max_ratio)).select(*pred.columns)


def time_window(scenario: Column, windows: Mapping = CALIBRATION_WINDOWS) -> Column:
    return F.when(scenario == 1, window_id(windows[1])).when(scenario == 2, window_id(windows[2]))


CALIBRATION_KEYS = ["scenario", "bucket", "time_window"]


def fit_grouped_calibration(val: DataFrame, min_rows: int = 5) -> DataFrame:
    """Linear fit volume_true ~ volume_pred per scenario, bucket and month window: at most 12 rows."""
    require(val, ["scenario", "bucket", MONTH, "volume_true", "volume_pred"], "validation frame")
    rows = val.withColumn("time_window", time_window(F.col("scenario"))).dropna(subset=CALIBRATION_KEYS)
    slope = F.coalesce(F.regr_slope("volume_true", "volume_pred"), F.lit(0.0))
    fit = rows.groupBy(*CALIBRATION_KEYS).agg(
        slope.alias("a"), (F.avg("volume_true") - slope * F.avg("volume_pred")).alias("b"),
        F.count(F.lit(1)).alias("n_samples"))
    return stage(fit.where(F.col("n_samples") >= min_rows))


def apply_calibration(pred: DataFrame, params: DataFrame) -> DataFrame:
    """a x volume + b by group, floored at 0; a group without parameters keeps its volume."""
    rows = pred.withColumn("time_window", time_window(F.col("scenario")))
    out = rows.join(params.select(*CALIBRATION_KEYS, "a", "b"), CALIBRATION_KEYS, "left")
    fitted = F.coalesce(F.col("a") * F.col("volume") + F.col("b"), F.col("volume"))
    return out.withColumn("volume", F.greatest(fitted, F.lit(0.0))).select(*pred.columns)


# ---- isotonic calibration: pool adjacent violators as blocks that merge

BLOCKS = f"{', '.join(f'{k} int' for k in CALIBRATION_KEYS)}, lo double, hi double, total double, n long"
SEGMENTS = 16


def pooled(lo, hi, total, n) -> list[list]:
    """Blocks (lo, hi, total, n) in order, merged until their means rise; merging merged blocks gives the same as merging all."""
    out: list[list] = []
    for a, b, t, c in zip(lo, hi, total, n):
        block = [a, b, t, c]
        while out and out[-1][2] * block[3] >= block[2] * out[-1][3]:
            last = out.pop()
            block = [last[0], block[1], last[2] + block[2], last[3] + block[3]]
        out.append(block)
    return out


def _pool_batch(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("lo")
    blocks = pooled(*(rows[c].tolist() for c in ("lo", "hi", "total", "n")))
    out = pd.DataFrame(blocks, columns=["lo", "hi", "total", "n"])
    for k in CALIBRATION_KEYS:
        out.insert(0, k, rows[k].iloc[0])
    return out[[*CALIBRATION_KEYS, "lo", "hi", "total", "n"]]


def fit_isotonic_calibration(val: DataFrame, min_rows: int = 5) -> DataFrame:
    """Isotonic fit of volume_true over volume_pred per scenario, bucket and month window: (keys, lo, hi, fit), a row per block.

    All groups are fitted together. Equal predictions are one point. Points are
    dealt by ranges of (group, prediction), and every range pools its violators
    by itself. What is left meets across ranges only where it can: the first
    mean of any range behind bounds what may still come from there, the last
    mean of any range before what may come from the other side, and blocks
    between the two are final and part the others into runs that are pooled on
    their own. Nothing comes to the driver.
    """
    keys = CALIBRATION_KEYS
    rows = val.withColumn("time_window", time_window(F.col("scenario"))).dropna(subset=keys).dropna(subset=["volume_true", "volume_pred"])
    rows = rows.select(*[F.col(k).cast("int").alias(k) for k in keys], F.col("volume_pred").cast("double").alias("lo"), F.col("volume_true").cast("double").alias("y"))
    points = rows.groupBy(*keys, "lo").agg(F.sum("y").alias("total"), F.count("*").alias("n"))
    order = [*keys, "lo"]
    ranged = points.select(*keys, "lo", F.col("lo").alias("hi"), "total", "n").repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    # a group's rows of one range are one group of the task
    blocks = stage(ranged.groupBy(*keys, "part").applyInPandas(
        lambda key, rows: _pool_batch(rows).assign(part=key[-1]), BLOCKS + ", part int"))
    blocks = blocks.withColumn("mean", F.col("total") / F.col("n"))
    # a row per group and range
    ends = blocks.groupBy(*keys, "part").agg(F.min_by("mean", "lo").alias("first"), F.max_by("mean", "lo").alias("last"))
    along = Window.partitionBy(*keys).orderBy("part")
    inf = F.lit(float("inf"))
    ends = ends.select(*keys, "part", F.coalesce(F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1)), -inf).alias("below"),
                       F.coalesce(F.min("first").over(along.rowsBetween(1, Window.unboundedFollowing)), inf).alias("above"))
    judged = blocks.join(stage(ends), [*keys, "part"]).withColumn("final", F.col("mean").between(F.col("below"), F.col("above")))
    # runs of open blocks lie between final ones; counted per range first, so that no window holds a group
    within = Window.partitionBy(*keys, "part").orderBy("lo").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    judged = stage(judged.withColumn("seen", F.sum(F.col("final").cast("long")).over(within)))
    passed = judged.groupBy(*keys, "part").agg(F.sum(F.col("final").cast("long")).alias("n_final"))
    passed = passed.select(*keys, "part", F.coalesce(F.sum("n_final").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("passed"))
    open_ = judged.where("NOT final").join(passed, [*keys, "part"]).withColumn("run", F.col("passed") + F.col("seen"))
    merged = open_.groupBy(*keys, "run").applyInPandas(lambda key, rows: _pool_batch(rows), BLOCKS)
    fit = judged.where("final").select(*keys, "lo", "hi", "total", "n").unionByName(merged)
    enough = blocks.groupBy(*keys).agg(F.sum("n").alias("rows")).where(F.col("rows") >= min_rows).select(*keys)
    return stage(fit.join(enough, keys).select(*keys, "lo", "hi", (F.col("total") / F.col("n")).alias("fit")))


def apply_isotonic_calibration(pred: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each volume through its group's fit, floored at 0; between blocks the line that joins them, outside the outer values.

    Rows of groups without a fit, and rows without a volume, keep it. Rows and
    blocks of a group meet in SEGMENTS pieces, whose bounds are quantiles of the
    blocks and whose neighbouring blocks are known.
    """
    keys = CALIBRATION_KEYS
    # the ends of the blocks are the knots of the line
    knots = blocks.select(*keys, F.explode(F.array(F.struct(F.col("lo").alias("x"), "fit"), F.struct(F.col("hi").alias("x"), "fit"))).alias("k")).select(*keys, "k.*").distinct()
    marks = {f"q{i}": i / SEGMENTS for i in range(1, SEGMENTS)}
    cuts = stage(quantiles(knots, keys, "x", marks).select(*keys, F.array(*marks).alias("cuts")))

    def segment(df, how):
        return df.join(cuts, keys, how).withColumn("segment", F.size(F.filter("cuts", lambda c: c < F.col("x"))))

    placed = stage(segment(knots, "inner").drop("cuts"))
    ends = placed.groupBy(*keys, "segment").agg(F.min(F.struct("x", "fit")).alias("low"), F.max(F.struct("x", "fit")).alias("high"))
    every = blocks.select(*keys).distinct().withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))))
    along = Window.partitionBy(*keys).orderBy("segment")  # SEGMENTS rows per group
    near = every.join(ends, [*keys, "segment"], "left").select(
        *keys, "segment", F.last("high", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("low", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    fields = [f.name for f in pred.schema.fields]
    rows = pred.select(F.struct(*[F.col(f"`{c}`") for c in fields]).alias("row"), F.col("scenario").cast("int").alias("scenario"), F.col("bucket").cast("int").alias("bucket"),
                       time_window(F.col("scenario")).cast("int").alias("time_window"), F.col("volume").cast("double").alias("x"))
    rows = segment(rows, "left")
    same = rows.where("cuts IS NULL OR x IS NULL").select("row.*")
    rows = rows.where("cuts IS NOT NULL AND x IS NOT NULL").drop("cuts").withColumn("fit", F.lit(None).cast("double"))
    both = rows.unionByName(placed.withColumn("row", F.lit(None).cast(rows.schema["row"].dataType)))
    at, piece = (Window.unboundedPreceding, Window.currentRow), Window.partitionBy(*keys, "segment")
    knot = F.when(F.col("row").isNull(), F.struct("x", "fit"))
    # both sides run forward: Spark goes through a frame up to the end anew for every row
    both = both.withColumn("left", F.last(knot, ignorenulls=True).over(piece.orderBy("x").rangeBetween(*at))).withColumn(
        "right", F.last(knot, ignorenulls=True).over(piece.orderBy(F.col("x").desc()).rangeBetween(*at)))
    both = both.where(F.col("row").isNotNull()).join(near, [*keys, "segment"], "left")
    left, right, x = F.coalesce("left", "before"), F.coalesce("right", "after"), F.col("x")
    line = left["fit"] + (right["fit"] - left["fit"]) * F.try_divide(x - left["x"], right["x"] - left["x"])
    fitted = (F.when(left.isNull(), right["fit"]).when(right.isNull(), left["fit"]).when(left["x"] == x, left["fit"]).when(right["x"] == x, right["fit"]).otherwise(line))
    volume = F.greatest(fitted, F.lit(0.0))
    return both.select(*[volume.alias("volume") if c == "volume" else F.col("row")[c].alias(c) for c in fields]).unionByName(same)


def smooth_predictions(pred: DataFrame, method: str = "rolling_median", window: int = 3,
                       clip_negative: bool = True) -> DataFrame:
    """Centred rolling median or mean along each series; a gap takes the next, then the previous value."""
    half = window // 2
    frame = by_month().rowsBetween(-half, window - 1 - half)
    if method == "rolling_median":
        smoothed = F.expr("percentile(volume, 0.5)").over(frame)
    elif method == "rolling_mean":
        smoothed = F.avg("volume").over(frame)
    else:
        smoothed = F.col("volume")
    out = pred.withColumn("_s", smoothed)
    ahead = by_month().rowsBetween(Window.currentRow, Window.unboundedFollowing)
    past = by_month().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = F.coalesce(F.first("_s", ignorenulls=True).over(ahead), F.last("_s", ignorenulls=True).over(past),
                       F.lit(0.0))
    if clip_negative:
        value = F.greatest(value, F.lit(0.0))
    return out.withColumn("volume", value).drop("_s")


def fit_bias_corrections(val: DataFrame, group_cols=("ther_area", "country"), method: str = "mean_error",
                         min_samples: int = 5) -> DataFrame:
    """Mean or median of volume_true - volume_pred per group with enough rows."""
    groups = [c for c in group_cols if c in val.columns]
    rows = val.withColumn("_e", F.col("volume_true") - F.col("volume_pred")).dropna(subset=groups)
    sizes = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_samples"), F.avg("_e").alias("bias"))
    if method == "median_error":
        sizes = sizes.drop("bias").join(median(rows, groups, "_e", "bias"), groups)
    elif method != "mean_error":
        raise ValueError(f"unknown bias method {method!r}")
    return stage(sizes.where(F.col("n_samples") >= min_samples))


def apply_bias_corrections(pred: DataFrame, biases: DataFrame) -> DataFrame:
    groups = [c for c in biases.columns if c not in ("bias", "n_samples")]
    out = pred.join(biases.select(*groups, "bias"), groups, "left")
    fixed = F.greatest(F.col("volume") + F.coalesce("bias", F.lit(0.0)), F.lit(0.0))
    return out.withColumn("volume", fixed).select(*pred.columns)


def residual_rows(buckets=(1,), windows: Mapping = RESIDUAL_WINDOWS) -> Column:
    """Rows the residual model speaks for."""
    return F.coalesce(F.col("bucket").isin(list(buckets)) & time_window(F.col("scenario"), windows).isNotNull(), F.lit(False))


def apply_residual_correction(pred: DataFrame, residual_col: str, buckets=(1,),
                              windows: Mapping = RESIDUAL_WINDOWS) -> DataFrame:
    """Add the predicted residual where the residual model speaks, floored at 0."""
    moved = F.col("volume") + F.when(residual_rows(buckets, windows), F.col(residual_col)).otherwise(0.0)
    return pred.withColumn("volume", F.greatest(moved, F.lit(0.0)))
