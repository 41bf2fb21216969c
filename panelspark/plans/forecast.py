"""From a test panel to a submission."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.constants import BUCKET_THRESHOLD, MONTH, ROW_KEY, SERIES, scenario_window
from panelspark.functions.expr import clip, steady_avg
from panelspark.functions.stage import stage
from panelspark.operators import features as E
from panelspark.operators import models as I
from panelspark.operators import panel as P
from panelspark.operators import postprocess as K


#: Bucket models of a scenario under their bucket; the model under BASE tells the bucket of series that have none.
BASE = 0


def _featured(panel: DataFrame, scenario, codes: DataFrame | None) -> DataFrame:
    _, low, high = scenario_window(scenario)
    features = E.make_features(P.expand_panel(panel, low, high), scenario, "test", codes=codes)
    return features.where(F.col(MONTH).between(low, high))


def with_bucket(scored: DataFrame, known: DataFrame | None, threshold: float = BUCKET_THRESHOLD) -> DataFrame:
    """``scored`` with the bucket of each series: the known one, else by its forecast mean share, as the bucket is defined."""
    by_forecast = scored.groupBy(*SERIES).agg(F.when(steady_avg(F.col("prediction")) <= threshold, 1).otherwise(2).alias("_forecast"))
    out = scored.drop("bucket").join(by_forecast, SERIES)
    if known is not None:
        out = out.join(known.select(*SERIES, F.col("bucket").alias("_known")), SERIES, "left")
        return out.withColumn("bucket", F.coalesce("_known", "_forecast")).drop("_known", "_forecast")
    return out.withColumnRenamed("_forecast", "bucket")


def scenario_forecast(model: I.FittedModel | Mapping[int, I.FittedModel], panel: DataFrame, scenario, residual: I.FittedModel | None = None,
                      residual_buckets=(1,)) -> DataFrame:
    """Forecast the target months of all series of one scenario, with the category codes of the model: (row key, bucket, volume).

    A mapping holds one model per bucket. The bucket of a series is the panel's
    where it has one, else what the forecast of the base model (BASE, or the
    default bucket's) says. ``residual`` corrects the rows it speaks for.
    """
    models = model if isinstance(model, Mapping) else {BASE: model}
    base = models.get(BASE) or models.get(2) or next(iter(models.values()))
    rows = stage(_featured(panel, scenario, base.codes))
    known = panel.where(F.col("bucket").isNotNull()).groupBy(*SERIES).agg(F.max("bucket").alias("bucket")) if "bucket" in panel.columns else None
    scored = with_bucket(stage(I.predict(base, rows)), known)
    routed = {b: m for b, m in models.items() if b != BASE}
    if routed:
        scored = I.route_by_bucket(routed, scored.drop("prediction"))
    volume = scored.withColumn("volume", F.greatest(F.col("prediction") * F.col("avg_vol_12m"), F.lit(0.0))).withColumn("scenario", F.lit(int(scenario)))
    if residual is not None:
        moved = residual.transform(volume.withColumn("volume_pred", F.col("volume")).withColumnRenamed("prediction", "_share"))
        volume = K.apply_residual_correction(moved, "prediction", residual_buckets)
    return volume.select(*ROW_KEY, "bucket", "scenario", "volume")


def generate_submission(models: Mapping[int, I.FittedModel | Mapping[int, I.FittedModel]], test_panel: DataFrame, template: DataFrame,
                        calibration: DataFrame | None = None, smooth: bool = False, biases: DataFrame | None = None,
                        residuals: Mapping[int, I.FittedModel] | None = None, residual_buckets=(1,)) -> DataFrame:
    """Split the series by scenario, expand, featurise, score, correct, and align to the template.

    ``models`` holds a model, or one per bucket, under each scenario; see
    ``scenario_forecast``. ``residuals`` holds a residual model per scenario.
    Corrections run in the order residual, calibration (by scenario, bucket and
    window), smoothing, bias. Rows the template asks for and no forecast covers
    get avg_vol_12m x exp(-0.05 x month).
    """
    panel = stage(P.handle_missing_pre_entry_data(test_panel))
    kinds = stage(P.detect_test_scenarios(panel).select(*SERIES, "scenario"))
    parts = []
    for scenario, model in models.items():
        mine = panel.join(kinds.where(F.col("scenario") == scenario).select(*SERIES), SERIES, "left_semi")
        parts.append(scenario_forecast(model, mine, scenario, (residuals or {}).get(scenario), residual_buckets))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if calibration is not None:
        out = K.apply_calibration(out, calibration)
    if smooth:
        out = K.smooth_predictions(out)
    if biases is not None:
        area = panel.groupBy(*SERIES).agg(F.min("ther_area").alias("ther_area"))
        out = K.apply_bias_corrections(out.join(area, SERIES, "left"), biases)
    base = panel.groupBy(*SERIES).agg(F.max("avg_vol_12m").alias("_base"))
    filled = template.select(*ROW_KEY).join(out.select(*ROW_KEY, "volume"), ROW_KEY, "left").join(base, SERIES, "left")
    decay = F.col("_base") * F.exp(-0.05 * F.col(MONTH))
    return filled.withColumn("volume", clip(F.coalesce("volume", decay), 0, None)).select(*ROW_KEY, "volume")
