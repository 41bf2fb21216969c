"""Nearest-neighbour erosion curves and the per-series blended forecaster."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.constants import MONTH, SERIES
from panelspark.functions.expr import one_row, ratio
from panelspark.functions.stage import stage
from panelspark.operators import similarity
from panelspark.operators.forecasters import SeriesForecaster

MATCHING = ["log_avg_vol", "pre_entry_trend", "pre_entry_volatility", "hospital_rate", "n_gxs_at_entry", "n_gxs"]
CATEGORIES = ["ther_area", "main_package"]


@dataclass
class HistoricalCurve:
    """Forecast of a series: distance-weighted mean of the curves of its k nearest training series.

    Falls back to the mean curve of the month, then to the overall mean.
    """

    k: int = 5
    weights: str = "distance"
    columns: list[str] = field(default_factory=lambda: list(MATCHING))
    categories: list[str] = field(default_factory=lambda: list(CATEGORIES))

    def _series(self, df: DataFrame) -> DataFrame:
        have = [c for c in [*self.columns, *self.categories] if c in df.columns]
        return df.groupBy(*SERIES).agg(*[F.min_by(c, MONTH).alias(c) for c in have])

    def _vectors(self, df: DataFrame) -> DataFrame:
        series = self._series(df)
        known = one_row(self.codes)
        values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.used]
        for c in self.coded:
            code = F.array_position(F.col("_codes")[c], F.col(c)).cast("double") - 1
            values.append(F.when(F.coalesce(code, F.lit(-1.0)) >= 0, code).otherwise(F.size(F.col("_codes")[c]).cast("double")))
        return series.withColumn("_codes", known).select(
            F.concat_ws("|", *SERIES).alias("node"), F.array(*values).alias("raw"))

    def fit(self, train: DataFrame, target: str = "y_norm") -> HistoricalCurve:
        self.used = [c for c in self.columns if c in train.columns]
        self.coded = [c for c in self.categories if c in train.columns]
        # categories are few by nature; a column of free text does not belong here
        self.codes = stage(train.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in self.coded])
                           if self.coded else train.agg(F.count(F.lit(1)).alias("n")))
        raw = stage(self._vectors(train))
        dim = len(self.used) + len(self.coded)
        self.scale = stage(raw.agg(
            F.array(*[F.avg(F.col("raw")[i]) for i in range(dim)]).alias("m"),
            F.array(*[F.coalesce(F.stddev_pop(F.col("raw")[i]), F.lit(1.0)) for i in range(dim)]).alias("s")))
        self.vectors = stage(self._scaled(raw))
        # a curve is one row, so that what meets a neighbour is no row per month
        points = F.collect_list(F.struct(MONTH, F.col(target).alias("_y")))
        self.curves = stage(train.groupBy(F.concat_ws("|", *SERIES).alias("neighbour")).agg(points.alias("_p")).select(
            "neighbour", F.col(f"_p.{MONTH}").alias("_months"), F.col("_p._y").alias("_ys")))
        self.month_curve = stage(self._by_month(self.curves).groupBy(MONTH).agg(F.avg("_y").alias("_curve")))
        self.mean = stage(self._by_month(self.curves).agg(F.avg("_y").alias("m")))
        return self

    @staticmethod
    def _by_month(curves: DataFrame, *keep: str) -> DataFrame:
        point = F.explode(F.arrays_zip("_months", "_ys")).alias("_p")
        return curves.select(*keep, point).select(*keep, F.col("_p._months").alias(MONTH), F.col("_p._ys").alias("_y"))

    def _scaled(self, raw: DataFrame) -> DataFrame:
        pairs = F.arrays_zip("raw", "_p.m", "_p.s")
        scaled = F.transform(F.col("_z"), lambda x: (x["raw"] - x["m"]) / F.when(x["s"] == 0, 1.0).otherwise(x["s"]))
        return raw.withColumn("_p", one_row(self.scale)).withColumn("_z", pairs).select("node", scaled.alias("vec"))

    def neighbours(self, df: DataFrame) -> DataFrame:
        return similarity.nearest(self._scaled(self._vectors(df)), self.vectors, "node", "vec", self.k)

    def predict(self, df: DataFrame) -> DataFrame:
        near = self.neighbours(df)
        weight = 1.0 / (F.col("distance") + 1e-6) if self.weights == "distance" else F.lit(1.0)
        # dealt by query once: its months are summed, put together and joined to its rows there
        met = (near.join(self.curves, "neighbour").select(F.col("query").alias("_node"), weight.alias("_w"), "_months", "_ys")
               .repartition("_node"))
        own = (self._by_month(met, "_node", "_w").where(F.col(MONTH).isNotNull())
               .groupBy("_node", F.col(MONTH).cast("double").alias("_m")).agg(ratio(F.sum(F.col("_w") * F.col("_y")), F.sum("_w")).alias("_v"))
               .groupBy("_node").agg(F.map_from_entries(F.collect_list(F.struct("_m", "_v"))).alias("_own")))
        rows = df.withColumn("_node", F.concat_ws("|", *SERIES))
        return (rows.join(own, "_node", "left").join(self.month_curve, MONTH, "left")
                .withColumn("prediction", F.coalesce(F.col("_own")[F.col(MONTH).cast("double")], "_curve", one_row(self.mean)["m"]))
                .drop("_node", "_own", "_curve"))


def blended_series_forecast(history: DataFrame, months, min_history: int = 6, window: int = 12,
                            fallback: DataFrame | None = None, decay_rate: float = 0.05) -> DataFrame:
    """The per-series forecaster with its usual options: ARIMA(1, 1, 1) and additive-trend smoothing, blended on the last points."""
    return SeriesForecaster(window=window, min_history=min_history).forecast(history, months, fallback, decay_rate)
