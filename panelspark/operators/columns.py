"""Projections, column summaries, correlations and scalers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.constants import ROW_KEY, require, scenario_window
from panelspark.functions.expr import numeric_columns, one_row, ratio
from panelspark.functions.order_stats import average_rank, column_quantiles
from panelspark.functions.stage import stage
from panelspark.operators import features as E
from panelspark.operators import panel as P


def select_training_rows(panel: DataFrame, scenario) -> DataFrame:
    _, low, high = scenario_window(scenario)
    return P.select_rows(panel, low, high)


def simulate_scenario(panel: DataFrame, scenario) -> tuple[DataFrame, DataFrame]:
    cutoff, _, high = scenario_window(scenario)
    return P.simulate_scenario(panel, cutoff, high)


def training_columns(df: DataFrame) -> tuple[list[str], str, list[str]]:
    """Strict column lists for a fit: no meta column but the row key may stay; a null target is refused at fit time."""
    require(df, [*ROW_KEY, "y_norm"], "training frame")
    meta = {*E.META, "pre_entry_months_available"}
    return [c for c in E.feature_columns(df) if c not in meta], "y_norm", ROW_KEY


def chunked_apply(df: DataFrame, fn: Callable, schema: T.StructType | str | None = None) -> DataFrame:
    """Run a pandas function over Arrow batches of every partition."""
    def over(batches):
        for batch in batches:
            yield fn(batch)
    return df.mapInPandas(over, schema or df.schema)


def feature_summary(df: DataFrame) -> DataFrame:
    """One row per column: type, distinct values, nulls, and moments of the numeric ones.

    Distinct values and medians of all columns come from one unpivoted pass
    each; exact distinct counts of many columns in one aggregate would expand
    every row once per column inside a single job as well.
    """
    numbers = set(numeric_columns(df))
    types = dict(df.dtypes)
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).unpivot([], df.columns, "feature", "_v")
    distinct = (text.where(F.col("_v").isNotNull()).groupBy("feature", "_v").agg(F.lit(1).alias("_one"))
                .groupBy("feature").agg(F.count(F.lit(1)).alias("n_unique")))
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in df.columns:
        stats = {"n": F.count(c)}
        if c in numbers:
            stats |= {"mean": F.avg(c), "std": F.stddev_samp(c), "min": F.min(c), "max": F.max(c)}
        aggs.append(F.struct(*[v.cast("double").alias(k) for k, v in stats.items()]).alias(c))
    wide = df.agg(*aggs)
    null = F.lit(None).cast("double")
    per_column = F.array(*[F.struct(
        F.lit(c).alias("feature"), F.lit(types[c]).alias("dtype"), F.col(c)["n"].alias("n"),
        *[(F.col(c)[k] if c in numbers else null).alias(k) for k in ("mean", "std", "min", "max")])
        for c in df.columns])
    moments = wide.select("_rows", F.explode(per_column).alias("s")).select("_rows", "s.*")
    medians = column_quantiles(df, sorted(numbers), {"median": 0.5}).withColumnRenamed("column", "feature")
    missing = (F.col("_rows") - F.col("n")).cast("long")
    return (moments.join(distinct, "feature", "left").join(medians, "feature", "left")
            .select("feature", "dtype", F.coalesce("n_unique", F.lit(0)).alias("n_unique"), missing.alias("n_missing"),
                    (missing * 100.0 / F.col("_rows")).alias("missing_pct"), "mean", "std", "min", "max", "median"))


def feature_correlations(df: DataFrame, threshold: float = 0.95, method: str = "pearson") -> DataFrame:
    """Each pair of columns with its correlation; ``redundant`` marks the later column of a strong pair.

    All pairs of one row set come from one aggregate. Spearman first turns every
    column into average ranks.
    """
    columns = numeric_columns(df)
    rows = df
    if method == "spearman":
        for c in columns:
            rows = average_rank(rows, c, f"_rank_{c}")
        rows = rows.select(*[F.col(f"_rank_{c}").alias(c) for c in columns])
    elif method != "pearson":
        raise ValueError(f"unknown method {method!r}")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    wide = rows.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    listed = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                                F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)])
    strong = F.when(F.abs("correlation") >= threshold, 1).otherwise(0)
    return wide.select(F.explode(listed).alias("p")).select("p.*").withColumn("redundant", strong)


def remove_redundant_features(df: DataFrame, correlation_threshold: float = 0.95, variance_threshold: float = 0.0,
                              keep=tuple(ROW_KEY)) -> tuple[DataFrame, list[str]]:
    """Drop low-variance columns, then the later column of every strongly correlated pair.

    Which columns go depends on the data, so the two small results (one number
    per column, one row per strong pair) come to the driver.
    """
    columns = [c for c in numeric_columns(df) if c not in keep]
    dropped: list[str] = []
    if variance_threshold > 0:
        spread = df.agg(*[F.var_samp(c).alias(c) for c in columns]).first()
        dropped = [c for c in columns if spread[c] is not None and spread[c] <= variance_threshold]
    if correlation_threshold < 1.0:
        left = [c for c in columns if c not in dropped]
        strong = feature_correlations(df.select(*left), correlation_threshold).where("redundant = 1")
        names = {row["feature_b"] for row in strong.select("feature_b").distinct().collect()}
        dropped += [c for c in left if c in names]
    return df.drop(*dropped), dropped


@dataclass
class FeatureScaler:
    """standard, minmax, robust or none; the parameters stay a one-row DataFrame."""

    method: str = "standard"
    exclude: list[str] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    params: DataFrame | None = None

    def __post_init__(self):
        if self.method not in ("standard", "minmax", "robust", "none"):
            raise ValueError(f"unknown scaling method {self.method!r}")

    def fit(self, df: DataFrame) -> FeatureScaler:
        self.columns = [c for c in numeric_columns(df) if c not in self.exclude]
        if self.method == "standard":
            self.params = df.agg(*[F.struct(F.avg(c).alias("center"), F.stddev_pop(c).alias("scale")).alias(c)
                                   for c in self.columns])
        elif self.method == "minmax":
            self.params = df.agg(*[F.struct(F.min(c).cast("double").alias("center"),
                                            (F.max(c) - F.min(c)).cast("double").alias("scale")).alias(c)
                                   for c in self.columns])
        elif self.method == "robust":
            q = column_quantiles(df, self.columns, {"a": 0.25, "m": 0.5, "b": 0.75})
            self.params = q.agg(*[F.struct(
                F.max(F.when(F.col("column") == c, F.col("m"))).alias("center"),
                F.max(F.when(F.col("column") == c, F.col("b") - F.col("a"))).alias("scale")).alias(c)
                for c in self.columns])
        if self.params is not None:
            self.params = stage(self.params)
        return self

    def _apply(self, df: DataFrame, forward: bool) -> DataFrame:
        if self.method == "none":
            return df
        if self.params is None:
            raise ValueError("fit the scaler first")
        columns = [c for c in self.columns if c in df.columns]
        p = F.col("_p")

        def moved(c):
            # a constant column has no scale; like any unit column it is only shifted
            scale = F.when(p[c]["scale"] == 0, 1.0).otherwise(p[c]["scale"])
            return (ratio(F.col(c) - p[c]["center"], scale) if forward else F.col(c) * scale + p[c]["center"])

        return df.withColumn("_p", one_row(self.params)).withColumns({c: moved(c) for c in columns}).drop("_p")

    def transform(self, df: DataFrame) -> DataFrame:
        return self._apply(df, True)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return self._apply(df, False)
