"""Forecast models as pyspark.ml pipelines.

A model is fitted on a DataFrame with feature columns and a label. Frames that
are fitted more than once are staged, so their lineage runs once.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import sys
import uuid
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator
from pyspark.ml.feature import Imputer, PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.constants import MONTH, ROW_KEY, SERIES
from panelspark.functions.expr import clip, steady_sum
from panelspark.functions.order_stats import hash_bucket, order_hash, spread_rank
from panelspark.functions.stage import stage, stage_folder
from panelspark.operators import features as E
from panelspark.operators import metrics as G
from panelspark.operators import postprocess as K
from panelspark.operators import splits as S
from panelspark.operators import weights as H

# the terms of a model are scored in workers and travel with the functions that call them
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Presets of the tree families: deep and slow, leaf-sampled, and shallow and fast.
PRESETS: dict[str, dict] = {
    "gbt_deep": {"maxDepth": 6, "stepSize": 0.05, "maxIter": 60},
    "gbt_sampled": {"maxDepth": 5, "stepSize": 0.1, "maxIter": 60, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"},
    "gbt_fast": {"maxDepth": 4, "stepSize": 0.1, "maxIter": 40, "subsamplingRate": 0.8},
    "forest": {"maxDepth": 8, "numTrees": 60},
    "ridge": {"regParam": 0.1, "elasticNetParam": 0.0},
    "lasso": {"regParam": 0.01, "elasticNetParam": 1.0},
    "elastic": {"regParam": 0.05, "elasticNetParam": 0.5},
    "huber": {"loss": "huber", "regParam": 0.0},
}


@dataclass(frozen=True)
class ModelSpec:
    """``kind`` is a preset name; ``params`` override it."""

    kind: str = "gbt_fast"
    params: Mapping = field(default_factory=dict)
    features: tuple[str, ...] = ()
    label: str = "y_norm"
    weight: str | None = None
    polynomial: int = 1
    seed: int = 42
    validation: str | None = None

    def estimator(self):
        p = {**PRESETS[self.kind], **self.params, "featuresCol": "_features", "labelCol": self.label,
             "predictionCol": "prediction"}
        if self.weight:
            p["weightCol"] = self.weight
        if self.kind.startswith("gbt"):
            if self.validation:
                p["validationIndicatorCol"] = self.validation
            return GBTRegressor(seed=self.seed, **p)
        if self.kind == "forest":
            return RandomForestRegressor(seed=self.seed, **p)
        return LinearRegression(**p)

    def pipeline(self) -> Pipeline:
        inputs = [f"_x_{c}" for c in self.features]
        if self.kind.startswith("gbt") or self.kind == "forest":
            # codes split as ordered numbers, whatever the number of distinct values
            stages = [VectorAssembler(inputCols=inputs, outputCol="_features", handleInvalid="keep")]
        else:
            filled = [f"_i_{c}" for c in self.features]
            stages = [Imputer(inputCols=inputs, outputCols=filled, strategy="mean"),
                      VectorAssembler(inputCols=filled, outputCol="_raw")]
            if self.polynomial > 1:
                stages.append(PolynomialExpansion(degree=self.polynomial, inputCol="_raw", outputCol="_poly"))
            stages.append(StandardScaler(inputCol="_poly" if self.polynomial > 1 else "_raw", outputCol="_features",
                                         withMean=True))
        return Pipeline(stages=[*stages, self.estimator()])


def numeric(df: DataFrame, columns, fill: bool) -> DataFrame:
    """Add each feature as a double under a name of its own; trees get 0 for a gap, linear models impute."""
    value = (lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))) if fill else (lambda c: F.col(c).cast("double"))
    return df.withColumns({f"_x_{c}": value(c) for c in columns})


def monomials(spark, features, degree: int) -> list[str]:
    """Names of the columns that PolynomialExpansion makes, in its order: the product of distinct primes tells the factors."""
    primes = [p for p in range(2, 30 * len(features) + 30) if all(p % q for q in range(2, int(p ** 0.5) + 1))][:len(features)]
    one = spark.createDataFrame([(Vectors.dense([float(p) for p in primes]),)], ["x"])
    products = PolynomialExpansion(degree=degree, inputCol="x", outputCol="y").transform(one).first()["y"]
    out = []
    for product in products:
        left, factors = int(product), []
        for p, name in zip(primes, features):
            while left % p == 0:
                left //= p
                factors.append(name)
        out.append(" * ".join(factors))
    return out


@dataclass
class FittedModel:
    spec: ModelSpec
    model: PipelineModel
    codes: DataFrame | None = None  # category codes of the training data

    def save(self, path: str) -> None:
        """Write the pipeline, the spec and the category codes below ``path``."""
        spark = SparkSession.getActiveSession()
        self.model.write().overwrite().save(f"{path}/model")
        spec = json.dumps({**asdict(self.spec), "params": dict(self.spec.params)})
        spark.createDataFrame([(spec,)], "spec string").coalesce(1).write.mode("overwrite").parquet(f"{path}/spec")
        if self.codes is not None:
            self.codes.write.mode("overwrite").parquet(f"{path}/codes")

    @classmethod
    def load(cls, spark: SparkSession, path: str, codes: bool = False) -> "FittedModel":
        """What ``save`` wrote; with ``codes`` also the category codes."""
        spec = json.loads(spark.read.parquet(f"{path}/spec").first()["spec"])
        spec = ModelSpec(**{**spec, "features": tuple(spec["features"])})
        return cls(spec, PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/codes") if codes else None)

    def transform(self, df: DataFrame, keep_vector: bool = False) -> DataFrame:
        tree = not isinstance(self.spec.estimator(), LinearRegression)
        scored = self.model.transform(numeric(df, self.spec.features, tree))
        made = [c for c in scored.columns if c.startswith(("_i_", "_x_")) or c in ("_raw", "_poly", "_features")]
        return scored.drop(*[c for c in made if not (keep_vector and c == "_features")])

    def importance(self, spark) -> DataFrame:
        """(feature, importance): impurity gains, or absolute coefficients of the scaled columns."""
        last = self.model.stages[-1]
        values = (last.featureImportances if hasattr(last, "featureImportances") else last.coefficients).toArray()
        names = monomials(spark, self.spec.features, self.spec.polynomial) if len(values) > len(self.spec.features) else list(self.spec.features)
        return spark.createDataFrame([(n, float(abs(v))) for n, v in zip(names, values)],
                                     "feature string, importance double")


def fit(spec: ModelSpec, train: DataFrame, codes: DataFrame | None = None) -> FittedModel:
    """Fit on rows with a label. Early stopping runs on rows whose ``validation`` column is true.

    ``codes`` is the table of category codes that ``train`` was made with; it stays with the model.
    """
    if not spec.features:
        raise ValueError("name the feature columns")
    est = spec.estimator()
    rows = train.where(F.col(spec.label).isNotNull())
    known = list(spec.features)
    if isinstance(est, LinearRegression):
        # the imputer needs one value per column; a column without any is useless to a linear model
        counts = rows.agg(*[F.count(c).alias(c) for c in known]).first()
        known = [c for c in known if counts[c]]
        spec = replace(spec, features=tuple(known))
    extra = [c for c in (spec.weight, spec.validation) if c]
    rows = numeric(rows.select(*dict.fromkeys([*known, spec.label, *extra])), known, not isinstance(est, LinearRegression))
    return FittedModel(spec, spec.pipeline().fit(rows), codes)


def predict(model: FittedModel, df: DataFrame, low: float = 0.0, high: float = 2.0) -> DataFrame:
    """Score partition by partition and clip the share to its bounds."""
    return model.transform(df).withColumn("prediction", clip(F.col("prediction"), low, high))


def as_volume(scored: DataFrame) -> DataFrame:
    return scored.select(*ROW_KEY, (F.col("prediction") * F.col("avg_vol_12m")).alias("volume"))


def evaluate(scored: DataFrame, scenario) -> DataFrame:
    """Official metric, RMSE, MAE and R2 of a scored frame with y_norm, avg_vol_12m and bucket: one row.

    The row key is unique and a series has one avg_vol_12m and bucket, so what
    the metric compares stands in the row already. Joining the frame with itself
    would let Spark take a side of millions of rows for small by its compressed
    size and broadcast it through the driver.
    """
    sides = scored.where(" AND ".join(f"{c} IS NOT NULL" for c in ROW_KEY)).select(
        *ROW_KEY, F.col("volume").alias("actual"), (F.col("prediction") * F.col("avg_vol_12m")).alias("pred"),
        F.col("avg_vol_12m").alias("avg_vol"), "bucket")
    official = G.errors_of_rows(sides, scenario).agg(F.round(G.weighted_metric(), 4).alias("metric"))
    e = F.col("prediction") - F.col("y_norm")
    y = F.col("y_norm")
    return scored.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
                      (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"),
                      F.count(F.lit(1)).alias("n_rows")).withColumn("official_metric", official.scalar())


class OfficialMetricEvaluator(Evaluator):
    """pyspark.ml evaluator of the official metric, so that the tuning classes can use it."""

    def __init__(self, scenario=1):
        super().__init__()
        self.scenario = scenario

    def _evaluate(self, dataset: DataFrame) -> float:
        row = evaluate(dataset.withColumn("prediction", clip(F.col("prediction"), 0, 2)), self.scenario).first()
        return float(row["official_metric"]) if row["official_metric"] is not None else float("inf")

    def isLargerBetter(self) -> bool:
        return False


def split_frame(df: DataFrame, val_fraction: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and validation rows of a series-level split, from one staged frame."""
    tagged = stage(S.validation_split(df, val_fraction, ("bucket",), seed))
    return tagged.where("split = 'train'").drop("split"), tagged.where("split = 'val'").drop("split")


def train_scenario_model(train: DataFrame, val: DataFrame, scenario, spec: ModelSpec, target_transform: str = "none",
                         weighted: bool = True) -> tuple[FittedModel, DataFrame, DataFrame]:
    """Transform the target, weight, fit, predict, invert: (model, scored validation, metrics)."""
    rows = H.sample_weights(train, scenario) if weighted else train
    y = H.transform_target(F.col("y_norm"), target_transform)
    label = replace(spec, label="_label", weight="weight" if weighted else None)
    model = fit(label, rows.withColumn("_label", y))
    scored = model.transform(val).withColumn(
        "prediction", clip(H.inverse_transform_target(F.col("prediction"), target_transform), 0, 2))
    scored = stage(scored)
    return model, scored, evaluate(scored, scenario)


def _labelled(df: DataFrame, **labels) -> DataFrame:
    return df.select(*[F.lit(v).alias(k) for k, v in labels.items()], "*")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cross_validate(df: DataFrame, scenario, spec: ModelSpec, n_folds: int = 5, weighted: bool = True
                   ) -> tuple[DataFrame, DataFrame]:
    """(out-of-fold predictions, metrics per fold); folds are drawn by series and stratified by bucket."""
    tagged = stage(S.tag(df, S.fold_series(df, n_folds)))
    scored, scores = [], []
    for k in range(n_folds):
        _, oof, m = train_scenario_model(tagged.where(F.col("fold") != k), tagged.where(F.col("fold") == k), scenario, spec,
                                         weighted=weighted)
        scored.append(oof)
        scores.append(_labelled(m, fold=k))
    return _union(scored), _union(scores)


def long_scores(scores: DataFrame, ids: list[str]) -> DataFrame:
    """Fold scores as (ids, metric, value) for the statistics in splits."""
    return scores.unpivot(ids, ["official_metric", "rmse", "mae", "r2"], "metric", "value")


def tune(train: DataFrame, scenario, spec: ModelSpec, grid: Mapping[str, list], parallelism: int = 2, folds: int = 0,
         train_ratio: float = 0.8):
    """Grid search on the official metric, which needs whole series: (best fitted model, table of the grid with its metric).

    ``folds`` > 1 uses folds by series, else one hold-out of series; the best
    point is then fitted on all rows.
    """
    est = spec.estimator()
    tree = not isinstance(est, LinearRegression)
    rows = numeric(train, spec.features, tree)
    pipe = spec.pipeline()
    last = pipe.getStages()[-1]
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(last.getParam(name), values)
    points = builder.build()
    evaluator = OfficialMetricEvaluator(scenario)
    if folds > 1:
        rows = stage(S.tag(rows, S.fold_series(rows, folds, out="_fold")))
        tuner = CrossValidator(estimator=pipe, estimatorParamMaps=points, evaluator=evaluator, numFolds=folds,
                               foldCol="_fold", parallelism=parallelism)
        best = tuner.fit(rows)
        values = best.avgMetrics
        model = best.bestModel
    else:
        fitting, held = split_frame(rows, 1 - train_ratio, spec.seed)
        values = [evaluator.evaluate(pipe.fit(fitting, point).transform(held)) for point in points]
        model = pipe.fit(rows, points[min(range(len(points)), key=lambda i: values[i])])
    table = train.sparkSession.createDataFrame(
        [(i, str({p.name: v for p, v in point.items()}), float(m)) for i, (point, m) in enumerate(zip(points, values))],
        "config int, params string, official_metric double")
    return FittedModel(spec, model), table


def trial_points(grid: Mapping[str, list], n_trials: int | None = None, seed: int = 42) -> list[dict]:
    """All points of the grid, or ``n_trials`` of them, drawn by a hash of seed and point."""
    points = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    if n_trials is None or n_trials >= len(points):
        return points
    drawn = sorted(range(len(points)), key=lambda i: hashlib.md5(f"{seed}|{points[i]}".encode()).hexdigest())[:n_trials]
    return [points[i] for i in sorted(drawn)]


def tune_halving(train: DataFrame, scenario, spec: ModelSpec, grid: Mapping[str, list], folds: int = 4, eta: int = 2,
                 n_trials: int | None = None, weighted: bool = False, budget: int | None = None):
    """Successive halving over folds by series: (best model on all rows, table of points, table of fits).

    All points are tried on the first fold; the better 1 / ``eta`` of them, by
    the mean official metric so far, go on to the next fold, and so on, so weak
    points stop early. ``n_trials`` bounds the points, ``budget`` the fits: a
    fold is only begun if all points left can be tried on it. The winner is the
    best mean among the points with the most folds; ties go to the earlier
    point. Every fit is a row of the last table.
    """
    points = trial_points(grid, n_trials, spec.seed)
    tagged = stage(S.tag(train, S.fold_series(train, folds, seed=spec.seed)))
    alive, scores, log = list(range(len(points))), {i: [] for i in range(len(points))}, []
    for k in range(folds):
        if budget is not None and len(log) + len(alive) > budget:
            break
        fitting, held = tagged.where(F.col("fold") != k), tagged.where(F.col("fold") == k)
        for i in alive:
            own = replace(spec, params={**spec.params, **points[i]})
            value = train_scenario_model(fitting, held, scenario, own, weighted=weighted)[2].first()["official_metric"]
            scores[i].append(float("inf") if value is None else float(value))
            log.append((i, k, scores[i][-1]))
        if k < folds - 1 and len(alive) > 1:
            alive = sorted(sorted(alive, key=lambda i: (sum(scores[i]) / len(scores[i]), i))[:-(-len(alive) // eta)])
    most = max(len(v) for v in scores.values())
    if not most:
        raise ValueError("the budget does not allow one fit per point")
    mean = {i: sum(v) / len(v) for i, v in scores.items() if v}
    best = min((i for i in mean if len(scores[i]) == most), key=lambda i: (mean[i], i))
    spark = train.sparkSession
    table = spark.createDataFrame([(i, str(points[i]), len(scores[i]), mean.get(i), i == best) for i in range(len(points))],
                                  "config int, params string, n_folds int, official_metric double, best boolean")
    fits = spark.createDataFrame(log, "config int, fold int, official_metric double")
    rows = H.sample_weights(train, scenario) if weighted else train
    model = fit(replace(spec, params={**spec.params, **points[best]}, weight="weight" if weighted else None), rows)
    return model, table, fits


def compare_models(train: DataFrame, val: DataFrame, scenario, specs: Mapping[str, ModelSpec]) -> DataFrame:
    """One row of metrics per configuration, best official metric first."""
    parts = [_labelled(train_scenario_model(train, val, scenario, s)[2], model=n) for n, s in specs.items()]
    return stage(_union(parts)).orderBy("official_metric")


def compare_losses(train: DataFrame, val: DataFrame, scenario, spec: ModelSpec) -> DataFrame:
    """Squared and absolute loss of the trees, squared and huber loss of the linear model."""
    linear = replace(spec, kind="ridge", params={})
    return compare_models(train, val, scenario, {
        "squared": replace(spec, params={**spec.params, "lossType": "squared"}),
        "absolute": replace(spec, params={**spec.params, "lossType": "absolute"}),
        "linear_squared": linear, "linear_huber": replace(spec, kind="huber", params={"maxIter": 50})})


def bucket_models(train: DataFrame, scenario, spec: ModelSpec, buckets=(1, 2)) -> dict[int, FittedModel]:
    """One model per bucket that has rows."""
    present = {r["bucket"] for r in train.select("bucket").distinct().collect()}
    return {b: fit(spec, train.where(F.col("bucket") == b)) for b in buckets if b in present}


def route_by_bucket(models: Mapping[int, FittedModel], df: DataFrame, default: int = 2) -> DataFrame:
    """Each row through the model of its bucket; rows of an unknown bucket go to the default one."""
    default = default if default in models else next(iter(models))
    known = F.when(F.col("bucket").isin(list(models)), F.col("bucket")).otherwise(default)
    rows = df.withColumn("_route", known)
    return _union([predict(m, rows.where(F.col("_route") == b)).drop("_route") for b, m in models.items()])


def multi_seed(train: DataFrame, val: DataFrame, scenario, spec: ModelSpec, seeds) -> tuple[DataFrame, DataFrame]:
    """(metrics per seed, member table of the seeds' validation forecasts)."""
    scores, members = [], []
    for s in seeds:
        _, scored, m = train_scenario_model(train, val, scenario, replace(spec, seed=s))
        scores.append(_labelled(m, seed=s))
        members.append(scored.select(*ROW_KEY, F.lit(f"seed_{s}").alias("member"), "prediction"))
    return _union(scores), _union(members)


# --- hybrid and residual models -----------------------------------------------------------------


def fit_hybrid(train: DataFrame, spec: ModelSpec, decay_rate: float = 0.05) -> FittedModel:
    """Tree model of what exp(-rate x month) leaves over."""
    residual = F.col("y_norm") - F.exp(-decay_rate * F.col(MONTH))
    return fit(replace(spec, label="_residual"), train.withColumn("_residual", residual))


def predict_hybrid(model: FittedModel, df: DataFrame, decay_rate: float = 0.05, low: float = 0.0,
                   high: float = 2.0) -> DataFrame:
    """Decay plus residual, with both parts as columns."""
    scored = model.transform(df).withColumnRenamed("prediction", "ml_residual")
    scored = scored.withColumn("physics", F.exp(-decay_rate * F.col(MONTH)))
    return scored.withColumn("prediction", clip(F.col("physics") + F.col("ml_residual"), low, high))


def train_residual_model(df: DataFrame, spec: ModelSpec, buckets=(1,), val_fraction: float = 0.2
                         ) -> tuple[FittedModel, DataFrame]:
    """Model of volume_true - volume_pred on the rows it will speak for: (model, hold-out errors)."""
    rows = stage(df.where(K.residual_rows(buckets)).withColumns({
        "residual": F.col("volume_true") - F.col("volume_pred"),
        "_u": F.conv(F.substring(order_hash(spec.seed, *[F.col(c).cast("string") for c in ROW_KEY]), 1, 8), 16, 10)
        .cast("double") / float(2 ** 32)}))
    model = fit(replace(spec, label="residual"), rows.where(F.col("_u") >= val_fraction))
    held = model.transform(rows.where(F.col("_u") < val_fraction))
    e = F.col("prediction") - F.col("residual")
    return model, held.agg(F.sqrt(F.avg(e * e)).alias("rmse_residual"), F.avg(F.abs(e)).alias("mae_residual"),
                           F.count(F.lit(1)).alias("n_val"))


# --- importance, pruning, ablation --------------------------------------------------------------


@dataclass
class Scorer:
    """What a fitted model adds up, as plain arrays: terms, and which terms each feature is part of.

    A term is a tree, or a product of columns with a coefficient. A change of one
    feature changes the terms that use it and no others.
    """
    features: list[str]
    terms: list
    start: float
    fill: list[float]

    def uses(self) -> list[list[int]]:
        """Per feature the numbers of the terms that look at it."""
        return [[i for i, t in enumerate(self.terms) if f in t["features"]] for f in range(len(self.features))]

    def term(self, i: int, x: np.ndarray) -> np.ndarray:
        t = self.terms[i]
        if "factors" in t:
            return t["weight"] * np.prod(x[:, t["factors"]], axis=1)
        at = np.zeros(len(x), np.int64)
        while True:
            feature = t["feature"][at]
            open_ = np.flatnonzero(feature >= 0)
            if not len(open_):
                return t["weight"] * t["value"][at]
            left = x[open_, feature[open_]] <= t["threshold"][at[open_]]
            at[open_] = np.where(left, t["left"][at[open_]], t["right"][at[open_]])

    def filled(self, x: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(x), np.array(self.fill), x)


def scorer(model: FittedModel, spark: SparkSession) -> Scorer:
    """The terms of a fitted model; trees are read from its saved nodes, whose number the model's size bounds."""
    names, last = list(model.spec.features), model.model.stages[-1]
    if not hasattr(last, "trees"):
        imputer = model.model.stages[0]
        surrogate = imputer.surrogateDF.first().asDict()
        scale = next(s for s in model.model.stages if hasattr(s, "std"))
        kinds = [[names.index(f) for f in m.split(" * ")] for m in monomials(spark, names, model.spec.polynomial)] if model.spec.polynomial > 1 else [[i] for i in range(len(names))]
        mean, std = scale.mean.toArray(), scale.std.toArray()
        weights = [c / s if s else 0.0 for c, s in zip(last.coefficients.toArray(), std)]
        terms = [{"factors": f, "weight": w, "features": set(f)} for f, w in zip(kinds, weights)]
        return Scorer(names, terms, float(last.intercept - sum(w * m for w, m in zip(weights, mean))), [surrogate[f"_x_{c}"] for c in names])
    path = f"{stage_folder(spark)}/model-{uuid.uuid4().hex}"
    last.save(path)
    saved = spark.read.parquet(f"{path}/data")
    nodes: dict[int, dict[int, tuple]] = {}
    split = F.col("nodeData.split")
    for r in saved.select("treeID", F.col("nodeData.id").alias("id"), F.col("nodeData.prediction").alias("value"), F.col("nodeData.leftChild").alias("left"),
                          F.col("nodeData.rightChild").alias("right"), split["featureIndex"].alias("feature"),
                          F.try_element_at(split["leftCategoriesOrThreshold"], F.lit(1)).alias("threshold")).collect():
        nodes.setdefault(r["treeID"], {})[r["id"]] = (r["feature"] if r["left"] >= 0 else -1, r["threshold"], max(r["left"], 0), max(r["right"], 0), r["value"])
    weights = list(last.treeWeights)
    share = 1.0 / len(weights) if isinstance(last, RandomForestRegressionModel) else 1.0
    terms = []
    for i, weight in enumerate(weights):
        rows = [nodes[i][k] for k in range(len(nodes[i]))]
        feature = np.array([r[0] for r in rows], np.int64)
        terms.append({"feature": feature, "threshold": np.array([r[1] if r[0] >= 0 else 0.0 for r in rows], float), "left": np.array([r[2] for r in rows]),
                      "right": np.array([r[3] for r in rows]), "value": np.array([r[4] for r in rows], float), "weight": weight * share,
                      "features": set(feature[feature >= 0].tolist())})
    return Scorer(names, terms, 0.0, [0.0] * len(names))


def permutation_importance(model: FittedModel, df: DataFrame, n_repeats: int = 5, seed: int = 42) -> DataFrame:
    """Rise of the squared error when one column is shuffled: (feature, importance_mean, importance_std).

    Rows get a partner by matching two independent random ranks, so all columns
    of a repeat are shuffled by one join. A row and its partner then go through
    one task, which scores the row once and, for every feature, only the terms
    of the model that look at it again; a row is never copied per feature.
    """
    spec = model.spec
    names = list(spec.features)
    keys = [F.col(c).cast("string") for c in ROW_KEY]
    rows = stage(df.where(F.col(spec.label).isNotNull()).select(
        *ROW_KEY, *[c for c in names if c not in ROW_KEY], spec.label).withColumn("_all", F.lit(0)))
    parts = scorer(model, df.sparkSession)
    uses = parts.uses()

    def ranked(tag: str, repeat: int) -> DataFrame:
        h = rows.withColumn("_h", order_hash(seed, tag, repeat, *keys))
        return spread_rank(h, "_all", [F.col("_h"), *[F.col(c) for c in ROW_KEY]], hash_bucket(F.col("_h")), "_place").drop("_h")

    def tried(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own, other = (parts.filled(np.array(batch.column(c).flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1)) for c in ("x", "other"))
            y, repeat = batch.column("y").to_numpy(), batch.column("repeat").to_numpy()
            each = np.stack([parts.term(i, own) for i in range(len(parts.terms))]) if parts.terms else np.zeros((0, n))
            whole = parts.start + each.sum(axis=0)
            out = []

            def add(feature, prediction):
                error = (prediction - y) ** 2
                out.extend((feature, int(k), float(error[repeat == k].sum()), int((repeat == k).sum())) for k in np.unique(repeat))

            add(None, whole)
            for f, terms in enumerate(uses):
                swapped = own.copy() if terms else own
                if terms:
                    swapped[:, f] = other[:, f]
                add(names[f], whole + sum((parts.term(i, swapped) - each[i] for i in terms), np.zeros(n)))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64())],
                                             names=["feature", "repeat", "sse", "n"])

    x = F.array(*[F.col(c).cast("double") for c in names])
    pairs = _union([ranked("a", k).select("_place", x.alias("x"), F.col(spec.label).cast("double").alias("y"), F.lit(k).alias("repeat")).join(
        ranked("b", k).select("_place", x.alias("other")), "_place") for k in range(n_repeats)])
    sums = pairs.select("x", "other", "y", "repeat").mapInArrow(tried, "feature string, repeat int, sse double, n long")
    mse = stage(sums.groupBy("feature", "repeat").agg((steady_sum(F.col("sse")) / F.sum("n")).alias("mse")))
    rise = mse.where("feature IS NOT NULL").join(mse.where("feature IS NULL").select("repeat", F.col("mse").alias("_base")), "repeat")
    rise = rise.withColumn("_rise", F.col("mse") - F.col("_base"))
    return rise.groupBy("feature").agg(F.avg("_rise").alias("importance_mean"), F.stddev_pop("_rise").alias("importance_std"))


def select_features(importance: DataFrame, top_k: int | None = None, threshold: float | None = None,
                    column: str = "importance_mean") -> DataFrame:
    """The k most important features, or those above a threshold."""
    if top_k is not None:
        return importance.orderBy(F.col(column).desc(), "feature").limit(top_k).select("feature")
    if threshold is not None:
        return importance.where(F.col(column) > threshold).select("feature")
    return importance.select("feature")


def prune_features(importance: DataFrame, drop_fraction: float = 0.2, min_keep: int = 50, threshold: float | None = None,
                   column: str = "importance") -> DataFrame:
    """(feature, importance, keep): the bottom share goes, but at least ``min_keep`` stay.

    The table has one row per feature, so its ranking is small.
    """
    filled = importance.withColumn(column, F.coalesce(column, F.lit(0.0)))
    if threshold is not None:
        return filled.withColumn("keep", F.when(F.col(column) < threshold, 0).otherwise(1))
    small = stage(filled.withColumn("_all", F.lit(0)))
    n = small.agg(F.count(F.lit(1)).alias("n")).scalar()
    ranked = spread_rank(small, "_all", [F.col(column), F.col("feature")], F.lit(0), "_place")
    drop = F.greatest(F.least(F.floor(F.col("_total") * drop_fraction), F.col("_total") - min_keep), F.lit(0))
    return ranked.withColumn("_total", n).withColumn("keep", F.when(F.col("_place") <= drop, 0).otherwise(1)).drop(
        "_all", "_place", "_total")


def feature_ablation(df: DataFrame, spec: ModelSpec, groups: Mapping[str, list[str]], scenario=1) -> DataFrame:
    """RMSE and MAE of the whole set, without each group, and with each group alone; impact is the rise in RMSE."""
    train, val = split_frame(df)
    runs = {"baseline": list(spec.features)}
    for g, columns in groups.items():
        rest = [c for c in spec.features if c not in columns]
        own = [c for c in spec.features if c in columns]
        if rest and own:
            runs[f"drop_{g}"] = rest
            runs[f"add_{g}"] = own
    parts = []
    for name, columns in runs.items():
        scored = predict(fit(replace(spec, features=tuple(columns)), train), val)
        parts.append(_labelled(G.point_errors(scored, "y_norm", "prediction").select("rmse", "mae"), run=name,
                               n_features=len(columns)))
    table = stage(_union(parts))
    base = table.where("run = 'baseline'").agg(F.max("rmse").alias("r")).scalar()
    return table.withColumn("impact", F.col("rmse") - base)


def compare_approaches(panel: DataFrame, scenario, approaches: Mapping[str, dict], spec: ModelSpec) -> DataFrame:
    """Build features by each configuration, fit, and rank by RMSE."""
    from panelspark.operators.columns import select_training_rows
    parts = []
    for name, config in approaches.items():
        df = select_training_rows(E.make_features(panel, scenario, "train", config), scenario)
        columns = tuple(c for c in E.feature_columns(df) if c not in ("pre_entry_months_available", "avg_vol_12m"))
        train, val = split_frame(df)
        scored = predict(fit(replace(spec, features=columns), train), val)
        parts.append(_labelled(G.point_errors(scored, "y_norm", "prediction").select("rmse", "mae"), approach=name,
                               n_features=len(columns)))
    return stage(_union(parts)).orderBy("rmse")


def adversarial_rows(train: DataFrame, test: DataFrame, features: list[str], n_folds: int = 5, seed: int = 42) -> DataFrame:
    """Rows of both sides with their label (1 for test) and a fold drawn by series."""
    def side(df, label):
        return numeric(df, features, True).select(*SERIES, *[f"_x_{c}" for c in features]).withColumn(
            "_label", F.lit(float(label)))
    draw = F.conv(F.substring(order_hash(seed, *[F.col(c) for c in SERIES]), 1, 8), 16, 10).cast("long")
    return side(train, 0).unionByName(side(test, 1)).withColumn("_fold", (draw % n_folds).cast("int"))


def adversarial_validation(train: DataFrame, test: DataFrame, features: list[str], n_folds: int = 5, trees: int = 30,
                           depth: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Can a classifier tell train from test? (AUC per fold, mean importance per feature)."""
    rows = stage(adversarial_rows(train, test, features, n_folds, seed))
    forest = RandomForestClassifier(featuresCol="_x", labelCol="_label", numTrees=trees, maxDepth=depth, seed=seed)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=[f"_x_{c}" for c in features], outputCol="_x"), forest])
    judge = BinaryClassificationEvaluator(labelCol="_label")
    aucs, weights = [], []
    for k in range(n_folds):
        model = pipe.fit(rows.where(F.col("_fold") != k))
        aucs.append((k, float(judge.evaluate(model.transform(rows.where(F.col("_fold") == k))))))
        weights += [(f, float(v)) for f, v in zip(features, model.stages[-1].featureImportances.toArray())]
    spark = train.sparkSession
    auc = spark.createDataFrame(aucs, "fold int, auc double")
    shift = spark.createDataFrame(weights, "feature string, w double").groupBy("feature").agg(F.avg("w").alias("importance"))
    return auc, shift


# --- stacking, blending, several models ---------------------------------------------------------


def stacking(df: DataFrame, specs: Mapping[str, ModelSpec], n_folds: int = 3, reg: float = 1.0
             ) -> tuple[Callable[[DataFrame], DataFrame], DataFrame]:
    """Ridge over out-of-fold member forecasts; members are refitted on all rows. (predictor, out-of-fold table)."""
    tagged = stage(S.tag(df, S.fold_series(df, n_folds)))
    parts = []
    for k in range(n_folds):
        held = tagged.where(F.col("fold") == k)
        for name, s in specs.items():
            held = fit(s, tagged.where(F.col("fold") != k)).transform(held).withColumnRenamed("prediction", f"m_{name}")
        parts.append(held.select(*ROW_KEY, "y_norm", *[f"m_{n}" for n in specs]))
    oof = stage(_union(parts))
    return _meta(oof, specs, {n: fit(s, tagged) for n, s in specs.items()}, reg), oof


def blending(df: DataFrame, specs: Mapping[str, ModelSpec], holdout: float = 0.2, reg: float = 1.0
             ) -> tuple[Callable[[DataFrame], DataFrame], DataFrame]:
    """Ridge over hold-out member forecasts; members are refitted on all rows."""
    train, held = split_frame(df, holdout)
    for name, s in specs.items():
        held = fit(s, train).transform(held).withColumnRenamed("prediction", f"m_{name}")
    table = stage(held.select(*ROW_KEY, "y_norm", *[f"m_{n}" for n in specs]))
    return _meta(table, specs, {n: fit(s, df) for n, s in specs.items()}, reg), table


def _meta(table: DataFrame, specs: Mapping[str, ModelSpec], members: Mapping[str, FittedModel], reg: float):
    columns = [f"m_{n}" for n in specs]
    gather = VectorAssembler(inputCols=columns, outputCol="_m")
    meta = LinearRegression(featuresCol="_m", labelCol="y_norm", regParam=reg / 1000, elasticNetParam=0.0).fit(
        gather.transform(table))

    def predictor(rows: DataFrame) -> DataFrame:
        out = rows
        for n in specs:
            out = members[n].transform(out).withColumnRenamed("prediction", f"m_{n}")
        scored = meta.transform(gather.transform(out)).drop("_m")
        return scored.withColumn("prediction", clip(F.col("prediction"), 0, 2))
    return predictor


def train_multi_model_ensemble(train: DataFrame, val: DataFrame, scenario, specs: Mapping[str, ModelSpec],
                               metric: str = "official", parts: int = 5) -> DataFrame:
    """Fit members, search simplex weights, compare with the best member: one decision row."""
    from panelspark.operators import ensemble as J
    scores, members = [], None
    for name, s in specs.items():
        _, scored, m = train_scenario_model(train, val, scenario, s)
        scores.append(_labelled(m, model=name))
        part = scored.select(*ROW_KEY, F.lit(name).alias("member"),
                             (F.col("prediction") * F.col("avg_vol_12m")).alias("prediction"))
        members = part if members is None else members.unionByName(part)
    single = stage(_union(scores))
    # the few columns that the grid needs, staged: their size on disk is that of these columns alone
    truth = stage(val.select(*ROW_KEY, "volume", "avg_vol_12m", "bucket"))
    grid = J.grid_scores(stage(members), truth, G.create_aux(truth), list(specs), scenario, metric, parts)
    best = stage(J.best_grid_weights(grid))
    key = "official_metric" if metric == "official" else metric
    top = single.agg(F.min(F.struct(key, "model")).alias("b")).select(F.col(f"b.{key}").alias("s"), F.col("b.model").alias("m"))
    chosen = stage(top)
    return best.withColumns({"best_single": chosen.select("m").scalar(), "best_single_score": chosen.select("s").scalar()}
                            ).withColumn("recommendation", F.when(F.col("score") < F.col("best_single_score"), "ensemble")
                                         .otherwise(F.col("best_single")))


def sweep_with_cv(df: DataFrame, scenario, specs: Mapping[str, ModelSpec], n_folds: int = 3, weighted: bool = True) -> DataFrame:
    """K-fold scores of every configuration with mean, deviation and interval, ranked."""
    parts = [long_scores(cross_validate(df, scenario, s, n_folds, weighted)[1], ["fold"]).select(
        F.lit(n).alias("model"), "fold", "metric", "value") for n, s in specs.items()]
    return S.comparison_table(stage(_union(parts)), "official_metric")


def features_as_array(model: FittedModel, df: DataFrame) -> DataFrame:
    """The assembled feature vector of every row as an array column, for inspection."""
    return model.transform(df, keep_vector=True).withColumn("features", vector_to_array("_features")).drop("_features")
