"""Ordered target statistics: categories as running means of the target over a seeded permutation.

A row's value for a category is the mean target of the rows before it in the
permutation that have the same category, drawn to the overall mean by a prior.
No row sees its own target or a later one. The running sums are exact and need
no task that holds a category: rows fall into 4096 stretches of the permutation
by a prefix of their hash, every stretch is summed with map-side combine, and
only inside a stretch a window runs.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.constants import ROW_KEY
from panelspark.functions.expr import attach, steady_sum
from panelspark.functions.order_stats import hash_bucket, order_hash
from panelspark.functions.stage import stage
from panelspark.operators import models as I


def _category(column: str) -> Column:
    """The category as text; null is a category of its own."""
    return F.coalesce(F.col(column).cast("string"), F.lit("\0"))


def _mean(total: Column, n: Column, prior: Column, weight: float) -> Column:
    return (F.coalesce(total, F.lit(0.0)) + weight * prior) / (F.coalesce(n, F.lit(0)) + weight)


def ordered_target_statistics(df: DataFrame, columns: list[str], target: str, keys=tuple(ROW_KEY), weight: float = 1.0,
                              seed: int = 42) -> DataFrame:
    """``df`` with ``{column}_ots`` per category column.

    ``keys`` name a row; their hash with ``seed`` is its place in the
    permutation, and rows of one place do not see each other. Rows without a
    target get their value from the rows before them and add nothing. The prior
    is the mean target of all rows, 0 where there is none.
    """
    y = F.col(target).cast("double")
    prior = df.agg(F.coalesce(F.try_divide(steady_sum(y), F.count(y)), F.lit(0.0)).alias("_prior"))
    out = attach(df, stage(prior)).withColumn("_h", order_hash(seed, *[F.col(k).cast("string") for k in keys])).withColumn("_stretch", hash_bucket(F.col("_h")))
    for c in columns:
        out = out.withColumn("_c", _category(c))
        sums = out.groupBy("_c", "_stretch").agg(steady_sum(y).alias("_s"), F.count(y).alias("_n"))
        before = Window.partitionBy("_c").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
        offsets = stage(sums.select("_c", "_stretch", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s0"),
                                    F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0")))
        inside = Window.partitionBy("_c", "_stretch").orderBy("_h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        same = Window.partitionBy("_c", "_stretch", "_h")
        own = F.coalesce(F.sum(y).over(inside), F.lit(0.0)) - F.coalesce(F.sum(y).over(same), F.lit(0.0))
        seen = F.count(y).over(inside) - F.count(y).over(same)
        value = _mean(F.col("_s0") + F.col("_own"), F.col("_n0") + F.col("_seen"), F.col("_prior"), weight)
        out = out.withColumns({"_own": own, "_seen": seen}).join(offsets, ["_c", "_stretch"], "left").withColumn(f"{c}_ots", value)
        out = out.drop("_c", "_own", "_seen", "_s0", "_n0")
    return out.select(*[F.col(f"`{c}`") for c in df.columns if not c.endswith("_ots") or c.removesuffix("_ots") not in columns], *[f"{c}_ots" for c in columns])


@dataclass
class TargetStatistics:
    """Category tables of a training set, for rows that are not part of it."""

    columns: list[str]
    target: str = "y_norm"
    weight: float = 1.0
    seed: int = 42
    keys: tuple[str, ...] = tuple(ROW_KEY)
    tables: dict = field(default_factory=dict)
    prior: DataFrame | None = None

    def fit(self, train: DataFrame) -> TargetStatistics:
        y = F.col(self.target).cast("double")
        self.prior = stage(train.agg(F.coalesce(F.try_divide(steady_sum(y), F.count(y)), F.lit(0.0)).alias("_prior")))
        self.tables = {c: stage(train.groupBy(_category(c).alias("_c")).agg(steady_sum(y).alias("_s"), F.count(y).alias("_n"))) for c in self.columns}
        return self

    def transform_train(self, train: DataFrame) -> DataFrame:
        """Ordered statistics of the training rows themselves."""
        return ordered_target_statistics(train, self.columns, self.target, self.keys, self.weight, self.seed)

    def transform(self, df: DataFrame) -> DataFrame:
        """The whole training set's statistics; a category it does not know gets the prior."""
        if self.prior is None:
            raise ValueError("fit the statistics first")
        out = attach(df, self.prior)
        for c in self.columns:
            out = out.withColumn("_c", _category(c)).join(self.tables[c], "_c", "left")
            out = out.withColumn(f"{c}_ots", _mean(F.col("_s"), F.col("_n"), F.col("_prior"), self.weight)).drop("_c", "_s", "_n")
        return out.select(*[F.col(f"`{c}`") for c in df.columns if not c.endswith("_ots") or c.removesuffix("_ots") not in self.columns], *[f"{c}_ots" for c in self.columns])


@dataclass
class CategoryBooster:
    """Boosted trees over numbers and ordered target statistics of categories."""

    statistics: TargetStatistics
    model: I.FittedModel

    def predict(self, df: DataFrame, low: float = 0.0, high: float = 2.0) -> DataFrame:
        return I.predict(self.model, self.statistics.transform(df), low, high)


def fit_booster(spec: I.ModelSpec, train: DataFrame, categories: list[str], weight: float = 1.0) -> CategoryBooster:
    """``spec`` with its own features and a statistic per category column.

    With ``validation`` in the spec, rows marked by it stop the boosting early;
    they are scored with the statistics of the others, as new rows would be.
    """
    held = F.coalesce(F.col(spec.validation), F.lit(False)) if spec.validation else F.lit(False)
    rows = train.where(~held)
    statistics = TargetStatistics(categories, spec.label, weight, spec.seed).fit(rows)
    made = statistics.transform_train(rows)
    if spec.validation:
        made = made.unionByName(statistics.transform(train.where(held)))
    features = (*spec.features, *[f"{c}_ots" for c in categories])
    return CategoryBooster(statistics, I.fit(replace(spec, features=features), stage(made)))
