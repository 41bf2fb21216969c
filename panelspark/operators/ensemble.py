"""Blending member forecasts.

Members are kept long: one row per key and member. Averages are then one
grouped aggregate, whatever the number of members.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.constants import ROW_KEY, SERIES
from panelspark.functions.expr import clip
from panelspark.operators.metrics import TERMS, scenario_number, weighted_metric


def stack(members: Mapping[str, DataFrame], value: str = "prediction") -> DataFrame:
    """Long table (row key, member, prediction)."""
    out = None
    for name, df in members.items():
        part = df.select(*ROW_KEY, F.lit(name).alias("member"), F.col(value).cast("double").alias("prediction"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no members")
    return out


def wide(members: DataFrame, names: list[str]) -> DataFrame:
    """One column per member; a conditional aggregate, so one shuffle for all members."""
    return members.groupBy(*ROW_KEY).agg(
        *[F.max(F.when(F.col("member") == n, F.col("prediction"))).alias(n) for n in names])


def average(members: DataFrame, low: float | None = 0.0, high: float | None = 2.0) -> DataFrame:
    return members.groupBy(*ROW_KEY).agg(clip(F.avg("prediction"), low, high).alias("prediction"))


def weighted(members: DataFrame, weights: Mapping[str, float], low: float | None = 0.0,
             high: float | None = 2.0) -> DataFrame:
    """Weighted mean with weights brought to sum 1."""
    total = float(sum(weights.values()))
    w = F.coalesce(*[F.when(F.col("member") == n, F.lit(x / total)) for n, x in weights.items()])
    return members.where(F.col("member").isin(list(weights))).groupBy(*ROW_KEY).agg(
        clip(F.sum(w * F.col("prediction")), low, high).alias("prediction"))


def gram(df: DataFrame, names: list[str], target: str, weight: str | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Second moments of the members and the target: one aggregate with a single small row."""
    w = F.col(weight) if weight else F.lit(1.0)
    cells = {f"g{i}_{j}": F.sum(w * F.col(a) * F.col(b))
             for i, a in enumerate(names) for j, b in enumerate(names) if i <= j}
    cells |= {f"c{i}": F.sum(w * F.col(a) * F.col(target)) for i, a in enumerate(names)}
    cells |= {"y": F.sum(w * F.col(target) * F.col(target)), "n": F.sum(w)}
    row = df.dropna(subset=[*names, target]).agg(*[v.alias(k) for k, v in cells.items()]).first()
    k, n = len(names), row["n"] or 1.0
    g = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / n
    return g, np.array([row[f"c{i}"] for i in range(k)]) / n, row["y"] / n


def simplex_weights(g: np.ndarray, c: np.ndarray, steps: int = 20000) -> np.ndarray:
    """Weights >= 0 with sum 1 that minimise w'Gw - 2c'w.

    Projected gradient steps on the k x k matrix find which weights are zero;
    the others then follow from one linear system.
    """
    k = len(c)
    w = np.full(k, 1.0 / k)
    rate = 1.0 / max(2 * np.linalg.eigvalsh(g)[-1], 1e-12)
    for _ in range(steps):
        move = w - rate * 2 * (g @ w - c)
        up = np.sort(move)[::-1]
        excess = (np.cumsum(up) - 1) / np.arange(1, k + 1)
        new = np.maximum(move - excess[np.nonzero(up > excess)[0][-1]], 0)
        moved = np.abs(new - w).max()
        w = new
        if moved < 1e-12:
            break
    return _on_face(g, c, w)


def _on_face(g: np.ndarray, c: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The minimum with sum 1 over the weights that are not zero; ``w`` itself where the system has no such solution."""
    on = np.flatnonzero(w > 1e-7)
    n = len(on)
    system = np.ones((n + 1, n + 1))
    system[:n, :n], system[n, n] = g[np.ix_(on, on)], 0
    if np.linalg.matrix_rank(system) <= n:
        return w
    exact = np.zeros(len(w))
    exact[on] = np.linalg.solve(system, np.append(c[on], 1.0))[:n]
    return exact if exact.min() >= 0 else w


def box_weights(g: np.ndarray, c: np.ndarray, steps: int = 20000) -> np.ndarray:
    """Weights in [0, 1] without a sum condition."""
    w = np.full(len(c), 1.0 / len(c))
    rate = 1.0 / max(2 * np.linalg.eigvalsh(g)[-1], 1e-12)
    for _ in range(steps):
        new = np.clip(w - rate * 2 * (g @ w - c), 0, 1)
        if np.abs(new - w).max() < 1e-12:
            return new
        w = new
    return w


def simplex_grid(k: int, parts: int = 10) -> list[tuple[float, ...]]:
    """All weight vectors with entries i/parts and sum 1."""
    grid = []
    for bars in combinations(range(parts + k - 1), k - 1):
        edges = (-1, *bars, parts + k - 1)
        grid.append(tuple((edges[i + 1] - edges[i] - 1) / parts for i in range(k)))
    return grid


def fit_weights(df: DataFrame, names: list[str], target: str, metric: str = "mse", weight: str | None = None,
                constrain: bool = True, parts: int = 20) -> dict[str, float]:
    """Weights from one aggregate: a small quadratic problem for mse, a grid of weight vectors for mae."""
    if metric == "mse":
        g, c, _ = gram(df, names, target, weight)
        w = simplex_weights(g, c) if constrain else box_weights(g, c)
    elif metric == "mae":
        grid = simplex_grid(len(names), parts)
        errors = [F.avg(F.abs(sum(F.lit(x) * F.col(n) for x, n in zip(ws, names)) - F.col(target))).alias(f"e{i}")
                  for i, ws in enumerate(grid)]
        row = df.agg(*errors).first()
        w = grid[min(range(len(grid)), key=lambda i: row[f"e{i}"])]
    else:
        raise ValueError(f"unknown metric {metric!r}")
    return {n: float(x) for n, x in zip(names, w)}


def optimize_weights(val: DataFrame, members: DataFrame, names: list[str], target: str = "volume",
                     weight: str | None = None) -> tuple[dict[str, float], DataFrame]:
    """Fitted weights and the validation frame with the blended column."""
    joined = val.join(wide(members, names), ROW_KEY)
    weights = fit_weights(joined, names, target, weight=weight)
    return weights, joined.withColumn("blended", sum(F.lit(weights[n]) * F.col(n) for n in names))


def grid_scores(members: DataFrame, actual: DataFrame, aux: DataFrame, names: list[str], scenario,
                metric: str = "official", parts: int = 10) -> DataFrame:
    """Score of every weight vector of a simplex grid; one row per vector.

    The grid is a literal array laid on the rows; partial sums per series and
    vector are formed before the shuffle. The official metric needs them per
    series, rmse and mae only per vector.
    """
    grid = simplex_grid(len(names), parts)
    points = F.array(*[F.struct(F.lit(i).alias("w_id"), *[F.lit(x).alias(f"w_{n}") for x, n in zip(ws, names)])
                       for i, ws in enumerate(grid)])
    rows = (wide(members, names).join(actual.select(*ROW_KEY, F.col("volume").alias("actual")), ROW_KEY)
            .withColumn("_w", F.explode(points)))
    gap = F.col("actual") - sum(F.col(f"_w.w_{n}") * F.col(n) for n in names)
    rows = rows.select(*ROW_KEY, "_w", gap.alias("_gap"))
    weights = [f"_w.w_{n}" for n in names]
    keep = [F.first(F.col(c)).alias(c.split(".")[1]) for c in weights]
    if metric in ("rmse", "mae"):
        score = F.sqrt(F.avg(F.col("_gap") * F.col("_gap"))) if metric == "rmse" else F.avg(F.abs("_gap"))
        return rows.groupBy(F.col("_w.w_id").alias("w_id")).agg(*keep, score.alias("score"))
    if metric != "official":
        raise ValueError(f"unknown metric {metric!r}")
    first, weight, length, parts_ = TERMS[scenario_number(scenario)]
    month, zero = F.col("months_postgx"), F.lit(0.0)
    last = max(hi for _, _, hi, _ in parts_)
    sums = {"_abs": F.sum(F.when(month.between(first, last), F.abs("_gap")))}
    sums |= {f"_s{i}": F.sum(F.when(month.between(lo, hi), F.col("_gap"))) for i, (_, lo, hi, _) in enumerate(parts_)}
    series = rows.groupBy(*SERIES, F.col("_w.w_id").alias("w_id")).agg(
        F.min(month).alias("_first"), *keep, *[v.alias(k) for k, v in sums.items()])
    pe = weight * F.coalesce(F.col("_abs"), zero) / length
    for i, (w, _, _, n) in enumerate(parts_):
        pe = pe + w * F.abs(F.coalesce(F.col(f"_s{i}"), zero)) / n
    scored = (series.where(F.col("_first") == first).join(aux.select(*SERIES, "avg_vol", "bucket"), SERIES, "left")
              .withColumn("pe", F.try_divide(pe, F.col("avg_vol"))))
    return scored.groupBy("w_id").agg(*[F.first(f"w_{n}").alias(f"w_{n}") for n in names],
                                      F.round(weighted_metric(), 4).alias("score"))


def best_grid_weights(scores: DataFrame) -> DataFrame:
    return scores.orderBy("score", "w_id").limit(1)


def confidence(members: DataFrame, level: float = 0.9) -> DataFrame:
    """Mean and percentile band over the members of each row; a group holds one value per member."""
    tail = (1 - level) / 2
    return members.groupBy(*ROW_KEY).agg(
        F.avg("prediction").alias("mean"), F.percentile("prediction", F.lit(tail)).alias("lower"),
        F.percentile("prediction", F.lit(1 - tail)).alias("upper"))


def seed_ensemble(members: DataFrame, method: str = "mean") -> DataFrame:
    if method not in ("mean", "median"):
        raise ValueError(f"unknown method {method!r}")
    agg = F.avg("prediction") if method == "mean" else F.median("prediction")
    return members.groupBy(*ROW_KEY).agg(agg.alias("prediction"))
