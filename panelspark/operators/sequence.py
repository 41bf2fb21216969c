"""Lookback windows of series as arrays."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.constants import MONTH, SERIES
from panelspark.functions.expr import one_row
from panelspark.functions.order_stats import quantiles
from panelspark.functions.stage import stage
from panelspark.operators.panel import by_month, series_window


def _step(features: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in features])


def build_sequences(df: DataFrame, features: list[str], target: str | None = None, lookback: int = 12, horizon: int = 1,
                    static: list[str] = (), min_length: int = 1) -> DataFrame:
    """Every window of ``lookback`` rows that has ``horizon`` rows after it.

    Columns: X_seq (lookback x features), months, mask, the static columns of the
    series' first row and, with a target, y (the next ``horizon`` values).
    """
    w = by_month()
    back = w.rowsBetween(1 - lookback, 0)
    out = {
        "X_seq": F.collect_list(_step(features)).over(back),
        "months": F.collect_list(MONTH).over(back),
        "_n": F.count(F.lit(1)).over(series_window()),
        "_at": F.row_number().over(w),
    }
    out |= {f"_s_{c}": F.min_by(c, MONTH).over(series_window()) for c in static}
    if target is not None:
        out["y"] = F.array(*[F.lead(target, i).over(w).cast("double") for i in range(1, horizon + 1)])
    rows = df.withColumns(out).where((F.col("_at") >= lookback) & (F.col("_at") + horizon <= F.col("_n"))
                                     & (F.col("_n") >= min_length))
    return rows.select(*SERIES, "X_seq", "months", F.array_repeat(F.lit(1), lookback).alias("mask"),
                       *[F.col(f"_s_{c}").alias(c) for c in static], *(["y"] if target is not None else []))


def _ordered(df: DataFrame, features: list[str], static: list[str] = ()) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(MONTH, _step(features).alias("x"))))
    return df.groupBy(*SERIES).agg(F.transform(rows, lambda s: s["x"]).alias("X_seq"),
                                   *[F.min_by(c, MONTH).alias(c) for c in static])


def pad_sequences(df: DataFrame, column: str, max_length: int | None = None, pad_value: float = 0.0,
                  padding: str = "pre") -> DataFrame:
    """Pad or cut the sequence column to one length and add its mask.

    'pre' pads in front and keeps the last steps, 'post' pads behind and keeps
    the first. Without a length the longest sequence sets it.
    """
    if padding not in ("pre", "post"):
        raise ValueError(f"unknown padding {padding!r}")
    longest = (F.lit(max_length) if max_length is not None
               else one_row(df.agg(F.max(F.size(column)).alias("n")))["n"])
    nested = df.schema[column].dataType.elementType.typeName() == "array"
    blank = F.transform(F.col("_seq")[0], lambda _: F.lit(float(pad_value))) if nested else F.lit(float(pad_value))
    rows = df.withColumn("_seq", F.col(column)).withColumn("_max", longest).withColumn("_len", F.size("_seq"))
    keep = F.least("_len", "_max")
    cut = (F.expr("slice(_seq, greatest(_len - _max, 0) + 1, _max)") if padding == "pre"
           else F.expr("slice(_seq, 1, _max)"))
    empty = F.array_repeat(blank, F.greatest(F.col("_max") - F.col("_len"), F.lit(0)))
    off, on = F.array_repeat(F.lit(0), (F.col("_max") - keep).cast("int")), F.array_repeat(F.lit(1), keep.cast("int"))
    if padding == "pre":
        seq, mask = F.concat(empty, cut), F.concat(off, on)
    else:
        seq, mask = F.concat(cut, empty), F.concat(on, off)
    return rows.withColumns({column: seq, "mask": mask}).drop("_seq", "_max", "_len")


def sequences_for_inference(df: DataFrame, features: list[str], lookback: int = 12, static: list[str] = (),
                            pad_value: float = 0.0) -> DataFrame:
    """Last ``lookback`` rows of every series, padded in front, with a mask."""
    return pad_sequences(_ordered(df, features, static), "X_seq", lookback, pad_value, "pre")


def create_time_features(df: DataFrame, time_col: str = MONTH, base_month: int = 0) -> DataFrame:
    t = F.pmod(F.col(time_col), F.lit(12))
    quarter = F.floor(t / 3) % 4
    return df.withColumns({
        "time_relative": F.col(time_col) - base_month,
        "month_sin": F.sin(2 * math.pi * t / 12), "month_cos": F.cos(2 * math.pi * t / 12),
        "quarter_sin": F.sin(2 * math.pi * quarter / 4), "quarter_cos": F.cos(2 * math.pi * quarter / 4)})


@dataclass
class SequenceScaler:
    """standard, minmax or robust per feature over all steps of all windows; parameters stay a one-row DataFrame."""

    method: str = "standard"
    low: float = 0.0
    high: float = 1.0
    params: DataFrame | None = None

    def _table(self, cells: DataFrame) -> DataFrame:
        """(i, center, scale) per feature."""
        x = F.col("x")
        if self.method == "standard":
            return cells.groupBy("i").agg(F.avg(x).alias("center"), (F.stddev_pop(x) + 1e-8).alias("scale"))
        if self.method == "minmax":
            return cells.groupBy("i").agg(F.min(x).alias("center"), (F.max(x) - F.min(x) + 1e-8).alias("scale"))
        if self.method == "robust":
            q = quantiles(cells, ["i"], "x", {"a": 0.25, "m": 0.5, "b": 0.75})
            return q.select("i", F.col("m").alias("center"), (F.col("b") - F.col("a") + 1e-8).alias("scale"))
        raise ValueError(f"unknown scaling method {self.method!r}")

    def fit(self, windows: DataFrame, target: str | None = None) -> SequenceScaler:
        cells = windows.select(F.explode("X_seq").alias("s")).select(F.posexplode("s").alias("i", "x"))
        table = self._table(cells)
        params = table.agg(F.array_sort(F.collect_list(F.struct("i", "center", "scale"))).alias("seq"))
        if target is not None:
            y = windows.select(F.explode(target).alias("x"))
            low_high = y.agg(F.avg("x").alias("mean"), (F.stddev_pop("x") + 1e-8).alias("std"), F.min("x").alias("min"),
                             (F.max("x") - F.min("x") + 1e-8).alias("range"))
            params = params.withColumn("target", one_row(low_high))
        self.params = stage(params)
        return self

    def _p(self):
        if self.params is None:
            raise ValueError("fit the scaler first")
        return one_row(self.params)

    def transform(self, windows: DataFrame, target: str | None = None) -> DataFrame:
        rows = windows.withColumn("_p", self._p())
        span = self.high - self.low

        def scaled(x: Column, p: Column) -> Column:
            z = (x - p["center"]) / p["scale"]
            return z * span + self.low if self.method == "minmax" else z

        out = rows.withColumn("X_seq", F.transform("X_seq", lambda step: F.zip_with(step, F.col("_p.seq"), scaled)))
        if target is not None and self.method != "robust":
            t = F.col("_p.target")
            center, scale = (t["mean"], t["std"]) if self.method == "standard" else (t["min"], t["range"])
            out = out.withColumn(target, F.transform(target, lambda x: (x - center) / scale))
        return out.drop("_p")

    def inverse_transform_target(self, df: DataFrame, column: str) -> DataFrame:
        if self.method == "robust":
            return df
        t = F.col("_p.target")
        center, scale = (t["mean"], t["std"]) if self.method == "standard" else (t["min"], t["range"])
        return df.withColumn("_p", self._p()).withColumn(
            column, F.transform(column, lambda x: x * scale + center)).drop("_p")


def prepare_sequences(train: DataFrame, features: list[str], target: str, val: DataFrame | None = None,
                      lookback: int = 12, horizon: int = 1, scale: bool = True, method: str = "standard"
                      ) -> tuple[DataFrame, DataFrame | None, SequenceScaler | None]:
    """Training and validation windows, both scaled by the training windows."""
    made = build_sequences(train, features, target, lookback, horizon)
    checked = build_sequences(val, features, target, lookback, horizon) if val is not None else None
    if not scale:
        return made, checked, None
    scaler = SequenceScaler(method).fit(made, "y")
    return scaler.transform(made, "y"), (scaler.transform(checked, "y") if checked is not None else None), scaler
