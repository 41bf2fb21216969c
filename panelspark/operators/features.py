"""Feature groups of the panel.

All per-series statistics are window aggregates over the series key. They share
one exchange and one sort, need no join back, and a series has at most 48 rows.
Only months before the scenario's cutoff feed them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.constants import (EPS, INJECTION_WORDS, MONTH, NEVER_FEATURES, ORAL_WORDS, SERIES, VISIBILITY_COLUMNS,
                                  scenario_window)
from panelspark.functions.expr import any_of, clip, flag, numeric_columns, one_row, ratio
from panelspark.functions.order_stats import column_medians, hash_bucket, order_hash, spread_rank
from panelspark.functions.stage import stage
from panelspark.operators.panel import by_month, month_number, series_window


def _c(name: str) -> Column:
    return F.col(name)


def _when(cond: Column, column: str = "volume") -> Column:
    return F.when(cond, _c(column))


def _series(agg: Column) -> Column:
    return agg.over(series_window())


def _or(x: Column, default) -> Column:
    return F.coalesce(x, default if isinstance(default, Column) else F.lit(float(default)))


def _slope(cond: Column) -> Column:
    return _series(F.regr_slope(_when(cond), F.when(cond, _c(MONTH).cast("double"))))


def add_pre_entry_features(panel: DataFrame) -> DataFrame:
    """Level, trend, spread and growth of the months before the event."""
    m, vol, a = _c(MONTH), _c("volume"), _c("avg_vol_12m")
    pre = m < 0
    stats = panel.withColumns({
        "avg_vol_6m": _or(_series(F.avg(_when(m.between(-6, -1)))), a),
        "avg_vol_3m": _or(_series(F.avg(_when(m.between(-3, -1)))), a),
        "pre_entry_trend": _or(_slope(pre), 0),
        "_sd": _series(F.stddev_samp(_when(pre))),
        "pre_entry_max": _or(_series(F.max(_when(pre))), a),
        "pre_entry_min": _or(_series(F.min(_when(pre))), a),
    })
    base = a + EPS
    return stats.withColumns({
        "pre_entry_trend_norm": _c("pre_entry_trend") / base,
        "pre_entry_volatility": _or(_c("_sd") / base, 0),
        "pre_entry_max_ratio": _c("pre_entry_max") / base,
        "pre_entry_min_ratio": _c("pre_entry_min") / base,
        "pre_entry_range_ratio": (_c("pre_entry_max") - _c("pre_entry_min")) / base,
        "log_avg_vol": F.log1p(a),
        "log_avg_vol_6m": F.log1p(_c("avg_vol_6m")),
        "log_avg_vol_3m": F.log1p(_c("avg_vol_3m")),
        "volume_growth_rate": (_c("avg_vol_3m") - a) / base,
        "vol_ratio_6m_12m": _c("avg_vol_6m") / base,
        "vol_ratio_3m_12m": _c("avg_vol_3m") / base,
        "vol_ratio_3m_6m": _c("avg_vol_3m") / (_c("avg_vol_6m") + EPS),
    }).drop("_sd")


def add_seasonal_features(panel: DataFrame) -> DataFrame:
    """Month-of-year shape of the pre-event volume; neutral values under 6 rows or without volume."""
    pre = _c(MONTH) < 0
    known = panel.withColumn("_moy", month_number(_c("month")))
    level = [_series(F.avg(_when(pre & (_c("_moy") == k)))) for k in range(1, 13)]
    shaped = known.withColumns({
        "_rows": _series(F.count(F.when(pre, F.lit(1)))),
        "_mean": _series(F.avg(_when(pre))),
        "_level": F.array(*level),
    }).withColumn("_r", F.transform("_level", lambda x: F.try_divide(x, _c("_mean"))))
    usable = (_c("_rows") >= 6) & (_c("_mean") > 0)
    high, low = F.array_max("_r"), F.array_min("_r")

    def pick(value: Column, default: float) -> Column:
        return F.when(usable, value).otherwise(F.lit(default))

    def quarter(q: int) -> Column:
        held = F.filter(F.slice("_r", 3 * q - 2, 3), lambda x: x.isNotNull())
        total = F.aggregate(held, F.lit(0.0), lambda acc, x: acc + x)
        return F.coalesce(ratio(total, F.size(held)) - 1, F.lit(0.0))

    out = {
        "seasonal_amplitude": pick(high - low, 0.0),
        "seasonal_peak_month": F.when(usable, F.array_position("_r", high).cast("int")).otherwise(6),
        "seasonal_trough_month": F.when(usable, F.array_position("_r", low).cast("int")).otherwise(1),
        "seasonal_ratio": pick(F.when(low > 0, F.least(high / (low + EPS), F.lit(5.0))).otherwise(1.0), 1.0),
    }
    out |= {f"seasonal_q{q}_effect": pick(quarter(q), 0.0) for q in range(1, 5)}
    return shaped.withColumns(out).drop("_moy", "_rows", "_mean", "_level", "_r")


def add_time_features(panel: DataFrame) -> DataFrame:
    """Month powers, phase flags, calendar position (January where the month is unknown) and decay curves."""
    m = _c(MONTH)
    phase = F.when(m < 0, "pre").when(m <= 5, "early").when(m <= 11, "mid").otherwise("late")
    dated = panel.withColumns({"time_bucket": phase, "month_of_year": F.coalesce(month_number(_c("month")), F.lit(1))})
    moy = _c("month_of_year")
    turn = moy * (2 * math.pi / 12)
    after = m >= 0
    dated = dated.withColumn("quarter", F.ceil(moy / 3).cast("int"))
    return dated.withColumns({
        "months_postgx_sq": F.pow(m, F.lit(2.0)),
        "months_postgx_cube": F.pow(m, F.lit(3.0)),
        "is_post_entry": flag(after),
        "is_early": flag(m.between(0, 5)),
        "is_mid": flag(m.between(6, 11)),
        "is_late": flag(m >= 12),
        "month_sin": F.sin(turn),
        "month_cos": F.cos(turn),
        **{f"is_q{q}": flag(_c("quarter") == q) for q in range(1, 5)},
        "is_year_end": flag(moy == 12),
        "is_year_start": flag(moy == 1),
        "time_decay": F.when(after, F.exp(m * -0.1)).otherwise(0.0),
        "time_decay_fast": F.when(after, F.exp(m * -0.2)).otherwise(0.0),
        "sqrt_months_postgx": F.sqrt(F.greatest(m, F.lit(0))),
    })


def add_generics_features(panel: DataFrame, cutoff: int = 0) -> DataFrame:
    """Competitor counts: now, at the event, before the cutoff, and how fast they came."""
    m, n = _c(MONTH), _c("n_gxs")
    seen = m < cutoff
    stats = panel.withColumns({
        "n_gxs_at_entry": F.coalesce(_series(F.max(_when(m == 0, "n_gxs"))), F.lit(0)),
        "n_gxs_pre_cutoff_max": F.coalesce(_series(F.max(_when(seen, "n_gxs"))), F.lit(0)),
        "first_generic_month": _series(F.min(_when(seen & (n > 0), MONTH))),
        "_from": _series(F.min(_when(seen, MONTH))),
        "_to": _series(F.max(_when(seen, MONTH))),
        "_first_n": _series(F.min_by(_when(seen, "n_gxs"), _when(seen, MONTH))),
        "_last_n": _series(F.max_by(_when(seen, "n_gxs"), _when(seen, MONTH))),
    })
    bins = (F.when(n <= 0, "none").when(n <= 1, "one").when(n <= 3, "few").when(n <= 10, "several").otherwise("many"))
    return stats.withColumns({
        "has_generic": flag(n > 0),
        "multiple_generics": flag(n >= 2),
        "many_generics": flag(n >= 5),
        "months_since_first_generic": F.coalesce(m - _c("first_generic_month"), F.lit(-999)),
        "had_generic_pre_entry": flag(_c("first_generic_month") < 0),
        "generic_entry_speed": _or((_c("_last_n") - _c("_first_n")) / (_c("_to") - _c("_from") + 1 + EPS), 0),
        "log_n_gxs": F.log1p(n),
        "log_n_gxs_at_entry": F.log1p(_c("n_gxs_at_entry")),
        "n_gxs_bin": bins,
    }).drop("_from", "_to", "_first_n", "_last_n")


def add_future_generics_features(panel: DataFrame, cutoff: int = 0) -> DataFrame:
    """Known future competitor counts; n_gxs is an outside plan, so looking ahead leaks nothing."""
    m, n = _c(MONTH), _c("n_gxs")
    ahead = m.between(cutoff, 23)
    stats = panel.withColumns({
        "n_gxs_at_month_12": F.coalesce(_series(F.max(_when(m == 12, "n_gxs"))), n),
        "n_gxs_at_month_23": F.coalesce(_series(F.max(_when(m == 23, "n_gxs"))), n),
        "_now": F.coalesce(_series(F.max(_when(m == max(cutoff - 1, 0), "n_gxs"))), F.lit(0)),
        "n_gxs_max_forecast": F.coalesce(_series(F.max(_when(ahead, "n_gxs"))), n),
        "_low": _series(F.min(_when(ahead, "n_gxs"))),
    })
    return stats.withColumns({
        "n_gxs_change_to_12": _c("n_gxs_at_month_12") - _c("_now"),
        "n_gxs_change_to_23": _c("n_gxs_at_month_23") - _c("_now"),
        "expected_new_generics": F.greatest(F.coalesce(_c("n_gxs_max_forecast") - _c("_low"), F.lit(0)), F.lit(0)),
        "log_n_gxs_at_month_12": F.log1p(_c("n_gxs_at_month_12")),
        "log_n_gxs_at_month_23": F.log1p(_c("n_gxs_at_month_23")),
        "log_n_gxs_max_forecast": F.log1p(_c("n_gxs_max_forecast")),
    }).drop("_now", "_low")


def _by_category(df: DataFrame, columns, keep=(), others: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row and column as (kind, value, ...): several groupings then share one aggregate.

    Partial sums are formed before the shuffle, so the copies never travel.
    """
    named = {c: _c(c) for c in columns} | (others or {})
    parts = F.array(*[F.struct(F.lit(n).alias("kind"), x.cast("string").alias("value")) for n, x in named.items()])
    return df.select(*keep, F.explode(parts).alias("_p")).select(*keep, "_p.kind", "_p.value")


def _attach_category(df: DataFrame, table: DataFrame, kind: str, value: Column, columns) -> DataFrame:
    """Left join of one kind of a staged category table; its size is known, so Spark decides on broadcasting."""
    own = table.where(_c("kind") == kind).select(_c("value").alias("_value"), *columns)
    return df.withColumn("_value", value.cast("string")).join(own, "_value", "left").drop("_value")


CATEGORIES = ("ther_area", "main_package", "country")


def category_codes(df: DataFrame, columns=CATEGORIES) -> DataFrame:
    """(kind, value, _code): the place of each value among its column's sorted distinct values, from 0.

    The fitted half of ``label_codes``; keep it with the model that was trained on the codes.
    """
    values = _by_category(df, columns).where(_c("value").isNotNull()).distinct()
    ranked = spread_rank(values, "kind", [_c("value")], F.substring("value", 1, 3), "_rank")
    return stage(ranked.select("kind", "value", (_c("_rank") - 1).cast("int").alias("_code")))


def label_codes(df: DataFrame, columns: dict[str, str], codes: DataFrame | None = None) -> DataFrame:
    """Code of each value under a new name, by a table of ``category_codes`` or by the frame's own values; null and unknown become -1."""
    codes = category_codes(df, columns) if codes is None else codes
    out = df
    for name, code in columns.items():
        out = _attach_category(out, codes, name, _c(name), ["_code"]).withColumn(
            code, F.coalesce("_code", F.lit(-1))).drop("_code")
    return out


def add_drug_features(panel: DataFrame, encode=CATEGORIES, codes: DataFrame | None = None, bins=(30, 70)) -> DataFrame:
    """Hospital share, package form, category codes (of the training data, if its table is given) and two products.

    ``bins`` part the hospital share into low, medium and high, and tell retail
    from hospital drugs.
    """
    rate, pack = _c("hospital_rate"), F.lower("main_package")
    low, high = bins
    if not low < high:
        raise ValueError("the bins of the hospital rate must rise")

    def mentions(words) -> Column:
        return flag(any_of([pack.contains(w) for w in words]))

    out = panel.withColumns({
        "hospital_rate_bin": F.when(rate <= low, "low").when(rate <= high, "medium").otherwise("high"),
        "hospital_rate_norm": rate / 100,
        "is_hospital_drug": flag(rate > high),
        "is_retail_drug": flag(rate < low),
        "is_injection": mentions(INJECTION_WORDS),
        "is_oral": mentions(ORAL_WORDS),
        "biological_x_n_gxs": _c("biological").cast("int") * _c("n_gxs"),
        "hospital_rate_x_time": rate / 100 * _c(MONTH),
    })
    return label_codes(out, {name: f"{name}_encoded" for name in encode}, codes)


def add_early_erosion_features(panel: DataFrame) -> DataFrame:
    """Scenario 2: what months 0 to 5 tell."""
    m, base = _c(MONTH), _c("avg_vol_12m") + EPS
    stats = panel.withColumns({
        "avg_vol_0_5": _series(F.avg(_when(m.between(0, 5)))),
        "avg_vol_0_2": _series(F.avg(_when(m.between(0, 2)))),
        "avg_vol_3_5": _series(F.avg(_when(m.between(3, 5)))),
        "_v0": _series(F.max(_when(m == 0))),
        "trend_0_5": _or(_slope(m.between(0, 5)), 0),
        "competition_response": F.coalesce(
            _series(F.max(_when(m == 5, "n_gxs"))) - _series(F.max(_when(m == 0, "n_gxs"))), F.lit(0)),
    })
    a02, a35, v0 = _c("avg_vol_0_2"), _c("avg_vol_3_5"), _c("_v0")
    return stats.withColumns({
        "erosion_0_5": _or(_c("avg_vol_0_5") / base, 1),
        "trend_0_5_norm": _c("trend_0_5") / base,
        "drop_month_0": _or(v0 / base, 1),
        "month_0_to_3_change": _or((a02 - v0) / (v0 + EPS), 0),
        "month_3_to_5_change": _or((a35 - a02) / (a02 + EPS), 0),
        "erosion_0_2": a02 / base,
        "erosion_3_5": a35 / base,
        "recovery_signal": flag(a35 > a02),
        "recovery_magnitude": clip((a35 - a02) / (a02 + EPS), -1, 1),
        "erosion_per_generic": _or(ratio(_c("trend_0_5"), _c("competition_response") + 1), 0),
    }).drop("_v0")


def add_interaction_features(df: DataFrame, pairs) -> DataFrame:
    """Product of each pair of columns that exist; a value that is no number counts as missing, and missing as 0."""
    def number(name: str) -> Column:
        return F.expr(f"try_cast(`{name}` AS DOUBLE)")

    known = [(a, b) for a, b in pairs if a in df.columns and b in df.columns]
    return df.withColumns({f"{a}_x_{b}": _or(number(a) * number(b), 0) for a, b in known}) if known else df


def add_target_encoding_features(df: DataFrame, scenario=1, columns=("ther_area", "country"), n_folds: int = 5,
                                 smoothing: float = 10, seed: int = 42) -> DataFrame:
    """Out-of-fold smoothed category means of y_norm; folds are drawn by series.

    Category sums are kept per fold, and a row's own fold is taken off the total,
    so every category costs one aggregate instead of one pass per fold.
    """
    _, low, high = scenario_window(scenario)
    target = df.where(_c(MONTH).between(low, high))
    series = target.select(*SERIES).distinct().withColumns(
        {"_h": order_hash(seed, *[_c(k) for k in SERIES]), "_all": F.lit(0)})
    folds = stage(spread_rank(series, "_all", [_c("_h"), *[_c(k) for k in SERIES]], hash_bucket(_c("_h")), "_place")
                  .select(*SERIES, ((_c("_place") - 1) % n_folds).cast("int").alias("_fold")))
    tagged = target.join(folds, SERIES).withColumn("_y", _c("y_norm"))
    per_fold = _by_category(tagged, columns, ["_fold", "_y"], {"_all": F.lit("")}).groupBy("kind", "value", "_fold").agg(
        F.sum("_y").alias("s"), F.count("_y").alias("n"))
    table = stage(per_fold.groupBy("kind", "value").agg(F.sum("s").alias("_s"), F.sum("n").alias("_n"), F.map_from_entries(
        F.collect_list(F.struct("_fold", F.struct("s", "n")))).alias("_by_fold")))
    mean = table.where(_c("kind") == "_all").agg((F.max("_s") / F.max("_n")).alias("m"))
    out = df.join(folds, SERIES, "left").withColumn("_mean", mean.scalar())
    for name in columns:
        own = F.element_at("_by_fold", _c("_fold"))
        n = _c("_n") - F.coalesce(own["n"], F.lit(0))
        s = _c("_s") - F.coalesce(own["s"], F.lit(0.0))
        smooth = (s + _c("_mean") * smoothing) / (n + smoothing)
        out = (_attach_category(out, table, name, _c(name), ["_s", "_n", "_by_fold"])
               .withColumn(f"{name}_erosion_prior",
                           F.when(_c("_fold").isNotNull() & (n > 0), smooth).otherwise(_c("_mean")))
               .drop("_s", "_n", "_by_fold"))
    if "ther_area" in columns:
        prior = _c("ther_area_erosion_prior")
        if "erosion_0_5" in df.columns:
            out = out.withColumn("ther_area_x_early_erosion", prior * _c("erosion_0_5"))
        out = out.withColumn("ther_area_erosion_x_time", prior * _c(MONTH))
    return out.drop("_fold", "_mean")


def add_frequency_encoding_features(df: DataFrame, columns, normalize: bool = True) -> DataFrame:
    """Share (or count) of each value among the non-null values of its column; null gives 0."""
    table = _by_category(df, columns).where(_c("value").isNotNull()).groupBy("kind", "value").agg(
        F.count(F.lit(1)).cast("double").alias("_n"))
    table = stage(table)
    out = df
    for name in columns:
        total = table.where(_c("kind") == name).agg(F.sum("_n").alias("t")).scalar() if normalize else F.lit(1.0)
        out = _attach_category(out, table, name, _c(name), ["_n"]).withColumn("_t", total)
        out = out.withColumn(f"{name}_freq", _or(_c("_n") / _c("_t"), 0)).drop("_n", "_t")
    return out


def add_visibility_features(panel: DataFrame, visibility: DataFrame | None, date_col: str = "date") -> DataFrame:
    """Join the monthly supply metrics on series and month; gaps get the column's median, then 0."""
    if visibility is None:
        return panel.withColumns({c: F.lit(0.0) for c in VISIBILITY_COLUMNS})
    have = [c for c in VISIBILITY_COLUMNS if c in visibility.columns]
    monthly = visibility.select(*SERIES, _c("period").alias("_period"), *have)
    dated = panel.withColumn("_period", F.trunc(date_col, "MM"))
    # only the months that the panel has are kept, once: the medians weigh them by the rows that they meet
    keys = dated.groupBy(*SERIES, "_period").agg(F.count(F.lit(1)).alias("_n"))
    met = stage(keys.join(monthly, [*SERIES, "_period"]))
    medians = one_row(column_medians(met, have, "_n"))
    # the months of a series travel as one array: the panel meets them where its series windows left it, and is not dealt again
    months = met.groupBy(*SERIES).agg(F.collect_list(F.struct("_period", *have)).alias("_months"))
    joined = dated.join(months, SERIES, "left").withColumn(
        "_v", F.explode_outer(F.filter("_months", lambda x: x["_period"] == _c("_period"))))
    filled = {c: _or(F.coalesce(_c("_v")[c], _c("_m")[c]), 0) for c in have} | {c: F.lit(0.0) for c in VISIBILITY_COLUMNS if c not in have}
    return joined.withColumn("_m", medians).withColumns(filled).select(*panel.columns, *filled)


def add_loo_priors(df: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """Mean of y_norm over the other rows of the group, per output name and grouping expression.

    The group mean for a single row, the overall mean for a null group. Sums of
    all groupings come from one aggregate with map-side combine, so a group that
    holds a third of the rows never sits in one task.
    """
    sums = stage(_by_category(df, [], ["y_norm"], groups | {"_all": F.lit("")}).groupBy("kind", "value").agg(
        F.sum("y_norm").alias("_s"), F.count("y_norm").alias("_n")))
    overall = sums.where(_c("kind") == "_all").agg((F.max("_s") / F.max("_n")).alias("m")).scalar()
    value = F.when(_c("_n") > 1, (_c("_s") - _c("y_norm")) / (_c("_n") - 1)).otherwise(ratio(_c("_s"), _c("_n")))
    out = df.withColumn("_overall", overall)
    for name, group in groups.items():
        out = _attach_category(out, sums, name, group, ["_s", "_n"]).withColumn(
            name, F.coalesce(value, _c("_overall"))).drop("_s", "_n")
    return out.drop("_overall")


def add_loo_prior(df: DataFrame, group: str, out: str) -> DataFrame:
    return add_loo_priors(df, {out: _c(group)})


def hospital_segment(rate: Column) -> Column:
    return (F.when((rate > -1) & (rate <= 30), "retail").when((rate > 30) & (rate <= 70), "mixed")
            .when((rate > 70) & (rate <= 100), "hospital"))


def add_collaboration_features(df: DataFrame) -> DataFrame:
    """Leave-one-out erosion priors by country, area, hospital segment and package."""
    return add_loo_priors(df, {
        "collab_country_erosion_prior": _c("country"), "collab_ther_area_erosion_prior": _c("ther_area"),
        "collab_hospital_erosion_prior": hospital_segment(_c("hospital_rate")),
        "collab_package_erosion_prior": _c("main_package")})


def add_sequence_features(panel: DataFrame, lags=(1, 2, 3, 6), windows=(3, 6, 12)) -> DataFrame:
    """Lags, rolling means, differences, momentum, acceleration and rolling variation of the volume."""
    vol, base, w = _c("volume"), _c("avg_vol_12m") + EPS, by_month()

    def back(k: int) -> Column:
        return F.lag("volume", k).over(w)

    def rolling(k: int):
        return w.rowsBetween(1 - k, 0)

    out = {f"seq_volume_lag_{k}": _or(back(k) / base, 1) for k in lags}
    out |= {f"seq_volume_ma_{k}": _or(F.avg("volume").over(rolling(k)) / base, 1) for k in windows}
    out |= {f"seq_volume_diff_{k}": _or((vol - back(k)) / base, 0) for k in (1, 3)}
    out |= {f"seq_momentum_{k}": _or(clip(ratio(vol, back(k)) - 1, -1, 1), 0) for k in (3, 6)}
    out["seq_acceleration"] = _or((vol - 2 * back(1) + back(2)) / base, 0)
    out |= {f"seq_volatility_{k}": _or(ratio(F.stddev_samp("volume").over(rolling(k)),
                                             F.avg("volume").over(rolling(k))), 0) for k in (3, 6)}
    return panel.withColumns(out)


DEFAULT_FEATURES = {"pre_entry": {}, "time": {}, "generics": {}, "drug": {}, "scenario2_early": {}, "interactions": [], "target_encoding": False,
                    "collaboration": False, "sequence": False, "frequency": [], "visibility": None}

#: What goes when an option of a group is turned off. Windows that nothing asks for are never computed.
OPTIONS = {
    "pre_entry": {
        "compute_trend": ["pre_entry_trend", "pre_entry_trend_norm"],
        "compute_volatility": ["pre_entry_volatility"],
        "compute_max": ["pre_entry_max", "pre_entry_max_ratio", "pre_entry_range_ratio"],
        "compute_min": ["pre_entry_min", "pre_entry_min_ratio", "pre_entry_range_ratio"],
        "log_transform": ["log_avg_vol", "log_avg_vol_6m", "log_avg_vol_3m"],
        "compute_seasonal": ["seasonal_amplitude", "seasonal_peak_month", "seasonal_trough_month", "seasonal_ratio", *[f"seasonal_q{q}_effect" for q in range(1, 5)]]},
    "time": {
        "include_squared": ["months_postgx_sq", "months_postgx_cube"],
        "include_is_post_entry": ["is_post_entry"],
        "include_time_bucket": ["time_bucket", "is_early", "is_mid", "is_late"],
        "include_month_of_year": ["month_of_year", "month_sin", "month_cos", "is_year_end", "is_year_start"],
        "include_quarters": ["quarter", *[f"is_q{q}" for q in range(1, 5)]],
        "include_decay": ["time_decay", "time_decay_fast", "sqrt_months_postgx"]},
    "generics": {
        "include_has_generic": ["has_generic"],
        "include_multiple_generics": ["multiple_generics", "many_generics"],
        "include_cummax": ["n_gxs_pre_cutoff_max"],
        "include_first_month": ["first_generic_month", "months_since_first_generic", "had_generic_pre_entry"],
        "include_entry_speed": ["generic_entry_speed"],
        "include_future_n_gxs": ["n_gxs_at_month_12", "n_gxs_at_month_23", "n_gxs_max_forecast", "n_gxs_change_to_12", "n_gxs_change_to_23", "expected_new_generics",
                                 "log_n_gxs_at_month_12", "log_n_gxs_at_month_23", "log_n_gxs_max_forecast"]},
    "drug": {"derive_is_injection": ["is_injection", "is_oral"]},
    "scenario2_early": {
        "compute_avg_0_5": ["avg_vol_0_5", "avg_vol_0_2", "avg_vol_3_5"],
        "compute_erosion_0_5": ["erosion_0_5", "erosion_0_2", "erosion_3_5"],
        "compute_trend_0_5": ["trend_0_5", "trend_0_5_norm"],
        "compute_drop_month_0": ["drop_month_0"],
        "compute_change_windows": ["month_0_to_3_change", "month_3_to_5_change"],
        "compute_recovery_signal": ["recovery_signal", "recovery_magnitude"],
        "compute_competition_response": ["competition_response", "erosion_per_generic"]},
}


def _dropped(config: dict) -> list[str]:
    """Columns of the options that the config turns off; an option it does not know is an error."""
    out = []
    for group, options in OPTIONS.items():
        for name, on in (config[group] or {}).items():
            if name in options and not on:
                out += options[name]
            elif name not in options and name not in {"drug": ("hospital_rate_bins", "categoricals")}.get(group, ()):
                raise ValueError(f"unknown option {group}.{name}")
    return out


def make_features(panel: DataFrame, scenario, mode: str = "train", config: dict | None = None, codes: DataFrame | None = None) -> DataFrame:
    """All feature groups under the scenario's cutoff; ``codes`` are category codes of the training data.

    The config turns whole groups off (``False``) or single options of them
    (see OPTIONS), and turns on what is off by default: interactions (pairs),
    target_encoding, collaboration, frequency (columns), sequence, and
    visibility: the monthly supply metrics, or {"data": metrics, "date_col":
    name} where the panel's date is not called date. Options of drug are also
    hospital_rate_bins and categoricals.
    """
    config = {**DEFAULT_FEATURES, **(config or {})}
    unknown = set(config) - set(DEFAULT_FEATURES)
    if unknown:
        raise ValueError(f"unknown feature groups {sorted(unknown)}")
    gone = _dropped(config)
    cutoff, _, _ = scenario_window(scenario)
    out = panel
    # the category joins come first: they need plain columns only, and the series windows then share one exchange
    if config["drug"] is not False:
        drug = config["drug"] or {}
        out = add_drug_features(out, drug.get("categoricals", CATEGORIES), codes, drug.get("hospital_rate_bins", (30, 70)))
    if config["pre_entry"] is not False:
        out = add_seasonal_features(add_pre_entry_features(out))
    if config["time"] is not False:
        out = add_time_features(out)
    if config["generics"] is not False:
        out = add_future_generics_features(add_generics_features(out, cutoff), cutoff)
    if cutoff > 0 and config["scenario2_early"] is not False:
        out = add_early_erosion_features(out)
    out = add_interaction_features(out, config["interactions"])
    if mode == "train":
        if config["target_encoding"]:
            out = add_target_encoding_features(out, scenario)
        if config["collaboration"]:
            out = add_collaboration_features(out)
    if config["frequency"]:
        out = add_frequency_encoding_features(out, config["frequency"])
    if config["visibility"] is not None:
        given = config["visibility"] if isinstance(config["visibility"], dict) else {"data": config["visibility"]}
        out = add_visibility_features(out, given.get("data"), given.get("date_col", "date"))
    if config["sequence"]:
        # Values at and after the cutoff are hidden from lags and rolling windows.
        hidden = out.withColumn("_kept", _c("volume")).withColumn("volume", _when(_c(MONTH) < cutoff))
        out = add_sequence_features(hidden).withColumn("volume", _c("_kept")).drop("_kept")
    return out.drop(*[c for c in gone if c not in panel.columns])


META = [*SERIES, MONTH, "volume", "avg_vol_12m", "bucket", "mean_erosion", "y_norm"]


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns that may enter a model."""
    return [c for c in numeric_columns(df) if c not in NEVER_FEATURES]


def split_features_target_meta(df: DataFrame, include_month: bool = True) -> tuple[list[str], str, list[str]]:
    """Three column lists over one frame: features, target, meta. Rows are joined by key, never by order."""
    features = [c for c in feature_columns(df) if include_month or c != MONTH]
    if "y_norm" not in df.columns:
        raise ValueError("the frame has no y_norm target")
    return features, "y_norm", [c for c in META if c in df.columns]


def feature_matrix(df: DataFrame) -> DataFrame:
    """Inference projection: key and numeric features, nulls as 0."""
    features = [c for c in feature_columns(df) if c not in (MONTH,)]
    return df.select(*SERIES, MONTH, *[F.coalesce(_c(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
