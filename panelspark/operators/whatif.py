"""What-if analysis: demand shocks laid on a forecast table.

A shock is a small parameter object. Its factor is a column expression of the
month, so shocks, scenarios and magnitudes are literal arrays on the rows; no
table is crossed with another.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.constants import MONTH, SERIES
from panelspark.functions.expr import clip, flag, ratio, steady_sum
from panelspark.functions.order_stats import order_hash

HORIZON_END = 23


@dataclass(frozen=True)
class Shock:
    """kind: step, impulse, ramp, decay or seasonal; a filter that is None matches everything."""

    name: str
    kind: str
    magnitude: float
    start: int = 0
    duration: int | None = None
    decay: float = 0.1
    countries: tuple[str, ...] | None = None
    brands: tuple[str, ...] | None = None
    ther_areas: tuple[str, ...] | None = None


# The built-in shocks.
PRESETS = {
    "accelerated_erosion": Shock("accelerated_erosion", "ramp", 0.9, 0, 24),
    "supply_disruption": Shock("supply_disruption", "impulse", 0.7, 3, 3),
    "competitive_launch": Shock("competitive_launch", "step", 0.85, 6),
    "formulary_exclusion": Shock("formulary_exclusion", "ramp", 0.6, 0, 12),
    "epidemic_surge": Shock("epidemic_surge", "decay", 1.5, 0, 6, 0.3),
}


def shock_factor(shock: Shock, month: Column | str = MONTH, magnitude: Column | None = None) -> Column:
    """Multiplier of a month; 1 outside [start, start + duration).

    A ramp runs by month from 1 to the magnitude over its duration, or to the
    end of the horizon where it has none.
    """
    m = F.col(month) if isinstance(month, str) else month
    mag = F.lit(float(shock.magnitude)) if magnitude is None else magnitude
    inside = m >= shock.start
    if shock.duration is not None:
        inside = inside & (m < shock.start + shock.duration)
    since = m - shock.start
    if shock.kind in ("step", "impulse"):
        value = mag
    elif shock.kind == "ramp":
        length = shock.duration if shock.duration is not None else HORIZON_END - shock.start + 1
        value = 1 + (mag - 1) * since / max(length - 1, 1)
    elif shock.kind == "decay":
        value = mag * F.exp(-shock.decay * since)
    elif shock.kind == "seasonal":
        value = 1 + (mag - 1) * F.sin(2 * math.pi * F.pmod(m, F.lit(12)) / 12)
    else:
        raise ValueError(f"unknown shock kind {shock.kind!r}")
    return F.when(inside, value).otherwise(1.0)


def _matches(shock: Shock, columns: Sequence[str]) -> Column:
    cond = F.lit(True)
    if shock.countries is not None and "country" in columns:
        cond = cond & F.upper("country").isin([c.upper() for c in shock.countries])
    if shock.brands is not None and "brand_name" in columns:
        cond = cond & F.col("brand_name").isin(list(shock.brands))
    if shock.ther_areas is not None and "ther_area" in columns:
        cond = cond & F.col("ther_area").isin(list(shock.ther_areas))
    return F.coalesce(cond, F.lit(False))


def shocked_volume(shocks: Sequence[Shock], columns: Sequence[str], volume: str = "volume") -> Column:
    """The volume after the shocks in turn, never below 0."""
    out = F.col(volume)
    for s in shocks:
        out = F.greatest(F.when(_matches(s, columns), out * shock_factor(s)).otherwise(out), F.lit(0.0))
    return out


def apply_demand_shock(pred: DataFrame, shock: Shock, volume: str = "volume") -> DataFrame:
    return apply_multiple_shocks(pred, [shock], volume)


def apply_multiple_shocks(pred: DataFrame, shocks: Sequence[Shock], volume: str = "volume") -> DataFrame:
    return pred.withColumn(volume, shocked_volume(shocks, pred.columns, volume))


def compare_scenarios(pred: DataFrame, scenarios: Mapping[str, Sequence[Shock]], volume: str = "volume") -> DataFrame:
    """One row per scenario: change of total and mean, extremes, and what is affected."""
    options = F.array(*[F.struct(F.lit(n).alias("scenario"), shocked_volume(s, pred.columns, volume).alias("adjusted"))
                        for n, s in scenarios.items()])
    rows = pred.withColumn("_s", F.explode(options))
    base, new = F.col(volume), F.col("_s.adjusted")
    change = new - base
    moved = new != base
    return rows.groupBy(F.col("_s.scenario").alias("scenario")).agg(
        (F.sum(new) - F.sum(base)).alias("total_volume_change"),
        F.coalesce(F.when(F.sum(base) > 0, ratio((F.sum(new) - F.sum(base)) * 100, F.sum(base))), F.lit(0.0))
        .alias("total_volume_change_pct"),
        F.avg(change).alias("mean_volume_change"), F.min(change).alias("max_negative_impact"),
        F.max(change).alias("max_positive_impact"), F.sum(flag(moved)).alias("affected_periods"),
        F.count_distinct(F.when(moved, F.struct(*SERIES))).alias("affected_series_count"))


def scenario_predictions(pred: DataFrame, scenarios: Mapping[str, Sequence[Shock]], volume: str = "volume") -> DataFrame:
    """Every row once per scenario: (scenario, key, baseline, adjusted)."""
    options = F.array(*[F.struct(F.lit(n).alias("scenario"), shocked_volume(s, pred.columns, volume).alias("adjusted")) for n, s in scenarios.items()])
    return pred.withColumn("_s", F.explode(options)).select("_s.scenario", *SERIES, MONTH, F.col(volume).alias("baseline"), "_s.adjusted")


def summarize_scenario_impacts(results: DataFrame, baseline: str = "baseline", adjusted: str = "adjusted", by: str = "scenario") -> DataFrame:
    """One row per scenario of a table of adjusted forecasts, whatever made them.

    The table has a row per scenario, series and month; a null counts as no
    change. Changes and totals, the largest fall and rise, and how many periods
    and series moved. Series are first brought to one row each, so a scenario is
    never counted in one task.
    """
    before, after = F.col(baseline), F.coalesce(adjusted, baseline)
    change, moved = after - before, after != before
    per_series = results.groupBy(by, *SERIES).agg(
        steady_sum(before).alias("_b"), steady_sum(change).alias("_c"), F.count(change).alias("_n"), F.min(change).alias("_lo"), F.max(change).alias("_hi"),
        F.sum(flag(moved)).alias("_m"))
    base, total = steady_sum(F.col("_b")), steady_sum(F.col("_c"))
    return per_series.groupBy(by).agg(
        total.alias("total_volume_change"), F.coalesce(F.when(base > 0, ratio(total * 100, base)), F.lit(0.0)).alias("total_volume_change_pct"),
        ratio(total, F.sum("_n")).alias("mean_volume_change"), F.min("_lo").alias("max_negative_impact"), F.max("_hi").alias("max_positive_impact"),
        F.sum("_m").alias("affected_periods"), F.sum(flag(F.col("_m") > 0)).alias("affected_series_count"))


def _month_sums(pred: DataFrame, shock: Shock, volume: str) -> DataFrame:
    """Volumes by month and by whether the shock applies: at most two rows per month.

    A factor depends on nothing else, so any number of magnitudes is then
    evaluated on these few rows. Negative volumes are summed apart because of
    the floor at 0.
    """
    v = F.col(volume)
    return pred.groupBy(MONTH, _matches(shock, pred.columns).alias("_hit")).agg(
        F.sum(F.when(v >= 0, v)).alias("_plus"), F.sum(F.when(v < 0, v)).alias("_minus"),
        F.sum(v).alias("_base"), F.count(v).alias("_rows"))


def _floored(factor: Column) -> Column:
    plus, minus = F.coalesce("_plus", F.lit(0.0)), F.coalesce("_minus", F.lit(0.0))
    return plus * F.greatest(factor, F.lit(0.0)) + minus * F.least(factor, F.lit(0.0))


def sensitivity_analysis(pred: DataFrame, shock: Shock, magnitudes: tuple[float, float] = (0.5, 1.5), n_steps: int = 10,
                         volume: str = "volume") -> DataFrame:
    low, high = magnitudes
    grid = [low + (high - low) * i / (n_steps - 1) for i in range(n_steps)] if n_steps > 1 else [low]
    rows = _month_sums(pred, shock, volume).withColumn("magnitude", F.explode(F.array(*[F.lit(x) for x in grid])))
    factor = F.when(F.col("_hit"), shock_factor(shock, magnitude=F.col("magnitude"))).otherwise(1.0)
    out = rows.groupBy("magnitude").agg(F.sum(_floored(factor)).alias("total_volume"), F.sum("_base").alias("_base"),
                                        F.sum("_rows").alias("_rows"))
    total, base = F.col("total_volume"), F.col("_base")
    return out.select("magnitude", "total_volume", ratio(total, F.col("_rows")).alias("mean_volume"),
                      F.when(base > 0, ratio((total - base) * 100, base)).otherwise(0.0).alias("volume_change_pct"))


def normal_draw(*parts) -> Column:
    """Repeatable standard normal draw: two hash draws through the Box-Muller transform."""
    def unit(tag: str) -> Column:
        bits = F.conv(F.substring(order_hash(*parts, tag), 1, 8), 16, 10).cast("double")
        return (bits + 0.5) / float(2 ** 32)
    return F.sqrt(-2 * F.log(unit("a"))) * F.cos(2 * math.pi * unit("b"))


def monte_carlo(pred: DataFrame, shock: Shock, magnitude_std: float = 0.1, n_simulations: int = 100,
                volume: str = "volume", seed: int = 42) -> DataFrame:
    """Spread of the total volume over drawn magnitudes (clipped to 0.1..3): one row."""
    draws = F.sequence(F.lit(1), F.lit(n_simulations))
    rows = _month_sums(pred, shock, volume).withColumn("sim", F.explode(draws))
    drawn = clip(shock.magnitude + magnitude_std * normal_draw(seed, F.col("sim").cast("string")), 0.1, 3.0)
    factor = F.when(F.col("_hit"), shock_factor(shock, magnitude=drawn)).otherwise(1.0)
    totals = rows.groupBy("sim").agg(F.sum(_floored(factor)).alias("t"), F.sum("_base").alias("b"))
    p = F.percentile("t", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return totals.agg(
        F.count(F.lit(1)).alias("n_simulations"), F.max("b").alias("base_volume"), F.avg("t").alias("mean_volume"),
        F.stddev_pop("t").alias("std_volume"), F.min("t").alias("min_volume"), F.max("t").alias("max_volume"),
        p.alias("_p")).select("*", F.col("_p")[0].alias("percentile_5"), F.col("_p")[1].alias("percentile_50"),
                              F.col("_p")[2].alias("percentile_95")).drop("_p")


def with_magnitude(shock: Shock, magnitude: float) -> Shock:
    return replace(shock, magnitude=magnitude)
