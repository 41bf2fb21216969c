"""Joining holidays, event intervals and macro indicators to the panel.

Intervals are turned into months and matched by equality on (country, month);
the exact date bounds are checked on the match. Matching runs on the distinct
(country, date) pairs, whose number the calendar bounds, never on panel rows
times events. What comes out has one row per country and date (and brand), is
staged, and so joins the panel with a known size: broadcast while it is small,
shuffled beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.constants import MACRO_COLUMNS, POLICY_TYPES, PROMO_TYPES
from panelspark.functions.expr import flag, one_row
from panelspark.functions.stage import stage

COUNT_COLUMNS = ["ext_n_holidays", "ext_is_holiday_month", "ext_epidemic_severity", "ext_epidemic_active",
                 "ext_promo_active", "ext_policy_change"]


def _month(date: Column | str) -> Column:
    return F.trunc(date, "MM")


def join_holidays(panel: DataFrame, holidays: DataFrame, date_col: str = "date") -> DataFrame:
    """Number of holidays in the row's country and month, and a flag."""
    counts = stage(holidays.groupBy("country", _month("date").alias("_month")).agg(
        F.count("holiday_name").cast("int").alias("ext_n_holidays")))
    out = panel.withColumn("_month", _month(date_col)).join(counts, ["country", "_month"], "left").drop("_month")
    n = F.coalesce("ext_n_holidays", F.lit(0))
    return out.withColumns({"ext_n_holidays": n, "ext_is_holiday_month": flag(n > 0)})


def _touched_months(events: DataFrame, dates: DataFrame) -> DataFrame:
    """One row per event and month it touches, cut at the last date asked for."""
    last = one_row(dates.agg(F.max("_date").alias("d")))["d"]
    capped = events.withColumn("_until", F.least(F.col("_end"), last)).where(F.col("_start") <= F.col("_until"))
    months = F.sequence(_month("_start"), _month("_until"), F.expr("INTERVAL 1 MONTH"))
    return capped.withColumn("_month", F.explode(months)).drop("_until")


def panel_dates(panel: DataFrame, date_col: str = "date") -> DataFrame:
    """The distinct (country, date) pairs of a panel, staged: every interval join matches against them."""
    return stage(panel.select("country", F.col(date_col).alias("_date")).where(F.col("_date").isNotNull()).distinct()
                 .withColumn("_month", _month("_date")))


def join_epidemics(panel: DataFrame, epidemics: DataFrame, date_col: str = "date",
                   dates: DataFrame | None = None) -> DataFrame:
    """Highest severity among the epidemics running on the row's date in its country; an open end runs until today."""
    dates = panel_dates(panel, date_col) if dates is None else dates
    events = (epidemics.select("country", F.col("start_date").alias("_start"),
                               F.coalesce("end_date", F.current_date()).alias("_end"), "severity")
              .groupBy("country", "_start", "_end").agg(F.max("severity").alias("severity")))
    running = (dates.join(_touched_months(events, dates), ["country", "_month"])
               .where(F.col("_date").between(F.col("_start"), F.col("_end")))
               .groupBy("country", F.col("_date").alias(date_col))
               .agg(F.max("severity").alias("ext_epidemic_severity")))
    out = panel.join(stage(running), ["country", date_col], "left")
    severity = F.col("ext_epidemic_severity")
    return out.withColumns({"ext_epidemic_active": flag(severity.isNotNull()),
                            "ext_epidemic_severity": F.coalesce(severity, F.lit(0))})


def _monthly_macro(macro: DataFrame) -> DataFrame:
    """Last value of each indicator per country and month, one column each."""
    def last(name: str) -> Column:
        here = (F.col("indicator_name") == name) & F.col("value").isNotNull()
        return F.max(F.when(here, F.struct("date", "value")))["value"].alias(MACRO_COLUMNS[name])

    known = macro.where(F.col("indicator_name").isin(list(MACRO_COLUMNS)))
    return known.groupBy("country", _month("date").alias("_month")).agg(*[last(n) for n in MACRO_COLUMNS])


def join_macro_indicators(panel: DataFrame, macro: DataFrame, date_col: str = "date") -> DataFrame:
    return (panel.withColumn("_month", _month(date_col)).join(stage(_monthly_macro(macro)), ["country", "_month"], "left")
            .drop("_month"))


def join_promo_policy(panel: DataFrame, promo_policy: DataFrame, date_col: str = "date",
                      dates: DataFrame | None = None) -> DataFrame:
    """Flags for promotions and policy changes running on the row's date, for all brands or for the listed ones.

    An event without an end runs for one month. ``brands`` is an array or null.
    """
    kinds = {"ext_promo_active": PROMO_TYPES, "ext_policy_change": POLICY_TYPES}
    dates = panel_dates(panel, date_col) if dates is None else dates
    events = (
        promo_policy.where(F.col("event_type").isin([*PROMO_TYPES, *POLICY_TYPES]))
        .select("country", F.col("start_date").alias("_start"),
                F.coalesce("end_date", F.add_months("start_date", 1)).alias("_end"),
                F.explode(F.coalesce("brands", F.array(F.lit(None).cast("string")))).alias("brand_name"),
                *[flag(F.col("event_type").isin(t)).alias(n) for n, t in kinds.items()])
        .groupBy("country", "_start", "_end", "brand_name").agg(*[F.max(n).alias(n) for n in kinds]))
    covered = (dates.join(_touched_months(events, dates), ["country", "_month"])
               .where(F.col("_date").between(F.col("_start"), F.col("_end")))
               .groupBy("country", F.col("_date").alias(date_col), "brand_name").agg(*[F.max(n).alias(n) for n in kinds]))
    covered = stage(covered)
    everyone = covered.where(F.col("brand_name").isNull()).select(
        "country", date_col, *[F.col(n).alias(f"_all_{n}") for n in kinds])
    listed = covered.where(F.col("brand_name").isNotNull()).select(
        "country", date_col, "brand_name", *[F.col(n).alias(f"_own_{n}") for n in kinds])
    out = panel.join(everyone, ["country", date_col], "left").join(listed, ["country", date_col, "brand_name"], "left")
    zero = F.lit(0)
    return out.withColumns({n: F.greatest(F.coalesce(f"_all_{n}", zero), F.coalesce(f"_own_{n}", zero))
                            for n in kinds}).drop(*[f"{p}{n}" for p in ("_all_", "_own_") for n in kinds])


def fill_external_missing(panel: DataFrame, date_col: str = "date") -> DataFrame:
    """Counts to 0; macro values forward, then backward along each country's months, then the overall mean.

    The filling runs over one row per country and month, so a large country is
    no large window.
    """
    counts = [c for c in COUNT_COLUMNS if c in panel.columns]
    macro = [c for c in MACRO_COLUMNS.values() if c in panel.columns]
    out = panel.withColumns({c: F.coalesce(c, F.lit(0)).cast("int") for c in counts}) if counts else panel
    if not macro:
        return out
    # sums and counts ride along, so the overall means need no second pass over the rows
    monthly = stage(out.groupBy("country", _month(date_col).alias("_month")).agg(
        *[F.max(c).alias(c) for c in macro], *[F.sum(c).alias(f"_s_{c}") for c in macro],
        *[F.count(c).alias(f"_k_{c}") for c in macro], F.count(F.lit(1)).alias("_rows")))
    along = Window.partitionBy("country").orderBy("_month")
    past = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = along.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = stage(monthly.select("*", *[
        F.coalesce(F.last(c, ignorenulls=True).over(past), F.first(c, ignorenulls=True).over(ahead)).alias(f"_f_{c}")
        for c in macro]))
    # rows without a value take their month's fill, so the mean counts the fill once per such row
    total = {c: F.coalesce(f"_s_{c}", F.lit(0.0)) + F.coalesce(f"_f_{c}", F.lit(0.0)) * (F.col("_rows") - F.col(f"_k_{c}"))
             for c in macro}
    n = {c: F.when(F.col(f"_f_{c}").isNotNull(), F.col("_rows")).otherwise(F.col(f"_k_{c}")) for c in macro}
    means = one_row(filled.agg(*[F.try_divide(F.sum(total[c]), F.sum(n[c])).alias(c) for c in macro]))
    fills = filled.select("country", "_month", *[f"_f_{c}" for c in macro])
    return (out.withColumn("_month", _month(date_col)).join(fills, ["country", "_month"], "left").drop("_month")
            .withColumn("_means", means)
            .withColumns({c: F.coalesce(F.col(c), F.col(f"_f_{c}"), F.col("_means")[c]) for c in macro})
            .drop("_means", *[f"_f_{c}" for c in macro]))


def join_external_context(panel: DataFrame, holidays: DataFrame | None = None, epidemics: DataFrame | None = None,
                          macro: DataFrame | None = None, promo_policy: DataFrame | None = None,
                          date_col: str = "date", fill_missing: bool = True) -> DataFrame:
    """All four joins; a table that is not given leaves its columns at their defaults."""
    def zeros(df, *names):
        return df.withColumns({n: F.lit(0) for n in names})

    dates = panel_dates(panel, date_col) if epidemics is not None or promo_policy is not None else None
    out = (join_holidays(panel, holidays, date_col) if holidays is not None
           else zeros(panel, "ext_n_holidays", "ext_is_holiday_month"))
    out = (join_epidemics(out, epidemics, date_col, dates) if epidemics is not None
           else zeros(out, "ext_epidemic_severity", "ext_epidemic_active"))
    out = (join_macro_indicators(out, macro, date_col) if macro is not None
           else out.withColumns({c: F.lit(None).cast("double") for c in MACRO_COLUMNS.values()}))
    out = (join_promo_policy(out, promo_policy, date_col, dates) if promo_policy is not None
           else zeros(out, "ext_promo_active", "ext_policy_change"))
    return fill_external_missing(out, date_col) if fill_missing else out


def external_data_summary(holidays: DataFrame, epidemics: DataFrame, macro: DataFrame,
                          promo_policy: DataFrame) -> DataFrame:
    """Rows, countries, first and last date and the distinct kinds of each external table."""
    def line(name, df, date, kind):
        return df.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("n_records"),
                      F.count_distinct("country").alias("n_countries"),
                      F.min(date).cast("string").alias("first_date"), F.max(date).cast("string").alias("last_date"),
                      F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"))

    parts = [line("holidays", holidays, "date", "holiday_type"), line("epidemics", epidemics, "start_date", "event_name"),
             line("macro", macro, "date", "indicator_name"),
             line("promo_policy", promo_policy, "start_date", "event_type")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
