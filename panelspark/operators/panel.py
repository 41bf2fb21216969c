"""Building the panel: joins, cleaning, pre-event statistics, expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.constants import BUCKET_THRESHOLD, MONTH, MONTH_NAMES, ROW_KEY, SERIES, require
from panelspark.functions.expr import attach, clip, flag, month_between, ratio, steady_avg, steady_parts, steady_total
from panelspark.functions.order_stats import group_and_overall_median, median, order_hash
from panelspark.functions.stage import stage


def series_window():
    """All rows of a series; at most 48 months, so no window over it grows with the data."""
    return Window.partitionBy(*SERIES)


def by_month():
    return series_window().orderBy(MONTH)


def prepare_base_panel(volume: DataFrame, generics: DataFrame, medicine_info: DataFrame) -> DataFrame:
    """volume left join generics on the row key, left join medicine_info on the series key.

    The competitor counts of a series (at most 48 months) travel as one map,
    so all three tables meet on the series key: volume is shuffled once, and the
    series windows that follow find their partitioning already there. No side is
    hinted; Spark's size threshold decides on broadcasting. The row key has to
    be unique in ``generics``, which quality.duplicate_keys checks.
    """
    require(volume, [*ROW_KEY, "volume"], "volume")
    require(generics, [*ROW_KEY, "n_gxs"], "generics")
    require(medicine_info, SERIES, "medicine_info")
    counts = generics.where(F.col(MONTH).isNotNull()).groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct(
        F.col(MONTH).cast("double").alias("m"), F.col("n_gxs").alias("n")))).alias("_c"))
    # a map is searched without a function call per entry; of a month's entries the least stays, as a map has each key once
    first = F.filter("_c", lambda c, i: (i == 0) | (F.get("_c", i - 1)["m"] != c["m"]))
    counts = counts.select(*SERIES, F.map_from_entries(first).alias("_counts"))
    joined = volume.join(counts, SERIES, "left").withColumn("n_gxs", F.col("_counts")[F.col(MONTH).cast("double")]).drop("_counts")
    return joined.select(*volume.columns, "n_gxs").join(medicine_info, SERIES, "left")


def handle_missing_values(panel: DataFrame) -> DataFrame:
    """Forward-fill n_gxs; hospital_rate by area then overall median; Unknown strings; false booleans.

    ``*_missing`` flags tell which values were filled.
    """
    filled = panel.withColumns({
        "hospital_rate_missing": flag(F.col("hospital_rate").isNull()),
        "biological_missing": flag(F.col("biological").isNull()),
        "small_molecule_missing": flag(F.col("small_molecule").isNull()),
    })
    area, overall = group_and_overall_median(panel, "ther_area", "hospital_rate", "_area_rate", "_all_rate")
    filled = filled.join(area, "ther_area", "left")
    running = by_month().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = attach(filled, overall).withColumns({
        "n_gxs": F.coalesce(F.last("n_gxs", ignorenulls=True).over(running), F.lit(0)),
        "hospital_rate": F.coalesce("hospital_rate", "_area_rate", "_all_rate"),
        "ther_area": F.coalesce("ther_area", F.lit("Unknown")),
        "main_package": F.coalesce("main_package", F.lit("Unknown")),
        "biological": F.coalesce("biological", F.lit(False)),
        "small_molecule": F.coalesce("small_molecule", F.lit(False)),
    })
    extra = ["hospital_rate_missing", "biological_missing", "small_molecule_missing"]
    return filled.select(*panel.columns, *extra)


def _own_by_series(panel: DataFrame, year: Column, before: Column) -> DataFrame:
    """(ther_area, _own, _rows) of each series: what the medians need, with no row sorted for them.

    A series has one area as a rule; rows of another one are a row of their own
    and share the means of the whole series.
    """
    parts = {"y": year, "b": before}
    per_area = panel.groupBy(*SERIES, "ther_area").agg(
        F.count(F.lit(1)).alias("_rows"), *[p.alias(f"_{n}{i}") for n, x in parts.items() for i, p in enumerate(steady_parts(x))],
        *[F.count(x).alias(f"_k{n}") for n, x in parts.items()])
    whole = {n: F.try_divide(steady_total(*[F.sum(f"_{n}{i}").over(series_window()) for i in range(2)]), F.sum(f"_k{n}").over(series_window()))
             for n in parts}
    return per_area.select("ther_area", F.coalesce(whole["y"], whole["b"]).alias("_own"), "_rows")


def compute_pre_entry_stats(panel: DataFrame, is_train: bool = True,
                            bucket_threshold: float = BUCKET_THRESHOLD) -> DataFrame:
    """avg_vol_12m with its fallbacks; for training also y_norm, mean_erosion and bucket."""
    year = F.when(month_between(-12, -1), F.col("volume"))
    before = F.when(F.col(MONTH) < 0, F.col("volume"))
    own = panel.withColumns({
        "pre_entry_months_available": F.count(year).over(series_window()),
        "_own": F.coalesce(steady_avg(year, series_window()), steady_avg(before, series_window())),
    })
    area, overall = group_and_overall_median(_own_by_series(panel, year, before), "ther_area", "_own", "_area", "_overall", F.col("_rows"))
    done = attach(own.join(area, "ther_area", "left"), overall).withColumn(
        "avg_vol_12m", F.coalesce("_own", "_area", "_overall"))
    columns = [*panel.columns, "avg_vol_12m", "pre_entry_months_available"]
    if not is_train:
        return done.select(*columns)
    return add_target(done, bucket_threshold).select(*columns, "y_norm", "mean_erosion", "bucket")


def add_target(panel: DataFrame, bucket_threshold: float = BUCKET_THRESHOLD) -> DataFrame:
    y = F.coalesce(ratio(F.col("volume"), F.col("avg_vol_12m")), F.lit(1.0))
    scored = panel.withColumn("y_norm", y)
    post = F.when(month_between(0, 23), F.col("y_norm"))
    # each y_norm is a rounded quotient, so digits after the 15th are noise: without them a mean such as 63 / 128 is met
    mean = F.round(steady_avg(post, series_window()), 15)
    return scored.withColumn("mean_erosion", mean).withColumn(
        "bucket", F.when(F.col("mean_erosion") <= bucket_threshold, 1).when(F.col("mean_erosion").isNotNull(), 2))


def build_panel(volume: DataFrame, generics: DataFrame, medicine_info: DataFrame,
                is_train: bool = True) -> DataFrame:
    """The whole panel; the joined tables are written once, since each median and the panel itself read them again."""
    base = stage(prepare_base_panel(volume, generics, medicine_info))
    return compute_pre_entry_stats(handle_missing_values(base), is_train)


def unit_draw(*parts) -> Column:
    """Repeatable number in [0, 1) from a hash of the parts."""
    return F.conv(F.substring(order_hash(*parts), 1, 8), 16, 10).cast("double") / F.lit(float(2 ** 32))


def augment_panel(panel: DataFrame, jitter: float = 0.05, drop_prob: float = 0.05,
                  months: tuple[int, int] = (0, 23), seed: int = 42) -> DataFrame:
    """Jitter the volume, drop months at random unless 80% of a series would go, keep a month range."""
    keys = [F.col(c).cast("string") for c in ROW_KEY]
    noise = (unit_draw(seed, "jitter", *keys) * 2 - 1) * jitter
    drawn = panel.withColumns({
        "volume": F.greatest(F.col("volume") * (1 + noise), F.lit(0.0)),
        "_drop": flag(unit_draw(seed, "drop", *keys) < drop_prob),
    })
    share = F.avg("_drop").over(series_window())
    return (drawn.withColumn("_share", share)
            .where((F.col("_drop") == 0) | (F.col("_share") >= 0.8))
            .where(month_between(*months)).drop("_drop", "_share"))


def month_number(month: Column) -> Column:
    """Jan..Dec -> 1..12; null for other text."""
    at = F.position(F.substring(month, 1, 3), F.lit(MONTH_NAMES))
    return F.when((at > 0) & ((at - 1) % 3 == 0), ((at - 1) / 3 + 1).cast("int"))


def month_name(number: Column) -> Column:
    return F.substring(F.lit(MONTH_NAMES), (number - 1) * 3 + 1, F.lit(3))


def expand_panel(panel: DataFrame, start_month: int, end_month: int) -> DataFrame:
    """Add the missing forecast months to every series.

    Static columns are carried over from the last known row, the calendar month
    moves on from it, volume and y_norm stay null, and n_gxs is filled forward,
    then backward.
    """
    moving = [c for c in ("volume", "n_gxs", "y_norm") if c in panel.columns]
    static = [c for c in panel.columns if c not in [*ROW_KEY, "month", *moving]]
    last = panel.groupBy(*SERIES).agg(
        F.max(MONTH).alias("_last"), F.max_by("month", MONTH).alias("_month"),
        F.collect_set(MONTH).alias("_known"),
        *[F.min_by(c, MONTH).alias(c) for c in static])
    wanted = F.sequence(F.lit(start_month), F.lit(end_month))
    number = (F.coalesce(month_number(F.col("_month")), F.lit(1)) - 1 + F.col(MONTH) - F.col("_last"))
    added = (
        last.withColumn(MONTH, F.explode(F.array_except(wanted, "_known")))
        .select(*SERIES, MONTH, month_name(F.pmod(number, F.lit(12)) + 1).alias("month"), *static,
                *[F.lit(None).cast(panel.schema[c].dataType).alias(c) for c in moving])
    )
    both = panel.unionByName(added.select(*panel.columns))
    past = by_month().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = by_month().rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return both.withColumn("n_gxs", F.coalesce(F.last("n_gxs", ignorenulls=True).over(past),
                                               F.first("n_gxs", ignorenulls=True).over(ahead)))


def detect_test_scenarios(volume: DataFrame) -> DataFrame:
    """Series with any row in months 0..5 belong to scenario 2, the others to 1."""
    return volume.groupBy(*SERIES).agg(
        F.min(MONTH).alias("min_month"), F.max(MONTH).alias("max_month"),
        F.when(F.max(flag(month_between(0, 5))) == 1, 2).otherwise(1).alias("scenario"))


# --- row selection and projection ---------------------------------------------------------------


def select_rows(panel: DataFrame, low: int, high: int) -> DataFrame:
    return panel.where(month_between(low, high))


def simulate_scenario(panel: DataFrame, cutoff: int, high: int) -> tuple[DataFrame, DataFrame]:
    """Rows visible before the cutoff, and the target rows from it on."""
    return panel.where(F.col(MONTH) < cutoff), panel.where(month_between(cutoff, high))


def series_ids(panel: DataFrame) -> DataFrame:
    return panel.select(*SERIES).distinct()


def series_count(panel: DataFrame) -> DataFrame:
    return series_ids(panel).agg(F.count(F.lit(1)).alias("n_series"))


def clip_predictions(df: DataFrame, column: str = "y_norm", low: float = 0.0, high: float = 2.0) -> DataFrame:
    return df.withColumn(column, clip(F.col(column), low, high))


def handle_missing_pre_entry_data(panel: DataFrame, fallback: float = 1000.0) -> DataFrame:
    """A missing or non-positive avg_vol_12m becomes the median of the valid ones, or the fallback."""
    valid = F.col("avg_vol_12m") > 0
    overall = median(panel.where(valid), [], "avg_vol_12m", "_valid_median")
    # quantiles over no row at all give no row, so a one-row aggregate keeps the subquery scalar
    overall = overall.agg(F.coalesce(F.max("_valid_median"), F.lit(fallback)).alias("_valid_median"))
    filled = F.when(valid, F.col("avg_vol_12m")).otherwise(F.col("_valid_median"))
    return attach(panel, overall).withColumn("avg_vol_12m", filled).select(*panel.columns)


#: Columns whose precision matters keep their type; whole numbers of a panel fit an int whatever its rows.
PRECISE = ("y_norm", "volume", "avg_vol_12m", "mean_erosion", "hospital_rate")
WHOLE = (MONTH, "n_gxs", "pre_entry_months_available", "bucket", "month_of_year", "quarter")


def narrow_types(df: DataFrame, keep=PRECISE, types: dict[str, str] | None = None) -> DataFrame:
    """Narrower types by a fixed rule, the same for every table: doubles to float, the WHOLE columns and flags to int.

    Flags are columns that begin with is_ or has_ or end with _missing. Other
    longs stay. ``types`` adds or overrides single columns. The type never
    follows the values; a value that does not fit its type is an error.
    """
    def target(name: str, kind: str) -> str | None:
        if types and name in types:
            return types[name]
        if name in keep:
            return None
        if kind == "bigint" and (name in WHOLE or name.startswith(("is_", "has_", "n_gxs_")) or name.endswith("_missing")):
            return "int"
        return "float" if kind == "double" else None

    return df.withColumns({c: F.col(f"`{c}`").cast(t) for c, kind in df.dtypes if (t := target(c, kind))})
