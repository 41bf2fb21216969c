"""Exact ranks and quantiles that never put one whole group into one task.

A plain ``row_number`` over a hot key sorts that key in a single task, and a
plain ``percentile`` keeps every distinct value of it in one hash map. Quantiles
go down a radix tree: rows are counted in order-preserving buckets (with
map-side combine), the bucket that holds a quantile is split again between its
least and its largest value, and so on until few distinct values are left, so
that values close together cost a further round and no large group. Ranks come
from ranges of (value, salt) of equal size, with the counts of the values at
their edges, so a value that most rows have is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.stage import stage

STEPS_PER_OCTAVE = 128
OCTAVES = 1100


def order_hash(*parts) -> Column:
    """md5 over the parts joined by '|': a repeatable draw that any SQL engine can repeat."""
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def hash_bucket(hash_col: Column) -> Column:
    """First three hex digits: 4096 buckets in the order of the hash."""
    return F.substring(hash_col, 1, 3)


def magnitude_bucket(value: Column) -> Column:
    """Monotone integer bucket of a double, 128 per octave, so their number does not grow with the rows."""
    octave = F.least(F.log2(F.abs(value)), F.lit(1024.0)) + F.lit(float(OCTAVES))
    step = F.floor(octave * F.lit(float(STEPS_PER_OCTAVE))).cast("long")
    return F.when(value > 0, step).when(value < 0, -step).otherwise(F.lit(0).cast("long"))


def spread_rank(df: DataFrame, group: str, order: list[Column], bucket: Column, out: str) -> DataFrame:
    """``row_number`` within ``group`` in ``order``; ``bucket`` must rise with the first order column.

    ``group`` is one non-null column.
    """
    tagged = df.withColumn("_bucket", bucket)
    along = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .select(group, "_bucket", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(group, "_bucket").orderBy(*order)
    return (
        tagged.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [group, "_bucket"])
        .withColumn(out, F.col("_offset") + F.col("_inside"))
        .drop("_bucket", "_inside", "_offset")
    )


INSIDE = 20_000  # rows of different values that one task may order at the end of a descent
CELLS = 4096  # cells that a bucket is split into


def _chosen(counts: DataFrame, along_keys: list[str]) -> DataFrame:
    """Of counted cells those that hold the lower or the upper row of their quantile, with what lies before them.

    ``counts`` has _before, the rows before all cells of one descent. The cells of
    a descent are bounded in number, so the window along them is too.
    """
    along = Window.partitionBy(*along_keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    moved = counts.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_n").over(along), F.lit(0)))
    return moved.where((F.col("_before") <= F.ceil("_pos")) & (F.col("_before") + F.col("_n") > F.floor("_pos")))


def quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float],
              weight: Column | None = None, inside: int = INSIDE) -> DataFrame:
    """Exact quantiles with linear interpolation per group; columns ``by`` + names of ``probs``.

    The first round counts magnitude buckets, whose number is bounded, and finds
    the one or two that hold each quantile. A bucket with more than ``inside``
    rows and more than one value is cut into CELLS cells between its least and largest value
    and counted again: a bucket spans less than 2**46 doubles, so four rounds
    reach single values. What is left is ordered. Only rows of chosen buckets
    travel after the first round. Null keys and null values are left out;
    infinite values are ordered like all others. ``weight`` is an integer count
    of how often a row stands in the sample. The chosen cells are staged, one
    row or two per quantile and group, and one number per round comes to the
    driver.
    """
    keys = by or ["_all"]
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v))
    for k in by:
        rows = rows.where(F.col(k).isNotNull())
    w = weight if weight is not None else F.lit(1)
    rows = rows.select(*(by or [F.lit(0).alias("_all")]), v.alias("_v"), w.cast("long").alias("_w"),
                       magnitude_bucket(v).alias("_bucket"))
    measures = (F.sum("_w").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_rows"))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in sorted(set(probs.values()))]))
    first = rows.groupBy(*keys, "_bucket").agg(*measures).withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
    first = first.withColumns({"_p": wanted, "_cell": F.col("_bucket"), "_before": F.lit(0).cast("long")}).withColumn(
        "_pos", (F.col("_total") - 1) * F.col("_p"))
    columns = [*keys, "_p", "_bucket", "_lo", "_hi", "_before", "_pos", "_rows"]
    held = stage(_chosen(first, [*keys, "_p"]).select(*columns))
    here = F.col("_v").between(F.col("_lo"), F.col("_hi"))
    done = []
    wide = (F.col("_rows") > inside) & (F.col("_lo") < F.col("_hi"))
    while held.where(wide).limit(1).count():
        done.append(held.where(~wide))
        inner = rows.join(held.where(wide).withColumnsRenamed({"_lo": "_l", "_hi": "_h"}).drop("_rows"), [*keys, "_bucket"]).where(F.col("_v").between(F.col("_l"), F.col("_h")))
        share = (F.col("_v") / 2 - F.col("_l") / 2) / (F.col("_h") / 2 - F.col("_l") / 2)
        cells = inner.withColumn("_cell", F.least(F.floor(share * CELLS), F.lit(CELLS - 1)).cast("long"))
        counts = cells.groupBy(*keys, "_p", "_bucket", "_l", "_h", "_before", "_pos", "_cell").agg(*measures)
        held = stage(_chosen(counts, [*keys, "_p", "_bucket", "_l", "_h"]).select(*columns))
    for part in done:
        held = held.unionByName(part)
    along = Window.partitionBy(*keys, "_p", "_bucket", "_lo", "_hi").orderBy("_v")
    placed = (
        rows.join(held, [*keys, "_bucket"]).where(here)
        .groupBy(*keys, "_p", "_bucket", "_lo", "_hi", "_before", "_pos", "_v").agg(F.sum("_w").alias("_n"))
        .withColumn("_from", F.col("_before") + F.sum("_n").over(along) - F.col("_n"))
        .withColumn("_to", F.col("_from") + F.col("_n"))
        .where((F.col("_from") <= F.ceil("_pos")) & (F.col("_to") > F.floor("_pos")))
    )

    def holds(position: Column) -> Column:
        return (F.col("_from") <= position) & (F.col("_to") > position)

    picks = []
    for name, p in probs.items():
        mine = F.col("_p") == F.lit(float(p))
        low = F.max(F.when(mine & holds(F.floor("_pos")), F.col("_v")))
        high = F.max(F.when(mine & holds(F.ceil("_pos")), F.col("_v")))
        part = F.max(F.when(mine, F.col("_pos") - F.floor("_pos")))
        picks.append(F.when(low == high, low).otherwise(low + (high - low) * part).alias(name))
    result = placed.groupBy(*keys).agg(*picks)
    return result if by else result.drop("_all")


def median(df: DataFrame, by: list[str], value: str, out: str, weight: Column | None = None) -> DataFrame:
    return quantiles(df, by, value, {out: 0.5}, weight)


def group_and_overall_median(df: DataFrame, group: str, value: str, out: str, overall_out: str,
                             weight: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Median per group, and the median over all rows once nulls are filled with their group's median.

    Both come from one staged histogram, so ``df`` is read once. The group table
    is staged too: its size is then known when it is joined, and it is broadcast
    only if it is small. ``weight`` is an integer count of the rows that a row of
    ``df`` stands for.
    """
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    hist = stage(df.groupBy(group, F.col(value).cast("double").alias(value)).agg(rows.alias("_w")))
    per_group = stage(quantiles(hist, [group], value, {out: 0.5}, F.col("_w")))
    filled = hist.join(per_group, group, "left").withColumn(value, F.coalesce(value, out))
    overall = quantiles(filled, [], value, {overall_out: 0.5}, F.col("_w"))
    return per_group, overall


def column_quantiles(df: DataFrame, columns: list[str], probs: dict[str, float], weight: str | None = None) -> DataFrame:
    """One row per column with its quantiles; a column without values has no row. ``weight`` names an integer count of the rows that a row stands for."""
    kept = [weight] if weight else []
    long = df.select(*kept, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(kept, columns, "column", "_x")
    return quantiles(long, ["column"], "_x", probs, F.col(weight) if weight else None)


def column_medians(df: DataFrame, columns: list[str], weight: str | None = None) -> DataFrame:
    """One row holding the median of each column under the column's own name."""
    table = column_quantiles(df, columns, {"m": 0.5}, weight)
    return table.agg(*[F.max(F.when(F.col("column") == c, F.col("m"))).alias(c) for c in columns])


def average_rank(df: DataFrame, value: str, out: str, per_task: int = 1_000_000) -> DataFrame:
    """Rank of the value over all rows, ties sharing their mean rank, starting at 1; a null has none.

    Rows are dealt by ranges of (value, salt) of about ``per_task`` rows. Inside
    a range everything is known but for its first and its last value, which may
    go on in other ranges: one row per range tells how many rows have those and
    how many come before. No row is joined on its value.
    """
    part, salt, n = "__rank_part", "__rank_salt", df.count()
    ranges = max(1, -(-n // per_task))
    rows = df.withColumn(salt, F.xxhash64(F.monotonically_increasing_id()))
    ranged = stage(rows.repartitionByRange(ranges, F.col(value).asc_nulls_last(), F.col(salt)).withColumn(part, F.spark_partition_id()).drop(salt))
    known = F.col(value).isNotNull()
    edges = stage(ranged.where(known).groupBy(part).agg(F.min(value).alias("lo"), F.max(value).alias("hi")))  # a row per range
    sizes = ranged.where(known).select(part, F.col(value).alias("v")).join(edges, part).groupBy(part, "lo", "hi").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("v") == F.col("lo"), 1)).alias("at_lo"), F.count(F.when(F.col("v") == F.col("hi"), 1)).alias("at_hi"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("before", before)
    ends = F.explode(F.array(F.struct(F.col("lo").alias("v"), F.col("at_lo").alias("n"), F.col("before").alias("less")),
                             F.struct(F.col("hi").alias("v"), F.col("at_hi").alias("n"), (F.col("before") + F.col("n") - F.col("at_hi")).alias("less"))))
    # a value at both ends of a range stands there once
    spread = sizes.select(part, "lo", "hi", ends.alias("e")).distinct().groupBy(F.col("e.v").alias("v")).agg(F.sum("e.n").alias("all"), F.min("e.less").alias("less"))
    table = stage(sizes.join(spread.select(F.col("v").alias("lo"), F.col("all").alias("lo_all"), F.col("less").alias("lo_less")), "lo")
                  .join(spread.select(F.col("v").alias("hi"), F.col("all").alias("hi_all"), F.col("less").alias("hi_less")), "hi"))
    own = Window.partitionBy(part).orderBy(F.col(value).asc_nulls_last())
    same = Window.partitionBy(part, value)
    at = F.struct(*[F.col(c) for c in ("lo", "hi", "before", "lo_all", "lo_less", "hi_all", "hi_less")]).alias("__rank_at")
    inner = ranged.withColumns({"__rank_less": F.rank().over(own) - 1, "__rank_same": F.count("*").over(same)}).join(table.select(part, at), part, "left")
    v, at = F.col(value), F.col("__rank_at")
    less = F.when(v == at["lo"], at["lo_less"]).when(v == at["hi"], at["hi_less"]).otherwise(at["before"] + F.col("__rank_less"))
    tied = F.when(v == at["lo"], at["lo_all"]).when(v == at["hi"], at["hi_all"]).otherwise(F.col("__rank_same"))
    ranked = inner.withColumn("__rank", F.when(known, less + (tied + 1) / 2))
    return ranked.select(*[F.col(f"`{c}`") for c in df.columns if c != out], F.col("__rank").alias(out))
