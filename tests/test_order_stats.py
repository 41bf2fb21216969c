import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions import order_stats as o
from panelspark.functions.expr import steady_avg, steady_sum


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=40))
def test_quantiles_equal_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = o.quantiles(df, [], "x", {"a": 0.05, "m": 0.5, "z": 0.99}).first()
    want = np.percentile(values, [5, 50, 99])
    assert np.allclose([got["a"], got["m"], got["z"]], want, rtol=1e-9, atol=1e-9)


def test_quantiles_with_one_hot_value_nulls_and_groups(spark):
    rows = [("a", 7.0)] * 300 + [("a", float(i)) for i in range(50)] + [("b", -1.0), ("b", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r["m"] for r in o.median(df, ["g"], "x", "m").collect()}
    assert got == {"a": 7.0, "b": -1.0}


def test_quantiles_weight_counts_rows(spark):
    df = spark.createDataFrame([(1.0, 3), (10.0, 1)], "x double, w int")
    assert o.quantiles(df, [], "x", {"m": 0.5}, F.col("w")).first()["m"] == 1.0


def test_spread_rank_equals_row_number(spark):
    df = spark.range(2000).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise("cold")).withColumn(
        "h", o.order_hash(7, F.col("id").cast("string")))
    plain = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("h"))).select("id", F.col("r").cast("long"))
    spread = o.spread_rank(df, "g", [F.col("h")], o.hash_bucket(F.col("h")), "r").select("id", "r")
    assert spread.exceptAll(plain).count() == 0 and spread.count() == 2000


def test_average_rank_shares_ties(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (3.0,), (-2.0,)], "x double")
    assert sorted((r["x"], r["r"]) for r in o.average_rank(df, "x", "r").collect()) == [
        (-2.0, 1.0), (1.0, 2.0), (3.0, 3.5), (3.0, 3.5)]


@pytest.mark.parametrize("a,b", [(-5.0, -4.9), (-1e-9, 0.0), (0.0, 1e-300), (1.0, 1.0001), (2.0, 1e308)])
def test_magnitude_bucket_rises_with_the_value(spark, a, b):
    row = spark.createDataFrame([(a, b)], "a double, b double").select(
        o.magnitude_bucket(F.col("a")).alias("a"), o.magnitude_bucket(F.col("b")).alias("b")).first()
    assert row["a"] <= row["b"]


def test_quantiles_of_close_values_go_down_in_rounds(spark):
    """All values lie in one magnitude bucket, and one of them has most rows."""
    rng = np.random.default_rng(8)
    values = np.concatenate([1000 + rng.uniform(0, 1e-6, 3000), np.full(3000, 1000.0), 1000 + rng.uniform(0, 1.0, 500), [np.inf, -5.0]])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    for probs in ({"a": 0.01, "m": 0.5, "b": 0.77, "z": 0.999},):
        got = o.quantiles(df, [], "x", probs, inside=50).first()
        for name, p in probs.items():
            assert abs(got[name] - np.quantile(values, p)) <= 1e-12 * 1000, name
    ids = spark.range(50_000).selectExpr("id", "id % 3 AS g")
    got = {r["g"]: r["m"] for r in o.quantiles(ids, ["g"], "id", {"m": 0.5}, inside=10).collect()}
    assert got == {g: float(np.median(np.arange(g, 50_000, 3))) for g in range(3)}


def test_rank_of_a_value_that_most_rows_have(spark):
    """90 % of the rows have one value; it is spread over ranges of 500 rows, and no task ranks more than a few."""
    values = [7.0] * 9000 + [float(i % 400) for i in range(1000)] + [None] * 3
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    sizes = []
    staged = o.stage

    def watched(x):
        out = staged(x)
        if "__rank_part" in out.columns and "i" in out.columns:
            sizes.extend(r["count"] for r in out.groupBy("__rank_part").count().collect())
        return out

    o.stage = watched
    try:
        ranked = o.average_rank(df, "v", "r", per_task=500)
    finally:
        o.stage = staged
    got = {r["i"]: r["r"] for r in ranked.collect()}
    known = np.array([v for v in values if v is not None])
    less = {v: int((known < v).sum()) for v in set(known)}
    same = {v: int((known == v).sum()) for v in set(known)}
    assert all(got[i] == (None if v is None else less[v] + (same[v] + 1) / 2) for i, v in enumerate(values))
    assert len(sizes) >= 18 and max(sizes) < 1500
    assert o.average_rank(df.limit(0), "v", "r").count() == 0


def test_steady_sums_do_not_follow_the_order(spark):
    rng = np.random.default_rng(9)
    values = [float(x) for x in rng.normal(0, 1, 2000) * 10.0 ** rng.integers(-8, 9, 2000)]
    seen = set()
    for parts, order in ((1, values), (7, values[::-1]), (13, sorted(values))):
        df = spark.createDataFrame([(v,) for v in order], "x double").repartition(parts)
        seen.add((df.agg(steady_sum(F.col("x")).alias("s")).first()["s"], df.agg(steady_avg(F.col("x")).alias("s")).first()["s"]))
    assert len(seen) == 1
    assert abs(seen.pop()[0] - math.fsum(values)) <= 1e-12 * abs(math.fsum(values)) + 1e-14
    odd = spark.createDataFrame([(1e300,), (2.5,), (None,)], "x double")
    assert odd.agg(steady_sum(F.col("x")).alias("s")).first()["s"] == 1e300
    assert odd.where("x IS NULL").agg(steady_sum(F.col("x")).alias("s")).first()["s"] is None
