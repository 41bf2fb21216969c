import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import metrics as G
from panelspark.operators import models as I
from panelspark.operators import target_stats as T


def place(seed, *keys):
    return hashlib.md5("|".join([str(seed), *map(str, keys)]).encode()).hexdigest()


def test_no_row_sees_its_own_target(spark):
    rng = np.random.default_rng(1)
    rows = [("X", f"B{i}", i % 24, ["a", "b", None][int(rng.integers(3))], None if i % 11 == 0 else float(rng.normal())) for i in range(400)]
    df = spark.createDataFrame(rows, "country string, brand_name string, months_postgx int, cat string, y double")
    got = {(r["brand_name"], r["months_postgx"]): r["cat_ots"] for r in T.ordered_target_statistics(df, ["cat"], "y", weight=2.0, seed=7).collect()}
    known = [r[4] for r in rows if r[4] is not None]
    prior = sum(known) / len(known)
    for c, b, m, cat, _ in rows:
        mine = place(7, c, b, m)
        before = [r[4] for r in rows if r[3] == cat and r[4] is not None and place(7, *r[:3]) < mine]
        assert abs(got[b, m] - (sum(before) + 2 * prior) / (len(before) + 2)) < 1e-9
    # a row's own target changes nothing for itself but the prior
    changed = df.withColumn("y", F.when(F.col("brand_name") == "B5", F.col("y") + 400).otherwise(F.col("y")))
    other = {(r["brand_name"], r["months_postgx"]): r["cat_ots"] for r in T.ordered_target_statistics(changed, ["cat"], "y", weight=0.0001, seed=7).collect()}
    same = {(r["brand_name"], r["months_postgx"]): r["cat_ots"] for r in T.ordered_target_statistics(df, ["cat"], "y", weight=0.0001, seed=7).collect()}
    assert abs(other["B5", 5] - same["B5", 5]) < 0.1


def test_unknown_categories_get_the_prior_and_empty_tables_work(spark):
    df = spark.createDataFrame([("X", f"B{i}", 0, "a" if i % 2 else "b", float(i % 2)) for i in range(10)],
                               "country string, brand_name string, months_postgx int, cat string, y_norm double")
    stats = T.TargetStatistics(["cat"]).fit(df)
    new = spark.createDataFrame([("X", "N", 0, "zz", 0.0), ("X", "M", 0, "a", 0.0)], df.schema)
    got = {r["brand_name"]: r["cat_ots"] for r in stats.transform(new).collect()}
    assert got["N"] == 0.5 and abs(got["M"] - 5.5 / 6) < 1e-12
    assert T.ordered_target_statistics(df.limit(0), ["cat"], "y_norm").count() == 0
    with pytest.raises(ValueError):
        T.TargetStatistics(["cat"]).transform(df)


def test_booster_is_no_worse_than_plain_codes(spark):
    """The target depends on a category with many values in no order of theirs."""
    rng = np.random.default_rng(2)
    level = rng.permutation(40) / 40
    rows = [("X", f"B{i}", int(m), f"c{i % 40}", i % 40, float(level[i % 40] + rng.normal(0, 0.05)), 100.0, 1, 100.0 * float(level[i % 40]))
            for i in range(200) for m in range(6)]
    df = spark.createDataFrame(rows, "country string, brand_name string, months_postgx int, cat string, code int, y_norm double, avg_vol_12m double, bucket int, volume double").cache()
    train, val = df.where("substring(brand_name, 2) < 160"), df.where("substring(brand_name, 2) >= 160")
    spec = I.ModelSpec("gbt_fast", {"maxIter": 8, "maxDepth": 3}, ("months_postgx",))
    ordered = T.fit_booster(spec, train, ["cat"]).predict(val)
    coded = I.predict(I.fit(I.ModelSpec("gbt_fast", {"maxIter": 8, "maxDepth": 3}, ("months_postgx", "code")), train), val)

    def rmse(scored):
        return G.point_errors(scored, "y_norm", "prediction").first()["rmse"]

    assert rmse(ordered) <= rmse(coded) and rmse(ordered) < 0.15
    held = I.ModelSpec("gbt_fast", {"maxIter": 8, "maxDepth": 3}, ("months_postgx",), validation="held")
    both = train.withColumn("held", F.expr("substring(brand_name, 2) >= 120"))
    assert rmse(T.fit_booster(held, both, ["cat"]).predict(val)) < 0.2
