import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelspark.operators import quality as Q
from panelspark.operators import splits as S


@pytest.fixture(scope="module")
def many(spark):
    """60 series x 10 months; two thirds of the series lie in one bucket and one area."""
    rows = [("X", f"B{i}", m, 2 if i % 3 else 1, f"T{i % 4 if i % 3 else 9}") for i in range(60) for m in range(-4, 6)]
    return spark.createDataFrame(rows, "country string, brand_name string, months_postgx int, bucket int, ther_area string").cache()


def test_split_is_stratified_disjoint_and_complete(many):
    split = S.series_split(many, 0.2)
    assert split.count() == 60 and split.where("split = 'val'").count() == 12
    rows = S.validation_split(many)
    train, val = rows.where("split = 'train'"), rows.where("split = 'val'")
    assert Q.split_violations(many, train, val).count() == 0
    assert val.where("bucket = 1").select("brand_name").distinct().count() == 4
    assert S.series_split(many, 0.2).exceptAll(split).count() == 0


def test_rare_strata_are_drawn_together(spark):
    rows = [("X", f"B{i}", 0, "big" if i < 38 else f"rare{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "country string, brand_name string, months_postgx int, kind string")
    assert S.series_split(df, 0.2, ["kind"]).count() == 40


def test_folds_are_balanced_and_cover_everything(many):
    folds = S.fold_series(many, 5)
    sizes = [r["n"] for r in folds.groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert sorted(sizes) == [12] * 5


def test_grouped_folds_keep_groups_whole(many):
    folds = S.grouped_folds(many, 3)
    assert folds.groupBy("ther_area").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert folds.count() == 60


@settings(max_examples=25, deadline=None)
@given(months=st.sets(st.integers(-24, 23), min_size=1), folds=st.integers(1, 8), least=st.integers(-6, 20))
def test_temporal_cutoffs_stay_in_range(months, folds, least):
    cutoffs = S.temporal_cutoffs(sorted(months), folds, least)
    assert all(max(least, 0) <= c or c >= 0 for c in cutoffs) and len(cutoffs) <= max(folds - 1, 0)


def test_temporal_folds_train_before_the_cutoff(many):
    out = S.temporal_cv(many, 3, 1, 1)
    assert out.where("part = 'train' AND months_postgx > cutoff - 1").count() == 0
    assert out.where("part = 'val' AND months_postgx <= cutoff").count() == 0


def test_purged_folds_leave_a_gap(many):
    out = S.purged_cv(many, 3, gap_months=2, min_train_rows=1, min_val_rows=1)
    assert out.select("fold").distinct().count() == 3
    assert out.where("part = 'train' AND months_postgx > -2").count() == 0 and out.where("part = 'val' AND months_postgx < 0").count() == 0
    shared = out.where("part = 'train'").select("fold", "brand_name").intersect(out.where("part = 'val'").select("fold", "brand_name"))
    assert shared.count() == 0
    assert S.purged_cv(many, 3, min_train_rows=10 ** 6).count() == 0


def test_nested_folds(many):
    out = S.nested_cv(many, 3, 2)
    assert out.count() == 180 and out.where("part = 'val'").count() == 60
    assert out.where("part = 'train' AND inner_fold IS NULL").count() == 0


def test_fold_statistics(spark):
    rows = [(m, k, "rmse", v) for m, vs in (("a", [1.0, 2.0, 3.0]), ("b", [2.0, 4.0, float("nan")])) for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "model string, fold int, metric string, value double")
    got = {r["model"]: r for r in S.aggregate_scores(df, ["model", "metric"]).collect()}
    assert got["a"]["mean"] == 2.0 and got["a"]["std"] == 1.0 and got["b"]["n_folds"] == 2
    assert got["a"]["ci_upper"] == pytest.approx(2 + 4.302653 / math.sqrt(3))
    table = S.comparison_table(df, "rmse").orderBy("rank").collect()
    assert [r["model"] for r in table] == ["a", "b"] and table[0]["is_best"] == 1


def test_paired_t_test(spark):
    rows = [("a", k, "m", v) for k, v in enumerate([1.0, 2.0, 4.0, 5.0])] + [("b", k, "m", v) for k, v in enumerate([2.0, 2.5, 5.5, 6.0])]
    df = spark.createDataFrame(rows, "model string, fold int, metric string, value double")
    r = S.paired_t_test(df, "a", "b", "m").first()
    assert r["t_statistic"] == pytest.approx(-4.898979, abs=1e-5) and r["p_value"] == pytest.approx(0.016276, abs=1e-5)
    assert r["is_significant"] == 1


def test_ranges_duplicates_and_gaps(spark):
    rows = [("X", "A", 0, -1.0), ("X", "A", 0, 2.0), ("X", "A", 3, None), ("X", "A", 40, 1.0)]
    df = spark.createDataFrame(rows, "country string, brand_name string, months_postgx int, volume double")
    got = {r["column"]: (r["below_min"], r["above_max"]) for r in Q.value_range_violations(df).collect()}
    assert got == {"months_postgx": (0, 1), "volume": (1, 0)}
    assert Q.duplicate_keys(df, ["country", "brand_name", "months_postgx"]).first()["n_rows"] == 2
    gap = Q.date_continuity(df.where("months_postgx < 10")).first()
    assert gap["missing_months"] == [1, 2] and gap["gap_count"] == 2
    assert Q.date_continuity(df.where("months_postgx = 0"), (-12, 23)).count() == 1


def test_submission_checks(spark):
    cols = "country string, brand_name string, months_postgx int, volume double"
    template = spark.createDataFrame([("X", "A", m, None) for m in range(3)], cols)
    good = spark.createDataFrame([("X", "A", m, 1.0) for m in range(3)], cols)
    assert Q.submission_violations(good, template).where("n <> 0").count() == 0
    assert Q.submission_checklist(good, template).where("check = 'all_passed'").first()["passed"] == 1
    bad = spark.createDataFrame([("X", "A", 0, float("inf")), ("X", "A", 0, -1.0), ("X", "A", 30, None)], cols)
    got = {r["check"]: r["n"] for r in Q.submission_violations(bad, template).collect()}
    assert got["duplicate_keys"] == 1 and got["missing_keys"] == 2 and got["extra_keys"] == 1
    assert got["infinite_volume"] == got["negative_volume"] == got["missing_volume"] == got["invalid_months"] == 1
    assert Q.submission_completeness(bad, template).first()["missing_months"] == "1,2"
    assert Q.submission_checklist(bad, template).where("check = 'all_passed'").first()["passed"] == 0


def test_training_data_checks(many):
    got = {r["check"]: r["passed"] for r in Q.training_data_checks(many, many.limit(0)).collect()}
    assert got == {"train_rows": 1, "train_series": 1, "val_rows": 0, "val_series": 0}


def test_scenario_violations(many):
    got = {r["violation"]: r["n"] for r in Q.scenario_violations(many, many.where("months_postgx < 2"), 1).collect()}
    assert got["series_overlap"] == 60 and got["months_too_early"] == 240 and got["row_overlap"] == 360
    assert Q.scenario_violations(many.where("bucket = 1"), many.where("bucket = 2 AND months_postgx >= 0"), 1).count() == 0


def test_t_test_is_null_where_undefined(spark):
    rows = [("a", "m", 0, 1.0), ("b", "m", 0, 2.0), ("a", "n", 0, 1.0), ("b", "n", 0, 1.0), ("a", "n", 1, 2.0), ("b", "n", 1, 2.0)]
    scores = spark.createDataFrame(rows, "model string, metric string, fold int, value double")
    for metric in ("m", "n"):
        got = S.paired_t_test(scores, "a", "b", metric).first()
        assert got["t_statistic"] is None and got["p_value"] is None


def test_interval_at_any_level_and_more_metrics(spark):
    rows = [(m, f, "rmse", v) for m, vs in (("a", [1.0, 2.0, 4.0, 4.5]), ("b", [0.5, 1.8, 3.1, 4.6])) for f, v in enumerate(vs)] + [("a", 0, "mae", 7.0)]
    scores = spark.createDataFrame(rows, "model string, fold int, metric string, value double")
    mean, sd = 0.375, 0.45  # of the differences 0.5, 0.2, 0.9, -0.1
    sd = (sum((d - mean) ** 2 for d in (0.5, 0.2, 0.9, -0.1)) / 3) ** 0.5
    for alpha, q in ((0.1, 2.353363), (0.05, 3.182446), (0.01, 5.840909)):
        r = S.paired_t_test(scores, "a", "b", "rmse", alpha).first()
        assert r["ci_diff_upper"] == pytest.approx(mean + q * sd / 2, abs=1e-5) and r["n_valid_pairs"] == 4
        assert r["is_significant"] == int(abs(r["t_statistic"]) > q)
    with pytest.raises(ValueError):
        S.paired_t_test(scores, "a", "b", "rmse", 1.5)
    table = {r["model"]: r for r in S.comparison_table(scores, "rmse", additional_metrics=["mae"]).collect()}
    assert table["b"]["is_best"] == 1 and table["a"]["mae_mean"] == 7.0 and table["b"]["mae_mean"] is None
    assert {r["model"]: r["rank"] for r in S.comparison_table(scores, "rmse", ascending=False).collect()} == {"a": 1, "b": 2}
