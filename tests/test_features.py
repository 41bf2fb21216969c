import math

import pytest
from pyspark.sql import functions as F

from panel_rows import by_key
from panelspark.operators import columns as C
from panelspark.operators import features as E
from panelspark.operators import quality as Q


def test_pre_entry_features(spark):
    rows = [("X", "A", m, 100.0 - (m + 12), 94.5) for m in range(-12, 3)]
    df = spark.createDataFrame(rows, "country string, brand_name string, months_postgx int, volume double, avg_vol_12m double")
    r = E.add_pre_entry_features(df).first()
    assert abs(r["pre_entry_trend"] + 1.0) < 1e-9 and r["pre_entry_max"] == 100.0 and r["pre_entry_min"] == 89.0
    assert abs(r["avg_vol_3m"] - 90.0) < 1e-9 and abs(r["avg_vol_6m"] - 91.5) < 1e-9
    assert abs(r["log_avg_vol"] - math.log1p(94.5)) < 1e-12


def test_seasonal_peak_and_defaults(spark):
    names = "JanFebMarAprMayJunJulAugSepOctNovDec"
    rows = [("X", "S", names[(m % 12) * 3:(m % 12) * 3 + 3], m, 1200.0 if m % 12 in (5, 6, 7) else 900.0) for m in range(-24, 24)]
    rows += [("X", "T", "Jan", -1, 5.0)]
    df = spark.createDataFrame(rows, "country string, brand_name string, month string, months_postgx int, volume double")
    got = {r["brand_name"]: r for r in E.add_seasonal_features(df).dropDuplicates(["brand_name"]).collect()}
    assert got["S"]["seasonal_peak_month"] == 6 and got["S"]["seasonal_trough_month"] == 1
    assert got["S"]["seasonal_q3_effect"] > 0 > got["S"]["seasonal_q1_effect"]
    assert (got["T"]["seasonal_amplitude"], got["T"]["seasonal_peak_month"], got["T"]["seasonal_ratio"]) == (0.0, 6, 1.0)


def test_generics_features(panel):
    rows = by_key(E.add_future_generics_features(E.add_generics_features(panel, 6), 6))
    a = rows[("X", "A", 10)]
    assert a["n_gxs_at_entry"] == 1 and a["first_generic_month"] == 0 and a["months_since_first_generic"] == 10
    assert a["n_gxs_bin"] == "several" and a["n_gxs_pre_cutoff_max"] == 4
    assert a["n_gxs_at_month_12"] == 4 and a["expected_new_generics"] == 0
    assert rows[("X", "B", 0)]["months_since_first_generic"] == -999


def test_label_codes_follow_the_sorted_values(panel):
    got = {r["ther_area"]: r["code"] for r in E.label_codes(panel, {"ther_area": "code"}).collect()}
    assert got == {"T1": 0, "T2": 1}


def test_early_erosion_without_a_volume_at_0(spark):
    rows = [("X", "A", m, 10.0, 20.0, 1) for m in (-1, 3, 4)]
    df = spark.createDataFrame(rows, "country string, brand_name string, months_postgx int, volume double, avg_vol_12m double, n_gxs int")
    r = E.add_early_erosion_features(df).first()
    assert r["drop_month_0"] == 1.0 and r["month_0_to_3_change"] == 0.0 and r["recovery_signal"] == 0


def test_no_feature_sees_past_the_cutoff(panel):
    for scenario in (1, 2):
        bad = Q.future_leakage(panel, scenario, lambda p: E.make_features(p, scenario, "train", {"sequence": True}))
        assert bad.count() == 0
    bad = Q.future_leakage(panel, 1, lambda p: E.add_early_erosion_features(p), ["erosion_0_5"])
    assert bad.count() > 0


def test_scenario_one_has_no_early_erosion(panel):
    assert "erosion_0_5" not in E.make_features(panel, 1).columns
    out = E.make_features(panel, 2)
    assert "erosion_0_5" in out.columns and out.count() == panel.count()
    assert not set(E.feature_columns(out)) & {"volume", "y_norm", "bucket", "mean_erosion"}


def test_loo_prior_leaves_the_own_row_out(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 7.0)], "g string, y_norm double")
    got = sorted((r["y_norm"], r["p"]) for r in E.add_loo_prior(df, "g", "p").collect())
    assert got == [(1.0, 3.0), (3.0, 1.0), (5.0, 5.0), (7.0, 4.0)]


def test_frequency_encoding(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    got = sorted((r["c"] or "", round(r["c_freq"], 4)) for r in E.add_frequency_encoding_features(df, ["c"]).collect())
    assert got == [("", 0.0), ("a", 0.6667), ("a", 0.6667), ("b", 0.3333)]


def test_sequence_features(panel):
    rows = by_key(E.add_sequence_features(panel))
    r = rows[("X", "A", 1)]
    assert abs(r["seq_volume_lag_1"] - 1.0) < 1e-6 and abs(r["seq_volume_diff_1"] + 0.02) < 1e-6
    assert rows[("X", "A", -12)]["seq_volume_lag_6"] == 1.0 and rows[("X", "A", -12)]["seq_volatility_3"] == 0.0


def test_interactions_skip_unknown_and_text_columns(panel):
    out = E.add_interaction_features(panel, [("n_gxs", "volume"), ("month", "volume"), ("n_gxs", "nothing")])
    r = by_key(out)[("X", "A", 3)]
    assert r["n_gxs_x_volume"] == 4 * 94.0 and r["month_x_volume"] == 0.0 and "n_gxs_x_nothing" not in out.columns


def test_scalers_invert(panel):
    df = panel.select("volume", "hospital_rate", "months_postgx")
    for method in ("standard", "minmax", "robust", "none"):
        s = C.FeatureScaler(method, ["months_postgx"]).fit(df)
        back = s.inverse_transform(s.transform(df))
        gap = back.agg(F.sum("volume")).first()[0] - df.agg(F.sum("volume")).first()[0]
        assert abs(gap) < 1e-6


def test_correlated_columns_are_dropped(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float(i % 3), 1.0) for i in range(30)], "a double, b double, c double, d double")
    left, dropped = C.remove_redundant_features(df, 0.95, 0.01)
    assert dropped == ["d", "b"] and left.columns == ["a", "c"]


def test_feature_summary(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, None), (None, "x")], "n double, t string")
    got = {r["feature"]: r for r in C.feature_summary(df).collect()}
    assert got["n"]["n_unique"] == 2 and got["n"]["n_missing"] == 1 and got["n"]["median"] == 1.5
    assert got["t"]["n_unique"] == 1 and got["t"]["mean"] is None


def test_target_encoding_keeps_folds_apart(spark):
    rows = [(f"c{i % 2}", f"b{i}", m, "t", float(i)) for i in range(10) for m in range(3)]
    df = spark.createDataFrame(rows, "country string, brand_name string, months_postgx int, ther_area string, y_norm double")
    out = E.add_target_encoding_features(df, 1, ("ther_area",), 5, 0).select("brand_name", "y_norm", "ther_area_erosion_prior").distinct().collect()
    total = sum(range(10))
    # 10 series in 5 folds of two: the prior is the mean over the other eight
    assert all(any(abs(r[2] - (total - r[1] - j) / 8) < 1e-9 for j in range(10)) for r in out)


def test_codes_of_new_data_are_those_of_the_training_data(panel):
    codes = E.category_codes(panel, ("ther_area",))
    part = panel.where("ther_area = 'T2'")
    new = part.withColumn("ther_area", F.lit("T9")).unionByName(part)
    got = {r["ther_area"]: r["code"] for r in E.label_codes(new, {"ther_area": "code"}, codes).collect()}
    assert got == {"T2": 1, "T9": -1}


def test_options_turn_columns_off(panel):
    whole = set(E.make_features(panel, 2).columns)
    some = set(E.make_features(panel, 2, config={"time": {"include_decay": False}, "generics": {"include_future_n_gxs": False}, "scenario2_early": False}).columns)
    assert some < whole and {"time_decay", "n_gxs_at_month_12", "erosion_0_5"} <= whole - some and {"month_sin", "has_generic"} <= some
    none = E.make_features(panel, 1, config={g: False for g in ("pre_entry", "time", "generics", "drug")})
    assert none.columns == panel.columns and none.count() == panel.count()
    with pytest.raises(ValueError):
        E.make_features(panel, 1, config={"time": {"include_everything": True}})
    with pytest.raises(ValueError):
        E.make_features(panel, 1, config={"weather": True})
    with pytest.raises(ValueError):
        E.add_drug_features(panel, bins=(70, 30))


def test_visibility_is_a_feature_group(panel):
    dated = panel.withColumn("day", F.make_date(F.lit(2020), F.lit(1), F.lit(1)))
    metrics = panel.select("country", "brand_name").distinct().withColumns({"period": F.make_date(F.lit(2020), F.lit(1), F.lit(1)), "vis_fill_rate": F.lit(0.5)})
    from panelspark.constants import VISIBILITY_COLUMNS
    name = VISIBILITY_COLUMNS[0]
    out = E.make_features(dated, 1, config={"visibility": {"data": metrics.withColumnRenamed("vis_fill_rate", name), "date_col": "day"}})
    assert set(VISIBILITY_COLUMNS) <= set(out.columns) and out.where(f"{name} <> 0.5").count() == 0 and out.count() == panel.count()


def test_narrow_types_do_not_follow_the_values(spark):
    from panelspark.operators import panel as P
    kinds = "n_gxs long, ids long, is_x long, volume double, share double"
    for rows in ([(1, 2, 1, 3.0, 0.5)], [(1, 2 ** 40, 1, 3.0, 0.5)], []):
        out = P.narrow_types(spark.createDataFrame(rows, kinds))
        assert dict(out.dtypes) == {"n_gxs": "int", "ids": "bigint", "is_x": "int", "volume": "double", "share": "float"}
        assert out.count() == len(rows)
    assert dict(P.narrow_types(spark.createDataFrame([], kinds), types={"ids": "int"}).dtypes)["ids"] == "int"
    with pytest.raises(Exception):
        P.narrow_types(spark.createDataFrame([(2 ** 40, 1, 1, 1.0, 1.0)], kinds)).collect()
