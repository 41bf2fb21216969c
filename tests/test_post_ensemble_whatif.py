import numpy as np
import pytest
from pyspark.sql import functions as F

from panel_rows import by_key
from panelspark.operators import baselines as B
from panelspark.operators import ensemble as J
from panelspark.operators import metrics as G
from panelspark.operators import postprocess as K
from panelspark.operators import whatif as N

ROWS = "country string, brand_name string, months_postgx int, volume double"


@pytest.fixture(scope="module")
def flat(spark):
    return spark.createDataFrame([("X", "A", m, 100.0) for m in range(5)], ROWS)


def test_step_shock(flat):
    out = N.apply_demand_shock(flat, N.Shock("s", "step", 1.2, 2)).orderBy("months_postgx").collect()
    assert [r["volume"] for r in out] == [100, 100, 120, 120, 120]


def test_shock_shapes_and_filters(flat, spark):
    def run(s):
        return [round(r["volume"], 4) for r in N.apply_demand_shock(flat, s).orderBy("months_postgx").collect()]
    assert run(N.Shock("i", "impulse", 0.5, 1, 2)) == [100, 50, 50, 100, 100]
    assert run(N.Shock("r", "ramp", 0.6, 0, 5)) == [100, 90, 80, 70, 60]
    assert run(N.Shock("d", "decay", 2.0, 3, None, 0.5)) == [100, 100, 100, 200, round(200 * np.exp(-0.5), 4)]
    assert run(N.Shock("o", "step", 2.0, 0, None, countries=("other",))) == [100] * 5
    assert run(N.Shock("c", "step", 2.0, 0, None, countries=("x",), brands=("A",))) == [200] * 5
    with pytest.raises(ValueError):
        N.shock_factor(N.Shock("u", "unknown", 1.0))


def test_scenarios_and_sensitivity(flat):
    row = N.compare_scenarios(flat, {"half": [N.Shock("s", "step", 0.5, 3)], "none": []})
    got = {r["scenario"]: r for r in row.collect()}
    assert got["half"]["total_volume_change"] == -100 and got["half"]["affected_periods"] == 2 and got["none"]["affected_series_count"] == 0
    table = {round(r["magnitude"], 2): r["total_volume"] for r in N.sensitivity_analysis(flat, N.Shock("s", "step", 1, 3), (0.5, 1.5), 3).collect()}
    assert table == {0.5: 400.0, 1.0: 500.0, 1.5: 600.0}
    floor = N.sensitivity_analysis(flat, N.Shock("s", "step", 1, 0), (-1.0, -1.0), 1).first()
    assert floor["total_volume"] == 0.0


def test_monte_carlo_repeats(flat):
    s = N.Shock("s", "step", 0.8, 0)
    one, two = N.monte_carlo(flat, s, 0.1, 200).first(), N.monte_carlo(flat, s, 0.1, 200).first()
    assert one == two and abs(one["mean_volume"] - 400) < 10 and 35 < one["std_volume"] < 65


def test_smoothing_matches_the_window(spark):
    df = spark.createDataFrame([("X", "A", m, v) for m, v in enumerate([1.0, 9.0, 2.0, None, -8.0])], ROWS)
    out = [r["volume"] for r in K.smooth_predictions(df).orderBy("months_postgx").collect()]
    assert out == [5.0, 2.0, 5.5, 0.0, 0.0]
    mean = [r["volume"] for r in K.smooth_predictions(df, "rolling_mean", 3).orderBy("months_postgx").collect()]
    assert mean[:3] == [5.0, 4.0, 5.5]


def test_calibration_recovers_a_line(spark):
    rows = [("X", "A", m, 1, 2, 3.0 * m + 7, float(m)) for m in range(6)] + [("X", "A", 12, 1, 2, 1.0, 1.0)]
    val = spark.createDataFrame(rows, "country string, brand_name string, months_postgx int, scenario int, bucket int, volume_true double, volume_pred double")
    params = K.fit_grouped_calibration(val)
    assert params.count() == 1 and params.first()["a"] == pytest.approx(3) and params.first()["b"] == pytest.approx(7)
    pred = val.withColumn("volume", F.col("volume_pred"))
    got = by_key(K.apply_calibration(pred, params))
    assert got[("X", "A", 4)]["volume"] == pytest.approx(19) and got[("X", "A", 12)]["volume"] == 1.0
    iso = K.apply_isotonic_calibration(pred, K.fit_isotonic_calibration(val))
    assert iso.count() == 7 and by_key(iso)[("X", "A", 4)]["volume"] == pytest.approx(19)


def test_bias_corrections(spark):
    val = spark.createDataFrame([("X", "T1", 10.0 + i, 9.0) for i in range(5)] + [("Y", "T1", 1.0, 50.0)],
                                "country string, ther_area string, volume_true double, volume_pred double")
    for method in ("mean_error", "median_error"):
        b = K.fit_bias_corrections(val, method=method)
        assert b.count() == 1 and b.first()["bias"] == pytest.approx(3.0)
    pred = spark.createDataFrame([("X", "T1", 1.0), ("Y", "T1", 2.0), ("Z", None, 3.0)], "country string, ther_area string, volume double")
    assert sorted(r["volume"] for r in K.apply_bias_corrections(pred, b).collect()) == [2.0, 3.0, 4.0]


def test_zero_and_extreme_volumes(spark, flat):
    panel = spark.createDataFrame([("X", "A", 0.0), ("X", "B", 200.0)], "country string, brand_name string, avg_vol_12m double")
    got = [r["volume"] for r in K.handle_zero_volume_series(flat, panel).orderBy("months_postgx").collect()]
    assert got[0] == pytest.approx(20.0) and got[4] == pytest.approx(18.4)
    assert {r["volume"] for r in K.handle_zero_volume_series(flat, panel, "small_constant").collect()} == {1.0}
    cap = panel.withColumn("avg_vol_12m", F.lit(30.0))
    assert {r["volume"] for r in K.handle_extreme_predictions(flat, cap).collect()} == {60.0}
    assert {r["volume"] for r in K.handle_extreme_predictions(flat, cap.where("brand_name = 'B'")).collect()} == {100.0}


def test_edge_case_fallback(spark):
    panel = spark.createDataFrame([("X", f"B{i}", m, float(10 + 100 * i), 0.1, 0.5) for i in range(20) for m in (0, 1)],
                                  "country string, brand_name string, months_postgx int, avg_vol_12m double, pre_entry_volatility double, y_norm double")
    pred = panel.select("country", "brand_name", "months_postgx", F.lit(7.0).alias("volume"))
    got = by_key(K.apply_edge_case_fallback(pred, panel))
    assert got[("X", "B0", 0)]["volume"] == 5.0 and got[("X", "B5", 0)]["volume"] == 7.0


def test_simplex_weights_find_the_mixture(spark):
    rng = np.random.default_rng(0)
    a, b, c = rng.normal(size=(3, 200))
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c, 0.3 * a + 0.7 * b)], "a double, b double, c double, y double")
    w = J.fit_weights(df, ["a", "b", "c"], "y")
    assert w["a"] == pytest.approx(0.3, abs=1e-4) and w["b"] == pytest.approx(0.7, abs=1e-4) and w["c"] == pytest.approx(0, abs=1e-4)
    mae = J.fit_weights(df, ["a", "b", "c"], "y", "mae", parts=10)
    assert (mae["a"], mae["b"]) == (0.3, 0.7)
    free = J.fit_weights(df, ["a", "b", "c"], "y", constrain=False)
    assert free["b"] == pytest.approx(0.7, abs=1e-4)


def test_grid_has_all_points():
    grid = J.simplex_grid(3, 4)
    assert len(grid) == 15 and all(abs(sum(w) - 1) < 1e-12 for w in grid) and len(set(grid)) == 15


def test_grid_scores_agree_with_the_metric(scored):
    actual, pred, aux = scored
    low = B.naive_persistence(aux, range(24))
    members = J.stack({"good": pred, "bad": low}, "volume")
    scores = {r["w_good"]: r["score"] for r in J.grid_scores(members, actual, aux, ["good", "bad"], 1, "official", 2).collect()}
    assert scores[1.0] == G.compute_metric1(actual, pred, aux).first()["metric"]
    assert scores[0.0] == G.compute_metric1(actual, low, aux).first()["metric"]
    best = J.best_grid_weights(J.grid_scores(members, actual, aux, ["good", "bad"], 1, "official", 2)).first()
    assert best["w_good"] == 1.0


def test_member_blends(spark):
    one = spark.createDataFrame([("X", "A", 0, 1.0)], "country string, brand_name string, months_postgx int, prediction double")
    m = J.stack({"a": one, "b": one.withColumn("prediction", F.lit(4.0))})
    assert J.average(m).first()["prediction"] == 2.0 and J.average(m, None, None).first()["prediction"] == 2.5
    assert J.weighted(m, {"a": 3, "b": 1}).first()["prediction"] == pytest.approx(1.75)
    band = J.confidence(m, 0.9).first()
    assert (band["lower"], band["upper"]) == (pytest.approx(1.15), pytest.approx(3.85))


def test_decay_tuning_finds_the_rate(spark):
    aux = spark.createDataFrame([("X", "A", 50.0, 1)], "country string, brand_name string, avg_vol double, bucket int")
    actual = B.exponential_decay(aux, range(24), 0.07)
    assert B.best_decay_rate(B.decay_rate_table(actual, aux)).first()["decay_rate"] == 0.07
    assert B.linear_decay(aux, [0, 40]).orderBy("months_postgx").collect()[1]["volume"] == 0.0


def test_trend_and_global_mean(spark):
    train = spark.createDataFrame([(m, 1 - 0.1 * m) for m in range(5)], "months_postgx int, y_norm double")
    ask = spark.createDataFrame([(2,), (9,)], "months_postgx int")
    got = {r["months_postgx"]: r["prediction"] for r in B.trend(train, ask).collect()}
    assert got[2] == pytest.approx(1 - 2 * 0.095)
    got = {r["months_postgx"]: r["prediction"] for r in B.global_mean(train, ask).collect()}
    assert got[2] == pytest.approx(0.8) and got[9] == pytest.approx(0.8)


def isotonic_by_hand(x, y):
    """Least-squares rising fit at each point by the formula of greatest lowest means."""
    at = sorted(set(x))
    total = [sum(b for a, b in zip(x, y) if a == v) for v in at]
    n = [x.count(v) for v in at]
    mean = [[sum(total[i:j + 1]) / sum(n[i:j + 1]) if j >= i else None for j in range(len(at))] for i in range(len(at))]
    return at, [max(min(mean[i][j] for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]


@pytest.mark.parametrize("slope,noise", [(1.0, 3.0), (-1.0, 2.0), (0.0, 5.0), (2.0, 0.0)])
def test_isotonic_fit_equals_the_formula(spark, slope, noise):
    """All groups at once, points dealt over several ranges; lines between blocks, ends beyond them."""
    rng = np.random.default_rng(int(10 * noise))
    rows = []
    for scenario, bucket in ((1, 1), (1, 2), (2, 1)):
        for i in range(60 if bucket == 1 else 4):
            x = float(rng.integers(0, 40))
            rows.append(("X", f"B{i}", 3 if scenario == 1 else 8, scenario, bucket, slope * x + float(rng.normal(0, noise)) if noise else slope * x, x))
    val = spark.createDataFrame(rows, "country string, brand_name string, months_postgx int, scenario int, bucket int, volume_true double, volume_pred double")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        fit = K.fit_isotonic_calibration(val.repartition(3))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert {(r["scenario"], r["bucket"]) for r in fit.select("scenario", "bucket").distinct().collect()} == {(1, 1), (2, 1)}
    asked = [("Q", "Q", 3, 1, 1, float(v)) for v in np.arange(-2, 45, 0.5)] + [("Q", "R", 3, 1, 2, 5.5), ("Q", "S", 3, 1, None, 6.5), ("Q", "T", 3, 1, 1, None)]
    pred = spark.createDataFrame(asked, "country string, brand_name string, months_postgx int, scenario int, bucket int, volume double")
    got = K.apply_isotonic_calibration(pred, fit).withColumnRenamed("volume", "after")
    assert got.count() == len(asked)
    own = [(r[6], r[5]) for r in rows if r[3] == 1 and r[4] == 1]
    at, level = isotonic_by_hand([a for a, _ in own], [b for _, b in own])
    # the order of rows is free, so the answers are compared as a whole
    want = sorted(max(0.0, float(np.interp(v, at, level))) for *_, v in asked[:-3])
    mine = sorted(r["after"] for r in got.where("brand_name = 'Q'").collect())
    assert np.allclose(mine, want, atol=1e-9)
    rest = {r["brand_name"]: r["after"] for r in got.where("brand_name <> 'Q'").collect()}
    assert rest == {"R": 5.5, "S": 6.5, "T": None}


def test_summary_of_scenario_tables(spark):
    rows = [("down", "X", "A", m, 10.0, 10.0 - m) for m in range(3)] + [("up", "X", "B", 0, 5.0, 9.0), ("up", "X", "C", 0, 1.0, None)]
    df = spark.createDataFrame(rows, "scenario string, country string, brand_name string, months_postgx int, baseline double, adjusted double")
    got = {r["scenario"]: r for r in N.summarize_scenario_impacts(df).collect()}
    assert (got["down"]["total_volume_change"], got["down"]["max_negative_impact"], got["down"]["affected_periods"], got["down"]["affected_series_count"]) == (-3.0, -2.0, 2, 1)
    assert got["up"]["total_volume_change_pct"] == pytest.approx(400 / 6) and got["up"]["mean_volume_change"] == 2.0 and got["up"]["affected_series_count"] == 1
    shocks = {"a": [N.Shock("a", "step", 0.5, 0, None)], "b": [N.Shock("b", "step", 1.0, 0, None)]}
    pred = spark.createDataFrame([("X", "A", m, 8.0) for m in range(4)], "country string, brand_name string, months_postgx int, volume double")
    one = {r["scenario"]: r.asDict() for r in N.compare_scenarios(pred, shocks).collect()}
    two = {r["scenario"]: r.asDict() for r in N.summarize_scenario_impacts(N.scenario_predictions(pred, shocks)).collect()}
    assert one == two
