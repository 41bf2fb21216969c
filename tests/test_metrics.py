import pytest
from pyspark.sql import functions as F

from panelspark.operators import metrics as G
from panelspark.operators import weights as H


def test_a_perfect_forecast_scores_0(scored):
    actual, _, aux = scored
    assert G.compute_metric1(actual, actual, aux).first()["metric"] == 0.0
    assert G.compute_metric2(actual.where("months_postgx >= 6"), actual, aux).first()["metric"] == 0.0


def test_metric_by_hand(scored):
    actual, pred, aux = scored
    pe = [(0.2 * 24 * 10 / 24 + 0.5 * 60 / 6 + 0.2 * 60 / 6 + 0.1 * 120 / 12) / b for b in (1000.0, 2000.0, 3000.0, 4000.0)]
    want = round(2 / 2 * (pe[0] + pe[1]) + 1 / 2 * (pe[2] + pe[3]), 4)
    assert G.compute_metric1(actual, pred, aux).first()["metric"] == pytest.approx(want)
    pe2 = [(0.2 * 18 * 10 / 18 + 0.5 * 60 / 6 + 0.3 * 120 / 12) / b for b in (1000.0, 2000.0, 3000.0, 4000.0)]
    want2 = round(2 / 2 * (pe2[0] + pe2[1]) + 1 / 2 * (pe2[2] + pe2[3]), 4)
    assert G.compute_metric2(actual.where("months_postgx >= 6"), pred, aux).first()["metric"] == pytest.approx(want2)


def test_one_bucket_alone(scored):
    actual, pred, aux = scored
    table = {r["scope"]: r["metric"] for r in G.bucket_metrics(actual, pred, aux, 1).collect()}
    assert table["overall"] == pytest.approx(table["bucket1"] + table["bucket2"], abs=2e-4)
    only = aux.where("bucket = 2")
    rows = actual.join(only.select("brand_name"), "brand_name", "left_semi")
    assert G.compute_metric1(rows, pred, only).first()["metric"] == pytest.approx(table["bucket2"])


def test_a_series_without_average_counts_but_adds_nothing(scored):
    actual, pred, aux = scored
    whole = G.compute_metric1(actual, pred, aux.withColumn("avg_vol", F.when(F.col("brand_name") != "B0", F.col("avg_vol"))))
    assert whole.first()["metric"] == pytest.approx(round(2 / 2 * 10 * 1.0 / 2000 + 0.5 * (10 / 3000 + 10 / 4000), 4), abs=1e-3)


def test_series_must_start_at_the_first_month(scored):
    actual, pred, aux = scored
    assert G.series_errors(actual.where("months_postgx > 0"), pred, aux, 1).count() == 0


def test_per_series_error_and_worst(scored):
    actual, pred, aux = scored
    e = G.per_series_error(actual, pred, aux, 1)
    r = e.where("brand_name = 'B0'").first()
    assert r["mae"] == pytest.approx(10) and r["total_error"] == pytest.approx(240) and r["n_months"] == 24
    assert G.worst_series(e, "normalized_total_error", 1).first()["brand_name"] == "B0"
    with pytest.raises(ValueError):
        G.worst_series(e, "mae", 0)


def test_resilience_recovery(spark):
    rows = "country string, brand_name string, months_postgx int, volume double"
    actual = spark.createDataFrame([("X", "A", m, 100.0) for m in range(6)], rows)
    pred = spark.createDataFrame([("X", "A", m, v) for m, v in enumerate([100.0, 50.0, 80.0, 80.0, 99.0, 100.0])], rows)
    r = G.resilience(actual, pred).first()
    assert r["under_forecast_count"] == 4 and r["recovery_time"] == 3 and abs(r["max_under_forecast"] - 0.5) < 1e-6
    assert G.resilience(actual, actual).first()["resilience_score"] == 1.0


def test_bias_direction(scored):
    actual, pred, _ = scored
    assert G.forecast_bias(actual, actual).first()["bias_direction"] == "balanced"
    assert G.systematic_bias(actual, pred).first()["pct_overprediction"] == 100.0


@pytest.mark.parametrize("kind", ["identity", "sqrt", "log", "softmax", "rank"])
def test_weights_have_mean_1(spark, kind):
    df = spark.createDataFrame([(float(i),) for i in (1, 2, 2, 5)], "weight double")
    out = H.transform_weights(df, kind, 1e-6, 100)
    assert out.agg(F.avg("weight")).first()[0] == pytest.approx(1.0, abs=1e-6)


def test_target_transform_inverts(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.7,)], "y double")
    for kind in ("none", "log1p", "power"):
        back = H.inverse_transform_target(H.transform_target(F.col("y"), kind), kind)
        assert df.agg(F.max(F.abs(back - F.col("y")))).first()[0] < 1e-9
    with pytest.raises(ValueError):
        H.transform_target(F.col("y"), "cube")
