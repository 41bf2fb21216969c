import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import curves as U
from panelspark.operators import ensemble as J
from panelspark.operators import metrics as G
from panelspark.operators import models as I
from panelspark.operators import panel as P
from panelspark.plans import forecast


@pytest.fixture(scope="module")
def frame(spark):
    """40 series x 24 months whose erosion depends on the month and on x."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(40):
        x, base = i % 5, 100.0 + i
        for m in range(24):
            y = float(max(0.05, 1 - 0.01 * m * (1 + x)) + rng.normal(0, 0.01))
            rows.append(("X" if i % 2 else "Y", f"B{i}", m, y * base, base, 1 if x >= 3 else 2, y, float(x), i % 7 * 1.0, f"T{i % 3}"))
    return spark.createDataFrame(rows, "country string, brand_name string, months_postgx int, volume double, avg_vol_12m double, "
                                       "bucket int, y_norm double, x double, noise double, ther_area string").cache()


COLS = ("months_postgx", "x", "noise")
LINEAR = I.ModelSpec("ridge", {"regParam": 0.0}, COLS)
TREE = I.ModelSpec("gbt_fast", {"maxIter": 8}, COLS)


def rmse(df):
    return G.point_errors(df, "y_norm", "prediction").first()["rmse"]


@pytest.mark.parametrize("spec", [TREE, LINEAR, I.ModelSpec("forest", {"numTrees": 10}, COLS), I.ModelSpec("huber", {"maxIter": 20}, COLS),
                                  I.ModelSpec("lasso", {}, COLS, polynomial=2)])
def test_models_beat_the_flat_forecast(frame, spec):
    train, val = I.split_frame(frame)
    flat = rmse(val.withColumn("prediction", F.lit(1.0)))
    scored = I.predict(I.fit(spec, train), val)
    assert rmse(scored) < 0.6 * flat and scored.count() == val.count()
    assert scored.where("prediction < 0 OR prediction > 2").count() == 0


def test_scenario_training_reports_the_metric(frame):
    train, val = I.split_frame(frame)
    model, scored, m = I.train_scenario_model(train, val, 1, LINEAR, "log1p")
    row = m.first()
    flat = G.official_metric(val.select("country", "brand_name", "months_postgx", "volume"),
                             I.as_volume(val.withColumn("prediction", F.lit(1.0))), G.create_aux(val), 1).first()["metric"]
    assert row["official_metric"] < flat and 0.5 < row["r2"] <= 1
    assert model.importance(frame.sparkSession).orderBy(F.col("importance").desc()).first()["feature"] in ("months_postgx", "x")


def test_cross_validation_predicts_every_row_once(frame):
    oof, scores = I.cross_validate(frame, 1, LINEAR, 3)
    assert oof.count() == frame.count() and scores.count() == 3
    assert oof.select("country", "brand_name", "months_postgx").distinct().count() == frame.count()


def test_tuning_prefers_the_better_setting(frame):
    _, table = I.tune(frame, 1, LINEAR, {"regParam": [0.0, 10.0]})
    got = {r["params"]: r["official_metric"] for r in table.collect()}
    assert got["{'regParam': 0.0}"] < got["{'regParam': 10.0}"]


def test_importance_finds_the_signal(frame):
    train, val = I.split_frame(frame)
    got = {r["feature"]: r["importance_mean"] for r in I.permutation_importance(I.fit(LINEAR, train), val, 2).collect()}
    assert got["months_postgx"] > 10 * abs(got["noise"]) and got["x"] > 10 * abs(got["noise"])


def test_hybrid_adds_its_parts(frame):
    out = I.predict_hybrid(I.fit_hybrid(frame, TREE), frame)
    assert out.where("abs(prediction - greatest(0, least(2, physics + ml_residual))) > 1e-9").count() == 0
    assert rmse(out) < 0.1


def test_routing_covers_every_row(frame):
    models = I.bucket_models(frame, 1, LINEAR)
    assert set(models) == {1, 2}
    assert I.route_by_bucket(models, frame.withColumn("bucket", F.when(F.col("x") > 0, F.col("bucket")))).count() == frame.count()


def test_stacking_and_ensemble(frame):
    train, val = I.split_frame(frame)
    predict, oof = I.stacking(train, {"a": LINEAR, "b": I.ModelSpec("gbt_fast", {"maxIter": 4}, COLS)}, 2)
    assert oof.count() == train.count() and rmse(predict(val)) < 0.1
    row = I.train_multi_model_ensemble(train, val, 1, {"a": LINEAR, "b": I.ModelSpec("lasso", {"regParam": 1.0}, COLS)}, parts=2).first()
    assert row["score"] <= row["best_single_score"] and row["best_single"] == "a"


def test_residual_model_speaks_for_its_rows(frame):
    df = frame.withColumns({"volume_true": F.col("volume"), "volume_pred": F.col("volume") - 3.0, "scenario": F.lit(1)}).where("volume_pred > 0")
    model, errors = I.train_residual_model(df, I.ModelSpec("ridge", {}, COLS))
    assert errors.first()["mae_residual"] < 0.2
    from panelspark.operators.postprocess import apply_residual_correction
    rows = model.transform(df).withColumn("volume", F.col("volume_pred"))
    fixed = apply_residual_correction(rows, "prediction").withColumn("d", F.col("volume_true") - F.col("volume"))
    assert fixed.where("bucket = 1 AND months_postgx <= 11 AND abs(d) > 0.2").count() == 0
    assert fixed.where("(bucket = 2 OR months_postgx > 11) AND abs(d - 3) > 1e-9").count() == 0


def test_historical_curve_copies_its_twin(spark, frame):
    train = frame.withColumn("hospital_rate", F.col("x") * 10)
    twin = train.where("brand_name = 'B4'").withColumn("brand_name", F.lit("new"))
    model = U.HistoricalCurve(k=1, columns=["hospital_rate", "noise"], categories=["ther_area"]).fit(train)
    out = model.predict(twin).select("months_postgx", "prediction", "y_norm")
    assert out.where("abs(prediction - y_norm) > 1e-9").count() == 0


def test_series_forecaster(spark):
    rows = [("X", "line", m, 10.0 + 2 * m) for m in range(-12, 0)] + [("X", "short", -1, 7.0), ("X", "short", -2, 9.0)]
    hist = spark.createDataFrame(rows, "country string, brand_name string, months_postgx int, volume double")
    aux = spark.createDataFrame([("X", "short", 100.0)], "country string, brand_name string, avg_vol double")
    plain = U.blended_series_forecast(hist, [0, 1, 2])
    got = {(r["brand_name"], r["months_postgx"]): r["volume"] for r in plain.collect()}
    assert got[("line", 0)] == pytest.approx(10, abs=1.0) and got[("line", 2)] > got[("line", 0)]
    assert got[("short", 2)] == 7.0
    decayed = {(r["brand_name"], r["months_postgx"]): r["volume"] for r in U.blended_series_forecast(hist, [0, 1], fallback=aux).collect()}
    assert decayed[("short", 0)] == 100.0 and decayed[("line", 0)] == got[("line", 0)]


def test_adversarial_validation_sees_a_shift(frame):
    low, high = frame.where("x < 2"), frame.where("x >= 2")
    auc, shift = I.adversarial_validation(low, high, ["x", "noise"], 2, 5, 3)
    assert auc.agg(F.min("auc")).first()[0] > 0.95
    assert shift.orderBy(F.col("importance").desc()).first()["feature"] == "x"


def test_pruning_keeps_a_minimum(spark):
    imp = spark.createDataFrame([(f"f{i}", float(i)) for i in range(10)], "feature string, importance double")
    assert {r["feature"] for r in I.prune_features(imp, 0.3, 2).where("keep = 0").collect()} == {"f0", "f1", "f2"}
    assert I.prune_features(imp, 0.9, 8).where("keep = 0").count() == 2
    assert I.prune_features(imp, threshold=4.5).where("keep = 1").count() == 5


def test_submission_covers_the_template(spark, raw):
    panel = P.build_panel(**raw)
    from panelspark.operators import features as E
    train = E.make_features(panel, 1).where("months_postgx >= 0 AND bucket IS NOT NULL")
    spec = I.ModelSpec("ridge", {"regParam": 1.0}, ("months_postgx", "n_gxs", "time_decay"))
    test = P.build_panel(raw["volume"].where("months_postgx < 2"), raw["generics"], raw["medicine_info"], is_train=False)
    fitted = I.fit(spec, train)
    template = P.series_ids(test).withColumn("months_postgx", F.explode(F.sequence(F.lit(0), F.lit(23))))
    out = forecast.generate_submission({1: fitted, 2: fitted}, test, template, smooth=True)
    assert out.count() == 72 and out.where("volume IS NULL OR volume < 0").count() == 0


def test_seed_members(frame):
    train, val = I.split_frame(frame)
    spec = I.ModelSpec("gbt_sampled", {"maxIter": 3, "maxDepth": 3}, COLS)
    scores, members = I.multi_seed(train, val, 1, spec, [1, 2])
    assert scores.count() == 2 and J.seed_ensemble(members, "median").count() == val.count()


def test_importance_of_a_polynomial_has_a_row_per_coefficient(frame):
    spec = I.ModelSpec("ridge", {}, ("months_postgx", "x"), polynomial=2)
    model = I.fit(spec, frame)
    got = {r["feature"]: r["importance"] for r in model.importance(frame.sparkSession).collect()}
    assert set(got) == {"months_postgx", "x", "months_postgx * months_postgx", "months_postgx * x", "x * x"}
    assert len(got) == len(model.model.stages[-1].coefficients)


def test_saved_model_scores_alike(frame, spark, tmp_path):
    codes = spark.createDataFrame([("ther_area", "A", 0)], "kind string, value string, _code int")
    model = I.fit(LINEAR, frame, codes)
    model.save(str(tmp_path / "m"))
    again = I.FittedModel.load(spark, str(tmp_path / "m"), codes=True)
    assert again.spec.features == model.spec.features and again.codes.collect() == codes.collect()
    a, b = (sorted(r["prediction"] for r in m.transform(frame).collect()) for m in (model, again))
    assert a == b


def test_permutation_scores_only_what_looks_at_a_feature(frame):
    """The terms add up to the model's forecast, and swapping a column by hand gives the same rise of the error."""
    train, val = I.split_frame(frame)
    specs = [I.ModelSpec("gbt_fast", {"maxIter": 5}, COLS), I.ModelSpec("forest", {"numTrees": 4, "maxDepth": 3}, COLS), LINEAR,
             I.ModelSpec("lasso", {"regParam": 0.001}, COLS, polynomial=2)]
    rows = val.withColumn("x", F.when(F.col("months_postgx") != 3, F.col("x")))
    for spec in specs:
        model = I.fit(spec, train)
        parts = I.scorer(model, frame.sparkSession)
        got = model.transform(rows).select(*[F.col(c).cast("double").alias(c) for c in COLS], "prediction").toPandas()
        x = parts.filled(got[list(COLS)].to_numpy(float))
        assert np.allclose(parts.start + sum(parts.term(i, x) for i in range(len(parts.terms))), got["prediction"])
        asked = [len(u) for u in parts.uses()]
        assert max(asked) <= len(parts.terms) and sum(asked) < len(parts.terms) * len(COLS)
    table = {r["feature"]: r for r in I.permutation_importance(I.fit(LINEAR, train), val, 3).collect()}
    assert set(table) == set(COLS) and all(r["importance_std"] >= 0 for r in table.values())


def test_halving_stops_weak_points_early(frame):
    grid = {"regParam": [0.0, 0.5, 5.0, 50.0], "maxIter": [20]}
    _, full = I.tune(frame, 1, LINEAR, {"regParam": [0.0, 0.5, 5.0, 50.0]}, folds=3)
    best = min(full.collect(), key=lambda r: r["official_metric"])
    model, table, fits = I.tune_halving(frame, 1, LINEAR, grid, folds=3)
    got = {r["config"]: r for r in table.collect()}
    assert [r["n_folds"] for _, r in sorted(got.items())][0] == 3 and sorted(r["n_folds"] for r in got.values()) == [1, 1, 2, 3]
    assert fits.count() == 7 < 12 and "'regParam': 0.0" in best["params"]
    assert [r["params"] for r in got.values() if r["best"]] == ["{'regParam': 0.0, 'maxIter': 20}"]
    assert model.spec.params["regParam"] == 0.0
    _, table, fits = I.tune_halving(frame, 1, LINEAR, grid, folds=3, budget=6)
    assert fits.count() == 6 and max(r["n_folds"] for r in table.collect()) == 2
    assert len(I.trial_points(grid, 2)) == 2 and I.trial_points(grid, 2) == I.trial_points(grid, 2) and len(I.trial_points(grid)) == 4
    with pytest.raises(ValueError):
        I.tune_halving(frame, 1, LINEAR, grid, folds=2, budget=3)


def test_submission_routes_by_bucket_and_corrects_residuals(spark, raw):
    """A known bucket decides, else the base forecast's mean share; the residual model moves only the rows it speaks for."""
    panel = P.build_panel(**raw)
    from panelspark.operators import features as E
    train = E.make_features(panel, 1).where("months_postgx >= 0 AND bucket IS NOT NULL")
    test = P.build_panel(raw["volume"].where("months_postgx < 0"), raw["generics"], raw["medicine_info"], is_train=False)
    template = P.series_ids(test).withColumn("months_postgx", F.explode(F.sequence(F.lit(0), F.lit(23))))

    def constant(value, label="y_norm"):
        spec = I.ModelSpec("ridge", {"regParam": 0.0}, ("months_postgx",), label=label)
        return I.fit(spec, train.withColumn(label, F.lit(value) + F.col("months_postgx") * 0))

    def mean_share(models, panel=test, **more):
        out = forecast.generate_submission({1: models, 2: models}, panel, template, **more)
        both = out.join(panel.groupBy("country", "brand_name").agg(F.max("avg_vol_12m").alias("a")), ["country", "brand_name"])
        return {(r["brand_name"], r["months_postgx"]): r["volume"] / r["a"] for r in both.collect()}

    low, high = constant(0.2), constant(0.9)
    by_low = mean_share({forecast.BASE: low, 1: constant(0.1), 2: constant(1.5)})
    by_high = mean_share({forecast.BASE: high, 1: constant(0.1), 2: constant(1.5)})
    assert all(abs(v - 0.1) < 1e-6 for v in by_low.values()) and all(abs(v - 1.5) < 1e-6 for v in by_high.values())
    told = test.withColumn("bucket", F.when(F.col("brand_name") == "A", F.lit(1)))
    routed = mean_share({forecast.BASE: high, 1: constant(0.1), 2: constant(1.5)}, told)
    assert abs(routed["A", 0] - 0.1) < 1e-6 and all(abs(v - 1.5) < 1e-6 for (b, _), v in routed.items() if b != "A")
    plain, moved = mean_share(low), mean_share(low, residuals={1: constant(30.0, "residual"), 2: constant(30.0, "residual")})
    assert any(abs(moved[k] - plain[k]) > 0.1 for k in plain if k[1] <= 11) and all(abs(moved[k] - plain[k]) < 1e-9 for k in plain if k[1] > 11)
    scaled = spark.createDataFrame([(1, 1, w, 2.0, 0.0) for w in range(3)], "scenario int, bucket int, time_window int, a double, b double")
    assert all(abs(v - 0.4) < 1e-6 for k, v in mean_share(low, calibration=scaled).items())
