import json

import pytest
from pyspark.sql import functions as F

from panelspark.operators import runs as Q
from panelspark.operators import sequence as P
from panelspark.sources import logs, tables
from panelspark.sources.files import fingerprint, lazy_load


@pytest.fixture(scope="module")
def series(spark):
    rows = [("X", "A", m, float(m)) for m in range(6)] + [("X", "B", m, 10.0 * m) for m in range(2)]
    return spark.createDataFrame(rows, "country string, brand_name string, months_postgx int, volume double")


def test_windows_and_targets(series):
    out = P.build_sequences(series, ["volume"], "volume", lookback=3, horizon=2).orderBy("months").collect()
    assert [(r["months"], r["y"]) for r in out] == [([0, 1, 2], [3.0, 4.0]), ([1, 2, 3], [4.0, 5.0])]
    assert out[0]["X_seq"] == [[0.0], [1.0], [2.0]] and out[0]["mask"] == [1, 1, 1]


def test_inference_windows_are_padded(series):
    got = {r["brand_name"]: r for r in P.sequences_for_inference(series, ["volume"], 4, pad_value=-1.0).collect()}
    assert got["A"]["X_seq"] == [[2.0], [3.0], [4.0], [5.0]] and got["A"]["mask"] == [1] * 4
    assert got["B"]["X_seq"] == [[-1.0], [-1.0], [0.0], [10.0]] and got["B"]["mask"] == [0, 0, 1, 1]


def test_padding_modes(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [4.0])], "id int, s array<double>")
    def run(**kw):
        return {r["id"]: (r["s"], r["mask"]) for r in P.pad_sequences(df, "s", **kw).collect()}
    assert run(max_length=2) == {1: ([2.0, 3.0], [1, 1]), 2: ([0.0, 4.0], [0, 1])}
    assert run(max_length=2, padding="post") == {1: ([1.0, 2.0], [1, 1]), 2: ([4.0, 0.0], [1, 0])}
    assert run()[2] == ([0.0, 0.0, 4.0], [0, 0, 1])
    with pytest.raises(ValueError):
        P.pad_sequences(df, "s", padding="middle")


@pytest.mark.parametrize("method", ["standard", "minmax", "robust"])
def test_sequence_scaler_inverts_the_target(series, method):
    made = P.build_sequences(series, ["volume"], "volume", 2, 1)
    s = P.SequenceScaler(method).fit(made, "y")
    back = s.inverse_transform_target(s.transform(made, "y"), "y")
    gap = back.select(F.sum(F.col("y")[0])).first()[0] - made.select(F.sum(F.col("y")[0])).first()[0]
    assert abs(gap) < 1e-6


def test_grid_and_best_runs(spark):
    grid = Q.grid_runs(Q.grid_from(spark, {"depth": [4, 6], "rate": [0.1, 0.3, 0.5]}))
    assert grid.count() == 6 and grid.select("config_id").distinct().count() == 6
    runs = spark.createDataFrame([("a", "r1", 2.0), ("a", "r2", 1.0), ("b", "r3", 3.0), ("b", "r4", None)], "model string, run_id string, value double")
    got = {r["scope"]: r["run_id"] for r in Q.summarize_runs(runs, "value").collect()}
    assert got == {"a": "r2", "b": "r3", "overall": "r2"}
    assert Q.best_run(runs, "value", True).first()["run_id"] == "r3"


def test_submission_gaps(spark):
    df = spark.createDataFrame([("s1", 0.5, 0.7), ("s2", 0.6, 0.61), ("s3", None, 0.1), ("s4", 0.4, 0.55)], "submission_id string, cv_score double, lb_score double")
    r = Q.cv_lb_variance(df).first()
    assert r["n_submissions"] == 3 and r["worst_gap_submission"] == "s1" and r["overfitting_warning"] == 1
    assert Q.best_submission(df).first()["submission_id"] == "s3"
    assert {x["submission_id"] for x in Q.overfitting_submissions(df).collect()} == {"s1", "s4"}


def test_metric_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    assert logs.load_metric_records(spark, path).count() == 0
    rec = [{"run_id": "r1", "metric": "mae", "value": 1, "phase": "cv", "extra": {"k": 2}}, {"run_id": "r2", "metric": "mae", "value": 2.5}]
    logs.save_metric_records(logs.metric_records(spark, rec), path)
    logs.save_metric_records(logs.metric_records(spark, [{"run_id": "r1", "metric": "rmse", "value": 3}]), path)
    log = logs.load_metric_records(spark, path)
    assert log.count() == 3
    assert logs.metrics_for_run(log, "r1").count() == 2
    r = logs.metrics_for_run(log, "r1", metric="mae", phase="cv").first()
    assert r["value"] == 1.0 and r["extra"] == {"k": "2"}
    with pytest.raises(ValueError):
        logs.metrics_for_run(log, "r1", colour="red")


def test_raw_tables_panel_and_features_are_stored(spark, raw, tmp_path):
    paths = {}
    for name, df in raw.items():
        paths[name] = str(tmp_path / f"{name}.csv")
        df.toPandas().to_csv(paths[name], index=False)
    read = tables.load_raw_data(spark, paths)
    assert read["volume"].count() == raw["volume"].count() and dict(read["generics"].dtypes)["n_gxs"] == "int"
    store = str(tmp_path / "store")
    built = tables.get_panel(spark, store, "train", lambda: read)
    assert built.count() == raw["volume"].count()
    again = tables.get_panel(spark, store, "train", lambda: pytest.fail("must not rebuild"))
    assert again.count() == built.count()
    feats = tables.get_features(spark, store, "train", 2, "train", lambda: built)
    assert feats.where("months_postgx < 6").count() == 0
    with pytest.raises(FileNotFoundError):
        tables.load_raw_data(spark, {**paths, "volume": str(tmp_path / "absent.csv")})
    with pytest.raises(ValueError):
        tables.check_raw({"volume": read["volume"]})


def test_lazy_load_prefers_its_copy(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("b,a\nx,1\ny,oops\n")
    first = lazy_load(spark, str(path), "a int, b string, c string")
    assert first.columns == ["a", "b"] and [r["a"] for r in first.orderBy("b").collect()] == [1, None]
    path.write_text("b,a\nx,5\n")
    assert lazy_load(spark, str(path), "a int, b string").count() == 2
    with pytest.raises(FileNotFoundError):
        lazy_load(spark, str(tmp_path / "no.csv"), "a int")


def test_submission_is_versioned_and_logged(spark, scored, panel, tmp_path):
    _, pred, _ = scored
    for v in ("v1", "v2"):
        row = logs.save_submission(pred, str(tmp_path), v, panel, {"m": 1}, 0.5).first()
        assert row["version"] == v and row["n_rows"] == 96 and row["n_series"] == 4 and json.loads(row["model_info"]) == {"m": 1}
    assert spark.read.csv(str(tmp_path / "version=v1" / "submission"), header=True).count() == 96


def test_changed_raw_files_give_new_panel_and_features(spark, raw, tmp_path):
    paths = {}
    for name, df in raw.items():
        paths[name] = str(tmp_path / name)
        df.write.parquet(paths[name])
    store, built = str(tmp_path / "store"), []

    def panel():
        def load():
            built.append("panel")
            return tables.load_raw_data(spark, paths)
        return tables.get_panel(spark, store, "train", load, sources=paths.values())

    def features():
        def of():
            built.append("features")
            return panel()
        return tables.get_features(spark, store, "train", 1, "train", of, sources=paths.values())

    first = features().count()
    assert built == ["features", "panel"]
    assert features().count() == first and panel().count() > 0 and built == ["features", "panel"]
    before = fingerprint(spark, paths.values())
    more = raw["volume"].where("brand_name = 'A'").withColumn("brand_name", F.lit("D"))
    more.write.mode("append").parquet(paths["volume"])
    assert features().count() == first + 24 and built == ["features", "panel"] * 2
    assert features().where("brand_name = 'D'").count() == 24 and built == ["features", "panel"] * 2
    assert fingerprint(spark, [str(tmp_path / "absent")]) == fingerprint(spark, [str(tmp_path / "absent")]) != before
