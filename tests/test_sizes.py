"""What has to hold so that a query's memory, disk and time follow its input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import metrics as G
from panelspark.operators import models as I


def test_scores_of_folds_join_nothing(spark, scored):
    actual, pred, aux = scored
    both = actual.join(pred.withColumnRenamed("volume", "p"), ["country", "brand_name", "months_postgx"]).join(aux, ["country", "brand_name"])
    frame = both.withColumns({"avg_vol_12m": F.col("avg_vol"), "prediction": F.col("p") / F.col("avg_vol"), "y_norm": F.col("volume") / F.col("avg_vol")}).localCheckpoint()
    folds = I._union([I._labelled(I.evaluate(frame, 1), fold=k) for k in range(3)])
    assert "Join" not in folds._jdf.queryExecution().optimizedPlan().toString()
    want = G.official_metric(actual, pred, aux, 1).first()["metric"]
    assert [r["official_metric"] for r in folds.collect()] == [want] * 3


def test_cosine_edges_are_added_up_and_not_written(spark, monkeypatch):
    from panelspark.operators import graph as O
    from panelspark.operators import similarity as Z

    def no_pairs(*_, **__):
        raise AssertionError("a graph needs no list of its cosine edges")

    monkeypatch.setattr(Z, "similar_pairs", no_pairs)
    monkeypatch.setattr(Z, "CHUNK", 8)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    x[7] = x[3]
    df = spark.createDataFrame([("C", f"B{i}", 0, None, None, *map(float, v)) for i, v in enumerate(x)],
                               "country string, brand_name string, months_postgx int, ther_area string, main_package string, a double, b double, c double")
    g = O.build_graph(df, ["a", "b", "c"], ("therapeutic",), 0.7, normalize=False)
    norm = np.linalg.norm(x, axis=1)
    s = x @ x.T / (np.outer(norm, norm) + 1e-6)
    w = np.where((s > 0.7) & ~np.eye(300, dtype=bool), s, 0.0)
    got = {r["node"]: r["degree"] for r in O.degrees(g).collect()}
    assert np.allclose([got[f"C|B{i}"] for i in range(300)], 1 + w.sum(1))
    edges = {r["edge_type"]: r["n_edges"] for r in O.edge_summary(g).collect()}
    assert edges["similar_erosion"] == (w > 0).sum() / 2


def test_a_row_of_the_pair_index_meets_few_blocks(spark):
    from panelspark.operators import similarity as Z
    x = np.random.default_rng(4).normal(size=(3000, 16))
    index, _ = Z.similar_index(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>"), "id", "v", 0.3)
    assert index._meets(index.placed, ["rep"]).count() == 1


def test_blocks_of_the_pair_index_are_not_shuffled_to_each_other(spark, monkeypatch):
    """What two blocks give each other is computed where their files are read, so disk follows the rows and not the pairs of blocks."""
    from panelspark.operators import similarity as Z
    monkeypatch.setattr(Z, "CHUNK", 4)
    x = np.random.default_rng(5).normal(size=(300, 6)).astype(np.float32)
    x[9] = x[2]
    x[10] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<float>")
    index, _ = Z.similar_index(df, "id", "v", 0.3)
    pairs = index.found()
    assert index.boxes.agg(F.sum("parts")).first()[0] > 8
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    u = x.astype(float)
    norm = np.linalg.norm(u, axis=1)
    s = u @ u.T / (np.outer(norm, norm) + 1e-6)
    want = {(i, j): s[i, j] for i in range(300) for j in range(i + 1, 300) if s[i, j] > 0.3 and 9 not in (i, j)}
    found = [(r["src"], r["dst"], r["weight"]) for r in pairs.where("src IS NOT NULL").collect()]
    got = {(a, b): w for a, b, w in found}
    assert len(found) == len(got) and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_blocks_hold_vectors_as_they_came(spark):
    from panelspark.operators import similarity as Z
    for kind in ("float", "double"):
        index, _ = Z.similar_index(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0])], f"id bigint, v array<{kind}>"), "id", "v", 0.3)
        assert index.placed.schema["x"].dataType.elementType.typeName() == kind
        assert index.found().where("src IS NOT NULL").count() == 1


def test_a_mean_share_that_is_a_short_fraction_is_met(spark):
    """(147 / 8) / (112 / 3) = 63 / 128, whose rounding to 6 digits hangs on the last digit of the double."""
    from panelspark.operators import panel as P
    months = [-10, -9, -8, -7, -6, -2, 5, 11, 13, 14, 16, 18, 19, 22]
    volumes = [31.0, 44.0, 37.0, 37.0, 37.0, 38.0, 15.0, 30.0, 4.0, 12.0, 61.0, 6.0, 18.0, 1.0]
    df = spark.createDataFrame([("X", "A", m, v, 112 / 3) for m, v in zip(months, volumes)], "country string, brand_name string, months_postgx int, volume double, avg_vol_12m double")
    assert {r["mean_erosion"] for r in P.add_target(df).collect()} == {63 / 128}


def test_queries_reach_leaves_in_small_steps(spark, monkeypatch):
    """What a task holds of distances to leaves is bounded, however many queries a batch has."""
    from panelspark.operators import similarity as Z
    assert Z.REACHED * 8 <= 4 << 20
    monkeypatch.setattr(Z, "REACHED", 8)
    x = np.random.default_rng(8).normal(size=(1500, 3))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    got = {(r["query"], r["rank"]): r["neighbour"] for r in Z.nearest(df.where("id < 40"), df.where("id >= 40"), "id", "v", 3).collect()}
    near = np.lexsort((np.broadcast_to(np.arange(1460), (40, 1460)), np.round(1 - u[:40] @ u[40:].T, 9)), axis=1)[:, :3] + 40
    assert all(got[q, k + 1] == near[q, k] for q in range(40) for k in range(3))


def test_isotonic_rows_find_their_blocks_in_one_pass(spark):
    """A frame from the row to the end of its piece is gone through anew for every row, so its time grows with the square."""
    from panelspark.operators import postprocess as K
    x = np.random.default_rng(5).uniform(0, 100, 400)
    val = spark.createDataFrame([("X", "A", i % 6, 1, 1, float(v), float(v + 9 * np.sin(v))) for i, v in enumerate(x)],
                                "country string, brand_name string, months_postgx int, scenario int, bucket int, volume_pred double, volume_true double")
    out = K.apply_isotonic_calibration(val.withColumn("volume", F.col("volume_pred")), K.fit_isotonic_calibration(val))
    assert "RangeFrame, currentrow$(), unboundedfollowing$()" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = [r["volume"] for r in out.orderBy("volume_pred").collect()]
    assert len(got) == 400 and got == sorted(got)


def from_files(df) -> bool:
    return "LogicalRDD" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_a_panel_and_its_medians_do_not_repeat_the_joins(spark, raw):
    """A series with two areas weighs in each by its rows there; the least of a month's competitor counts stays."""
    from panelspark.operators import panel as P
    assert from_files(P.build_panel(**raw))
    rows = [("X", "A", "T1", -3, 10.0), ("X", "A", "T1", -2, 20.0), ("X", "A", "T2", -1, 60.0), ("X", "B", "T2", -1, None), ("X", "C", "T2", -1, 70.0), ("X", "C", "T2", 0, 1.0)]
    df = spark.createDataFrame(rows, "country string, brand_name string, ther_area string, months_postgx int, volume double")
    own = P._own_by_series(df, F.when(F.col("months_postgx") < 0, F.col("volume")), F.lit(None).cast("double"))
    assert sorted((r["ther_area"], r["_own"], r["_rows"]) for r in own.where("_own IS NOT NULL").collect()) == [("T1", 30.0, 2), ("T2", 30.0, 1), ("T2", 70.0, 2)]
    got = P.compute_pre_entry_stats(df, is_train=False).where("brand_name = 'B'").first()
    assert got["avg_vol_12m"] == 70.0  # of 30, 70 and 70
    twice = raw["generics"].unionByName(spark.createDataFrame([("X", "A", 3, 2)], raw["generics"].schema))
    base = P.prepare_base_panel(raw["volume"], twice, raw["medicine_info"]).where("country = 'X' AND brand_name = 'A'")
    assert {r["months_postgx"]: r["n_gxs"] for r in base.where("n_gxs IS NOT NULL").collect()} == {0: 1, 3: 2}


def test_shipments_are_dealt_by_series_once(spark):
    from panelspark.plans import fixtures as fx
    sf, texts = "/root/testdata/sf0.001", fx.view_texts(fx.SPARK)
    tables = {n: fx.table(spark, sf, n) for n in ("lineitem", "part", "supplier", "nation")}
    shipped = spark.sql(texts["shipped_month"], **tables)
    plan = spark.sql(texts["series_month"], supplied=spark.sql(texts["supplied"], shipped_month=shipped))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(nk") == plan.count("Exchange hashpartitioning") == 1


def test_supply_medians_do_not_repeat_the_rollup(spark):
    from panelspark.operators import features as E
    panel = spark.sql("SELECT 'X' AS country, 'A' AS brand_name, id AS months_postgx, add_months(DATE'2020-01-01', CAST(id AS INT)) AS date FROM range(4)")
    seen = spark.createDataFrame([("X", "A", "2020-01-01", 3.0), ("X", "A", "2020-02-01", 5.0)], "country string, brand_name string, period string, vis_fill_rate double")
    out = E.add_visibility_features(panel, seen.withColumn("period", F.col("period").cast("date")), "date")
    assert from_files(out)
    assert [r["vis_fill_rate"] for r in out.orderBy("months_postgx").collect()] == [3.0, 5.0, 4.0, 4.0]


def test_nearest_rows_are_found_where_their_blocks_are_read(spark, monkeypatch):
    """Queries travelled to every leaf in reach, so the disk grew with the product of queries and leaves; now only what is found is shuffled."""
    from panelspark.operators import similarity as Z
    for name, value in {"CHUNK": 40, "BALL": 8, "LEAVES": 12}.items():
        monkeypatch.setattr(Z, name, value)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[300:700] = x[300] + rng.normal(size=(400, 16)) * 1e-3  # one leaf holds most rows
    x[710:730] = x[710]  # copies
    ids = [f"s{i % 850:03d}" for i in range(900)]  # and some names twice
    df = spark.createDataFrame([(i, name, v.tolist()) for i, (name, v) in enumerate(zip(ids, x))], "i int, id string, v array<float>")
    missing = spark.createDataFrame([(1000, "none", None)], df.schema)
    near = Z.nearest(df.where("i % 3 = 0").unionByName(missing), df.where("i % 3 > 0").unionByName(missing), "id", "v", 4)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and plan.count("Exchange hashpartitioning") == 1
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want: dict = {}
    for q in range(0, 900, 3):
        d = np.round(1 - u[q] @ u.T, 9)
        want.setdefault(ids[q], []).extend((max(d[j], 0.0), ids[j]) for j in range(900) if j % 3)
    got: dict = {}
    for r in near.orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["distance"], r["neighbour"]))
    assert got.keys() == want.keys()
    for q, rows in got.items():
        best = sorted(want[q])[:4]
        assert np.allclose([d for d, _ in rows], [d for d, _ in best], atol=2e-9)
        assert all(n in {m for e, m in want[q] if abs(e - d) <= 2e-9} for d, n in rows)


def test_a_neighbours_curve_travels_as_one_row(spark):
    """Joined as a row per neighbour and month, it was shuffled to the sums of each month."""
    from panelspark.operators.curves import HistoricalCurve
    rng = np.random.default_rng(12)
    level = rng.normal(size=(30, 3))
    rows = [(f"C{s % 2}", f"B{s}", m, *map(float, level[s]), None if (s, m) == (4, 1) else float(s + m / 10)) for s in range(30) for m in range(6) if (s + m) % 7]
    rows += [("C0", "B0", None, *map(float, level[0]), 9.0), ("C1", "B21", None, *map(float, level[21]), 9.0), ("C1", "B21", 50, *map(float, level[21]), 9.0)]
    df = spark.createDataFrame(rows, "country string, brand_name string, months_postgx int, a double, b double, c double, y_norm double")
    number = F.substring("brand_name", 2, 9).cast("int")
    model = HistoricalCurve(k=3, columns=["a", "b", "c"], categories=[]).fit(df.where(number < 20))
    out = model.predict(df.where(number >= 20))
    exchanges = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert exchanges and not any("months_postgx" in x.split("ENSURE")[0].split("REPARTITION")[0] for x in exchanges)
    by_month: dict = {}
    for _, b, m, *_, y in rows:
        if int(b[1:]) < 20:
            by_month.setdefault(m, []).append((int(b[1:]), y))
    near: dict = {}
    for r in model.neighbours(df.where(number >= 20)).collect():
        near.setdefault(int(r["query"][4:]), {})[int(r["neighbour"][4:])] = 1 / (r["distance"] + 1e-6)
    known = [y for x in by_month.values() for _, y in x if y is not None]
    got = out.collect()
    assert len(got) == sum(int(b[1:]) >= 20 for _, b, *_ in rows)
    for r in got:
        m, w = r["months_postgx"], near[int(r["brand_name"][1:])]
        of = [(w[s], y) for s, y in by_month.get(m, []) if s in w] if m is not None else []
        every = [y for _, y in by_month.get(m, []) if y is not None] if m is not None else []
        if any(y is not None for _, y in of):  # a missing share weighs in the sum of the weights, as it did
            want = sum(x * y for x, y in of if y is not None) / sum(x for x, _ in of)
        else:
            want = np.mean(every or known)
        assert abs(r["prediction"] - want) < 1e-9, (r, want)


def test_supply_metrics_meet_the_features_on_their_series(spark, monkeypatch):
    """The frame of all features was dealt anew by series and month, and written, for eight columns of metrics."""
    from panelspark.operators import features as E
    from panelspark.operators.panel import series_window
    rows = [("X", "A", m, f"2020-0{m + 1}-15") for m in range(5)] + [("X", "A", 7, "2020-01-20"), ("X", "B", 0, "2020-01-01"), ("X", "B", 1, None), (None, "B", 0, "2020-01-01")]
    panel = spark.createDataFrame(rows, "country string, brand_name string, months_postgx int, date string").withColumn("date", F.col("date").cast("date"))
    wide = panel.withColumn("wide", F.count("*").over(series_window()))
    seen = [("X", "A", "2020-01-01", 3.0, 1.0), ("X", "A", "2020-02-01", 5.0, None), ("X", "A", "2020-03-01", 7.0, None), ("X", "A", "2020-03-01", 8.0, None),
            ("X", "A", "2021-01-01", 99.0, 9.0), ("X", "C", "2020-01-01", 99.0, 9.0), (None, "B", "2020-01-01", 99.0, 9.0)]
    metrics = spark.createDataFrame(seen, "country string, brand_name string, period string, vis_fill_rate double, vis_avg_lead_time double").withColumn("period", F.col("period").cast("date"))
    written = []
    monkeypatch.setattr(E, "stage", lambda df, keep=E.stage: written.extend(df.columns) or keep(df))
    out = E.add_visibility_features(wide, metrics)
    assert written and "wide" not in written
    exchanges = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert exchanges and not any("_period" in x for x in exchanges)
    assert out.columns[:5] == wide.columns and set(out.columns[5:]) == set(E.VISIBILITY_COLUMNS)
    # the joined rows bear 3, 3, 5, 7 and 8, so gaps get 5; a month that is known twice stands twice
    got = sorted((str(r["country"]), r["brand_name"], r["months_postgx"], r["wide"], r["vis_fill_rate"], r["vis_avg_lead_time"], r["vis_avg_inventory"]) for r in out.collect())
    assert got == [("None", "B", 0, 1, 5.0, 1.0, 0.0), ("X", "A", 0, 6, 3.0, 1.0, 0.0), ("X", "A", 1, 6, 5.0, 1.0, 0.0), ("X", "A", 2, 6, 7.0, 1.0, 0.0), ("X", "A", 2, 6, 8.0, 1.0, 0.0),
                   ("X", "A", 3, 6, 5.0, 1.0, 0.0), ("X", "A", 4, 6, 5.0, 1.0, 0.0), ("X", "A", 7, 6, 3.0, 1.0, 0.0), ("X", "B", 0, 2, 5.0, 1.0, 0.0), ("X", "B", 1, 2, 5.0, 1.0, 0.0)]
