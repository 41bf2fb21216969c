import pytest
from pyspark.sql import functions as F

from panel_rows import by_key
from panelspark.operators import columns as C
from panelspark.operators import panel as P


def test_missing_values_are_filled_in_order(raw):
    rows = by_key(P.handle_missing_values(P.prepare_base_panel(**raw)))
    a = [rows[("X", "A", m)]["n_gxs"] for m in (-1, 0, 2, 3, 23)]
    assert a == [0, 1, 1, 4, 4]
    b, c = rows[("X", "B", 0)], rows[("Y", "C", 0)]
    assert b["hospital_rate"] == 80.0 and b["hospital_rate_missing"] == 1  # median of its area
    assert c["hospital_rate"] == 80.0  # its area has none, so the overall median
    assert b["biological"] is False and b["biological_missing"] == 1 and c["small_molecule_missing"] == 1


def test_average_volume_falls_back_step_by_step(panel):
    rows = by_key(panel)
    assert rows[("X", "A", 0)]["avg_vol_12m"] == 100.0 and rows[("X", "A", 0)]["pre_entry_months_available"] == 12
    assert rows[("X", "B", 0)]["avg_vol_12m"] == 50.0  # any month before the event
    assert rows[("Y", "C", 0)]["avg_vol_12m"] == 100.0  # median over all rows
    assert rows[("X", "B", 0)]["bucket"] == 1 and rows[("X", "A", 0)]["bucket"] == 2


def test_a_missing_key_column_is_refused(raw):
    with pytest.raises(ValueError):
        P.prepare_base_panel(raw["volume"].drop("volume"), raw["generics"], raw["medicine_info"])


def test_expand_adds_missing_months_once(raw):
    base = P.prepare_base_panel(**raw).where("brand_name <> 'A'")
    out = P.expand_panel(base, 0, 3)
    rows = by_key(out)
    assert out.where("months_postgx >= 0").count() == 8 and out.groupBy("country", "brand_name", "months_postgx").count().where("count > 1").count() == 0
    assert rows[("Y", "C", 3)]["month"] == "Apr" and rows[("Y", "C", 3)]["volume"] is None
    assert [rows[("Y", "C", m)]["n_gxs"] for m in (0, 1, 3)] == [2, 2, 2]


def test_test_scenarios(spark):
    df = spark.createDataFrame([("X", "A", -3), ("X", "A", 2), ("X", "B", -1)], "country string, brand_name string, months_postgx int")
    got = {r["brand_name"]: r["scenario"] for r in P.detect_test_scenarios(df).collect()}
    assert got == {"A": 2, "B": 1}


def test_augmentation_repeats_and_keeps_its_bounds(panel):
    one, two = P.augment_panel(panel), P.augment_panel(panel)
    assert one.exceptAll(two).count() == 0
    joined = one.alias("o").join(panel.alias("p"), ["country", "brand_name", "months_postgx"])
    assert joined.where("abs(o.volume - p.volume) > 0.0500001 * p.volume").count() == 0
    assert one.where("months_postgx < 0").count() == 0


def test_rows_visible_and_target(panel):
    seen, target = C.simulate_scenario(panel, "scenario2")
    assert seen.agg(F.max("months_postgx")).first()[0] == 5 and target.agg(F.min("months_postgx")).first()[0] == 6
    assert C.select_training_rows(panel, 1).where("months_postgx < 0").count() == 0
    with pytest.raises(ValueError):
        C.select_training_rows(panel, 3)


def test_missing_pre_entry_data(spark):
    df = spark.createDataFrame([(10.0,), (30.0,), (None,), (0.0,)], "avg_vol_12m double")
    assert sorted(r[0] for r in P.handle_missing_pre_entry_data(df).collect()) == [10.0, 20.0, 20.0, 30.0]
    none = df.where("avg_vol_12m IS NULL OR avg_vol_12m = 0")
    assert {r[0] for r in P.handle_missing_pre_entry_data(none).collect()} == {1000.0}
