from __future__ import annotations

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from panelspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "4g")


@pytest.fixture(scope="session")
def raw(spark):
    """Three series: A with a full pre-event year, B with pre-event rows only before month -12, C without any."""
    volume = []
    for m in range(-12, 24):
        volume.append(("X", "A", "JanFebMarAprMayJunJulAugSepOctNovDec"[(m % 12) * 3:(m % 12) * 3 + 3], m,
                       100.0 if m < 0 else 100.0 * (1 - 0.02 * m)))
    volume += [("X", "B", "Jan", -20, 50.0), ("X", "B", "Feb", 0, 10.0), ("X", "B", "Mar", 1, 5.0)]
    volume += [("Y", "C", "Jan", 0, 30.0), ("Y", "C", "Feb", 1, 20.0)]
    generics = [("X", "A", 0, 1), ("X", "A", 3, 4), ("Y", "C", 1, 2)]
    medicine = [("X", "A", "T1", 80.0, "Tablet", True, False), ("X", "B", "T1", None, "Injection vial", None, True),
                ("Y", "C", "T2", None, "Cream", False, None)]
    return {
        "volume": spark.createDataFrame(volume, "country string, brand_name string, month string, months_postgx int, volume double"),
        "generics": spark.createDataFrame(generics, "country string, brand_name string, months_postgx int, n_gxs int"),
        "medicine_info": spark.createDataFrame(
            medicine, "country string, brand_name string, ther_area string, hospital_rate double, main_package string, "
                      "biological boolean, small_molecule boolean"),
    }


@pytest.fixture(scope="session")
def panel(raw):
    from panelspark.operators.panel import build_panel
    return build_panel(**raw).cache()


@pytest.fixture(scope="session")
def scored(spark):
    """Four series x 24 months: actual falls by 2% a month, the forecast is 10 off in every month."""
    actual, pred, aux = [], [], []
    for i in range(4):
        base = 1000.0 * (i + 1)
        aux.append(("X", f"B{i}", base, 1 if i < 2 else 2))
        for m in range(24):
            y = base * (1 - 0.02 * m)
            actual.append(("X", f"B{i}", m, y))
            pred.append(("X", f"B{i}", m, y + 10))
    rows = "country string, brand_name string, months_postgx int, volume double"
    return (spark.createDataFrame(actual, rows), spark.createDataFrame(pred, rows),
            spark.createDataFrame(aux, "country string, brand_name string, avg_vol double, bucket int"))
