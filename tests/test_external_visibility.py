import datetime as dt

from pyspark.sql import functions as F

from panelspark.operators import external as L
from panelspark.operators import visibility as V
from panelspark.sources import external as X
from panelspark.sources.visibility import VisibilitySource


def d(text):
    return dt.date.fromisoformat(text)


def panel(spark):
    rows = [(c, b, i, d(day)) for c, b in (("X", "A"), ("X", "B"), ("Y", "A"))
            for i, day in enumerate(("2020-01-01", "2020-02-01", "2020-03-01"))]
    return spark.createDataFrame(rows, "country string, brand_name string, months_postgx int, date date")


def test_epidemics_take_the_worst_running_event(spark):
    events = spark.createDataFrame(
        [("X", d("2019-12-20"), d("2020-02-01"), 2), ("X", d("2020-02-01"), None, 5), ("X", d("2020-02-10"), d("2020-02-20"), 4),
         ("Y", d("2020-03-02"), d("2020-01-01"), 3)],
        "country string, start_date date, end_date date, severity int")
    out = {(r["country"], r["months_postgx"]): (r["ext_epidemic_severity"], r["ext_epidemic_active"])
           for r in L.join_epidemics(panel(spark), events).where("brand_name = 'A'").collect()}
    assert out == {("X", 0): (2, 1), ("X", 1): (5, 1), ("X", 2): (5, 1), ("Y", 0): (0, 0), ("Y", 1): (0, 0), ("Y", 2): (0, 0)}


def test_promotions_for_all_and_for_listed_brands(spark):
    events = spark.createDataFrame(
        [("X", d("2020-01-01"), None, "price_cut", "A | Z"), ("X", d("2020-03-01"), d("2020-03-05"), "patent_expiry", ""),
         ("Y", d("2020-01-01"), d("2020-12-01"), "other", "")],
        "country string, start_date date, end_date date, event_type string, affected_brands string")
    out = L.join_promo_policy(panel(spark), X.load_promo_or_policy_events(spark, events))
    assert out.count() == 9
    promo = {(r["country"], r["brand_name"], r["months_postgx"]) for r in out.where("ext_promo_active = 1").collect()}
    policy = {(r["country"], r["brand_name"], r["months_postgx"]) for r in out.where("ext_policy_change = 1").collect()}
    assert promo == {("X", "A", 0), ("X", "A", 1)} and policy == {("X", "A", 2), ("X", "B", 2)}


def test_holidays_and_macro_fill(spark):
    hol = spark.createDataFrame([(d("2020-02-03"), "X", "a"), (d("2020-02-09"), "X", "b")], "date date, country string, holiday_name string")
    macro = spark.createDataFrame([(d("2020-02-03"), "X", "inflation", 1.0), (d("2020-02-20"), "X", "inflation", 3.0)],
                                  "date date, country string, indicator_name string, value double")
    out = L.join_external_context(panel(spark), hol, None, macro, None)
    got = {(r["country"], r["months_postgx"]): (r["ext_n_holidays"], r["ext_inflation"]) for r in out.collect()}
    assert got[("X", 1)] == (2, 3.0) and got[("X", 0)] == (0, 3.0) and got[("X", 2)] == (0, 3.0)
    assert got[("Y", 0)] == (0, 3.0)
    assert out.where("ext_gdp_growth IS NOT NULL").count() == 0


def test_loaders_normalise_and_survive_absent_files(spark, tmp_path):
    assert X.load_holiday_calendar(spark, None).count() == 0
    assert X.load_epidemic_events(spark, str(tmp_path / "absent.csv")).columns[0] == "start_date"
    path = tmp_path / "macro.csv"
    path.write_text("date,country,indicator_name,value\n2020-01-01,de,GDP Growth,1.5\n2020-01-01,de,Inflation,n/a\n")
    rows = X.load_macro_indicators(spark, str(path)).collect()
    assert [(r["country"], r["indicator_name"], r["value"]) for r in rows] == [("DE", "gdp_growth", 1.5)]
    path = tmp_path / "epi.csv"
    path.write_text("country,start_date,event_name,severity\nfr,2020-01-01,w,9\n")
    r = X.load_epidemic_events(spark, str(path), min_severity=5).first()
    assert r["severity"] == 5 and r["end_date"] is None and r["country"] == "FR"


def test_supply_rollup_keeps_every_month(spark):
    inv = spark.createDataFrame([(d("2020-01-05"), "x", "A", 10.0), (d("2020-01-25"), "x", "A", 20.0)],
                                "date date, country string, brand_name string, inventory_units double")
    orders = spark.createDataFrame([(d("2020-02-05"), "X", "A", 0.0, 3.0), (d("2020-03-05"), "X", "A", 10.0, 4.0)],
                                   "date date, country string, brand_name string, order_quantity double, lead_time_days double")
    dist = spark.createDataFrame([(d("2020-01-05"), "X", 0.5)], "date date, country string, capacity_utilization double")
    src = VisibilitySource(spark, {"inventory": inv, "orders": orders, "distribution": dist})
    out = V.aggregated_visibility(src.load_inventory(), src.load_orders(), src.load_supplier_metrics(), src.load_distribution_metrics())
    got = {r["period"].month: r for r in out.collect()}
    assert len(got) == 3 and got[1]["vis_avg_inventory"] == 15.0 and got[1]["vis_capacity_utilization"] == 0.5
    assert got[2]["vis_fill_rate"] is None and got[3]["vis_fill_rate"] == 1.0  # filled as ordered
    joined = V.join_visibility_features(panel(spark), out)
    assert joined.where("vis_avg_inventory IS NULL").count() == 0
    assert {r[0] for r in joined.select("vis_avg_inventory").collect()} == {15.0}
    raw = V.join_visibility_features(panel(spark), out, fill_missing=False)
    assert raw.where(F.col("vis_avg_inventory").isNotNull()).count() == 1
