"""Queries over sources, external joins and supply rollups (SURVEY sections A, L, M and E12)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelspark.constants import MACRO_COLUMNS, ROW_KEY, VISIBILITY_COLUMNS
from panelspark.functions.stage import stage_folder
from panelspark.operators import baselines as B
from panelspark.operators import columns as C
from panelspark.operators import external as L
from panelspark.operators import features as E
from panelspark.operators import metrics as G
from panelspark.operators import visibility as V
from panelspark.plans import fixtures as fx
from panelspark.plans import queries_features as qf
from panelspark.plans.fixtures import duck_ctes
from panelspark.plans.registry import ORACLES, query, r, rx
from panelspark.plans.shared_sql import SHARED
from panelspark.sources import external as X
from panelspark.sources import logs, schemas, tables
from panelspark.sources.files import lazy_load
from panelspark.sources.visibility import VisibilitySource

ROW = "country, brand_name, months_postgx"
SER = "country, brand_name"
MACRO = list(MACRO_COLUMNS.values())


def raw(spark, sf):
    return dict(zip(("volume", "generics", "medicine_info"), fx.raw_tables(spark, sf)))


def store(spark, sf):
    """A folder of this application inside the shared checkpoint folder."""
    tail = str(sf).rstrip("/").rsplit("/", 1)[-1]
    return f"{stage_folder(spark)}/panelspark-store-{spark.sparkContext.applicationId}-{tail}"


@query("a01_load_raw_data", views="volume generics medicine_info", sql=f"""
    SELECT 'volume' AS source, count(*) AS n_rows, {rx('sum(volume)', 'total')} FROM volume
    UNION ALL SELECT 'generics', count(*), sum(n_gxs) FROM generics
    UNION ALL SELECT 'medicine_info', count(*), {rx('sum(hospital_rate)', 'total')} FROM medicine_info""")
def _(spark, sf):
    checked = tables.check_raw(raw(spark, sf))
    out = None
    for name, value in (("volume", "volume"), ("generics", "n_gxs"), ("medicine_info", "hospital_rate")):
        part = checked[name].agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("n_rows"),
                                 F.sum(value).cast("double").alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


@query("a02_get_panel", views="panel", sql=f"""
    SELECT {ROW}, bucket, n_gxs, {r('volume avg_vol_12m y_norm hospital_rate')} FROM panel""")
def _(spark, sf):
    return tables.get_panel(spark, store(spark, sf), "train", lambda: raw(spark, sf)).select(
        *ROW_KEY, "bucket", "n_gxs", "volume", "avg_vol_12m", "y_norm", "hospital_rate")


@query("a03_get_features", views="panel", sql=f"""
    SELECT {ROW}, {r('y_norm')}, n_gxs, {rx('sqrt(greatest(months_postgx, 0))', 'sqrt_months_postgx')},
      {rx('hospital_rate / 100', 'hospital_rate_norm')} FROM panel WHERE months_postgx BETWEEN 0 AND 23""")
def _(spark, sf):
    df = tables.get_features(spark, store(spark, sf), "train", 1, "train", lambda: fx.panel(spark, sf))
    features, target, meta = E.split_features_target_meta(df)
    return df.select(*ROW_KEY, target, *[c for c in features if c in ("n_gxs", "sqrt_months_postgx", "hospital_rate_norm")])


@query("a05_holiday_calendar", views="holidays", sql="""
    SELECT CAST(date AS STRING) AS date, upper(country) AS country, holiday_name, holiday_type FROM holidays
    WHERE upper(country) IN ('NATION_1', 'NATION_2') AND date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'""")
def _(spark, sf):
    return X.load_holiday_calendar(spark, fx.view(spark, sf, "holidays"), ["nation_1", "nation_2"], "1996-01-01",
                                   "1997-12-31").withColumn("date", F.col("date").cast("string"))


@query("a06_epidemic_events", views="epidemics", sql="""
    SELECT CAST(start_date AS STRING) AS start_date, CAST(end_date AS STRING) AS end_date, country, event_name,
      greatest(1, least(5, severity)) AS severity FROM epidemics WHERE severity >= 3""")
def _(spark, sf):
    df = X.load_epidemic_events(spark, fx.view(spark, sf, "epidemics"), min_severity=3).drop("affected_ther_areas")
    return df.withColumns({c: F.col(c).cast("string") for c in ("start_date", "end_date")})


@query("a07_macro_indicators", views="macro", sql=f"""
    SELECT CAST(date AS STRING) AS date, country, lower(replace(indicator_name, ' ', '_')) AS indicator_name, {r('value')}, unit
    FROM macro WHERE indicator_name IN ('gdp_growth', 'inflation') AND value IS NOT NULL""")
def _(spark, sf):
    df = X.load_macro_indicators(spark, fx.view(spark, sf, "macro"), indicators=["GDP growth", "Inflation"])
    return df.withColumn("date", F.col("date").cast("string"))


@query("a08_promo_policy_events", views="promo_policy", sql="""
    SELECT CAST(start_date AS STRING) AS start_date, CAST(end_date AS STRING) AS end_date, country, event_type,
      CASE WHEN affected_brands <> '' THEN len(string_split(affected_brands, '|')) ELSE -1 END AS n_brands,
      CASE WHEN affected_brands <> '' THEN string_split(affected_brands, '|')[1] END AS first_brand FROM promo_policy""")
def _(spark, sf):
    df = X.load_promo_or_policy_events(spark, fx.view(spark, sf, "promo_policy"))
    return df.select(*[F.col(c).cast("string").alias(c) for c in ("start_date", "end_date")], "country", "event_type",
                     F.coalesce(F.size("brands"), F.lit(-1)).alias("n_brands"), F.col("brands")[0].alias("first_brand"))


def supply(spark, sf, **renames):
    return VisibilitySource(spark, {n: fx.view(spark, sf, f"vis_{n}") for n in
                                    ("inventory", "orders", "suppliers", "distribution")}, renames)


@query("a09_renamed_source", views="", sql=f"""
    SELECT CAST(l_shipdate AS DATE)::STRING AS date, upper(l_returnflag) AS country, l_linestatus AS brand_name,
      {rx('sum(l_quantity)', 'inventory_units')} FROM lineitem GROUP BY 1, 2, 3""")
def _(spark, sf):
    names = {"l_shipdate": "date", "l_returnflag": "country", "l_linestatus": "brand_name", "l_quantity": "inventory_units"}
    src = VisibilitySource(spark, {"inventory": fx.view(spark, sf, "lineitem")}, {"inventory": names})
    return src.load_inventory().groupBy(F.col("date").cast("date").cast("string").alias("date"), "country",
                                        "brand_name").agg(F.sum("inventory_units").alias("inventory_units"))


NARROW = "country IN ('NATION_1', 'NATION_7') AND brand_name IN ('Brand#3', 'Brand#11')"
PLACES = (["nation_1", "NATION_7"], ["Brand#3", "Brand#11"])


@query("a10_inventory", views="vis_inventory", sql=f"""
    SELECT CAST(date AS STRING) AS date, {SER}, 'distributor' AS location_type, {r('inventory_units days_of_supply stock_out_risk')}
    FROM vis_inventory WHERE {NARROW} AND date >= DATE '1996-06-01'""")
def _(spark, sf):
    return supply(spark, sf).load_inventory(*PLACES, start_date="1996-06-01").withColumn("date", F.col("date").cast("string"))


@query("a11_orders", views="vis_orders", sql=f"""
    SELECT CAST(date AS STRING) AS date, {SER}, {r('order_quantity filled_quantity')}, lead_time_days, 'replenishment' AS order_type
    FROM vis_orders WHERE {NARROW}""")
def _(spark, sf):
    return supply(spark, sf).load_orders(*PLACES).withColumn("date", F.col("date").cast("string"))


@query("a12_supplier_metrics", views="vis_suppliers", sql=f"""
    SELECT CAST(date AS STRING) AS date, {SER}, supplier_id, {r('reliability_score on_time_delivery_rate')} FROM vis_suppliers WHERE {NARROW}""")
def _(spark, sf):
    df = supply(spark, sf).load_supplier_metrics(*PLACES).drop("quality_score")
    return df.withColumn("date", F.col("date").cast("string"))


@query("a13_distribution_metrics", views="vis_distribution", sql=f"""
    SELECT CAST(date AS STRING) AS date, country, distribution_center_id, {r('capacity_utilization')} FROM vis_distribution
    WHERE country IN ('NATION_1', 'NATION_7')""")
def _(spark, sf):
    df = supply(spark, sf).load_distribution_metrics(PLACES[0]).drop("throughput_units", "backlog_units")
    return df.withColumn("date", F.col("date").cast("string"))


@query("a14_save_metric_records", views="metric_log", sql="SELECT run_id, count(*) AS n_rows FROM metric_log GROUP BY 1")
def _(spark, sf):
    path = f"{store(spark, sf)}/metric_log"
    logs.save_metric_records(fx.view(spark, sf, "metric_log"), path, append=False)
    return logs.load_metric_records(spark, path).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("a04_lazy_load", views="volume", sql=f"SELECT {SER}, month, months_postgx, {r('volume')} FROM volume")
def _(spark, sf):
    """The volume table through a CSV file and its parquet copy."""
    path = f"{store(spark, sf)}/volume.csv"
    fx.view(spark, sf, "volume").write.mode("overwrite").csv(path, header=True)
    lazy_load(spark, path, schemas.RAW["volume"])
    return lazy_load(spark, path, schemas.RAW["volume"])


LOG = "run_id, phase, split, scenario, model, metric, step, bucket, series_id"


@query("a15_load_metric_records", views="metric_log",
       sql=f"SELECT {LOG}, {r('value')}, json_extract_string(extra, '$.order') AS order_id FROM metric_log")
def _(spark, sf):
    df = logs.load_metric_records(spark, fx.view(spark, sf, "metric_log"))
    return df.withColumn("order_id", F.col("extra")["order"]).drop("extra", "timestamp")


@query("a16_metrics_for_run", views="metric_log", sql=f"""
    SELECT {LOG}, {r('value')} FROM metric_log WHERE run_id = 'run_7' AND phase = 'cv' AND metric = 'mae' AND bucket = 2""")
def _(spark, sf):
    df = logs.load_metric_records(spark, fx.view(spark, sf, "metric_log"))
    return logs.metrics_for_run(df, "run_7", phase="cv", metric="mae", bucket=2).drop("extra", "timestamp")


def forecast(spark, sf):
    return B.exponential_decay(G.create_aux(fx.panel(spark, sf)), range(24))


def _log_sql(notes: str, info: str, score: float) -> str:
    return f"""
    SELECT 'v1' AS version, count(*) AS n_rows, count(DISTINCT (country, brand_name)) AS n_series, {rx('avg(volume)', 'volume_mean')},
      {rx('stddev_samp(volume)', 'volume_std')}, {rx('min(volume)', 'volume_min')}, {rx('max(volume)', 'volume_max')},
      {score}::DOUBLE AS validation_score, '{info}' AS model_info, '{notes}' AS notes FROM pred"""


@query("a17_save_submission", views="pred", sql=_log_sql("", '{"model": "decay"}', 0.9))
def _(spark, sf):
    out = f"{store(spark, sf)}/submissions-{uuid.uuid4().hex}"
    return logs.save_submission(forecast(spark, sf), out, "v1", fx.panel(spark, sf), {"model": "decay"}, 0.9).drop("timestamp")


@query("a18_submission_log_row", views="pred", sql=_log_sql("n", "{}", 0.5))
def _(spark, sf):
    return logs.submission_log_row(forecast(spark, sf), "v1", None, 0.5, "n").drop("timestamp")


# --- L: external context ------------------------------------------------------------------------

DATED = {"dated": """SELECT p.country, p.brand_name, p.months_postgx, c.date FROM {panel} p
             JOIN {calendar} c USING (country, brand_name, months_postgx)""",
         "hol": """SELECT country, date_trunc('month', date) AS mon, count(holiday_name) AS n FROM {holidays} GROUP BY 1, 2""",
         "epi": f"""SELECT {ROW}, max(severity) AS sev FROM {{dated}} d JOIN {{epidemics}} e USING (country)
             WHERE d.date BETWEEN e.start_date AND coalesce(e.end_date, current_date) GROUP BY 1, 2, 3""",
         "mac": "SELECT country, date_trunc('month', date) AS mon, " + ", ".join(
             f"arg_max(value, date) FILTER (indicator_name = '{i}') AS {c}" for i, c in MACRO_COLUMNS.items())
             + " FROM {macro} GROUP BY 1, 2",
         "pro": f"""SELECT {ROW}, max(CASE WHEN event_type IN ('price_cut', 'marketing_campaign', 'competitor_launch') THEN 1 ELSE 0 END) AS promo,
             max(CASE WHEN event_type IN ('patent_expiry', 'formulary_change', 'regulatory_approval') THEN 1 ELSE 0 END) AS policy
             FROM {{dated}} d JOIN {{promo_policy}} e USING (country)
             WHERE d.date BETWEEN e.start_date AND coalesce(e.end_date, e.start_date + INTERVAL 1 MONTH)
               AND (affected_brands = '' OR list_contains(string_split(affected_brands, '|'), brand_name)) GROUP BY 1, 2, 3""",
         "mrow": f"SELECT {ROW}, date, {', '.join(MACRO)} FROM {{dated}} d LEFT JOIN {{mac}} m ON m.country = d.country AND m.mon = date_trunc('month', d.date)".replace("SELECT country", "SELECT d.country"),
         "mcm": "SELECT country, date, " + ", ".join(f"max({c}) AS {c}" for c in MACRO) + " FROM {mrow} GROUP BY 1, 2",
         "mfill": "SELECT country, date, " + ", ".join(
             f"""coalesce(last_value({c} IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 first_value({c} IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}""" for c in MACRO)
             + " FROM {mcm} WINDOW w AS (PARTITION BY country ORDER BY date)",
         "mdone": f"SELECT {ROW}, date, " + ", ".join(f"m.{c}" for c in MACRO) + " FROM {dated} d LEFT JOIN {mfill} m USING (country, date)"}


def dated(spark, sf):
    return fx.panel(spark, sf).select(*ROW_KEY).join(fx.view(spark, sf, "calendar"), ROW_KEY)


def promo(spark, sf):
    return X.load_promo_or_policy_events(spark, fx.view(spark, sf, "promo_policy"))


HOL_SQL = "coalesce(n, 0) AS ext_n_holidays, CASE WHEN n > 0 THEN 1 ELSE 0 END AS ext_is_holiday_month"


@query("l02_join_holidays", views="panel", ctes=DATED, sql=f"""
    SELECT {ROW}, {HOL_SQL} FROM dated LEFT JOIN hol ON hol.country = dated.country AND mon = date_trunc('month', date)
    """.replace("SELECT country", "SELECT dated.country"))
def _(spark, sf):
    return L.join_holidays(dated(spark, sf), fx.view(spark, sf, "holidays")).drop("date")


@query("l03_join_epidemics", views="panel", ctes=DATED, sql=f"""
    SELECT {ROW}, coalesce(sev, 0) AS ext_epidemic_severity, CASE WHEN sev IS NULL THEN 0 ELSE 1 END AS ext_epidemic_active
    FROM dated LEFT JOIN epi USING ({ROW})""")
def _(spark, sf):
    return L.join_epidemics(dated(spark, sf), fx.view(spark, sf, "epidemics")).drop("date")


@query("l04_join_macro_indicators", views="panel", ctes=DATED, sql=f"SELECT {ROW}, {r(' '.join(MACRO))} FROM mrow")
def _(spark, sf):
    return L.join_macro_indicators(dated(spark, sf), fx.view(spark, sf, "macro")).drop("date")


@query("l05_join_promo_policy", views="panel", ctes=DATED, sql=f"""
    SELECT {ROW}, coalesce(promo, 0) AS ext_promo_active, coalesce(policy, 0) AS ext_policy_change
    FROM dated LEFT JOIN pro USING ({ROW})""")
def _(spark, sf):
    return L.join_promo_policy(dated(spark, sf), promo(spark, sf)).drop("date")


FILLED = ", ".join(rx(f"coalesce({c}, (SELECT avg({c}) FROM mdone))", c) for c in MACRO)


@query("l06_fill_external_missing", views="panel", ctes=DATED, sql=f"SELECT {ROW}, {FILLED} FROM mdone")
def _(spark, sf):
    return L.fill_external_missing(L.join_macro_indicators(dated(spark, sf), fx.view(spark, sf, "macro"))).drop("date")


@query("l01_join_external_context", views="panel", ctes=DATED, sql=f"""
    SELECT {ROW}, coalesce(h.n, 0)::INT AS ext_n_holidays, CASE WHEN h.n > 0 THEN 1 ELSE 0 END AS ext_is_holiday_month,
      coalesce(sev, 0) AS ext_epidemic_severity, CASE WHEN sev IS NULL THEN 0 ELSE 1 END AS ext_epidemic_active,
      coalesce(promo, 0) AS ext_promo_active, coalesce(policy, 0) AS ext_policy_change, {FILLED}
    FROM mdone LEFT JOIN (SELECT country, CAST(mon AS DATE) AS date, n FROM hol) h USING (country, date)
    LEFT JOIN epi USING ({ROW}) LEFT JOIN pro USING ({ROW})""")
def _(spark, sf):
    v = {n: fx.view(spark, sf, n) for n in ("holidays", "epidemics", "macro")}
    return L.join_external_context(dated(spark, sf), v["holidays"], v["epidemics"], v["macro"], promo(spark, sf)).drop("date")


# --- M: supply rollups --------------------------------------------------------------------------

VIS = {"vi": "SELECT country, brand_name, date_trunc('month', date) AS period, avg(inventory_units) AS a, avg(days_of_supply) AS b, avg(stock_out_risk) AS c FROM {vis_inventory} GROUP BY 1, 2, 3",
       "vo": "SELECT country, brand_name, date_trunc('month', date) AS period, sum(filled_quantity) / nullif(sum(order_quantity), 0) AS d, avg(lead_time_days) AS e FROM {vis_orders} GROUP BY 1, 2, 3",
       "vs": "SELECT country, brand_name, date_trunc('month', date) AS period, avg(reliability_score) AS f, avg(on_time_delivery_rate) AS g FROM {vis_suppliers} GROUP BY 1, 2, 3",
       "vd": "SELECT country, date_trunc('month', date) AS period, avg(capacity_utilization) AS h FROM {vis_distribution} GROUP BY 1, 2",
       "vis": """SELECT country, brand_name, CAST(period AS DATE) AS period, a AS vis_avg_inventory, b AS vis_avg_days_of_supply, c AS vis_avg_stock_out_risk,
           d AS vis_fill_rate, e AS vis_avg_lead_time, f AS vis_supplier_reliability, g AS vis_on_time_delivery, h AS vis_capacity_utilization
           FROM {vi} FULL JOIN {vo} USING (country, brand_name, period) FULL JOIN {vs} USING (country, brand_name, period)
           LEFT JOIN {vd} USING (country, period)""",
       "vrow": f"SELECT d.country, d.brand_name, d.months_postgx, {', '.join(VISIBILITY_COLUMNS)} FROM {{dated}} d LEFT JOIN {{vis}} v ON v.country = d.country AND v.brand_name = d.brand_name AND v.period = d.date",
       "dated": DATED["dated"]}


def rollup(spark, sf):
    s = supply(spark, sf)
    return V.aggregated_visibility(s.load_inventory(), s.load_orders(), s.load_supplier_metrics(), s.load_distribution_metrics())


@query("m01_aggregated_visibility", views="", ctes=VIS, digits=9, sql=f"""
    SELECT {SER}, CAST(period AS STRING) AS period, {r(' '.join(VISIBILITY_COLUMNS), 9)} FROM vis""")
def _(spark, sf):
    return rollup(spark, sf).withColumn("period", F.col("period").cast("string"))


VIS_FILLED = ", ".join(rx(f"coalesce({c}, (SELECT median({c}) FROM vrow), 0)", c, 9) for c in VISIBILITY_COLUMNS)


@query("m02_join_visibility_features", views="panel", ctes=VIS, digits=9, sql=f"SELECT {ROW}, {r(' '.join(VISIBILITY_COLUMNS), 9)} FROM vrow")
def _(spark, sf):
    return V.join_visibility_features(dated(spark, sf), rollup(spark, sf), fill_missing=False).drop("date")


@query("e12_visibility_features", views="panel", ctes=VIS, digits=9, sql=f"SELECT {ROW}, {VIS_FILLED} FROM vrow")
def _(spark, sf):
    return E.add_visibility_features(dated(spark, sf), rollup(spark, sf)).drop("date")


def _whole_features() -> str:
    """Every column of all groups under the second scenario's cutoff, each group by the text of its own query."""
    future = duck_ctes(["panel", *qf.generics_ctes(6)], {**SHARED, **qf.generics_ctes(6)}) + f"SELECT {ROW}, {qf.FUTURE_SQL} FROM panel JOIN gx USING ({SER})"
    crossed = duck_ctes(["panel"], SHARED) + f"SELECT {ROW}, {rx('n_gxs * hospital_rate / 100', 'n_gxs_x_hospital_rate_norm')} FROM panel"
    names = ["e02_pre_entry_features", "e03_seasonal_features", "e04_time_features", "e05_generics_features", "e07_drug_features", "e08_early_erosion_features",
             "e12_visibility_features"]
    texts = [ORACLES[n] for n in names] + [future, crossed]
    return f"SELECT * FROM ({texts[0]}) " + " ".join(f"JOIN ({t}) USING ({ROW})" for t in texts[1:]) + " WHERE months_postgx BETWEEN 6 AND 23"


@query("e01_make_features_whole", digits=9, sql=_whole_features())
def _(spark, sf):
    """All feature groups with the supply metrics and one interaction: every column that is made."""
    p = dated(spark, sf).join(fx.panel(spark, sf), ROW_KEY)
    out = E.make_features(p, 2, config={"interactions": [("n_gxs", "hospital_rate_norm")], "visibility": rollup(spark, sf)})
    made = qf.added(p, C.select_training_rows(out, 2))
    # the supply metrics are compared to 9 digits, all other columns to 6
    return made.select(*[c if c in VISIBILITY_COLUMNS or t != "double" else (F.round(c, 6) + F.lit(0.0)).alias(c) for c, t in made.dtypes])
