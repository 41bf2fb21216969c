"""Queries over projections, feature groups, encodings and scalers (SURVEY sections C and E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.constants import ROW_KEY
from panelspark.operators import columns as C
from panelspark.operators import features as E
from panelspark.operators import panel as P
from panelspark.plans import fixtures as fx
from panelspark.plans.registry import query, r, rx

ROW = "country, brand_name, months_postgx"
SER = "country, brand_name"


def added(before, after, extra=()):
    """Row key, named columns and whatever the operator added."""
    keep = [*ROW_KEY, *extra]
    return after.select(*keep, *[c for c in after.columns if c not in before.columns and c not in keep])


# --- C: selection and projection ----------------------------------------------------------------

@query("c01_select_training_rows", views="panel", sql=f"""
    SELECT 1 AS scenario, {ROW}, {r('y_norm')} FROM panel WHERE months_postgx BETWEEN 0 AND 23
    UNION ALL SELECT 2, {ROW}, {r('y_norm')} FROM panel WHERE months_postgx BETWEEN 6 AND 23""")
def _(spark, sf):
    p = fx.panel(spark, sf)
    parts = [C.select_training_rows(p, s).select(F.lit(s).alias("scenario"), *ROW_KEY, "y_norm") for s in (1, 2)]
    return parts[0].unionByName(parts[1])


@query("c02_simulate_scenario", views="panel", sql=f"""
    SELECT {ROW}, {r('volume')}, CASE WHEN months_postgx < 6 THEN 'visible' ELSE 'target' END AS part FROM panel
    WHERE months_postgx <= 23""")
def _(spark, sf):
    seen, target = C.simulate_scenario(fx.panel(spark, sf), 2)
    tag = [d.select(*ROW_KEY, "volume", F.lit(n).alias("part")) for d, n in ((seen, "visible"), (target, "target"))]
    return tag[0].unionByName(tag[1])


@query("c03_split_features_target_meta", views="panel", sql=f"""
    SELECT {ROW}, bucket, n_gxs, hospital_rate_missing, {r('volume y_norm hospital_rate avg_vol_12m mean_erosion')},
      biological_missing, small_molecule_missing, pre_entry_months_available FROM panel""")
def _(spark, sf):
    p = fx.panel(spark, sf)
    features, target, meta = E.split_features_target_meta(p)
    return p.select(*dict.fromkeys([*meta, *features, target]))


@query("c04_split_training_frame", views="panel", sql=f"""
    SELECT {ROW}, n_gxs, hospital_rate_missing, {r('y_norm hospital_rate')},
      biological_missing, small_molecule_missing FROM panel WHERE months_postgx BETWEEN 0 AND 23""")
def _(spark, sf):
    X, y, key = C.training_columns(fx.panel(spark, sf))
    return C.select_training_rows(fx.panel(spark, sf), 1).select(*key, *X, y)


@query("c05_feature_matrix", views="panel", sql=f"""
    SELECT {ROW}, n_gxs * 1.0 + 0.0 AS n_gxs, {r('hospital_rate')}, hospital_rate_missing * 1.0 AS hospital_rate_missing,
      biological_missing * 1.0 AS biological_missing, small_molecule_missing * 1.0 AS small_molecule_missing,
      {r('avg_vol_12m')}, pre_entry_months_available * 1.0 AS pre_entry_months_available,
      dense_rank() OVER (ORDER BY ther_area) - 1.0 AS ther_area_encoded FROM panel""")
def _(spark, sf):
    return E.feature_matrix(E.label_codes(fx.panel(spark, sf), {"ther_area": "ther_area_encoded"}))


@query("c06_narrow_types", views="panel", digits=3, sql=f"""
    SELECT {ROW}, n_gxs, pre_entry_months_available, {r('volume avg_vol_12m', 3)},
      round(pre_entry_trend, 3) + 0.0 AS pre_entry_trend
    FROM panel JOIN (SELECT {SER}, coalesce(nullif(regr_slope(volume, months_postgx) FILTER (months_postgx < 0), 'nan'::DOUBLE), 0) AS pre_entry_trend
      FROM panel GROUP BY 1, 2) USING ({SER})""")
def _(spark, sf):
    df = E.add_pre_entry_features(fx.panel(spark, sf)).select(
        *ROW_KEY, "n_gxs", "pre_entry_months_available", "volume", "avg_vol_12m", "pre_entry_trend")
    return P.narrow_types(df).withColumn("pre_entry_trend", F.col("pre_entry_trend").cast("double"))


@query("c07_series_ids", views="panel", sql=f"SELECT DISTINCT {SER} FROM panel")
def _(spark, sf):
    return P.series_ids(fx.panel(spark, sf))


@query("c08_series_count", views="panel", sql=f"SELECT count(*) AS n_series FROM (SELECT DISTINCT {SER} FROM panel)")
def _(spark, sf):
    return P.series_count(fx.panel(spark, sf))


@query("c09_clip_predictions", views="panel",
       sql=f"SELECT {ROW}, {rx('greatest(0, least(2, y_norm))', 'y_norm')} FROM panel")
def _(spark, sf):
    return P.clip_predictions(fx.panel(spark, sf).select(*ROW_KEY, "y_norm"))


@query("c10_handle_missing_pre_entry_data", views="panel", sql=f"""
    , t AS (SELECT {ROW}, CASE WHEN bucket = 1 THEN 0 WHEN avg_vol_12m > 100 THEN NULL ELSE avg_vol_12m END AS a FROM panel)
    SELECT {ROW}, round(CASE WHEN a > 0 THEN a ELSE coalesce((SELECT median(a) FROM t WHERE a > 0), 1000.0) END, 6) + 0.0
      AS avg_vol_12m FROM t""")
def _(spark, sf):
    a = F.when(F.col("bucket") == 1, 0.0).when(F.col("avg_vol_12m") > 100, F.lit(None)).otherwise(F.col("avg_vol_12m"))
    return P.handle_missing_pre_entry_data(fx.panel(spark, sf).select(*ROW_KEY, a.alias("avg_vol_12m")))


@query("c11_chunked_apply", views="panel", sql=f"SELECT {ROW}, {rx('volume * 2', 'volume')} FROM panel")
def _(spark, sf):
    def double(batch):
        batch["volume"] = batch["volume"] * 2
        return batch
    return C.chunked_apply(fx.panel(spark, sf).select(*ROW_KEY, "volume"), double)


# --- E: feature groups --------------------------------------------------------------------------

PRE = {"pre_stats": f"""SELECT {SER}, avg(volume) FILTER (months_postgx BETWEEN -6 AND -1) AS a6,
      avg(volume) FILTER (months_postgx BETWEEN -3 AND -1) AS a3,
      coalesce(nullif(regr_slope(volume, months_postgx) FILTER (months_postgx < 0), 'nan'::DOUBLE), 0) AS tr,
      stddev_samp(volume) FILTER (months_postgx < 0) AS sd, max(volume) FILTER (months_postgx < 0) AS hi,
      min(volume) FILTER (months_postgx < 0) AS lo FROM {{panel}} GROUP BY 1, 2""",
       "pre_rows": f"""SELECT {ROW}, avg_vol_12m AS a, coalesce(a6, avg_vol_12m) AS a6, coalesce(a3, avg_vol_12m) AS a3,
      tr, sd, coalesce(hi, avg_vol_12m) AS hi, coalesce(lo, avg_vol_12m) AS lo
      FROM {{panel}} JOIN {{pre_stats}} USING ({SER})"""}

PRE_SQL = f"""SELECT {ROW}, {rx('a6', 'avg_vol_6m')}, {rx('a3', 'avg_vol_3m')}, {rx('tr', 'pre_entry_trend')},
      {rx('tr / (a + 1e-6)', 'pre_entry_trend_norm')}, {rx('coalesce(sd / (a + 1e-6), 0)', 'pre_entry_volatility')},
      {rx('hi', 'pre_entry_max')}, {rx('lo', 'pre_entry_min')}, {rx('hi / (a + 1e-6)', 'pre_entry_max_ratio')},
      {rx('lo / (a + 1e-6)', 'pre_entry_min_ratio')}, {rx('(hi - lo) / (a + 1e-6)', 'pre_entry_range_ratio')},
      {rx('ln(1 + a)', 'log_avg_vol')}, {rx('ln(1 + a6)', 'log_avg_vol_6m')}, {rx('ln(1 + a3)', 'log_avg_vol_3m')},
      {rx('(a3 - a) / (a + 1e-6)', 'volume_growth_rate')}, {rx('a6 / (a + 1e-6)', 'vol_ratio_6m_12m')},
      {rx('a3 / (a + 1e-6)', 'vol_ratio_3m_12m')}, {rx('a3 / (a6 + 1e-6)', 'vol_ratio_3m_6m')}"""


@query("e02_pre_entry_features", views="panel", ctes=PRE, sql=f"{PRE_SQL} FROM pre_rows")
def _(spark, sf):
    p = fx.panel(spark, sf)
    return added(p, E.add_pre_entry_features(p))


MOY = "(position(month IN 'JanFebMarAprMayJunJulAugSepOctNovDec') + 2) // 3"
SEASON = {
    "pre_moy": f"SELECT {SER}, {MOY} AS moy, avg(volume) AS v FROM {{panel}} WHERE months_postgx < 0 GROUP BY 1, 2, 3",
    "pre_all": f"SELECT {SER}, avg(volume) AS mean, count(*) AS n FROM {{panel}} WHERE months_postgx < 0 GROUP BY 1, 2",
    "shape": f"""SELECT {SER}, max(v / mean) AS hi, min(v / mean) AS lo,
        arg_max(moy, (v / mean, -moy)) AS peak, arg_min(moy, (v / mean, moy)) AS trough,
        {', '.join(f"coalesce(avg(v / mean) FILTER (moy BETWEEN {3 * q - 2} AND {3 * q}) - 1, 0) AS q{q}" for q in range(1, 5))}
        FROM {{pre_moy}} JOIN {{pre_all}} USING ({SER}) WHERE n >= 6 AND mean > 0 GROUP BY 1, 2""",
}


@query("e03_seasonal_features", views="panel", ctes=SEASON, sql=f"""
    SELECT {ROW}, {rx('coalesce(hi - lo, 0)', 'seasonal_amplitude')}, CAST(coalesce(peak, 6) AS INT) AS seasonal_peak_month,
      CAST(coalesce(trough, 1) AS INT) AS seasonal_trough_month,
      {rx('CASE WHEN lo > 0 THEN least(hi / (lo + 1e-6), 5) ELSE 1 END', 'seasonal_ratio')},
      {', '.join(rx(f'coalesce(q{q}, 0)', f'seasonal_q{q}_effect') for q in range(1, 5))}
    FROM panel LEFT JOIN shape USING ({SER})""")
def _(spark, sf):
    p = fx.panel(spark, sf)
    return added(p, E.add_seasonal_features(p))


@query("e04_time_features", views="panel", sql=f"""
    , t AS (SELECT {ROW}, months_postgx AS m, CAST({MOY} AS INT) AS moy FROM panel)
    SELECT {ROW}, {rx('pow(m, 2)', 'months_postgx_sq')}, {rx('pow(m, 3)', 'months_postgx_cube')},
      CASE WHEN m >= 0 THEN 1 ELSE 0 END AS is_post_entry,
      CASE WHEN m < 0 THEN 'pre' WHEN m <= 5 THEN 'early' WHEN m <= 11 THEN 'mid' ELSE 'late' END AS time_bucket,
      CASE WHEN m BETWEEN 0 AND 5 THEN 1 ELSE 0 END AS is_early, CASE WHEN m BETWEEN 6 AND 11 THEN 1 ELSE 0 END AS is_mid,
      CASE WHEN m >= 12 THEN 1 ELSE 0 END AS is_late, moy AS month_of_year,
      {rx('sin(2 * pi() * moy / 12)', 'month_sin')}, {rx('cos(2 * pi() * moy / 12)', 'month_cos')},
      CAST((moy + 2) // 3 AS INT) AS quarter,
      {', '.join(f"CASE WHEN (moy + 2) // 3 = {q} THEN 1 ELSE 0 END AS is_q{q}" for q in range(1, 5))},
      CASE WHEN moy = 12 THEN 1 ELSE 0 END AS is_year_end, CASE WHEN moy = 1 THEN 1 ELSE 0 END AS is_year_start,
      {rx('CASE WHEN m >= 0 THEN exp(-0.1 * m) ELSE 0 END', 'time_decay')},
      {rx('CASE WHEN m >= 0 THEN exp(-0.2 * m) ELSE 0 END', 'time_decay_fast')},
      {rx('sqrt(greatest(m, 0))', 'sqrt_months_postgx')} FROM t""")
def _(spark, sf):
    p = fx.panel(spark, sf)
    return added(p, E.add_time_features(p))


def generics_ctes(cut: int) -> dict[str, str]:
    return {"gx": f"""SELECT {SER}, max(n_gxs) FILTER (months_postgx = 0) AS n0,
        max(n_gxs) FILTER (months_postgx < {cut}) AS top,
        min(months_postgx) FILTER (months_postgx < {cut} AND n_gxs > 0) AS first_generic_month,
        arg_max(n_gxs, months_postgx) FILTER (months_postgx < {cut}) AS n_last,
        arg_min(n_gxs, months_postgx) FILTER (months_postgx < {cut}) AS n_first,
        max(months_postgx) FILTER (months_postgx < {cut}) AS m_last,
        min(months_postgx) FILTER (months_postgx < {cut}) AS m_first,
        max(n_gxs) FILTER (months_postgx = 12) AS n12, max(n_gxs) FILTER (months_postgx = 23) AS n23,
        coalesce(max(n_gxs) FILTER (months_postgx = {max(cut - 1, 0)}), 0) AS now,
        max(n_gxs) FILTER (months_postgx BETWEEN {cut} AND 23) AS far,
        min(n_gxs) FILTER (months_postgx BETWEEN {cut} AND 23) AS near FROM {{panel}} GROUP BY 1, 2"""}


GENERICS_SQL = f"""CASE WHEN n_gxs > 0 THEN 1 ELSE 0 END AS has_generic,
      CASE WHEN n_gxs >= 2 THEN 1 ELSE 0 END AS multiple_generics, CASE WHEN n_gxs >= 5 THEN 1 ELSE 0 END AS many_generics,
      coalesce(n0, 0) AS n_gxs_at_entry, coalesce(top, 0) AS n_gxs_pre_cutoff_max, first_generic_month,
      coalesce(months_postgx - first_generic_month, -999) AS months_since_first_generic,
      CASE WHEN first_generic_month < 0 THEN 1 ELSE 0 END AS had_generic_pre_entry,
      {rx('coalesce((n_last - n_first) / (m_last - m_first + 1 + 1e-6), 0)', 'generic_entry_speed')},
      {rx('ln(1 + n_gxs)', 'log_n_gxs')}, {rx('ln(1 + coalesce(n0, 0))', 'log_n_gxs_at_entry')},
      CASE WHEN n_gxs <= 0 THEN 'none' WHEN n_gxs <= 1 THEN 'one' WHEN n_gxs <= 3 THEN 'few'
           WHEN n_gxs <= 10 THEN 'several' ELSE 'many' END AS n_gxs_bin"""
FUTURE_SQL = f"""coalesce(n12, n_gxs) AS n_gxs_at_month_12, coalesce(n23, n_gxs) AS n_gxs_at_month_23,
      coalesce(n12, n_gxs) - now AS n_gxs_change_to_12, coalesce(n23, n_gxs) - now AS n_gxs_change_to_23,
      coalesce(far, n_gxs) AS n_gxs_max_forecast,
      CASE WHEN near IS NULL THEN 0 ELSE coalesce(far, n_gxs) - near END AS expected_new_generics,
      {rx('ln(1 + coalesce(n12, n_gxs))', 'log_n_gxs_at_month_12')},
      {rx('ln(1 + coalesce(n23, n_gxs))', 'log_n_gxs_at_month_23')},
      {rx('ln(1 + coalesce(far, n_gxs))', 'log_n_gxs_max_forecast')}"""


@query("e05_generics_features", views="panel", ctes=generics_ctes(6),
       sql=f"SELECT {ROW}, {GENERICS_SQL} FROM panel JOIN gx USING ({SER})")
def _(spark, sf):
    p = fx.panel(spark, sf)
    return added(p, E.add_generics_features(p, 6))


@query("e06_future_generics_features", views="panel", ctes=generics_ctes(0),
       sql=f"SELECT {ROW}, {FUTURE_SQL} FROM panel JOIN gx USING ({SER})")
def _(spark, sf):
    p = fx.panel(spark, sf)
    return added(p, E.add_future_generics_features(p, 0))


DRUG_SQL = f"""CASE WHEN hospital_rate <= 30 THEN 'low' WHEN hospital_rate <= 70 THEN 'medium' ELSE 'high' END
        AS hospital_rate_bin, {rx('hospital_rate / 100', 'hospital_rate_norm')},
      CASE WHEN hospital_rate > 70 THEN 1 ELSE 0 END AS is_hospital_drug,
      CASE WHEN hospital_rate < 30 THEN 1 ELSE 0 END AS is_retail_drug,
      CASE WHEN regexp_matches(lower(main_package), 'injection|injectable|syringe|vial|iv|infusion') THEN 1 ELSE 0 END AS is_injection,
      CASE WHEN regexp_matches(lower(main_package), 'tablet|capsule|oral|pill') THEN 1 ELSE 0 END AS is_oral,
      CAST(biological AS INT) * n_gxs AS biological_x_n_gxs,
      {rx('hospital_rate / 100 * months_postgx', 'hospital_rate_x_time')},
      CAST(dense_rank() OVER (ORDER BY ther_area) - 1 AS INT) AS ther_area_encoded,
      CAST(dense_rank() OVER (ORDER BY main_package) - 1 AS INT) AS main_package_encoded,
      CAST(dense_rank() OVER (ORDER BY country) - 1 AS INT) AS country_encoded"""


@query("e07_drug_features", views="panel", sql=f"SELECT {ROW}, {DRUG_SQL} FROM panel")
def _(spark, sf):
    p = fx.panel(spark, sf)
    return added(p, E.add_drug_features(p))


EARLY = {"early": f"""SELECT {SER}, avg(volume) FILTER (months_postgx BETWEEN 0 AND 5) AS a05,
      avg(volume) FILTER (months_postgx BETWEEN 0 AND 2) AS a02, avg(volume) FILTER (months_postgx BETWEEN 3 AND 5) AS a35,
      max(volume) FILTER (months_postgx = 0) AS v0,
      coalesce(nullif(regr_slope(volume, months_postgx) FILTER (months_postgx BETWEEN 0 AND 5), 'nan'::DOUBLE), 0) AS tr,
      coalesce(max(n_gxs) FILTER (months_postgx = 5) - max(n_gxs) FILTER (months_postgx = 0), 0) AS resp
      FROM {{panel}} GROUP BY 1, 2"""}


@query("e08_early_erosion_features", views="panel", ctes=EARLY, sql=f"""
    , t AS (SELECT *, avg_vol_12m + 1e-6 AS b FROM panel JOIN early USING ({SER}))
    SELECT {ROW}, {rx('a05', 'avg_vol_0_5')}, {rx('a02', 'avg_vol_0_2')}, {rx('a35', 'avg_vol_3_5')},
      {rx('coalesce(a05 / b, 1)', 'erosion_0_5')}, {rx('tr', 'trend_0_5')}, {rx('tr / b', 'trend_0_5_norm')},
      {rx('coalesce(v0 / b, 1)', 'drop_month_0')}, {rx('coalesce((a02 - v0) / (v0 + 1e-6), 0)', 'month_0_to_3_change')},
      {rx('coalesce((a35 - a02) / (a02 + 1e-6), 0)', 'month_3_to_5_change')}, {rx('a02 / b', 'erosion_0_2')},
      {rx('a35 / b', 'erosion_3_5')}, CASE WHEN a35 > a02 THEN 1 ELSE 0 END AS recovery_signal,
      round(CASE WHEN a35 IS NOT NULL AND a02 IS NOT NULL THEN greatest(-1, least(1, (a35 - a02) / (a02 + 1e-6))) END, 6) + 0.0
        AS recovery_magnitude, resp AS competition_response,
      {rx('coalesce(tr / nullif(resp + 1, 0), 0)', 'erosion_per_generic')} FROM t""")
def _(spark, sf):
    p = fx.panel(spark, sf)
    return added(p, E.add_early_erosion_features(p))


@query("e01_make_features", views="panel", ctes={**PRE, **SEASON, **generics_ctes(6), **EARLY}, sql=f"""
    SELECT p.country, p.brand_name, p.months_postgx, {rx('coalesce(s.hi - s.lo, 0)', 'seasonal_amplitude')},
      {rx('r.tr', 'pre_entry_trend')}, {rx('coalesce(e.a05 / (p.avg_vol_12m + 1e-6), 1)', 'erosion_0_5')},
      {rx('coalesce((n_last - n_first) / (m_last - m_first + 1 + 1e-6), 0)', 'generic_entry_speed')},
      coalesce(far, n_gxs) AS n_gxs_max_forecast, {rx('p.hospital_rate / 100', 'hospital_rate_norm')},
      {rx('CASE WHEN p.months_postgx >= 0 THEN exp(-0.1 * p.months_postgx) ELSE 0 END', 'time_decay')},
      {rx('n_gxs * p.hospital_rate / 100', 'n_gxs_x_hospital_rate_norm')}
    FROM panel p JOIN pre_rows r USING ({ROW}) LEFT JOIN shape s USING ({SER}) JOIN gx USING ({SER})
    JOIN early e USING ({SER}) WHERE p.months_postgx BETWEEN 6 AND 23""")
def _(spark, sf):
    out = E.make_features(fx.panel(spark, sf), 2, config={"interactions": [("n_gxs", "hospital_rate_norm")]})
    return C.select_training_rows(out, 2).select(
        *ROW_KEY, "seasonal_amplitude", "pre_entry_trend", "erosion_0_5", "generic_entry_speed", "n_gxs_max_forecast",
        "hospital_rate_norm", "time_decay", "n_gxs_x_hospital_rate_norm")


BINNED_SQL = DRUG_SQL.replace("30", "20").replace("70", "60").split("CAST(dense_rank() OVER (ORDER BY main_package)")[0].rstrip().rstrip(",")
SOME_PRE = [c for c in PRE_SQL.removeprefix(f"SELECT {ROW}, ").split("round(") if c and " AS log_" not in c and "pre_entry_trend" not in c]


@query("e01_make_features_options", views="panel", ctes=PRE, sql=f"""
    SELECT * FROM (SELECT {ROW}, {', '.join('round(' + c.strip().rstrip(',') for c in SOME_PRE)} FROM pre_rows) JOIN (SELECT {ROW}, {BINNED_SQL} FROM panel) USING ({ROW})""")
def _(spark, sf):
    """Whole groups and single options turned off, other bins of the hospital share: no other column is left."""
    p = fx.panel(spark, sf)
    off = {"time": False, "generics": False, "scenario2_early": False, "pre_entry": {"compute_seasonal": False, "log_transform": False, "compute_trend": False},
           "drug": {"hospital_rate_bins": (20, 60), "categoricals": ["ther_area"]}}
    return added(p, E.make_features(p, 2, config=off))


@query("e07_drug_features_bins", views="panel", sql=f"SELECT {ROW}, {BINNED_SQL} FROM panel")
def _(spark, sf):
    p = fx.panel(spark, sf)
    return added(p, E.add_drug_features(p, ["ther_area"], bins=(20, 60)))


@query("e09_interaction_features", views="panel", sql=f"""
    SELECT {ROW}, {rx('coalesce(n_gxs * hospital_rate, 0)', 'n_gxs_x_hospital_rate')},
      0.0 AS month_x_n_gxs, {rx('coalesce(avg_vol_12m * months_postgx, 0)', 'avg_vol_12m_x_months_postgx')} FROM panel""")
def _(spark, sf):
    p = fx.panel(spark, sf)
    pairs = [("n_gxs", "hospital_rate"), ("month", "n_gxs"), ("avg_vol_12m", "months_postgx"), ("n_gxs", "absent")]
    return added(p, E.add_interaction_features(p, pairs))


@query("e10_target_encoding_features", views="panel", sql=f"""
    , tgt AS (SELECT * FROM panel WHERE months_postgx BETWEEN 0 AND 23),
    fold AS (SELECT {SER}, (row_number() OVER (ORDER BY md5(concat_ws('|', '42', country, brand_name)), {SER}) - 1) % 5 AS fold
      FROM (SELECT DISTINCT {SER} FROM tgt)),
    t AS (SELECT tgt.*, fold FROM tgt JOIN fold USING ({SER})),
    g AS (SELECT avg(y_norm) AS m FROM tgt),
    ta AS (SELECT a.fold, b.ther_area, (sum(b.y_norm) + 10 * (SELECT m FROM g)) / (count(*) + 10) AS p
      FROM (SELECT DISTINCT fold FROM fold) a JOIN t b ON b.fold <> a.fold GROUP BY 1, 2),
    tc AS (SELECT a.fold, b.country, (sum(b.y_norm) + 10 * (SELECT m FROM g)) / (count(*) + 10) AS p
      FROM (SELECT DISTINCT fold FROM fold) a JOIN t b ON b.fold <> a.fold GROUP BY 1, 2),
    o AS (SELECT x.country, x.brand_name, x.months_postgx, coalesce(ta.p, (SELECT m FROM g)) AS pa, coalesce(tc.p, (SELECT m FROM g)) AS pc
      FROM panel x LEFT JOIN fold f ON x.country = f.country AND x.brand_name = f.brand_name
      LEFT JOIN ta ON ta.fold = f.fold AND ta.ther_area = x.ther_area LEFT JOIN tc ON tc.fold = f.fold AND tc.country = x.country)
    SELECT {ROW}, {rx('pa', 'ther_area_erosion_prior')}, {rx('pc', 'country_erosion_prior')},
      {rx('pa * months_postgx', 'ther_area_erosion_x_time')} FROM o""")
def _(spark, sf):
    p = fx.panel(spark, sf)
    return added(p, E.add_target_encoding_features(p))


@query("e11_frequency_encoding_features", views="panel", sql=f"""
    SELECT {ROW}, {rx('coalesce(a.n / (SELECT count(ther_area) FROM panel), 0)', 'ther_area_freq')},
      {rx('coalesce(b.n / (SELECT count(main_package) FROM panel), 0)', 'main_package_freq')}
    FROM panel LEFT JOIN (SELECT ther_area, count(*) AS n FROM panel GROUP BY 1) a USING (ther_area)
    LEFT JOIN (SELECT main_package, count(*) AS n FROM panel GROUP BY 1) b USING (main_package)""")
def _(spark, sf):
    p = fx.panel(spark, sf)
    return added(p, E.add_frequency_encoding_features(p, ["ther_area", "main_package"]))


@query("e11_frequency_encoding_customers", views="", sql="""
    SELECT c_custkey, round(n / (SELECT count(*) FROM customer), 6) + 0.0 AS c_mktsegment_freq
    FROM customer JOIN (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) USING (c_mktsegment)""")
def _(spark, sf):
    df = fx.view(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return E.add_frequency_encoding_features(df, ["c_mktsegment"]).drop("c_mktsegment")


LOO = ", ".join(rx(f"""coalesce(CASE WHEN count(y_norm) OVER (PARTITION BY {g}) > 1
      THEN (sum(y_norm) OVER (PARTITION BY {g}) - y_norm) / (count(y_norm) OVER (PARTITION BY {g}) - 1)
      ELSE avg(y_norm) OVER (PARTITION BY {g}) END, (SELECT avg(y_norm) FROM panel))""", f"collab_{n}_erosion_prior")
                for g, n in (("country", "country"), ("ther_area", "ther_area"), ("seg", "hospital"),
                             ("main_package", "package")))


@query("e13_collaboration_features", views="panel", sql=f"""
    , t AS (SELECT *, CASE WHEN hospital_rate > -1 AND hospital_rate <= 30 THEN 'retail'
      WHEN hospital_rate > 30 AND hospital_rate <= 70 THEN 'mixed'
      WHEN hospital_rate > 70 AND hospital_rate <= 100 THEN 'hospital' END AS seg FROM panel)
    SELECT {ROW}, {LOO} FROM t""")
def _(spark, sf):
    p = fx.panel(spark, sf)
    return added(p, E.add_collaboration_features(p))


@query("e14_loo_prior", views="", sql=f"""
    SELECT event_id, {rx('CASE WHEN n > 1 THEN (s - value) / (n - 1) ELSE s / n END', 'prior')}
    FROM events JOIN (SELECT event_type, sum(value) AS s, count(value) AS n FROM events GROUP BY 1) USING (event_type)""")
def _(spark, sf):
    df = fx.view(spark, sf, "events").select("event_id", "event_type", F.col("value").alias("y_norm"))
    return E.add_loo_prior(df, "event_type", "prior").select("event_id", "prior")


def _win(k: int) -> str:
    return f"(PARTITION BY country, brand_name ORDER BY months_postgx ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


SEQ_SQL = ", ".join(
    [rx(f"coalesce(lag(volume, {k}) OVER w / (avg_vol_12m + 1e-6), 1)", f"seq_volume_lag_{k}") for k in (1, 2, 3, 6)]
    + [rx(f"coalesce(avg(volume) OVER {_win(k)} / (avg_vol_12m + 1e-6), 1)", f"seq_volume_ma_{k}") for k in (3, 6, 12)]
    + [rx(f"coalesce((volume - lag(volume, {k}) OVER w) / (avg_vol_12m + 1e-6), 0)", f"seq_volume_diff_{k}") for k in (1, 3)]
    + [rx(f"""CASE WHEN lag(volume, {k}) OVER w IS NULL THEN 0
          ELSE greatest(-1, least(1, volume / lag(volume, {k}) OVER w - 1)) END""", f"seq_momentum_{k}") for k in (3, 6)]
    + [rx("coalesce((volume - 2 * lag(volume, 1) OVER w + lag(volume, 2) OVER w) / (avg_vol_12m + 1e-6), 0)", "seq_acceleration")]
    + [rx(f"coalesce(stddev_samp(volume) OVER {_win(k)} / nullif(avg(volume) OVER {_win(k)}, 0), 0)", f"seq_volatility_{k}")
       for k in (3, 6)])


@query("e15_sequence_features", views="panel", sql=f"""
    SELECT {ROW}, {SEQ_SQL} FROM panel WINDOW w AS (PARTITION BY country, brand_name ORDER BY months_postgx)""")
def _(spark, sf):
    p = fx.panel(spark, sf)
    return added(p, E.add_sequence_features(p))


NUMS = ["volume", "n_gxs", "hospital_rate", "avg_vol_12m", "y_norm"]


@query("e16_feature_summary", views="panel", digits=4, sql=" UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_unique, count(*) - count({c}) AS n_missing,
      {rx(f'100.0 * (count(*) - count({c})) / count(*)', 'missing_pct', 4)}, {rx(f'avg({c})', 'mean', 4)},
      {rx(f'stddev_samp({c})', 'std', 4)}, {rx(f'min({c})', 'min', 4)}, {rx(f'max({c})', 'max', 4)},
      {rx(f'median({c})', 'median', 4)} FROM panel""" if c != "ther_area" else
    """SELECT 'ther_area', count(DISTINCT ther_area), count(*) - count(ther_area),
      round(100.0 * (count(*) - count(ther_area)) / count(*), 4), NULL, NULL, NULL, NULL, NULL FROM panel"""
    for c in [*NUMS, "ther_area"]))
def _(spark, sf):
    return C.feature_summary(fx.panel(spark, sf).select(*NUMS, "ther_area")).drop("dtype")


LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("e16_feature_summary_lineitem", views="", digits=4, sql=" UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_unique, count(*) - count({c}) AS n_missing,
      {rx(f'100.0 * (count(*) - count({c})) / count(*)', 'missing_pct', 4)}, {rx(f'avg({c})', 'mean', 4)},
      {rx(f'stddev_samp({c})', 'std', 4)}, {rx(f'min({c})', 'min', 4)}, {rx(f'max({c})', 'max', 4)},
      {rx(f'median({c})', 'median', 4)} FROM lineitem""" for c in LI))
def _(spark, sf):
    return C.feature_summary(fx.view(spark, sf, "lineitem").select(*LI)).drop("dtype")


PAIRS = [(a, b) for i, a in enumerate(NUMS) for b in NUMS[i + 1:]]


@query("e17_feature_correlations", views="panel", sql=" UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {rx(f'corr({a}, {b})', 'correlation')}, "
    f"CASE WHEN abs(corr({a}, {b})) >= 0.5 THEN 1 ELSE 0 END AS redundant FROM panel" for a, b in PAIRS))
def _(spark, sf):
    return C.feature_correlations(fx.panel(spark, sf).select(*NUMS), 0.5)


AVG_RANKS = {f"rk_{c}": f"""SELECT {ROW}, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS k
      FROM {{panel}}""" for c in ("volume", "n_gxs", "hospital_rate")}


@query("e17_feature_correlations_spearman", views="panel", ctes=AVG_RANKS, sql=" UNION ALL ".join(
    f"""SELECT '{a}' AS feature_a, '{b}' AS feature_b, {rx('corr(x.k, y.k)', 'correlation')},
      CASE WHEN abs(corr(x.k, y.k)) >= 0.5 THEN 1 ELSE 0 END AS redundant
      FROM rk_{a} x JOIN rk_{b} y USING ({ROW})""" for a, b in
    (("volume", "n_gxs"), ("volume", "hospital_rate"), ("n_gxs", "hospital_rate"))))
def _(spark, sf):
    return C.feature_correlations(fx.panel(spark, sf).select("volume", "n_gxs", "hospital_rate"), 0.5, "spearman")


def _redundant() -> dict[str, str]:
    spread = " UNION ALL ".join(f"SELECT {i} AS i, '{c}' AS feature, var_samp({c}) > 0.01 AS varied FROM {{panel}}" for i, c in enumerate(NUMS))
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) >= 0.9 AS strong FROM {{panel}}"
                               for i, a in enumerate(NUMS) for b in NUMS[i + 1:])
    rows = " UNION ALL ".join(f"SELECT {ROW}, '{c}' AS feature, {c}::DOUBLE AS value FROM {{panel}}" for c in NUMS)
    return {"spread": spread, "strong": pairs, "cells": rows,
            "kept": """SELECT feature FROM {spread} s WHERE varied AND NOT EXISTS (SELECT 1 FROM {strong} p JOIN {spread} o ON o.feature = p.a
                WHERE p.b = s.feature AND p.strong AND o.varied)"""}


@query("e18_remove_redundant_features", views="panel", ctes=_redundant(), sql=f"""
    SELECT {ROW}, feature, {r('value')} FROM cells WHERE feature IN (SELECT feature FROM kept)""")
def _(spark, sf):
    """The columns that stay, one row per cell."""
    left = C.remove_redundant_features(fx.panel(spark, sf).select(*ROW_KEY, *[F.col(c).cast("double").alias(c) for c in NUMS]), 0.9, 0.01)[0]
    return left.unpivot(ROW_KEY, [c for c in NUMS if c in left.columns], "feature", "value")


@query("e19_feature_scaler_standard", views="panel", sql=f"""
    SELECT {ROW}, {', '.join(rx(f'({c} - (SELECT avg({c}) FROM panel)) / (SELECT stddev_pop({c}) FROM panel)', c)
                             for c in NUMS)} FROM panel""")
def _(spark, sf):
    df = fx.panel(spark, sf).select(*ROW_KEY, *NUMS)
    return C.FeatureScaler("standard", ["months_postgx"]).fit(df).transform(df)


@query("e19_feature_scaler_robust", views="panel", sql=f"""
    SELECT {ROW}, {', '.join(rx(f'({c} - (SELECT median({c}) FROM panel)) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM panel)', c)
                             for c in NUMS)} FROM panel""")
def _(spark, sf):
    df = fx.panel(spark, sf).select(*ROW_KEY, *NUMS)
    return C.FeatureScaler("robust", ["months_postgx"]).fit(df).transform(df)


@query("e19_feature_scaler_minmax_inverse", views="panel", sql=f"SELECT {ROW}, {r(' '.join(NUMS))} FROM panel")
def _(spark, sf):
    df = fx.panel(spark, sf).select(*ROW_KEY, *NUMS)
    scaler = C.FeatureScaler("minmax", ["months_postgx"]).fit(df)
    return scaler.inverse_transform(scaler.transform(df))
