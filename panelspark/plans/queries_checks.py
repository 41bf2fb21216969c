"""Queries over quality checks, splits and fold statistics (SURVEY sections B and F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.constants import ROW_KEY, SERIES
from panelspark.operators import baselines as N
from panelspark.operators import external as L
from panelspark.operators import features as E
from panelspark.operators import metrics as G
from panelspark.operators import quality as Q
from panelspark.operators import splits as S
from panelspark.plans import fixtures as fx
from panelspark.plans.registry import query, r, rx

ROW = "country, brand_name, months_postgx"
SER = "country, brand_name"
HASH = "md5(concat_ws('|', '42', country, brand_name))"


@query("b01_value_ranges", views="panel", sql="""
    SELECT 'months_postgx' AS "column", count(*) FILTER (months_postgx < -20) AS below_min, count(*) FILTER (months_postgx > 20) AS above_max FROM panel
    UNION ALL SELECT 'volume', count(*) FILTER (volume < 0), 0 FROM panel
    UNION ALL SELECT 'n_gxs', count(*) FILTER (n_gxs < 0), count(*) FILTER (n_gxs > 3) FROM panel
    UNION ALL SELECT 'hospital_rate', count(*) FILTER (hospital_rate < 10), count(*) FILTER (hospital_rate > 90) FROM panel
    UNION ALL SELECT 'y_norm', count(*) FILTER (y_norm < 0), count(*) FILTER (y_norm > 1) FROM panel""")
def _(spark, sf):
    return Q.value_range_violations(fx.panel(spark, sf), {
        "months_postgx": (-20, 20), "volume": (0, None), "n_gxs": (0, 3), "hospital_rate": (10, 90), "y_norm": (0, 1)})


@query("b02_duplicate_keys", views="", sql="""
    SELECT l_orderkey, l_suppkey, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def _(spark, sf):
    return Q.duplicate_keys(fx.view(spark, sf, "lineitem"), ["l_orderkey", "l_suppkey"])


STAT_COLS = ["country", "brand_name", "months_postgx", "volume", "n_gxs", "hospital_rate", "biological"]


@query("b03_data_statistics", views="base", sql=" UNION ALL ".join(f"""
    SELECT '{c}' AS "column", count(*) AS n_rows, count(DISTINCT (country, brand_name)) AS n_series, min(months_postgx) AS min_month,
      max(months_postgx) AS max_month, {rx(f'100.0 * (count(*) - count({c})) / count(*)', 'missing_pct')} FROM base""" for c in STAT_COLS))
def _(spark, sf):
    from panelspark.operators.panel import prepare_base_panel
    return Q.data_statistics(prepare_base_panel(*fx.raw_tables(spark, sf)).select(*STAT_COLS))


@query("b04_no_future_leakage", views="panel", sql=f"SELECT {ROW} FROM panel WHERE false")
def _(spark, sf):
    return Q.future_leakage(fx.panel(spark, sf), 2, lambda p: E.make_features(p, 2, "train", {"sequence": True}))


@query("b04_leakage_is_found", views="panel", sql=f"SELECT {ROW} FROM panel WHERE months_postgx >= 0")
def _(spark, sf):
    return Q.future_leakage(fx.panel(spark, sf), 1, lambda p: p.withColumn("leak", F.coalesce("volume", F.lit(-1.0))),
                            ["leak"])


@query("b05_feature_matrix", views="panel", sql="""
    SELECT 'all_null' AS "check", 'nothing' AS "column", 0 AS n FROM (SELECT count(*) AS c FROM panel) WHERE c > 0
    UNION ALL SELECT 'target_missing', 'half', count(*) FILTER (y_norm > 0.5) FROM panel HAVING count(*) FILTER (y_norm > 0.5) < count(*)""")
def _(spark, sf):
    df = fx.panel(spark, sf).withColumns({"nothing": F.lit(None).cast("double"),
                                          "half": F.when(F.col("y_norm") > 0.5, F.col("y_norm"))})
    return Q.feature_matrix_violations(df, ["n_gxs", "hospital_rate", "nothing"], "half")


GAPS = {"span": f"SELECT {SER}, min(months_postgx) AS lo, max(months_postgx) AS hi, count(DISTINCT months_postgx) AS have FROM {{panel}} GROUP BY 1, 2"}


@query("b06_date_continuity", views="panel", ctes=GAPS, sql=f"""
    , want AS (SELECT {SER}, unnest(range(lo, hi + 1)) AS months_postgx FROM span),
    gap AS (SELECT {SER}, list(months_postgx ORDER BY months_postgx) AS g FROM want w
      WHERE NOT EXISTS (SELECT 1 FROM panel p WHERE p.country = w.country AND p.brand_name = w.brand_name
        AND p.months_postgx = w.months_postgx) GROUP BY 1, 2)
    SELECT s.country, s.brand_name, lo AS min_month, hi AS max_month, len(g) AS gap_count, have AS actual_count,
      array_to_string(g, ',') AS missing_months FROM span s JOIN gap USING ({SER})""")
def _(spark, sf):
    out = Q.date_continuity(fx.panel(spark, sf))
    return out.withColumn("missing_months", F.concat_ws(",", F.transform("missing_months", lambda x: x.cast("string"))))


@query("b06_date_continuity_expected", views="panel", ctes=GAPS, sql=f"""
    , want AS (SELECT {SER}, unnest(range(greatest(lo, -12), least(hi, 23) + 1)) AS months_postgx FROM span),
    gap AS (SELECT {SER}, count(*) AS n FROM want w
      WHERE NOT EXISTS (SELECT 1 FROM panel p WHERE p.country = w.country AND p.brand_name = w.brand_name
        AND p.months_postgx = w.months_postgx) GROUP BY 1, 2)
    SELECT s.country, s.brand_name, lo AS min_month, hi AS max_month, coalesce(n, 0) AS gap_count
    FROM span s LEFT JOIN gap USING ({SER}) WHERE n > 0 OR lo > -12 OR hi < 23""")
def _(spark, sf):
    return Q.date_continuity(fx.panel(spark, sf), (-12, 23)).select(*SERIES, "min_month", "max_month", "gap_count")


@query("b07_month_coverage", views="panel", sql=f"""
    SELECT {SER}, min(months_postgx) AS min_month, max(months_postgx) AS max_month,
      count(DISTINCT months_postgx) FILTER (months_postgx BETWEEN -12 AND -1) AS pre_entry_months,
      count(DISTINCT months_postgx) FILTER (months_postgx BETWEEN 0 AND 23) AS post_entry_months,
      count(DISTINCT months_postgx) AS total_months,
      CASE WHEN count(DISTINCT months_postgx) FILTER (months_postgx BETWEEN -12 AND -1) = 12 THEN 1 ELSE 0 END AS has_full_pre_entry,
      CASE WHEN count(DISTINCT months_postgx) FILTER (months_postgx BETWEEN 0 AND 23) = 24 THEN 1 ELSE 0 END AS has_full_post_entry
    FROM panel GROUP BY 1, 2""")
def _(spark, sf):
    return Q.month_coverage(fx.panel(spark, sf))


def halves(spark, sf):
    p = fx.panel(spark, sf)
    return p, p.where("bucket = 2"), p.where("bucket = 1 OR (bucket = 2 AND n_gxs > 6)")


@query("b08_training_data_checks", views="panel", sql="""
    , c AS (SELECT count(*) FILTER (bucket = 2) AS tr, count(DISTINCT (country, brand_name)) FILTER (bucket = 2) AS ts,
      count(*) FILTER (bucket = 1) AS vr, count(DISTINCT (country, brand_name)) FILTER (bucket = 1) AS vs FROM panel)
    SELECT 'train_rows' AS "check", tr AS actual, 100 AS required, CAST(tr >= 100 AS INT) AS passed FROM c
    UNION ALL SELECT 'train_series', ts, 3, CAST(ts >= 3 AS INT) FROM c
    UNION ALL SELECT 'val_rows', vr, 1000000000, CAST(vr >= 1000000000 AS INT) FROM c
    UNION ALL SELECT 'val_series', vs, 1, CAST(vs >= 1 AS INT) FROM c""")
def _(spark, sf):
    p = fx.panel(spark, sf)
    return Q.training_data_checks(p.where("bucket = 2"), p.where("bucket = 1"), 100, 10 ** 9)


@query("b09_split_violations", views="panel", sql=f"""
    , tr AS (SELECT DISTINCT {SER} FROM panel WHERE bucket = 2),
    va AS (SELECT DISTINCT {SER} FROM panel WHERE bucket = 1 OR (bucket = 2 AND n_gxs > 6))
    SELECT {SER}, 'overlap' AS violation FROM tr SEMI JOIN va USING ({SER})
    UNION ALL SELECT {SER}, 'lost' FROM (SELECT DISTINCT {SER} FROM panel) p
      WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.country = p.country AND tr.brand_name = p.brand_name)
        AND NOT EXISTS (SELECT 1 FROM va WHERE va.country = p.country AND va.brand_name = p.brand_name)""")
def _(spark, sf):
    return Q.split_violations(*halves(spark, sf))


@query("b10_scenario_violations", views="panel", sql=f"""
    , tr AS (SELECT * FROM panel WHERE bucket = 2), va AS (SELECT * FROM panel WHERE bucket = 1 OR (bucket = 2 AND n_gxs > 6)),
    v AS (SELECT 'months_too_early' AS violation, count(*) FILTER (months_postgx < 6) AS n FROM va
      UNION ALL SELECT 'months_too_late', count(*) FILTER (months_postgx > 23) FROM va
      UNION ALL SELECT 'series_overlap', count(*) FROM (SELECT DISTINCT {SER} FROM tr) SEMI JOIN va USING ({SER})
      UNION ALL SELECT 'row_overlap', count(*) FROM tr SEMI JOIN va USING ({ROW}))
    SELECT violation, n FROM v WHERE n > 0""")
def _(spark, sf):
    _, train, val = halves(spark, sf)
    return Q.scenario_violations(train, val, 2)


@query("b11_external_data_summary", views="holidays epidemics macro promo_policy", sql=" UNION ALL ".join(f"""
    SELECT '{n}' AS source, count(*) AS n_records, count(DISTINCT country) AS n_countries, CAST(min({d}) AS STRING) AS first_date,
      CAST(max({d}) AS STRING) AS last_date, array_to_string(list_sort(list(DISTINCT {k})), ',') AS kinds FROM {n}"""
    for n, d, k in (("holidays", "date", "holiday_type"), ("epidemics", "start_date", "event_name"),
                    ("macro", "date", "indicator_name"), ("promo_policy", "start_date", "event_type"))))
def _(spark, sf):
    return L.external_data_summary(*[fx.view(spark, sf, n) for n in ("holidays", "epidemics", "macro", "promo_policy")])


def submission(spark, sf):
    """Forecasts of all series but one country, with some months twice and some values below 0."""
    p = N.exponential_decay(G.create_aux(fx.panel(spark, sf)), range(24)).where("country <> 'NATION_3'")
    p = p.withColumn("volume", F.when(F.col("months_postgx") == 23, -F.col("volume"))
                     .when(F.col("months_postgx") == 22, F.lit(None)).otherwise(F.col("volume")))
    return p.unionByName(p.where("months_postgx = 3"))


def template(spark, sf):
    return G.create_aux(fx.panel(spark, sf)).select(*SERIES).withColumn(
        "months_postgx", F.explode(F.sequence(F.lit(1), F.lit(23))))


SUB = {"sub0": """SELECT country, brand_name, months_postgx, CASE WHEN months_postgx = 23 THEN -volume WHEN months_postgx = 22 THEN NULL
           ELSE volume END AS volume FROM {pred} WHERE country <> 'NATION_3'""",
       "sub": "SELECT * FROM {sub0} UNION ALL SELECT * FROM {sub0} WHERE months_postgx = 3",
       "tmpl": "SELECT country, brand_name, months_postgx FROM {pred} WHERE months_postgx >= 1",
       "kc": f"""SELECT {ROW}, sum(s) AS s, sum(t) AS t FROM (SELECT {ROW}, 1 AS s, 0 AS t FROM {{sub}} UNION ALL
           SELECT {ROW}, 0, 1 FROM {{tmpl}}) GROUP BY 1, 2, 3"""}


@query("b12_submission_violations", views="pred", ctes=SUB, sql="""
    SELECT 'row_count_difference' AS "check", CAST((SELECT count(*) FROM sub) - (SELECT count(*) FROM tmpl) AS BIGINT) AS n
    UNION ALL SELECT 'missing_keys', count(*) FILTER (s = 0) FROM kc UNION ALL SELECT 'extra_keys', count(*) FILTER (t = 0) FROM kc
    UNION ALL SELECT 'duplicate_keys', CAST(coalesce(sum(s - 1) FILTER (s > 1), 0) AS BIGINT) FROM kc
    UNION ALL SELECT 'missing_volume', count(*) FILTER (volume IS NULL) FROM sub
    UNION ALL SELECT 'negative_volume', count(*) FILTER (volume < 0) FROM sub
    UNION ALL SELECT 'infinite_volume', count(*) FILTER (isinf(volume)) FROM sub
    UNION ALL SELECT 'invalid_months', count(*) FILTER (months_postgx NOT BETWEEN 0 AND 23) FROM sub""")
def _(spark, sf):
    return Q.submission_violations(submission(spark, sf), template(spark, sf))


@query("b13_submission_completeness", views="pred", ctes=SUB, sql=f"""
    SELECT count(*) FILTER (s = 0) AS missing_rows, count(*) FILTER (t = 0) AS extra_rows,
      count(DISTINCT (country, brand_name)) FILTER (s = 0) AS missing_series,
      array_to_string(list_sort(list(DISTINCT months_postgx) FILTER (s = 0)), ',') AS missing_months,
      CASE WHEN count(*) FILTER (s = 0) = 0 THEN 1 ELSE 0 END AS is_complete FROM kc""")
def _(spark, sf):
    return Q.submission_completeness(submission(spark, sf), template(spark, sf))


SANE = {"mm": "SELECT months_postgx, avg(volume) AS m FROM {sub} GROUP BY 1",
        "ends": """SELECT avg(m) FILTER (a <= 6) AS early_mean, avg(m) FILTER (z <= 6) AS late_mean, count(*) AS k FROM
            (SELECT m, row_number() OVER (ORDER BY months_postgx) AS a, row_number() OVER (ORDER BY months_postgx DESC) AS z FROM {mm})"""}


@query("b14_prediction_sanity", views="pred", ctes={**SUB, **SANE}, sql=f"""
    SELECT {rx('avg(volume)', 'mean')}, {rx('stddev_samp(volume)', 'std')}, {rx('min(volume)', 'min')}, {rx('max(volume)', 'max')},
      {rx('avg(CASE WHEN volume = 0 THEN 1.0 ELSE 0 END) * 100', 'pct_zero')},
      {rx('avg(CASE WHEN volume < 0 THEN 1.0 ELSE 0 END) * 100', 'pct_negative')},
      {rx('avg(CASE WHEN volume > 10 * (SELECT quantile_cont(volume, 0.99) FROM sub) THEN 1.0 ELSE 0 END) * 100', 'pct_extreme')},
      count(*) FILTER (volume IS NULL) AS n_missing, {rx('max(early_mean)', 'early_mean')}, {rx('max(late_mean)', 'late_mean')},
      CASE WHEN count(*) FILTER (volume < 0 OR volume IS NULL) = 0 THEN 1 ELSE 0 END AS is_sane,
      CASE WHEN max(k) > 6 AND max(late_mean) > 1.5 * max(early_mean) THEN 1 ELSE 0 END AS late_above_early FROM sub, ends""")
def _(spark, sf):
    return Q.prediction_sanity(submission(spark, sf))


@query("b15_submission_checklist", views="pred", ctes=SUB, sql="""
    SELECT 'completeness' AS "check", CASE WHEN count(*) FILTER (s = 0) = 0 THEN 1 ELSE 0 END AS passed FROM kc
    UNION ALL SELECT 'sanity', CASE WHEN count(*) FILTER (volume < 0 OR volume IS NULL) = 0 THEN 1 ELSE 0 END FROM sub
    UNION ALL SELECT 'columns_match', 0 UNION ALL SELECT 'all_passed', 0""")
def _(spark, sf):
    return Q.submission_checklist(submission(spark, sf), template(spark, sf))


@query("b16_inverse_transform_error", views="panel", sql=f"""
    SELECT {rx('max(abs(volume - y_norm * avg_vol_12m) / (abs(y_norm * avg_vol_12m) + 1e-10))', 'max_error')},
      {rx('avg(abs(volume - y_norm * avg_vol_12m) / (abs(y_norm * avg_vol_12m) + 1e-10))', 'mean_error')} FROM panel""")
def _(spark, sf):
    return Q.inverse_transform_error(fx.panel(spark, sf))


def _wr(cond: str, name: str) -> str:
    f = f" FILTER ({cond})" if cond else ""
    return rx(f"sqrt(sum(w * (va - vp) ** 2){f} / sum(w){f})", name)


@query("b17_weights_correlation", views="pairs", sql=f"""
    , t AS (SELECT *, (CASE WHEN months_postgx <= 5 THEN 3.0 WHEN months_postgx <= 11 THEN 1.5 ELSE 1.0 END) * (CASE bucket WHEN 1 THEN 2.0 ELSE 1.0 END) AS w FROM pairs)
    SELECT count(*) AS n_samples, {rx('min(w)', 'weight_min')}, {rx('max(w)', 'weight_max')}, {rx('avg(w)', 'weight_mean')},
      {rx('stddev_samp(w)', 'weight_std')}, {_wr('', 'weighted_rmse')}, {rx('sqrt(avg((va - vp) ** 2))', 'unweighted_rmse')},
      {_wr('bucket = 1', 'bucket1_weighted_rmse')}, {_wr('bucket = 2', 'bucket2_weighted_rmse')},
      {_wr('months_postgx BETWEEN 0 AND 5', 'window_0_5_weighted_rmse')}, {_wr('months_postgx BETWEEN 6 AND 11', 'window_6_11_weighted_rmse')},
      {_wr('months_postgx BETWEEN 12 AND 23', 'window_12_23_weighted_rmse')}, {rx('corr(w, abs(va - vp))', 'weight_error_correlation')},
      {rx('sqrt(sum(w * (va - vp) ** 2) / sum(w)) / (sqrt(avg((va - vp) ** 2)) + 1e-8)', 'rmse_ratio')},
      CASE WHEN corr(w, abs(va - vp)) < 0 THEN 'Good' WHEN abs(corr(w, abs(va - vp))) < 0.1 THEN 'Neutral' ELSE 'Review weights' END AS interpretation
    FROM t""")
def _(spark, sf):
    panel = fx.panel(spark, sf)
    aux = G.create_aux(panel)
    rows = G.matched(panel.where("months_postgx BETWEEN 0 AND 23"), N.exponential_decay(aux, range(24)), aux)
    m = F.col("months_postgx")
    w = (F.when(m <= 5, 3.0).when(m <= 11, 1.5).otherwise(1.0)) * F.when(F.col("bucket") == 1, 2.0).otherwise(1.0)
    return Q.weights_correlation(rows.withColumn("weight", w))


# --- F: splits and folds ------------------------------------------------------------------------

def split_sql(fraction: float, strat: str) -> str:
    return f"""
    , s AS (SELECT {SER}, {strat} AS st FROM panel GROUP BY 1, 2),
    n AS (SELECT st, CASE WHEN count(*) < greatest(3, floor((SELECT count(*) FROM s) * {fraction} * 0.5)) THEN 'OTHER' ELSE st END AS nm FROM s GROUP BY 1),
    t AS (SELECT s.*, nm, row_number() OVER (PARTITION BY nm ORDER BY {HASH}, {SER}) AS k, count(*) OVER (PARTITION BY nm) AS c
      FROM s JOIN n USING (st))
    SELECT {SER}, CASE WHEN k <= round(c * {fraction}) THEN 'val' ELSE 'train' END AS split FROM t"""


@query("f01_validation_split", views="panel", sql=split_sql(0.2, "coalesce(CAST(min(bucket) AS STRING), 'nan')"))
def _(spark, sf):
    return S.validation_split(fx.panel(spark, sf)).select(*SERIES, "split").distinct()


@query("f01_validation_split_two_columns", views="panel", sql=split_sql(
    0.2, "concat(coalesce(CAST(min(bucket) AS STRING), 'nan'), '_', min(ther_area))"))
def _(spark, sf):
    return S.series_split(fx.panel(spark, sf), 0.2, ["bucket", "ther_area"])


@query("f02_holdout_set", views="panel", sql=split_sql(0.1, "coalesce(CAST(min(bucket) AS STRING), 'nan')"))
def _(spark, sf):
    return S.holdout_set(fx.panel(spark, sf)).select(*SERIES, "split").distinct()


@query("f02_customer_holdout", views="", sql="""
    WITH t AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(concat_ws('|', '42', CAST(c_custkey AS STRING), c_name))) AS k,
      count(*) OVER (PARTITION BY c_mktsegment) AS c FROM customer)
    SELECT CAST(c_custkey AS STRING) AS c_custkey, CASE WHEN k <= round(c * 0.2) THEN 'val' ELSE 'train' END AS split FROM t""")
def _(spark, sf):
    df = fx.view(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("country"), F.col("c_name").alias("brand_name"), "c_mktsegment")
    return S.series_split(df, 0.2, ["c_mktsegment"]).select(F.col("country").alias("c_custkey"), "split")


FOLD = f"""(row_number() OVER (PARTITION BY coalesce(CAST(b AS STRING), 'nan') ORDER BY {HASH}, {SER}) - 1)"""
SERS = {"sers": f"SELECT {SER}, min(bucket) AS b FROM {{panel}} GROUP BY 1, 2",
        "folds": f"SELECT {SER}, b, CAST({FOLD} % 5 AS INT) AS fold FROM {{sers}}"}


@query("f03_fold_series", views="panel", ctes=SERS, sql=f"SELECT {SER}, fold FROM folds")
def _(spark, sf):
    return S.fold_series(fx.panel(spark, sf))


@query("f04_grouped_folds", views="panel", sql=f"""
    , s AS (SELECT {SER}, min(ther_area) AS ther_area FROM panel GROUP BY 1, 2),
    g AS (SELECT ther_area, row_number() OVER (ORDER BY count(*) DESC, ther_area) - 1 AS i, least(5, count(*) OVER ()) AS k FROM s GROUP BY 1)
    SELECT {SER}, ther_area, CAST(CASE WHEN (i // k) % 2 = 0 THEN i % k ELSE k - 1 - i % k END AS INT) AS fold FROM s JOIN g USING (ther_area)""")
def _(spark, sf):
    return S.grouped_folds(fx.panel(spark, sf))


@query("f05_temporal_cv", views="panel", sql=f"""
    , f AS (SELECT * FROM (VALUES (0, 12), (1, 12), (2, 13), (3, 18)) t(fold, cutoff)),
    x AS (SELECT p.*, f.*, min(p.months_postgx) OVER (PARTITION BY country, brand_name, fold) AS lo FROM panel p, f)
    SELECT fold, cutoff, CASE WHEN months_postgx <= cutoff - 2 THEN 'train' ELSE 'val' END AS part, count(*) AS n_rows,
      count(DISTINCT (country, brand_name)) AS n_series
    FROM x WHERE months_postgx <= cutoff - 2 OR (months_postgx > cutoff AND lo <= cutoff - 2) GROUP BY 1, 2, 3""")
def _(spark, sf):
    out = S.temporal_cv(fx.panel(spark, sf), 5, 12, 2)
    return out.groupBy("fold", "cutoff", "part").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.struct(*SERIES)).alias("n_series"))


@query("f06_purged_cv", views="panel", ctes=SERS, sql=f"""
    , t AS (SELECT p.*, f.fold AS own FROM panel p JOIN folds f USING ({SER})),
    st AS (SELECT own AS fold, min(months_postgx) AS s FROM t WHERE months_postgx >= 0 GROUP BY 1),
    x AS (SELECT t.{ROW.replace(', ', ', t.')}, st.fold, CASE WHEN own = st.fold AND months_postgx >= 0 THEN 'val'
      WHEN own <> st.fold AND months_postgx BETWEEN -6 AND s - 3 THEN 'train' END AS part FROM t, st),
    ok AS (SELECT fold FROM x GROUP BY 1 HAVING count(*) FILTER (part = 'train') >= 100 AND count(*) FILTER (part = 'val') >= 50)
    SELECT fold, part, {ROW} FROM x JOIN ok USING (fold) WHERE part IS NOT NULL""")
def _(spark, sf):
    return S.purged_cv(fx.panel(spark, sf)).select("fold", "part", *ROW_KEY)


@query("f07_nested_cv", views="panel", ctes=SERS, sql=f"""
    , x AS (SELECT f.*, o.outer_fold FROM folds f, (SELECT unnest(range(0, 5)) AS outer_fold) o)
    SELECT {SER}, CAST(outer_fold AS INT) AS outer_fold, 'val' AS part, NULL AS inner_fold FROM x WHERE fold = outer_fold
    UNION ALL SELECT {SER}, CAST(outer_fold AS INT), 'train', CAST((row_number() OVER (PARTITION BY outer_fold, coalesce(CAST(b AS STRING), 'nan')
      ORDER BY md5(concat_ws('|', '42', 'inner', CAST(outer_fold AS STRING), country, brand_name)), {SER}) - 1) % 3 AS INT)
      FROM x WHERE fold <> outer_fold""")
def _(spark, sf):
    return S.nested_cv(fx.panel(spark, sf))


SCORES = {"scores": """SELECT lower(substr(o_orderpriority, 1, 1)) AS model, CAST(o_orderkey % 5 AS INT) AS fold,
      CASE o_custkey % 3 WHEN 0 THEN 'rmse' WHEN 1 THEN 'mae' ELSE 'metric1_official' END AS metric, avg(o_totalprice) / 1000 AS value
      FROM {orders} GROUP BY 1, 2, 3""",
          "agg": """SELECT model, metric, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, min(value) AS "min", max(value) AS "max", count(*) AS n_folds
      FROM {scores} GROUP BY 1, 2"""}


def scores(spark, sf):
    """Fold scores of five models, averaged from the orders table."""
    o = fx.view(spark, sf, "orders")
    k = F.col("o_custkey") % 3
    return o.groupBy(F.lower(F.substring("o_orderpriority", 1, 1)).alias("model"),
                     (F.col("o_orderkey") % 5).cast("int").alias("fold"),
                     F.when(k == 0, "rmse").when(k == 1, "mae").otherwise("metric1_official").alias("metric")).agg(
        (F.avg("o_totalprice") / 1000).alias("value"))


@query("f09_aggregate_cv_scores", views="", ctes=SCORES, sql=f"""
    SELECT model, metric, n_folds, {r('mean std')}, {rx('"min"', '"min"')}, {rx('"max"', '"max"')},
      {rx('mean - 2.776445 * std / sqrt(n_folds)', 'ci_lower')}, {rx('mean + 2.776445 * std / sqrt(n_folds)', 'ci_upper')} FROM agg""")
def _(spark, sf):
    return S.aggregate_scores(scores(spark, sf), ["model", "metric"])


@query("f10_cv_comparison_table", views="", ctes=SCORES, sql=f"""
    SELECT model, n_folds, {r('mean std')}, {rx('"min"', '"min"')}, {rx('"max"', '"max"')},
      {rx('mean - 2.776445 * std / sqrt(n_folds)', 'ci_lower')}, {rx('mean + 2.776445 * std / sqrt(n_folds)', 'ci_upper')},
      row_number() OVER (ORDER BY mean, model) AS rank, CASE WHEN row_number() OVER (ORDER BY mean, model) = 1 THEN 1 ELSE 0 END AS is_best
    FROM agg WHERE metric = 'metric1_official'""")
def _(spark, sf):
    return S.comparison_table(scores(spark, sf), "metric1_official")


@query("f11_paired_t_test", views="", ctes=SCORES, sql=f"""
    , d AS (SELECT a.value - b.value AS d FROM scores a JOIN scores b ON a.fold = b.fold AND a.metric = b.metric
      WHERE a.model = '1' AND b.model = '2' AND a.metric = 'rmse'),
    s AS (SELECT avg(d) AS m, stddev_samp(d) AS sd, count(*) AS n FROM d),
    t AS (SELECT *, m / (sd / sqrt(n)) AS t, n - 1 AS df FROM s),
    p AS (SELECT *, atan(abs(t) / sqrt(df)) AS a FROM t)
    SELECT n AS n_valid_pairs, {rx('m', 'mean_diff')}, {rx('t', 't_statistic')}, {rx('m - 2.776445 * sd / sqrt(n)', 'ci_diff_lower')},
      {rx('m + 2.776445 * sd / sqrt(n)', 'ci_diff_upper')}, CASE WHEN abs(t) > 2.776445 THEN 1 ELSE 0 END AS is_significant,
      {rx('''greatest(0, 1 - (SELECT sum(a / 2000 * pow(cos((i - 0.5) * a / 2000), df - 1)) / sum(pi() / 4000 * pow(cos((i - 0.5) * pi() / 4000), df - 1))
        FROM (SELECT unnest(range(1, 2001)) AS i)))''', 'p_value')} FROM p""")
def _(spark, sf):
    return S.paired_t_test(scores(spark, sf), "1", "2", "rmse")


@query("f10_cv_comparison_additional", views="", ctes=SCORES, sql=f"""
    SELECT a.model, a.n_folds, {rx('a.mean', 'mean')}, {rx('a.std', 'std')}, {rx('b.mean', 'rmse_mean')}, {rx('b.std', 'rmse_std')}, {rx('c.mean', 'mae_mean')}, {rx('c.std', 'mae_std')},
      row_number() OVER (ORDER BY a.mean DESC, a.model) AS rank
    FROM agg a LEFT JOIN agg b ON a.model = b.model AND b.metric = 'rmse' LEFT JOIN agg c ON a.model = c.model AND c.metric = 'mae' WHERE a.metric = 'metric1_official'""")
def _(spark, sf):
    """Ranked from the largest mean down, with two more metrics beside."""
    table = S.comparison_table(scores(spark, sf), "metric1_official", ascending=False, additional_metrics=("rmse", "mae"))
    return table.select("model", "n_folds", "mean", "std", "rmse_mean", "rmse_std", "mae_mean", "mae_std", "rank")


@query("f11_paired_t_test_alpha", views="", ctes=SCORES, digits=4, sql=f"""
    , d AS (SELECT a.value - b.value AS d FROM scores a JOIN scores b ON a.fold = b.fold AND a.metric = b.metric WHERE a.model = '1' AND b.model = '2' AND a.metric = 'rmse'),
    s AS (SELECT avg(d) AS m, stddev_samp(d) AS sd, count(*) AS n FROM d)
    SELECT n AS n_valid_pairs, {rx('m - 4.6040949 * sd / sqrt(n)', 'ci_diff_lower', 4)}, {rx('m + 4.6040949 * sd / sqrt(n)', 'ci_diff_upper', 4)},
      CASE WHEN abs(m / (sd / sqrt(n))) > 4.6040949 THEN 1 ELSE 0 END AS is_significant FROM s""")
def _(spark, sf):
    """The interval at 99 %, with four degrees of freedom."""
    return S.paired_t_test(scores(spark, sf), "1", "2", "rmse", alpha=0.01).select("n_valid_pairs", "ci_diff_lower", "ci_diff_upper", "is_significant")
