"""Queries over metrics, error analyses, weights and closed-form forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.constants import ROW_KEY, SERIES
from panelspark.operators import baselines as B
from panelspark.operators import metrics as G
from panelspark.operators import weights as H
from panelspark.plans import fixtures as fx
from panelspark.plans.registry import query, r, rx
from panelspark.plans.shared_sql import metric_sql

ROW = "country, brand_name, months_postgx"
SER = "country, brand_name"


def actual(spark, sf, low=0):
    return fx.panel(spark, sf).where(F.col("months_postgx").between(low, 23)).select(*ROW_KEY, "volume")


def aux(spark, sf):
    return G.create_aux(fx.panel(spark, sf))


def pred(spark, sf):
    return B.exponential_decay(aux(spark, sf), range(24))


def apx(spark, sf, low=0):
    return actual(spark, sf, low), pred(spark, sf), aux(spark, sf)


for _n, _pe in ((1, "pe1"), (2, "pe2")):
    def _register(n=_n, pe=_pe):
        low = 0 if n == 1 else 6

        @query(f"g0{1 if n == 1 else 4}_series_error_scenario{n}", views=pe,
               sql=f"SELECT {SER}, bucket, {r('pe')} FROM {pe}")
        def _(spark, sf):
            return G.series_errors(*apx(spark, sf, low), n)

        @query(f"g0{2 if n == 1 else 5}_metric{n}_terms", views=pe, sql=f"""
            SELECT count(*) FILTER (bucket = 1) AS n1, count(*) FILTER (bucket = 2) AS n2,
              {rx('sum(pe) FILTER (bucket = 1)', 's1')}, {rx('sum(pe) FILTER (bucket = 2)', 's2')} FROM {pe}""")
        def _(spark, sf):
            b1, b2 = F.col("bucket") == 1, F.col("bucket") == 2
            return G.series_errors(*apx(spark, sf, low), n).agg(
                F.count(F.when(b1, 1)).alias("n1"), F.count(F.when(b2, 1)).alias("n2"),
                F.sum(F.when(b1, F.col("pe"))).alias("s1"), F.sum(F.when(b2, F.col("pe"))).alias("s2"))

        @query(f"g0{3 if n == 1 else 6}_compute_metric{n}", views=pe, digits=4, sql=metric_sql(pe))
        def _(spark, sf):
            return G.official_metric(*apx(spark, sf, low), n)

        @query(f"g0{8 if n == 1 else 9}_metric{n}_single_bucket", views=pe, digits=4,
               ctes={"one": f"SELECT * FROM {{{pe}}} WHERE bucket = {n}"}, sql=metric_sql("one"))
        def _(spark, sf):
            a, p, x = apx(spark, sf, low)
            own = x.where(F.col("bucket") == n)
            return G.official_metric(a.join(own.select(*SERIES), SERIES, "left_semi"), p, own, n)
    _register()


@query("g07_compute_bucket_metrics", views="pe1", digits=4, ctes={
    "scoped": "SELECT 'overall' AS scope, * FROM {pe1} UNION ALL SELECT concat('bucket', bucket), * FROM {pe1} WHERE bucket IS NOT NULL"},
    sql=f"""SELECT m.scope, m.metric, n.n_series FROM ({metric_sql('scoped', 'scope')}) m
        JOIN (SELECT scope, count(*) AS n_series FROM scoped WHERE bucket IS NOT NULL GROUP BY 1) n USING (scope)""")
def _(spark, sf):
    """How wrong is exponential decay by the bucket-weighted metric, overall and per bucket?"""
    return G.bucket_metrics(*apx(spark, sf), 1)


@query("g10_create_aux", views="aux", sql=f"SELECT {SER}, bucket, {r('avg_vol')} FROM aux")
def _(spark, sf):
    return aux(spark, sf)


@query("g11_point_errors", views="pairs", sql=f"""
    SELECT {rx('sqrt(avg((vp - va) ** 2))', 'rmse')}, {rx('avg(abs(vp - va))', 'mae')},
      {rx('avg(abs((va - vp) / (va + 1e-8))) * 100', 'mape')} FROM pairs""")
def _(spark, sf):
    return G.point_errors(G.matched(actual(spark, sf), pred(spark, sf)))


@query("g11_point_errors_lineitem", views="", sql=f"""
    , t AS (SELECT l_extendedprice AS y, l_quantity * (SELECT sum(l_extendedprice) / sum(l_quantity) FROM lineitem) AS p FROM lineitem)
    SELECT {rx('sqrt(avg((p - y) ** 2))', 'rmse', 4)}, {rx('avg(abs(p - y))', 'mae', 4)},
      {rx('avg(abs((y - p) / (y + 1e-8))) * 100', 'mape', 4)} FROM t""".replace(", t AS", "WITH t AS", 1), digits=4)
def _(spark, sf):
    rows = fx.view(spark, sf, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("actual"))
    unit = rows.agg((F.sum("actual") / F.sum("l_quantity")).alias("u"))
    return G.point_errors(rows.withColumn("pred", F.col("l_quantity") * unit.scalar()))


SERIES_ERR = {"serr": f"""SELECT {SER}, max(bucket) AS bucket, coalesce(max(avg_vol), avg(va)) AS avg_vol,
      avg(abs(vp - va)) AS mae, sqrt(avg((vp - va) ** 2)) AS rmse, avg(abs(vp - va) / (abs(va) + 1e-8)) * 100 AS mape,
      sum(va) AS total_actual, sum(vp) AS total_pred, abs(sum(va) - sum(vp)) AS total_error,
      abs(sum(va) - sum(vp)) / (coalesce(max(avg_vol), avg(va)) + 1e-8) AS normalized_total_error, count(*) AS n_months
      FROM {{pairs}} GROUP BY 1, 2"""}


@query("g14_per_series_error", views="pairs", ctes=SERIES_ERR, digits=4, sql=f"""
    SELECT {SER}, bucket, n_months, {r('avg_vol mae rmse mape total_actual total_pred total_error normalized_total_error', 4)}
    FROM serr""")
def _(spark, sf):
    return G.per_series_error(*apx(spark, sf), 1)


@query("g15_worst_series", views="pairs", ctes=SERIES_ERR, digits=4, sql=f"""
    SELECT {SER}, bucket, {r('mae rmse', 4)} FROM serr WHERE bucket = 2 ORDER BY mae DESC, {SER} LIMIT 10""")
def _(spark, sf):
    return G.worst_series(G.per_series_error(*apx(spark, sf), 1), "mae", 10, 2).select(*SERIES, "bucket", "mae", "rmse")


@query("g16_errors_by_bucket", views="pairs", ctes=SERIES_ERR, digits=4, sql=f"""
    SELECT scope, count(*) AS n_series, {rx('avg(mae)', 'mean_mae', 4)}, {rx('stddev_pop(mae)', 'std_mae', 4)},
      {rx('avg(rmse)', 'mean_rmse', 4)}, {rx('stddev_pop(rmse)', 'std_rmse', 4)}, {rx('avg(mape)', 'mean_mape', 4)},
      {rx('max(mae)', 'max_mae', 4)}, {rx('avg(normalized_total_error)', 'mean_normalized_error', 4)},
      {rx('median(mae)', 'median_mae', 4)}, {rx('median(rmse)', 'median_rmse', 4)}
    FROM (SELECT 'overall' AS scope, * FROM serr UNION ALL SELECT concat('bucket', bucket), * FROM serr WHERE bucket IS NOT NULL)
    GROUP BY 1""")
def _(spark, sf):
    return G.errors_by_bucket(G.per_series_error(*apx(spark, sf), 1))


@query("g17_errors_by_time_window", views="pairs", sql=f"""
    , t AS (SELECT CASE WHEN months_postgx <= 5 THEN 'early' WHEN months_postgx <= 11 THEN 'mid' ELSE 'late' END AS "window",
      CASE WHEN months_postgx <= 5 THEN '0-5' WHEN months_postgx <= 11 THEN '6-11' ELSE '12-23' END AS months, vp - va AS e FROM pairs)
    SELECT "window", months, count(*) AS n_rows, {rx('avg(abs(e))', 'mae')}, {rx('sqrt(avg(e * e))', 'rmse')},
      {rx('avg(e)', 'mean_error')}, {rx('stddev_samp(e)', 'std_error')} FROM t GROUP BY 1, 2""")
def _(spark, sf):
    return G.errors_by_time_window(actual(spark, sf), pred(spark, sf), 1)


@query("g18_systematic_bias", views="pairs", sql=f"""
    SELECT {rx('avg(vp - va)', 'mean_error')}, {rx('median(vp - va)', 'median_error')},
      {rx('avg(CASE WHEN vp > va THEN 1.0 ELSE 0 END) * 100', 'pct_overprediction')},
      {rx('avg(CASE WHEN vp < va THEN 1.0 ELSE 0 END) * 100', 'pct_underprediction')},
      {rx('abs(avg(vp - va)) / (avg(va) + 1e-8)', 'bias_magnitude')}, count(*) AS n_rows FROM pairs""")
def _(spark, sf):
    return G.systematic_bias(actual(spark, sf), pred(spark, sf))


for _g, _id in (("ther_area", "g19_metric_by_ther_area"), ("country", "g20_metric_by_country")):
    def _register_group(g=_g, name=_id):
        area = {"area": f"SELECT DISTINCT {SER}, {'ther_area' if g == 'ther_area' else 'country AS grp'} FROM {{panel}}"
                        + ("" if g == "ther_area" else " WHERE months_postgx BETWEEN 0 AND 23")}
        key = "ther_area" if g == "ther_area" else "grp"
        area["gpe"] = f"SELECT x.{key}, p.bucket, p.pe FROM {{pe1}} p JOIN {{area}} x USING ({SER})"

        @query(name, views="pe1 pairs", ctes=area, digits=4, sql=f"""
            SELECT s.{key} AS {g}, s.n_series, e.n_rows, {r('mean_error std_error mean_abs_error', 4, 'e.')}, m.metric
            FROM (SELECT {key}, count(*) AS n_series FROM area GROUP BY 1) s
            JOIN (SELECT {key}, count(*) AS n_rows, avg(vp - va) AS mean_error, stddev_samp(vp - va) AS std_error,
              avg(abs(vp - va)) AS mean_abs_error FROM pairs JOIN area USING ({SER}) GROUP BY 1) e USING ({key})
            LEFT JOIN ({metric_sql('gpe', key)}) m USING ({key})""")
        def _(spark, sf):
            a, p, x = apx(spark, sf)
            if g == "country":
                return G.metric_by_country(a, p, x, 1)
            return G.metric_by_ther_area(a, p, x, fx.panel(spark, sf), 1)
    _register_group()


@query("g21_evaluation_frame", views="pairs panel", digits=4, sql=f"""
    SELECT b.country, b.brand_name, b.months_postgx, b.bucket, concat(b.country, '_', b.brand_name) AS series_id, 1 AS scenario,
      {rx('va', 'y_true', 4)}, {rx('vp', 'y_pred', 4)}, {r('avg_vol', 4)}, {rx('vp - va', 'error', 4)},
      {rx('abs(vp - va)', 'abs_error', 4)}, {rx('(vp - va) / (va + 1e-8) * 100', 'pct_error', 4)},
      m.ther_area, m.main_package, m.biological
    FROM pairs b LEFT JOIN (SELECT DISTINCT {SER}, ther_area, main_package, CAST(biological AS INT) AS biological FROM panel) m USING ({SER})""")
def _(spark, sf):
    out = G.evaluation_frame(*apx(spark, sf), fx.panel(spark, sf), 1)
    return out.withColumn("biological", F.col("biological").cast("int"))


@query("g22_per_series_records", views="pairs", ctes=SERIES_ERR, digits=4, sql=" UNION ALL ".join(
    f"""SELECT 'r1' AS run_id, 1 AS scenario, 'decay' AS model, concat(country, '_', brand_name) AS series_id, {SER}, bucket,
      '{m}' AS metric, {rx(m, 'value', 4)} FROM serr""" for m in ("mae", "rmse", "mape", "normalized_total_error")))
def _(spark, sf):
    return G.per_series_records(G.per_series_error(*apx(spark, sf), 1), 1, "r1", "decay").drop("timestamp")


@query("g23_diagnostic_metrics", views="pred", sql=f"""
    SELECT {rx('avg(volume)', 'pred_mean')}, {rx('stddev_samp(volume)', 'pred_std')}, {rx('min(volume)', 'pred_min')},
      {rx('max(volume)', 'pred_max')}, {rx('median(volume)', 'pred_median')}, count(*) AS pred_count,
      count(*) - count(volume) AS pred_null_count FROM pred""")
def _(spark, sf):
    return G.diagnostic_metrics(pred(spark, sf))


RES = {
    "short": f"SELECT {ROW}, va - vp AS e, (va - vp) / (va + 1e-6) AS pct FROM {{pairs}}",
    "worst": f"SELECT {SER}, arg_max(months_postgx, (pct, -months_postgx)) AS worst_at, max(pct) AS w FROM {{short}} GROUP BY 1, 2",
    "after": f"""SELECT {SER}, row_number() OVER (PARTITION BY {SER} ORDER BY months_postgx) - 1 AS i, pct > 0.1 AS crit
        FROM {{short}} JOIN {{worst}} USING ({SER}) WHERE months_postgx >= worst_at""",
    "rec": f"SELECT {SER}, coalesce(min(i) FILTER (NOT crit), count(*)) AS rec FROM {{after}} GROUP BY 1, 2",
    "res0": f"""SELECT {SER}, count(*) AS n_months, count(*) FILTER (e > 0) AS under_forecast_count,
        count(*) FILTER (e > 0) / count(*) AS under_forecast_pct, coalesce(max(pct) FILTER (e > 0), 0) AS max_under_forecast,
        coalesce(avg(pct) FILTER (e > 0), 0) AS avg_under_forecast,
        CAST(0.6 AS DOUBLE) * (count(*) FILTER (e > 0) / count(*)) + CAST(0.4 AS DOUBLE) * (count(*) FILTER (pct > 0.1) / count(*)) AS stock_out_risk_score
        FROM {{short}} GROUP BY 1, 2""",
    "res1": f"""SELECT r.*, CAST(CASE WHEN max_under_forecast > 0.1 THEN rec ELSE 0 END AS INT) AS recovery_time
        FROM {{res0}} r JOIN {{rec}} USING ({SER})""",
    "res": """SELECT *, greatest(0, least(1, 1 - (0.4 * under_forecast_pct + 0.3 * least(max_under_forecast, 1)
        + 0.2 * stock_out_risk_score + 0.1 * least(recovery_time / 12, 1)))) AS resilience_score FROM {res1}""",
}


@query("g24_resilience", views="pairs", ctes=RES, sql=f"""
    SELECT {SER}, n_months, under_forecast_count, recovery_time,
      {r('under_forecast_pct max_under_forecast avg_under_forecast stock_out_risk_score resilience_score')} FROM res""")
def _(spark, sf):
    return G.resilience(actual(spark, sf), pred(spark, sf))


@query("g24_resilience_overall", views="pairs", ctes=RES, sql=f"""
    SELECT count(*) AS total_series, CAST(sum(under_forecast_count) AS BIGINT) AS total_under_forecasts,
      {rx('avg(under_forecast_pct)', 'avg_under_forecast_pct')}, {rx('avg(stock_out_risk_score)', 'avg_stock_out_risk')},
      {rx('avg(resilience_score)', 'avg_resilience_score')}, {rx('min(resilience_score)', 'min_resilience_score')},
      {rx('avg(CASE WHEN stock_out_risk_score > 0.3 THEN 1.0 ELSE 0 END)', 'pct_high_risk_series')} FROM res""")
def _(spark, sf):
    return G.resilience_overall(G.resilience(actual(spark, sf), pred(spark, sf)))


@query("g25_under_forecast_patterns", views="pairs", ctes=RES, sql=f"""
    SELECT months_postgx, count(*) FILTER (pct > 0.1) AS under_forecast_count,
      {rx('avg(CASE WHEN pct > 0.1 THEN 1.0 ELSE 0 END)', 'under_forecast_rate')}, {rx('avg(pct)', 'mean_error_pct')},
      {rx('stddev_samp(pct)', 'std_error_pct')}, {rx('max(pct)', 'max_error_pct')}, {rx('avg(e)', 'mean_error')}
    FROM short GROUP BY 1""")
def _(spark, sf):
    return G.under_forecast_patterns(actual(spark, sf), pred(spark, sf))


@query("g26_high_risk_series", views="pairs", ctes=RES, sql=f"""
    SELECT {SER}, {r('stock_out_risk_score')} FROM res WHERE stock_out_risk_score >= 0.3
    ORDER BY res.stock_out_risk_score DESC, {SER} LIMIT 20""")
def _(spark, sf):
    return G.high_risk_series(G.resilience(actual(spark, sf), pred(spark, sf)), 0.3, 20)


@query("g27_forecast_bias", views="pairs", sql=f"""
    , t AS (SELECT avg(va - vp) AS me, avg(va - vp) / (avg(va) + 1e-6) AS b, avg(CASE WHEN va > vp THEN 1.0 ELSE 0 END) AS u,
      avg(CASE WHEN va < vp THEN 1.0 ELSE 0 END) AS o FROM pairs)
    SELECT {rx('me', 'mean_error')}, {rx('b', 'mean_bias_ratio')}, {rx('u', 'pct_under_forecast')}, {rx('o', 'pct_over_forecast')},
      {rx('1 - u - o', 'pct_exact')}, CASE WHEN b > 0.01 THEN 'under' WHEN b < -0.01 THEN 'over' ELSE 'balanced' END AS bias_direction
    FROM t""")
def _(spark, sf):
    return G.forecast_bias(actual(spark, sf), pred(spark, sf))


@query("g28_submission_statistics", views="pred", sql=f"""
    SELECT {rx('avg(volume)', 'volume_mean')}, {rx('stddev_samp(volume)', 'volume_std')}, {rx('min(volume)', 'volume_min')},
      {rx('max(volume)', 'volume_max')}, {rx('median(volume)', 'volume_median')}, count(*) AS total_rows,
      count(*) FILTER (volume = 0) AS n_zero_volume,
      count(*) FILTER (volume > (SELECT quantile_cont(volume, 0.99) FROM pred)) AS n_high_volume,
      (SELECT count(*) FROM (SELECT {SER} FROM pred GROUP BY 1, 2 HAVING min(months_postgx) = 0)) AS n_scenario1_series,
      (SELECT count(*) FROM (SELECT {SER} FROM pred GROUP BY 1, 2 HAVING min(months_postgx) > 0)) AS n_scenario2_series,
      (SELECT count(*) FROM (SELECT DISTINCT {SER} FROM pred)) AS total_series FROM pred""")
def _(spark, sf):
    return G.submission_statistics(pred(spark, sf))


@query("g28_volume_by_month", views="pred",
       sql=f"SELECT months_postgx, {rx('avg(volume)', 'volume_mean')} FROM pred GROUP BY 1")
def _(spark, sf):
    return G.volume_by_month(pred(spark, sf))


@query("g29_auxiliary_file", views="test_volume panel", sql=f"""
    SELECT t.country, t.brand_name, {r('avg_vol')}, bucket FROM (SELECT DISTINCT {SER} FROM test_volume) t
    LEFT JOIN (SELECT DISTINCT {SER}, avg_vol_12m AS avg_vol, bucket FROM panel) USING ({SER})""")
def _(spark, sf):
    return G.auxiliary_file(fx.view(spark, sf, "test_volume"), fx.panel(spark, sf))


# --- H: weights and target transforms -----------------------------------------------------------

W0 = {"wrows": f"""SELECT {ROW}, bucket, avg_vol_12m, y_norm, (CASE WHEN months_postgx <= 5 THEN 3.0
      WHEN months_postgx <= 11 THEN 1.5 ELSE 1.0 END) * (CASE bucket WHEN 1 THEN 2.0 ELSE 1.0 END) AS w0
      FROM {{panel}} WHERE months_postgx BETWEEN 0 AND 23""",
      "wn": f"SELECT *, w0 * count(*) OVER () / sum(w0) OVER () AS w1 FROM {{wrows}}",
      "wt": "SELECT *, greatest(0.01, least(100, w1)) AS w2 FROM {wn}"}


def target_rows(spark, sf):
    return fx.panel(spark, sf).where(F.col("months_postgx").between(0, 23)).select(
        *ROW_KEY, "bucket", "avg_vol_12m", "y_norm")


@query("h01_sample_weights", views="panel", ctes=W0, sql=f"""
    SELECT {ROW}, {rx('w2 * count(*) OVER () / (sum(w2) OVER () + 1e-8)', 'weight')} FROM wt""")
def _(spark, sf):
    return H.sample_weights(target_rows(spark, sf), 1).select(*ROW_KEY, "weight")


@query("h02_metric_aligned_weights", views="panel", sql=f"""
    , t AS (SELECT {ROW}, bucket, (CASE WHEN months_postgx <= 5 THEN 0.0917 WHEN months_postgx <= 11 THEN 0.0417 ELSE 0.0167 END) AS mw,
      1.0 / greatest(avg_vol_12m, 1) AS inv FROM panel WHERE months_postgx BETWEEN 0 AND 23),
    n AS (SELECT count(DISTINCT (country, brand_name)) FILTER (bucket = 1) AS n1, count(DISTINCT (country, brand_name)) FILTER (bucket = 2) AS n2 FROM t),
    u AS (SELECT {ROW}, mw * inv / avg(inv) OVER () * CASE bucket WHEN 1 THEN 2.0 / n1 * (n1 + n2) / 3 WHEN 2 THEN 1.0 / n2 * (n1 + n2) / 3 ELSE 1 END AS w
      FROM t, n)
    SELECT {ROW}, {rx('greatest(0.01, w * count(*) OVER () / (sum(w) OVER () + 1e-8))', 'weight')} FROM u""")
def _(spark, sf):
    return H.metric_aligned_weights(target_rows(spark, sf), 1).select(*ROW_KEY, "weight")


for _kind, _expr in (("sqrt", "sqrt(w1)"), ("log", "ln(1 + w1)"),
                     ("softmax", "exp(w1 - max(w1) OVER ()) / sum(exp(w1 - (SELECT max(w1) FROM wn))) OVER ()"),
                     ("rank", "(rank() OVER (ORDER BY k) + (count(*) OVER (PARTITION BY k) - 1) / 2.0) / count(*) OVER ()")):
    def _register_weight(kind=_kind, expr=_expr):
        src = "(SELECT *, round(avg_vol_12m, 9) AS k FROM wn)" if kind == "rank" else "wn"

        @query(f"h03_transform_weights_{kind}", views="panel", ctes=W0, sql=f"""
            , x AS (SELECT {ROW}, {expr} AS t FROM {src}), c AS (SELECT {ROW}, greatest(0.00001, least(100, t)) AS t FROM x)
            SELECT {ROW}, {rx('t * count(*) OVER () / (sum(t) OVER () + 1e-8)', 'weight')} FROM c""")
        def _(spark, sf):
            rows = H.base_weights(target_rows(spark, sf), 1)
            if kind == "rank":
                rows = rows.withColumn("weight", F.round("avg_vol_12m", 9))
            return H.transform_weights(rows, kind, 0.00001, 100).select(*ROW_KEY, "weight")
    _register_weight()


@query("h04_transform_target", views="panel", sql=f"""
    SELECT {ROW}, {rx('ln(1 + greatest(y_norm, 0) + 1e-6)', 'y_log')}, {rx('pow(greatest(y_norm, 0) + 1e-6, 0.5)', 'y_power')}
    FROM panel""")
def _(spark, sf):
    y = F.col("y_norm")
    return fx.panel(spark, sf).select(*ROW_KEY, H.transform_target(y, "log1p").alias("y_log"),
                                      H.transform_target(y, "power").alias("y_power"))


@query("h05_inverse_transform_target", views="panel",
       sql=f"SELECT {ROW}, {rx('y_norm + 1e-7', 'y_log')}, {rx('y_norm + 1e-7', 'y_power')} FROM panel")
def _(spark, sf):
    """There and back again; the tiny shift keeps binary fractions off the rounding boundary."""
    y, shift = F.col("y_norm"), F.lit(1e-7)
    return fx.panel(spark, sf).select(
        *ROW_KEY, (H.inverse_transform_target(H.transform_target(y, "log1p"), "log1p") + shift).alias("y_log"),
        (H.inverse_transform_target(H.transform_target(y, "power"), "power") + shift).alias("y_power"))


# --- I01-I08: closed-form forecasts -------------------------------------------------------------

def _grid_sql(expr: str) -> str:
    return f"""SELECT country, brand_name, CAST(h.months_postgx AS INT) AS months_postgx, {rx(expr, 'volume')}
        FROM aux, horizon h"""


@query("i01_naive_persistence", views="aux horizon", sql=_grid_sql("avg_vol"))
def _(spark, sf):
    return B.naive_persistence(aux(spark, sf), range(24))


@query("i02_linear_decay", views="aux horizon", sql=_grid_sql("avg_vol * greatest(0, 1 - 0.03 * h.months_postgx)"))
def _(spark, sf):
    return B.linear_decay(aux(spark, sf), range(24))


@query("i03_exponential_decay", views="aux horizon", sql=_grid_sql("avg_vol * exp(-0.05 * h.months_postgx)"))
def _(spark, sf):
    return B.exponential_decay(aux(spark, sf), range(24))


RATES = {"rates": "SELECT unnest([0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.1, 0.12, 0.15])::DOUBLE AS decay_rate",
         "tuned": """SELECT decay_rate, volume AS v, avg_vol * exp(-decay_rate * months_postgx) AS p
             FROM {actual} JOIN {aux} USING (country, brand_name), {rates}"""}


@query("i04_tune_decay_rate", views="actual", ctes=RATES, digits=4, sql=f"""
    SELECT decay_rate, {rx('avg((v - p) ** 2)', 'mse', 4)}, {rx('sqrt(avg((v - p) ** 2))', 'rmse', 4)},
      {rx('avg(abs(v - p))', 'mae', 4)}, {rx('avg(abs((v - p) / v)) FILTER (v > 0) * 100', 'mape', 4)} FROM tuned GROUP BY 1""")
def _(spark, sf):
    return B.decay_rate_table(actual(spark, sf), aux(spark, sf))


@query("i04_best_decay_rate", views="actual", ctes=RATES, sql=f"""
    SELECT decay_rate, {r('rmse')} FROM (SELECT decay_rate, sqrt(avg((v - p) ** 2)) AS rmse FROM tuned GROUP BY 1)
    ORDER BY rmse, decay_rate LIMIT 1""")
def _(spark, sf):
    return B.best_decay_rate(B.decay_rate_table(actual(spark, sf), aux(spark, sf)))


@query("i05_bucket_specific_decay", views="aux horizon", sql=_grid_sql(
    "avg_vol * exp(-(CASE bucket WHEN 1 THEN 0.2 WHEN 2 THEN 0.02 ELSE 0.05 END) * h.months_postgx)"))
def _(spark, sf):
    return B.bucket_specific_decay(aux(spark, sf), range(24), {1: 0.2, 2: 0.02})


@query("i06_flat_baseline", views="panel", sql=f"SELECT {ROW}, 1.0::DOUBLE AS prediction FROM panel")
def _(spark, sf):
    return B.flat(fx.panel(spark, sf).select(*ROW_KEY))


@query("i07_global_mean_baseline", views="panel", sql=f"""
    SELECT {ROW}, round(coalesce(c, (SELECT avg(y_norm) FROM panel WHERE months_postgx BETWEEN 0 AND 23)), 6) + 0.0 AS prediction
    FROM panel LEFT JOIN (SELECT months_postgx, avg(y_norm) AS c FROM panel WHERE months_postgx BETWEEN 0 AND 23 GROUP BY 1)
      USING (months_postgx)""")
def _(spark, sf):
    p = fx.panel(spark, sf)
    return B.global_mean(p.where("months_postgx BETWEEN 0 AND 23"), p.select(*ROW_KEY))


@query("i08_trend_baseline", views="panel", sql=f"""
    , curve AS (SELECT months_postgx AS m, avg(y_norm) AS y FROM panel WHERE months_postgx BETWEEN 0 AND 23 GROUP BY 1),
    s AS (SELECT avg(d) AS s FROM (SELECT y - lag(y) OVER (ORDER BY m) AS d FROM curve))
    SELECT {ROW}, {rx('greatest(0, least(2, 1 + months_postgx * s * 0.95))', 'prediction')} FROM panel, s""")
def _(spark, sf):
    p = fx.panel(spark, sf)
    return B.trend(p.where("months_postgx BETWEEN 0 AND 23"), p.select(*ROW_KEY))
