"""Queries over ensembles, post-processing and what-if analysis (SURVEY sections J, K, N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.constants import ROW_KEY, SERIES
from panelspark.operators import baselines as B
from panelspark.operators import ensemble as J
from panelspark.operators import features as E
from panelspark.operators import metrics as G
from panelspark.operators import postprocess as K
from panelspark.operators import whatif as N
from panelspark.plans import fixtures as fx
from panelspark.plans.registry import query, r, rx
from panelspark.plans.shared_sql import metric_sql

ROW = "country, brand_name, months_postgx"
SER = "country, brand_name"
NAMES = ["naive", "linear", "expo"]


def aux(spark, sf):
    return G.create_aux(fx.panel(spark, sf))


def pred(spark, sf):
    return B.exponential_decay(aux(spark, sf), range(24))


def actual(spark, sf):
    return fx.panel(spark, sf).where("months_postgx BETWEEN 0 AND 23").select(*ROW_KEY, "volume")


def members(spark, sf, norm=True):
    """Three closed-form forecasts as members, as shares of avg_vol or as volumes."""
    x = aux(spark, sf)
    base = x.withColumn("avg_vol", F.lit(1.0)) if norm else x
    made = {"naive": B.naive_persistence(base, range(24)), "linear": B.linear_decay(base, range(24), 0.05),
            "expo": B.exponential_decay(base, range(24), 0.2)}
    return J.stack({n: d.withColumnRenamed("volume", "prediction") for n, d in made.items()})


MEM = {"mem": """SELECT country, brand_name, CAST(h.months_postgx AS INT) AS months_postgx, avg_vol, 1.0::DOUBLE AS naive,
      greatest(0, 1 - 0.05 * h.months_postgx)::DOUBLE AS linear, exp(-0.2 * h.months_postgx) AS expo FROM {aux}, {horizon} h"""}


@query("j01_average", views="aux", ctes=MEM, sql=f"SELECT {ROW}, {rx('(naive + linear + expo) / 3', 'prediction')} FROM mem")
def _(spark, sf):
    return J.average(members(spark, sf))


@query("j02_weighted", views="aux", ctes=MEM,
       sql=f"SELECT {ROW}, {rx('(2 * naive + linear + 5 * expo) / 8', 'prediction')} FROM mem")
def _(spark, sf):
    return J.weighted(members(spark, sf), {"naive": 2, "linear": 1, "expo": 5})


def _best_mae() -> dict[str, str]:
    values = ", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE)" for i, (x, y, z) in enumerate(J.simplex_grid(3, 10)))
    return {**MEM, "points": f"SELECT * FROM (VALUES {values}) t(w_id, a, b, c)",
            "best": f"""SELECT w_id, a, b, c FROM {{mem}} JOIN {{panel}} USING ({ROW}), {{points}} GROUP BY 1, 2, 3, 4
                ORDER BY avg(abs(a * naive + b * linear + c * expo - y_norm)), w_id LIMIT 1"""}


@query("j02_fit_weights_mae", views="panel aux", ctes=_best_mae(), sql=f"""
    SELECT {ROW}, {rx('greatest(0, least(2, a * naive + b * linear + c * expo))', 'prediction')} FROM mem, best""")
def _(spark, sf):
    y = fx.panel(spark, sf).where("months_postgx BETWEEN 0 AND 23").select(*ROW_KEY, "y_norm")
    w = J.fit_weights(y.join(J.wide(members(spark, sf), NAMES), ROW_KEY), NAMES, "y_norm", "mae", parts=10)
    return J.weighted(members(spark, sf), {n: x for n, x in w.items() if x > 0})


def _best_squares(rows: str) -> dict[str, str]:
    """Least squares over three weights >= 0 with sum 1: the best of the corners, edge minima and inner minimum that are feasible."""
    cells = ", ".join(f"avg(x{i} * x{j}) AS g{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j)
    edges = []
    for i, j in ((1, 2), (1, 3), (2, 3)):
        t = f"(g{j}{j} - g{i}{j} + c{i} - c{j}) / nullif(g{i}{i} - 2 * g{i}{j} + g{j}{j}, 0)"
        w = {i: t, j: f"1 - ({t})"}
        edges.append("SELECT " + ", ".join(f"{w.get(k, '0')} AS w{k}" for k in (1, 2, 3)) + " FROM {moments}")
    inner = """SELECT (r1 * a22 - r2 * a12) / nullif(a11 * a22 - a12 * a12, 0) AS w1, (r2 * a11 - r1 * a12) / nullif(a11 * a22 - a12 * a12, 0) AS w2
        FROM (SELECT g11 - 2 * g13 + g33 AS a11, g12 - g13 - g23 + g33 AS a12, g22 - 2 * g23 + g33 AS a22,
          c1 - c3 - g13 + g33 AS r1, c2 - c3 - g23 + g33 AS r2 FROM {moments})"""
    return {**MEM, "fitrows": rows, "moments": f"SELECT {cells}, avg(x1 * t) AS c1, avg(x2 * t) AS c2, avg(x3 * t) AS c3 FROM {{fitrows}}",
            "corners": "SELECT * FROM (VALUES (1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), (0, 1, 0), (0, 0, 1)) v(w1, w2, w3) UNION ALL "
                       + " UNION ALL ".join(edges) + f" UNION ALL SELECT w1, w2, 1 - w1 - w2 FROM ({inner})",
            "chosen": """SELECT w1, w2, w3 FROM {corners}, {moments} WHERE w1 >= 0 AND w2 >= 0 AND w3 >= 0
                ORDER BY w1 * w1 * g11 + w2 * w2 * g22 + w3 * w3 * g33 + 2 * (w1 * w2 * g12 + w1 * w3 * g13 + w2 * w3 * g23)
                  - 2 * (w1 * c1 + w2 * c2 + w3 * c3) LIMIT 1"""}


@query("j05_blender", views="panel aux", ctes=_best_squares(f"""SELECT {ROW}, naive AS x1, linear AS x2, expo AS x3, y_norm AS t
    FROM {{mem}} JOIN {{panel}} USING ({ROW}) WHERE y_norm IS NOT NULL"""), sql=f"""
    SELECT {ROW}, {rx('t', 'y_norm')}, {rx('x1', 'naive')}, {rx('x2', 'linear')}, {rx('x3', 'expo')},
      {rx('w1 * x1 + w2 * x2 + w3 * x3', 'blended')} FROM fitrows, chosen""")
def _(spark, sf):
    y = fx.panel(spark, sf).where("months_postgx BETWEEN 0 AND 23").select(*ROW_KEY, "y_norm")
    return J.optimize_weights(y, members(spark, sf), NAMES, "y_norm")[1]


@query("j06_optimize_ensemble_weights", views="actual aux", digits=5, ctes=_best_squares(f"""SELECT {ROW}, avg_vol * naive AS x1,
    avg_vol * linear AS x2, avg_vol * expo AS x3, volume AS t FROM {{mem}} JOIN {{actual}} USING ({ROW})"""), sql=f"""
    SELECT {ROW}, {rx('t', 'volume', 5)}, {rx('x1', 'naive', 5)}, {rx('x2', 'linear', 5)}, {rx('x3', 'expo', 5)},
      {rx('w1 * x1 + w2 * x2 + w3 * x3', 'blended', 5)} FROM fitrows, chosen""")
def _(spark, sf):
    return J.optimize_weights(actual(spark, sf), members(spark, sf, False), NAMES)[1]


def _grid_official() -> dict[str, str]:
    points = J.simplex_grid(3, 4)
    values = ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for i, (a, b, c) in enumerate(points))
    gap = "(a.volume - avg_vol * (w_naive * naive + w_linear * linear + w_expo * expo))"

    def part(lo, hi):
        return f"abs(coalesce(sum({gap}) FILTER (months_postgx BETWEEN {lo} AND {hi}), 0))"
    return {**MEM, "grid": f"SELECT * FROM (VALUES {values}) t(w_id, w_naive, w_linear, w_expo)",
            "gpe": f"""SELECT w_id, {SER}, (0.2 * sum(abs({gap})) / 24 + 0.5 * {part(0, 5)} / 6 + 0.2 * {part(6, 11)} / 6
                + 0.1 * {part(12, 23)} / 12) / max(avg_vol) AS pe FROM {{mem}} JOIN {{actual}} a USING ({ROW}), {{grid}}
                GROUP BY 1, 2, 3 HAVING min(months_postgx) = 0""",
            "gpb": f"SELECT w_id, bucket, pe FROM {{gpe}} JOIN {{aux}} USING ({SER})"}


@query("j07_grid_weights_official", views="aux actual", ctes=_grid_official(), digits=4, sql=f"""
    SELECT w_id, w_naive, w_linear, w_expo, metric AS score FROM grid JOIN ({metric_sql('gpb', 'w_id')}) USING (w_id)""")
def _(spark, sf):
    return J.grid_scores(members(spark, sf, False), actual(spark, sf), aux(spark, sf), NAMES, 1, "official", 4)


@query("j07_best_grid_weights_rmse", views="aux actual", ctes=_grid_official(), digits=4, sql=f"""
    SELECT w_id, any_value(w_naive) AS w_naive, any_value(w_linear) AS w_linear, any_value(w_expo) AS w_expo,
      {rx('sqrt(avg((a.volume - avg_vol * (w_naive * naive + w_linear * linear + w_expo * expo)) ** 2))', 'score', 4)}
    FROM mem JOIN actual a USING ({ROW}), grid GROUP BY 1 ORDER BY score, w_id LIMIT 1""")
def _(spark, sf):
    return J.best_grid_weights(J.grid_scores(members(spark, sf, False), actual(spark, sf), aux(spark, sf), NAMES, 1, "rmse", 4))


@query("j09_confidence", views="aux", ctes=MEM, sql=f"""
    , t AS (SELECT {ROW}, unnest([naive, linear, expo]) AS p FROM mem)
    SELECT {ROW}, {rx('avg(p)', 'mean')}, {rx('quantile_cont(p, 0.05)', 'lower')}, {rx('quantile_cont(p, 0.95)', 'upper')}
    FROM t GROUP BY 1, 2, 3""")
def _(spark, sf):
    return J.confidence(members(spark, sf), 0.9)


@query("j10_seed_ensemble_median", views="aux", ctes=MEM, sql=f"""
    , t AS (SELECT {ROW}, unnest([naive, linear, expo]) AS p FROM mem)
    SELECT {ROW}, {rx('median(p)', 'prediction')} FROM t GROUP BY 1, 2, 3""")
def _(spark, sf):
    return J.seed_ensemble(members(spark, sf), "median")


# --- K: post-processing -------------------------------------------------------------------------

EDGE = {"vola": f"""SELECT {SER}, max(avg_vol_12m) AS a, coalesce(stddev_samp(volume) FILTER (months_postgx < 0) / (max(avg_vol_12m) + 1e-6), 0) AS v
            FROM {{panel}} GROUP BY 1, 2""",
        "edge": "SELECT * FROM {vola} WHERE a < (SELECT quantile_cont(a, 0.05) FROM {vola}) OR v > (SELECT quantile_cont(v, 0.95) FROM {vola})",
        "mcurve": f"""SELECT months_postgx, median(y_norm) AS c FROM {{panel}} p WHERE NOT EXISTS
            (SELECT 1 FROM {{edge}} e WHERE e.country = p.country AND e.brand_name = p.brand_name) GROUP BY 1"""}


@query("k02_edge_case_fallback", views="pred panel", ctes=EDGE, sql=f"""
    SELECT {ROW}, {rx('CASE WHEN e.a IS NOT NULL AND c IS NOT NULL THEN c * e.a ELSE volume END', 'volume')}
    FROM pred LEFT JOIN edge e USING ({SER}) LEFT JOIN mcurve USING (months_postgx)""")
def _(spark, sf):
    return K.apply_edge_case_fallback(pred(spark, sf), E.add_pre_entry_features(fx.panel(spark, sf)))


@query("k03_zero_volume_series", views="pred panel", sql=f"""
    , z AS (SELECT {SER}, CASE WHEN max(avg_vol_12m) < 10 THEN 0 ELSE max(avg_vol_12m) END AS a, count(*) AS n FROM panel GROUP BY 1, 2),
    m AS (SELECT median(CASE WHEN avg_vol_12m < 10 THEN NULL ELSE avg_vol_12m END) AS m FROM panel)
    SELECT {ROW}, {rx('CASE WHEN a = 0 THEN m * greatest(0.01, 0.1 * (1 - 0.02 * months_postgx)) ELSE volume END', 'volume')}
    FROM pred LEFT JOIN z USING ({SER}), m""")
def _(spark, sf):
    p = fx.panel(spark, sf).withColumn("avg_vol_12m", F.when(F.col("avg_vol_12m") < 10, 0.0).otherwise(F.col("avg_vol_12m")))
    return K.handle_zero_volume_series(pred(spark, sf), p)


@query("k04_extreme_predictions", views="pred aux", sql=f"""
    SELECT {ROW}, {rx('greatest(avg_vol * 0.4, least(avg_vol * 0.8, volume))', 'volume')} FROM pred JOIN aux USING ({SER})""")
def _(spark, sf):
    return K.handle_extreme_predictions(pred(spark, sf), fx.panel(spark, sf), 0.8, 0.4)


def validation(spark, sf):
    """Matched forecasts with scenario 1 everywhere and again with scenario 2 from month 6."""
    rows = G.matched(actual(spark, sf), pred(spark, sf), aux(spark, sf)).withColumnsRenamed(
        {"actual": "volume_true", "pred": "volume_pred"}).withColumn("scenario", F.explode(F.array(F.lit(1), F.lit(2))))
    return rows.where("scenario = 1 OR months_postgx >= 6")


CAL = {"valrows": """SELECT *, CASE WHEN scenario = 1 THEN CASE WHEN months_postgx <= 5 THEN 0 WHEN months_postgx <= 11 THEN 1 ELSE 2 END
          ELSE CASE WHEN months_postgx <= 11 THEN 0 WHEN months_postgx <= 17 THEN 1 ELSE 2 END END AS time_window
          FROM {pairs}, (SELECT unnest([1, 2]) AS scenario) WHERE scenario = 1 OR months_postgx >= 6""",
       "cal": """SELECT scenario, bucket, time_window, regr_slope(va, vp) AS a, regr_intercept(va, vp) AS b, count(*) AS n_samples
          FROM {valrows} WHERE bucket IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 5"""}


@query("k06_fit_grouped_calibration", views="pairs", ctes=CAL, sql=f"""
    SELECT scenario, bucket, time_window, n_samples, {r('a b')} FROM cal""")
def _(spark, sf):
    return K.fit_grouped_calibration(validation(spark, sf))


ISO = {**CAL,
       "levels": """SELECT scenario, bucket, time_window, vp, row_number() OVER (PARTITION BY scenario, bucket, time_window ORDER BY vp) AS i,
           sum(sum(va)) OVER w AS s, sum(count(*)) OVER w AS n, sum(va) AS s1, count(*) AS n1 FROM {valrows} WHERE bucket IS NOT NULL GROUP BY 1, 2, 3, 4
           WINDOW w AS (PARTITION BY scenario, bucket, time_window ORDER BY vp ROWS UNBOUNDED PRECEDING)""",
       "spans": """SELECT a.scenario, a.bucket, a.time_window, a.i AS lo, b.i AS hi, b.vp, min((b.s - a.s + a.s1) / (b.n - a.n + a.n1)) OVER (
             PARTITION BY a.scenario, a.bucket, a.time_window, a.i ORDER BY b.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m
           FROM {levels} a JOIN {levels} b ON a.scenario = b.scenario AND a.bucket = b.bucket AND a.time_window = b.time_window AND a.i <= b.i""",
       "iso": "SELECT scenario, bucket, time_window, vp, max(m) AS fit FROM {spans} GROUP BY 1, 2, 3, 4",
       "isosize": "SELECT scenario, bucket, time_window FROM {valrows} GROUP BY 1, 2, 3 HAVING count(*) >= 5"}


@query("k06_isotonic_calibration", views="pairs", ctes=ISO, digits=3, sql=f"""
    SELECT {ROW}, v.scenario, v.bucket, {rx('avg_vol', 'avg_vol', 3)}, {rx('va', 'volume_true', 3)}, {rx('v.vp', 'volume_pred', 3)},
      {rx('greatest(0, CASE WHEN z.scenario IS NULL THEN v.vp ELSE coalesce(fit, v.vp) END)', 'volume', 3)}
    FROM valrows v LEFT JOIN isosize z ON z.scenario = v.scenario AND z.bucket = v.bucket AND z.time_window = v.time_window
    LEFT JOIN iso i ON i.scenario = v.scenario AND i.bucket = v.bucket AND i.time_window = v.time_window AND i.vp = v.vp""")
def _(spark, sf):
    val = validation(spark, sf)
    return K.apply_isotonic_calibration(val.withColumn("volume", F.col("volume_pred")), K.fit_isotonic_calibration(val))


@query("k07_apply_calibration", views="pairs", ctes=CAL, sql=f"""
    SELECT {ROW}, scenario, v.bucket, {rx('greatest(0, coalesce(a * vp + b, vp))', 'volume')}
    FROM valrows v LEFT JOIN cal USING (scenario, bucket, time_window)""")
def _(spark, sf):
    val = validation(spark, sf)
    raw = val.select(*ROW_KEY, "scenario", "bucket", F.col("volume_pred").alias("volume"))
    return K.apply_calibration(raw, K.fit_grouped_calibration(val))


@query("k08_smooth_predictions", views="panel", sql=f"""
    SELECT {ROW}, {rx('''greatest(0, median(volume) OVER (PARTITION BY country, brand_name ORDER BY months_postgx
      ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))''', 'volume')} FROM panel""")
def _(spark, sf):
    return K.smooth_predictions(fx.panel(spark, sf).select(*ROW_KEY, "volume"))


@query("k08_smooth_predictions_mean", views="panel", sql=f"""
    SELECT {ROW}, {rx('''greatest(0, avg(volume) OVER (PARTITION BY country, brand_name ORDER BY months_postgx
      ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))''', 'volume')} FROM panel""")
def _(spark, sf):
    return K.smooth_predictions(fx.panel(spark, sf).select(*ROW_KEY, "volume"), "rolling_mean", 5)


def with_area(spark, sf):
    area = fx.view(spark, sf, "medicine_info").select(*SERIES, "ther_area")
    return G.matched(actual(spark, sf), pred(spark, sf)).withColumnsRenamed(
        {"actual": "volume_true", "pred": "volume_pred"}).join(area, SERIES)


BIAS = {"barea": f"SELECT b.*, m.ther_area FROM {{pairs}} b JOIN {{medicine_info}} m USING ({SER})",
        "bias": "SELECT ther_area, country, avg(va - vp) AS bias, count(*) AS n_samples FROM {barea} GROUP BY 1, 2 HAVING count(*) >= 5"}


@query("k09_fit_bias_corrections", views="pairs", ctes=BIAS, sql=f"SELECT ther_area, country, n_samples, {r('bias')} FROM bias")
def _(spark, sf):
    return K.fit_bias_corrections(with_area(spark, sf))


@query("k09_fit_bias_corrections_median", views="pairs", ctes=BIAS, sql=f"""
    SELECT ther_area, count(*) AS n_samples, {rx('median(va - vp)', 'bias')} FROM barea GROUP BY 1""")
def _(spark, sf):
    return K.fit_bias_corrections(with_area(spark, sf), ["ther_area"], "median_error")


@query("k10_apply_bias_corrections", views="pairs", ctes=BIAS, sql=f"""
    SELECT {ROW}, b.ther_area, {rx('greatest(0, vp + coalesce(bias, 0))', 'volume')} FROM barea b LEFT JOIN bias USING (ther_area, country)""")
def _(spark, sf):
    rows = with_area(spark, sf)
    return K.apply_bias_corrections(rows.select(*ROW_KEY, "ther_area", F.col("volume_pred").alias("volume")),
                                    K.fit_bias_corrections(rows))


# --- N: what-if ---------------------------------------------------------------------------------

SHOCKS = [*N.PRESETS.values(), N.Shock("summer", "seasonal", 1.3, 0, 12)]


def factor_sql(s: N.Shock, mag: str | None = None, m: str = "months_postgx") -> str:
    mag = mag or str(float(s.magnitude))
    end = "" if s.duration is None else f" AND {m} < {s.start + s.duration}"
    value = {"step": mag, "impulse": mag,
             "ramp": f"1 + ({mag} - 1) * ({m} - {s.start}) / {max((s.duration or 24 - s.start) - 1, 1)}",
             "decay": f"{mag} * exp(-{s.decay} * ({m} - {s.start}))",
             "seasonal": f"1 + ({mag} - 1) * sin(2 * pi() * ({m} % 12) / 12)"}[s.kind]
    return f"(CASE WHEN {m} >= {s.start}{end} THEN {value} ELSE 1 END)"


@query("n01_shock_factor", views="pred", sql=" UNION ALL ".join(
    f"SELECT DISTINCT '{s.name}' AS shock, months_postgx, {rx(factor_sql(s), 'factor')} FROM pred" for s in SHOCKS))
def _(spark, sf):
    table = F.array(*[F.struct(F.lit(s.name).alias("shock"), N.shock_factor(s).alias("factor")) for s in SHOCKS])
    return pred(spark, sf).select("months_postgx").distinct().select("months_postgx", F.explode(table).alias("s")).select(
        "months_postgx", "s.shock", "s.factor")


LOCAL = N.Shock("local", "step", 1.2, 2, None, countries=("nation_1", "NATION_4"), brands=("Brand#3", "Brand#7"))


@query("n02_apply_demand_shock", views="pred", sql=f"""
    SELECT {ROW}, {rx("volume * CASE WHEN country IN ('NATION_1', 'NATION_4') AND brand_name IN ('Brand#3', 'Brand#7') AND months_postgx >= 2 THEN 1.2 ELSE 1 END", 'volume')} FROM pred""")
def _(spark, sf):
    return N.apply_demand_shock(pred(spark, sf), LOCAL)


TWO = [N.PRESETS["accelerated_erosion"], N.PRESETS["supply_disruption"], LOCAL]
LOCAL_SQL = "CASE WHEN country IN ('NATION_1', 'NATION_4') AND brand_name IN ('Brand#3', 'Brand#7') AND months_postgx >= 2 THEN 1.2 ELSE 1 END"


@query("n03_apply_multiple_shocks", views="pred", sql=f"""
    SELECT {ROW}, {rx(f'volume * {factor_sql(TWO[0])} * {factor_sql(TWO[1])} * {LOCAL_SQL}', 'volume')} FROM pred""")
def _(spark, sf):
    return N.apply_multiple_shocks(pred(spark, sf), TWO)


SCEN = {"launch": [N.PRESETS["competitive_launch"]], "double": [N.PRESETS["formulary_exclusion"], N.PRESETS["epidemic_surge"]],
        "local": [LOCAL]}
SCEN_SQL = {"launch": factor_sql(N.PRESETS["competitive_launch"]),
            "double": f"{factor_sql(N.PRESETS['formulary_exclusion'])} * {factor_sql(N.PRESETS['epidemic_surge'])}",
            "local": f"({LOCAL_SQL})"}
SCEN_CTE = {"adj": " UNION ALL ".join(f"SELECT '{n}' AS scenario, country, brand_name, volume AS v, volume * {f} AS w FROM {{pred}}"
                                      for n, f in SCEN_SQL.items())}


@query("n04_compare_scenarios", views="pred", ctes=SCEN_CTE, digits=4, sql=f"""
    SELECT scenario, {rx('sum(w) - sum(v)', 'total_volume_change', 4)}, {rx('(sum(w) - sum(v)) * 100 / sum(v)', 'total_volume_change_pct', 4)},
      {rx('avg(w - v)', 'mean_volume_change', 4)}, {rx('min(w - v)', 'max_negative_impact', 4)}, {rx('max(w - v)', 'max_positive_impact', 4)},
      count(*) FILTER (w <> v) AS affected_periods, count(DISTINCT (country, brand_name)) FILTER (w <> v) AS affected_series_count
    FROM adj GROUP BY 1""")
def _(spark, sf):
    return N.compare_scenarios(pred(spark, sf), SCEN)


@query("n05_summarize_scenario_impacts", views="pred", ctes=SCEN_CTE, digits=4, sql=f"""
    SELECT scenario, {rx('sum(w) - sum(v)', 'total_volume_change', 4)}, {rx('(sum(w) - sum(v)) * 100 / sum(v)', 'total_volume_change_pct', 4)},
      {rx('avg(w - v)', 'mean_volume_change', 4)}, {rx('min(w - v)', 'max_negative_impact', 4)}, {rx('max(w - v)', 'max_positive_impact', 4)},
      count(*) FILTER (w <> v) AS affected_periods, count(DISTINCT (country, brand_name)) FILTER (w <> v) AS affected_series_count FROM adj GROUP BY 1""")
def _(spark, sf):
    """From the table of adjusted forecasts, by way of one row per series."""
    return N.summarize_scenario_impacts(N.scenario_predictions(pred(spark, sf), SCEN))


RAMP = N.Shock("ramp", "ramp", 0.8, 3, 9)


@query("n06_sensitivity_analysis", views="pred", digits=4, sql=f"""
    , g AS (SELECT unnest([{', '.join(str(0.5 + i / 9) for i in range(10))}])::DOUBLE AS magnitude),
    x AS (SELECT magnitude, volume AS v, volume * {factor_sql(RAMP, 'magnitude')} AS w FROM pred, g)
    SELECT round(magnitude, 4) + 0.0 AS magnitude, {rx('sum(w)', 'total_volume', 4)}, {rx('avg(w)', 'mean_volume', 4)},
      {rx('(sum(w) - sum(v)) * 100 / sum(v)', 'volume_change_pct', 4)} FROM x GROUP BY x.magnitude""")
def _(spark, sf):
    return N.sensitivity_analysis(pred(spark, sf), RAMP)


def _unit(tag: str) -> str:
    return f"(CAST(CAST(concat('0x', substr(md5(concat_ws('|', '42', CAST(sim AS STRING), '{tag}')), 1, 8)) AS UBIGINT) AS DOUBLE) + 0.5) / 4294967296.0"


@query("n07_monte_carlo", views="pred", digits=4, sql=f"""
    , d AS (SELECT sim, greatest(0.1, least(3, 0.85 + 0.1 * sqrt(-2 * ln({_unit('a')})) * cos(2 * pi() * ({_unit('b')})))) AS mag
      FROM (SELECT unnest(range(1, 101)) AS sim)),
    t AS (SELECT sim, sum(volume * CASE WHEN months_postgx >= 6 THEN mag ELSE 1 END) AS t, sum(volume) AS b FROM pred, d GROUP BY 1)
    SELECT count(*) AS n_simulations, {rx('max(b)', 'base_volume', 4)}, {rx('avg(t)', 'mean_volume', 4)}, {rx('stddev_pop(t)', 'std_volume', 4)},
      {rx('min(t)', 'min_volume', 4)}, {rx('max(t)', 'max_volume', 4)}, {rx('quantile_cont(t, 0.05)', 'percentile_5', 4)},
      {rx('quantile_cont(t, 0.5)', 'percentile_50', 4)}, {rx('quantile_cont(t, 0.95)', 'percentile_95', 4)} FROM t""")
def _(spark, sf):
    return N.monte_carlo(pred(spark, sf), N.PRESETS["competitive_launch"])
