"""Queries over fitted models.

Operators that fit any model given are run with unpenalised linear models, whose
forecasts and scores SQL repeats from the normal equations. What trees, forests
and stacks predict has no SQL twin: their queries give the rows they speak for,
their target and the training curve, and what must hold of any good forecast.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.constants import MONTH, RESIDUAL_WINDOWS, ROW_KEY, SERIES
from panelspark.functions.expr import attach, clip
from panelspark.operators import baselines as B
from panelspark.operators import curves as U
from panelspark.operators import forecasters as fc
from panelspark.operators import features as E
from panelspark.operators import metrics as G
from panelspark.operators import models as I
from panelspark.operators import panel as P
from panelspark.operators import postprocess as K
from panelspark.operators import similarity as Z
from panelspark.operators import target_stats as T
from panelspark.plans import fixtures as fx
from panelspark.plans import forecast
from panelspark.plans import least_squares as ls
from panelspark.plans.queries_external import store
from panelspark.plans.queries_features import PRE
from panelspark.plans.queries_metrics import W0
from panelspark.plans.registry import query, r, rx
from panelspark.plans.shared_sql import SHARED
from panelspark.sources import tables

ROW = "country, brand_name, months_postgx"
SER = "country, brand_name"

COLUMNS = ("months_postgx", "n_gxs", "hospital_rate_norm", "time_decay", "pre_entry_trend_norm", "pre_entry_volatility",
           "log_avg_vol", "vol_ratio_3m_12m", "n_gxs_at_month_12", "is_injection", "ther_area_encoded", "month_sin")
TREE = I.ModelSpec("gbt_fast", {"maxIter": 8, "maxDepth": 4}, COLUMNS)
LINEAR = I.ModelSpec("ridge", {}, COLUMNS)
#: Least squares over the month and the competitors, and over the month alone.
BOTH = I.ModelSpec("ridge", {"regParam": 0.0}, ("months_postgx", "n_gxs"))
MONTHLY = I.ModelSpec("ridge", {"regParam": 0.0}, ("months_postgx",))


def frame(spark, sf, scenario=1):
    """Stored training features of a scenario."""
    return tables.get_features(spark, store(spark, sf), "train", scenario, "train", lambda: fx.panel(spark, sf)).where(
        "bucket IS NOT NULL")


def parts(spark, sf):
    """Train and validation by brand: odd numbers train, even ones validate."""
    df = frame(spark, sf)
    odd = F.substring("brand_name", 7, 9).cast("int") % 2 == 1
    return df.where(odd), df.where(~odd)


KNN = {"frm": "SELECT p.*, ln(1 + avg_vol_12m) AS log_avg_vol FROM {panel} p WHERE bucket IS NOT NULL AND months_postgx BETWEEN 0 AND 23",
       "g0": f"SELECT {SER}, coalesce(max(n_gxs) FILTER (months_postgx = 0), 0) AS n0 FROM {{panel}} GROUP BY 1, 2",
       "raw0": f"""SELECT {SER}, arg_min(log_avg_vol, months_postgx) AS x0, any_value(tr) AS x1, any_value(coalesce(sd / (avg_vol_12m + 1e-6), 0)) AS x2,
           arg_min(hospital_rate, months_postgx) AS x3, any_value(n0) AS x4, arg_min(n_gxs, months_postgx) AS x5, min(ther_area) AS ta, min(main_package) AS mp
           FROM {{frm}} JOIN {{pre_stats}} USING ({SER}) JOIN {{g0}} USING ({SER}) GROUP BY 1, 2""",
       "side": f"""SELECT *, CAST(substr(brand_name, 7) AS INT) % 2 AS odd, concat(country, '|', brand_name) AS node FROM {{raw0}}""",
       "cta": "SELECT ta, row_number() OVER (ORDER BY ta) - 1 AS x6 FROM (SELECT DISTINCT ta FROM {side} WHERE odd = 1)",
       "cmp": "SELECT mp, row_number() OVER (ORDER BY mp) - 1 AS x7 FROM (SELECT DISTINCT mp FROM {side} WHERE odd = 1)",
       "rawx": """SELECT s.node, s.odd, x0, x1, x2, x3, x4, x5, coalesce(x6, (SELECT count(*) FROM {cta})) AS x6, coalesce(x7, (SELECT count(*) FROM {cmp})) AS x7
           FROM {side} s LEFT JOIN {cta} USING (ta) LEFT JOIN {cmp} USING (mp)""",
       "mv": "SELECT " + ", ".join(f"avg(x{i}) AS m{i}, CASE WHEN stddev_pop(x{i}) = 0 THEN 1 ELSE stddev_pop(x{i}) END AS s{i}" for i in range(8)) + " FROM {rawx} WHERE odd = 1",
       "vec": "SELECT node, odd, [" + ", ".join(f"(x{i} - m{i}) / s{i}" for i in range(8)) + "]::DOUBLE[] AS v FROM {rawx}, {mv}",
       "nn": """SELECT q.node AS query, b.node AS neighbour, round(greatest(0, least(2, 1 - list_dot_product(q.v, b.v)
           / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(b.v, b.v))))), 9) AS distance FROM {vec} q, {vec} b WHERE q.odd = 0 AND b.odd = 1""",
       "knn": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS rank FROM {nn}) WHERE rank <= 5",
       "own": f"""SELECT query, months_postgx, sum(y_norm / (distance + 1e-6)) / sum(1 / (distance + 1e-6)) AS c FROM {{knn}} JOIN {{frm}} f
           ON concat(f.country, '|', f.brand_name) = neighbour GROUP BY 1, 2""",
       "mcv": "SELECT months_postgx, avg(y_norm) AS c FROM {frm} WHERE CAST(substr(brand_name, 7) AS INT) % 2 = 1 GROUP BY 1"}
KNN = {**PRE, **{(k if k != "own" else "knn_own"): v for k, v in KNN.items()}}


@query("i09_historical_curve", views="panel", ctes=KNN, sql=f"""
    SELECT f.country, f.brand_name, f.months_postgx, {rx('coalesce(o.c, m.c)', 'prediction')} FROM frm f
    LEFT JOIN knn_own o ON o.query = concat(f.country, '|', f.brand_name) AND o.months_postgx = f.months_postgx
    LEFT JOIN mcv m ON m.months_postgx = f.months_postgx WHERE CAST(substr(f.brand_name, 7) AS INT) % 2 = 0""")
def _(spark, sf):
    train, val = parts(spark, sf)
    return U.HistoricalCurve().fit(train).predict(val).select(*ROW_KEY, "prediction")


@query("i09_curve_neighbours", views="panel", ctes=KNN, sql=f"SELECT query, neighbour, CAST(rank AS INT) AS rank, {r('distance')} FROM knn")
def _(spark, sf):
    train, val = parts(spark, sf)
    return U.HistoricalCurve().fit(train).neighbours(val)


@query("i09_embedding_neighbours", views="", sql=f"""
    WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    d AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, round(greatest(0, least(2, 1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))))), 9) AS distance
      FROM e a, e b WHERE a.label % 2 = 0 AND b.label % 2 = 1),
    k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS INT) AS rank FROM d)
    SELECT query, neighbour, rank, {r('distance')} FROM k WHERE rank <= 5""")
def _(spark, sf):
    df = fx.view(spark, sf, "embeddings")
    return Z.nearest(df.where("label % 2 = 0"), df.where("label % 2 = 1"), "vec_id", "embedding", 5)


def judged(train, scored):
    """Keys, target and training curve of the scored rows; are forecasts in [0, 2], and better than the training mean?"""
    e = F.col("prediction") - F.col("y_norm")
    flat = F.col("_mean") - F.col("y_norm")
    better = attach(scored, train.agg(F.avg("y_norm").alias("_mean"))).agg((F.avg(e * e) < F.avg(flat * flat)).alias("b"))
    curve = train.groupBy(MONTH).agg(F.avg("y_norm").alias("curve"))
    return scored.join(curve, MONTH, "left").select(
        *ROW_KEY, "y_norm", "curve", F.coalesce(F.col("prediction").between(0, 2), F.lit(False)).alias("in_range"),
        better.scalar().alias("beats_mean"))


def measured(metrics, *keep):
    """Scores of a hold-out: its size, and do they hang together and explain the target?"""
    return metrics.select(*keep, "n_rows", (F.col("rmse") >= F.col("mae")).alias("ordered"), (F.col("r2") > 0).alias("explains"),
                          F.col("official_metric").between(0, 5).alias("in_range"))


EVEN, ODD = "CAST(substr(brand_name, 7) AS INT) % 2 = 0", "CAST(substr(brand_name, 7) AS INT) % 2 = 1"
FRAME = {k: KNN[k] for k in ("frm", "mcv")}
JUDGED = {"views": "panel", "ctes": FRAME, "sql": f"""
    SELECT country, brand_name, f.months_postgx, {r('y_norm')}, {rx('c', 'curve')}, true AS in_range, true AS beats_mean
    FROM frm f LEFT JOIN mcv m ON m.months_postgx = f.months_postgx WHERE {EVEN}"""}
GOOD = "true AS ordered, true AS explains, true AS in_range"


def measured_sql(labels):
    """Hold-out scores of the even brands under each label."""
    return {"views": "panel", "ctes": FRAME, "sql": " UNION ALL ".join(
        f"SELECT {x}, (SELECT count(*) FROM frm WHERE {EVEN}) AS n_rows, {GOOD}" for x in labels)}


LEAST = {**FRAME, "tr": f"SELECT *, n_gxs::DOUBLE AS g, months_postgx::DOUBLE AS m FROM {{frm}} WHERE {ODD}",
         "mom": """SELECT covar_pop(m, m) AS mm, covar_pop(g, g) AS gg, covar_pop(m, g) AS mg, covar_pop(m, y_norm) AS my,
             covar_pop(g, y_norm) AS gy, avg(m) AS am, avg(g) AS ag, avg(y_norm) AS ay FROM {tr}""",
         "coef": "SELECT (my * gg - gy * mg) / (mm * gg - mg * mg) AS bm, (gy * mm - my * mg) / (mm * gg - mg * mg) AS bg, am, ag, ay FROM {mom}"}


@query("i10_least_squares", views="panel", ctes=LEAST, digits=5, sql=f"""
    SELECT {ROW},
      {rx('greatest(0, least(2, ay + bm * (months_postgx - am) + bg * (n_gxs - ag)))', 'prediction', 5)}
    FROM frm, coef WHERE {EVEN}""")
def _(spark, sf):
    """Without a penalty, the linear model solves the normal equations."""
    train, val = parts(spark, sf)
    spec = I.ModelSpec("ridge", {"regParam": 0.0}, ("months_postgx", "n_gxs"))
    return I.predict(I.fit(spec, train), val).select(*ROW_KEY, "prediction")


@query("i10_linear_model", **JUDGED)
def _(spark, sf):
    train, val = parts(spark, sf)
    return judged(train, I.predict(I.fit(LINEAR, train), val))


@query("i10_linear_model_polynomial_huber", **JUDGED)
def _(spark, sf):
    train, val = parts(spark, sf)
    few = I.ModelSpec("huber", {"maxIter": 20}, COLUMNS[:4], polynomial=2)
    return judged(train, I.predict(I.fit(few, train), val))


@query("i11_gbt_early_stopping", **JUDGED)
def _(spark, sf):
    train, val = parts(spark, sf)
    both = train.withColumn("_held", F.lit(False)).unionByName(val.withColumn("_held", F.lit(True)))
    spec = I.ModelSpec("gbt_deep", {"maxIter": 10, "maxDepth": 4}, COLUMNS, validation="_held")
    return judged(train, I.predict(I.fit(spec, both), val))


@query("i12_gbt_sampled", **JUDGED)
def _(spark, sf):
    train, val = parts(spark, sf)
    return judged(train, I.predict(I.fit(I.ModelSpec("gbt_sampled", {"maxIter": 8, "maxDepth": 4}, COLUMNS), train), val))


@query("i13_forest", **JUDGED)
def _(spark, sf):
    train, val = parts(spark, sf)
    return judged(train, I.predict(I.fit(I.ModelSpec("forest", {"numTrees": 15, "maxDepth": 6}, COLUMNS), train), val))


REG = {**FRAME, "reg": "SELECT *, months_postgx::DOUBLE AS m, n_gxs::DOUBLE AS g FROM {frm}",
       "odd": f"SELECT * FROM {{reg}} WHERE {ODD}", "even": f"SELECT * FROM {{reg}} WHERE {EVEN}"}
PHYSICS = "exp(-0.05 * months_postgx)"


@query("i14_hybrid_model", views="panel", ctes={**REG, **ls.solved("fit", "odd", y=f"y_norm - {PHYSICS}")}, digits=5, sql=f"""
    SELECT {ROW}, {rx(PHYSICS, 'physics', 5)}, {rx(ls.value(), 'ml_residual', 5)}, {rx(ls.clipped(f'{PHYSICS} + {ls.value()}'), 'prediction', 5)} FROM even, fit""")
def _(spark, sf):
    """What the decay leaves over is fitted by least squares; the forecast is the sum."""
    train, val = parts(spark, sf)
    return I.predict_hybrid(I.fit_hybrid(train, BOTH), val).select(*ROW_KEY, "physics", "ml_residual", "prediction")


@query("i14_hybrid_trees", views="panel", ctes=FRAME, sql=f"""
    SELECT {ROW}, {rx('exp(-0.05 * months_postgx)', 'physics')}, true AS adds_up, true AS in_range, true AS beats_mean
    FROM frm WHERE {EVEN}""")
def _(spark, sf):
    train, val = parts(spark, sf)
    scored = I.predict_hybrid(I.fit_hybrid(train, TREE), val)
    rows = judged(train, scored).drop("y_norm", "curve").join(scored.select(*ROW_KEY, "physics", "ml_residual", "prediction"), ROW_KEY)
    whole = clip(F.col("physics") + F.col("ml_residual"), 0, 2)
    return rows.select(*ROW_KEY, "physics", (F.abs(F.col("prediction") - whole) < 1e-9).alias("adds_up"), "in_range", "beats_mean")


@query("i15_blended_series_forecast", views="panel aux", ctes={
    "past": f"SELECT {SER}, count(*) AS n FROM {{panel}} WHERE months_postgx < 0 AND volume IS NOT NULL GROUP BY 1, 2"}, sql=f"""
    SELECT p.country, p.brand_name, CAST(h.m AS INT) AS months_postgx, CASE WHEN n >= 6 THEN 1 ELSE 0 END AS fitted,
      CASE WHEN n < 6 THEN {rx('coalesce(avg_vol, 1) * exp(-0.05 * h.m)', 'x').rsplit(' AS ', 1)[0]} END AS decayed, true AS in_range
    FROM past p CROSS JOIN (SELECT unnest(range(24)) AS m) h LEFT JOIN aux x ON x.country = p.country AND x.brand_name = p.brand_name""")
def _(spark, sf):
    p = fx.panel(spark, sf)
    out = U.blended_series_forecast(p.where("months_postgx < 0"), range(24), fallback=G.create_aux(p))
    return out.select(*ROW_KEY, "fitted", F.when(F.col("fitted") == 0, F.col("volume")).alias("decayed"),
                      (F.col("volume") >= 0).alias("in_range"))


HOLT = (0.4, 0.2)
PAST = {"hist": f"""SELECT {SER}, months_postgx, volume, row_number() OVER (PARTITION BY {SER} ORDER BY months_postgx) AS t,
        count(*) OVER (PARTITION BY {SER}) AS n FROM {{panel}} WHERE volume IS NOT NULL AND months_postgx < 0"""}


@query("i15_holt_by_rates", views="panel", ctes={**PAST,
    "runs": f"""SELECT {SER}, n, list(volume ORDER BY t) AS v FROM {{hist}} GROUP BY 1, 2, 3 HAVING n >= 2""",
    "state": f"""SELECT {SER}, list_reduce(list_prepend([v[1], v[2] - v[1]], list_transform(v[2:], lambda x: [x, 0.0])), lambda a, b: [
        {HOLT[0]} * b[1] + {1 - HOLT[0]} * (a[1] + a[2]),
        {HOLT[1]} * ({HOLT[0]} * b[1] + {1 - HOLT[0]} * (a[1] + a[2]) - a[1]) + {1 - HOLT[1]} * a[2]]) AS s FROM {{runs}}"""}, digits=4, sql=f"""
    SELECT {SER}, CAST(h AS INT) AS months_postgx, {rx('s[1] + (h + 1) * s[2]', 'volume', 4)} FROM state, (SELECT unnest(range(6)) AS h)""")
def _(spark, sf):
    """Additive-trend smoothing with given rates."""
    past = fx.panel(spark, sf).where("months_postgx < 0")
    long = past.join(past.where("volume IS NOT NULL").groupBy(*SERIES).count().where("count >= 2").select(*SERIES), SERIES, "left_semi")
    return fc.smoothed_by(long, fc.Smoothing("add"), list(HOLT), range(6))


PHI = 0.5


@query("i15_arima_likelihood", views="panel", ctes={**PAST,
    "dif": f"SELECT {SER}, t, n, volume - lag(volume) OVER (PARTITION BY {SER} ORDER BY t) AS d FROM {{hist}}",
    "err": f"""SELECT {SER}, CASE WHEN t = 2 THEN d * d * {1 - PHI * PHI} ELSE pow(d - {PHI} * lag(d) OVER (PARTITION BY {SER} ORDER BY t), 2) END AS e
        FROM {{dif}} WHERE t >= 2""",
    "s2": f"SELECT {SER}, count(*) AS n, avg(e) AS s2 FROM {{err}} GROUP BY 1, 2"}, digits=3, sql=f"""
    SELECT {SER}, CAST(n AS INT) AS n, {rx(f'-0.5 * (n * ln(2 * pi() * greatest(s2, 1e-300)) - ln({1 - PHI * PHI}) + n)', 'log_likelihood', 3)}, {rx('s2', 'variance', 3)} FROM s2""")
def _(spark, sf):
    """Likelihood of first differences as an autoregression, from the prediction errors of the filter."""
    past = fx.panel(spark, sf).where("months_postgx < 0")
    return fc.filtered(past, fc.Order((1, 1, 0)), [PHI], []).where("n > 0")


OTS = {"frm": KNN["frm"], "orows": f"""SELECT {ROW}, y_norm, ther_area, md5(concat_ws('|', '42', country, brand_name, CAST(months_postgx AS STRING))) AS h,
        (SELECT avg(y_norm) FROM {{frm}}) AS prior FROM {{frm}}"""}


@query("i11_ordered_target_statistics", views="panel", ctes=OTS, sql=f"""
    SELECT {ROW}, {rx('(coalesce(sum(y_norm) OVER w, 0) + prior) / (count(y_norm) OVER w + 1)', 'ther_area_ots')} FROM orows
    WINDOW w AS (PARTITION BY ther_area ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(spark, sf):
    """The mean target of the rows before, in a seeded permutation, of the same area."""
    return T.ordered_target_statistics(frame(spark, sf), ["ther_area"], "y_norm").select(*ROW_KEY, "ther_area_ots")


@query("i11_gbt_categories", **JUDGED)
def _(spark, sf):
    train, val = parts(spark, sf)
    spec = I.ModelSpec("gbt_fast", {"maxIter": 8, "maxDepth": 4}, COLUMNS)
    return judged(train, T.fit_booster(spec, train, ["ther_area", "main_package"]).predict(val))


WEIGHTED = {**REG, "wodd": f"SELECT t.*, ({W0['wrows'].split('(CASE WHEN', 1)[1].rsplit(' AS w0', 1)[0].join(['(CASE WHEN', ''])}) AS w0 FROM {{odd}} t",
            "wtrain": "SELECT *, greatest(0.01, least(100, w0 * count(*) OVER () / sum(w0) OVER ())) AS w FROM {wodd}"}
LOGGED = "ln(1 + greatest(y_norm, 0) + 1e-6)"
SCORES = "rmse mae r2 official_metric"


@query("i16_train_scenario_model", views="panel", digits=4, ctes={
    **WEIGHTED, **ls.solved("fit", "wtrain", y=LOGGED, w="w"), **ls.scored("sc", "even", "fit", f"greatest(0, exp({ls.value()}) - 1 - 1e-6)", "1 AS scenario"),
    **ls.scores("out", "sc", "scenario")}, sql=f"SELECT scenario, n_rows, {r(SCORES, 4)} FROM out")
def _(spark, sf):
    """Weighted least squares of the logarithm, scored on the shares themselves."""
    train, val = parts(spark, sf)
    return I.train_scenario_model(train, val, 1, BOTH, "log1p")[2].select(F.lit(1).alias("scenario"), "n_rows", *SCORES.split())


@query("i17_cross_validation", views="panel", digits=4, ctes={**REG, **ls.folds("fl", "reg", 3), **ls.out_of_fold("oof", "fl", 3), **ls.scores("out", "oof", "fold")},
       sql=f"SELECT fold, n_rows, {r(SCORES, 4)} FROM out")
def _(spark, sf):
    return I.cross_validate(frame(spark, sf), 1, BOTH, 3, weighted=False)[1].select("fold", "n_rows", *SCORES.split())


@query("i17_out_of_fold", views="panel", digits=5, ctes={**REG, **ls.folds("fl", "reg", 3), **ls.out_of_fold("oof", "fl", 3)},
       sql=f"SELECT {ROW}, fold, {rx('p', 'prediction', 5)} FROM oof")
def _(spark, sf):
    return I.cross_validate(frame(spark, sf), 1, BOTH, 3, weighted=False)[0].select(*ROW_KEY, "fold", "prediction")


PLAIN_GRID = {"elasticNetParam": [0.0, 1.0]}  # without a penalty its kind does not matter
HELD = {**REG, **ls.split("sp", "reg"), "tr": "SELECT * FROM {sp} WHERE NOT val", "va": "SELECT * FROM {sp} WHERE val", **ls.solved("fit", "tr"),
        **ls.scored("sc", "va", "fit", keep="1 AS one"), **ls.scores("out", "sc", "one")}


def tuned_sql(source):
    return " UNION ALL ".join(f"SELECT {i} AS config, '{{''elasticNetParam'': {v}}}' AS params, {source} AS official_metric" for i, v in enumerate(PLAIN_GRID["elasticNetParam"]))


@query("i18_tune", views="panel", digits=4, ctes=HELD, sql=tuned_sql("(SELECT round(official_metric, 4) FROM out)"))
def _(spark, sf):
    return I.tune(frame(spark, sf), 1, BOTH, PLAIN_GRID)[1]


TWO = {**REG, **ls.folds("fl", "reg", 2), **ls.out_of_fold("oof", "fl", 2), **ls.scores("out", "oof", "fold"),
       **ls.out_of_fold("flat", "fl", 2, intercept=False), **ls.scores("flatout", "flat", "fold")}


@query("i18_tune_folds", views="panel", digits=4, ctes=TWO, sql=tuned_sql("(SELECT round(avg(official_metric), 4) FROM out)"))
def _(spark, sf):
    return I.tune(frame(spark, sf), 1, BOTH, PLAIN_GRID, folds=2)[1]


@query("i18_halving", views="panel", digits=4, ctes=TWO, sql="""
    , first AS (SELECT (SELECT official_metric FROM out WHERE fold = 0) <= (SELECT official_metric FROM flatout WHERE fold = 0) AS plain)
    SELECT 0 AS config, '{''fitIntercept'': True}' AS params, CASE WHEN plain THEN 2 ELSE 1 END AS n_folds,
      round((SELECT avg(official_metric) FROM out WHERE plain OR fold = 0), 4) AS official_metric, plain AS best FROM first
    UNION ALL SELECT 1, '{''fitIntercept'': False}', CASE WHEN plain THEN 1 ELSE 2 END,
      round((SELECT avg(official_metric) FROM flatout WHERE NOT plain OR fold = 0), 4), NOT plain FROM first""")
def _(spark, sf):
    """The point that is worse on the first fold is not tried on the second."""
    return I.tune_halving(frame(spark, sf), 1, BOTH, {"fitIntercept": [True, False]}, folds=2)[1]


@query("i19_compare_models", views="panel", digits=4, ctes={
    **WEIGHTED, **ls.solved("fit", "wtrain", w="w"), **ls.solved("one", "wtrain", g=None, w="w"), **ls.scored("s1", "even", "fit", keep="'both' AS model"),
    **ls.scored("s2", "even", "one", keep="'monthly' AS model"), "sc": "SELECT * FROM {s1} UNION ALL SELECT * FROM {s2}", **ls.scores("out", "sc", "model")},
       sql=f"SELECT model, n_rows, {r(SCORES, 4)} FROM out")
def _(spark, sf):
    train, val = parts(spark, sf)
    return I.compare_models(train, val, 1, {"both": BOTH, "monthly": MONTHLY}).select("model", "n_rows", *SCORES.split())


@query("i19_compare_kinds", **measured_sql(["'tree' AS model", "'linear' AS model"]))
def _(spark, sf):
    train, val = parts(spark, sf)
    return measured(I.compare_models(train, val, 1, {"tree": TREE, "linear": LINEAR}), "model")


@query("i20_compare_losses", **measured_sql([f"'{m}' AS model" for m in ("squared", "absolute", "linear_squared", "linear_huber")]))
def _(spark, sf):
    train, val = parts(spark, sf)
    return measured(I.compare_losses(train, val, 1, I.ModelSpec("gbt_fast", {"maxIter": 4, "maxDepth": 3}, COLUMNS)), "model")


BUCKETED = {**REG, "o1": "SELECT * FROM {odd} WHERE bucket = 1", "o2": "SELECT * FROM {odd} WHERE bucket = 2", **ls.solved("b1", "o1"), **ls.solved("b2", "o2"),
            "routed": f"""SELECT t.*, {ls.clipped(ls.value())} AS p FROM {{even}} t, {{b1}} WHERE bucket = 1
                UNION ALL SELECT t.*, {ls.clipped(ls.value())} FROM {{even}} t, {{b2}} WHERE bucket = 2"""}


@query("i21_bucket_specialized_models", views="panel", ctes=BUCKETED, digits=5, sql=f"SELECT {ROW}, bucket, {rx('p', 'prediction', 5)} FROM routed")
def _(spark, sf):
    train, val = parts(spark, sf)
    return I.route_by_bucket(I.bucket_models(train, 1, BOTH), val).select(*ROW_KEY, "bucket", "prediction")


@query("i22_multi_seed", **measured_sql(["1 AS seed", "2 AS seed"]))
def _(spark, sf):
    train, val = parts(spark, sf)
    spec = I.ModelSpec("gbt_sampled", {"maxIter": 4, "maxDepth": 3}, COLUMNS)
    return measured(I.multi_seed(train, val, 1, spec, [1, 2])[0], "seed")


def residual_frame(spark, sf):
    df = frame(spark, sf)
    base = B.exponential_decay(G.create_aux(fx.panel(spark, sf)), range(24)).withColumnRenamed("volume", "volume_pred")
    return df.join(base, ROW_KEY).withColumns({"volume_true": F.col("volume"), "scenario": F.lit(1)})


SPOKEN = "bucket = 1 AND (" + " OR ".join(f"months_postgx BETWEEN {a} AND {b}" for a, b in RESIDUAL_WINDOWS[1]) + ")"


DRAWN = """CAST(CAST(concat('0x', substr(md5(concat_ws('|', '42', country, brand_name, CAST(months_postgx AS STRING))), 1, 8)) AS UBIGINT) AS DOUBLE) / 4294967296.0"""
RESIDUAL = {**REG, "rr": f"SELECT t.*, p.volume AS vp, t.volume - p.volume AS res, {DRAWN.replace('months_postgx', 't.months_postgx').replace('country', 't.country').replace('brand_name', 't.brand_name')} AS u FROM {{reg}} t JOIN {{pred}} p USING ({ROW})",
            "rtrain": f"SELECT * FROM {{rr}} WHERE {SPOKEN} AND u >= 0.2", "rheld": f"SELECT * FROM {{rr}} WHERE {SPOKEN} AND u < 0.2", **ls.solved("rfit", "rtrain", y="res")}


@query("i23_residual_model", views="panel pred", ctes=RESIDUAL, digits=4, sql=f"""
    SELECT count(*) AS n_val, {rx(f'sqrt(avg(pow({ls.value()} - res, 2)))', 'rmse_residual', 4)}, {rx(f'avg(abs({ls.value()} - res))', 'mae_residual', 4)} FROM rheld, rfit""")
def _(spark, sf):
    return I.train_residual_model(residual_frame(spark, sf), BOTH)[1]


@query("k11_residual_correction", views="panel pred", ctes=RESIDUAL, digits=4, sql=f"""
    SELECT {ROW}, {rx(f'greatest(0, vp + CASE WHEN {SPOKEN} THEN {ls.value()} ELSE 0 END)', 'volume', 4)} FROM rr, rfit""")
def _(spark, sf):
    """Rows the residual model does not speak for keep their volume."""
    df = residual_frame(spark, sf)
    model = I.train_residual_model(df, BOTH)[0]
    rows = model.transform(df).withColumn("volume", F.col("volume_pred"))
    return K.apply_residual_correction(rows, "prediction").select(*ROW_KEY, "volume")


def _swapped(repeat: int) -> dict[str, str]:
    """Rows beside the partner that two independent random orders give them."""
    def ranked(tag):
        h = f"md5(concat_ws('|', '42', '{tag}', '{repeat}', country, brand_name, CAST(months_postgx AS STRING)))"
        return f"SELECT *, row_number() OVER (ORDER BY {h}, country, brand_name, months_postgx) AS place FROM {{even}}"
    return {f"pa{repeat}": ranked("a"), f"pb{repeat}": ranked("b"),
            f"both{repeat}": f"SELECT {repeat} AS rep, a.y_norm AS y, a.m, a.g, b.m AS m2, b.g AS g2 FROM {{pa{repeat}}} a JOIN {{pb{repeat}}} b USING (place)"}


RAW_ERROR = {c: f"avg(pow({ls.value(m, g)} - y, 2))" for c, m, g in (("base", "m", "g"), ("months_postgx", "m2", "g"), ("n_gxs", "m", "g2"))}


@query("i24_permutation_importance", views="panel", digits=5, ctes={
    **REG, **ls.solved("fit", "odd"), **_swapped(0), **_swapped(1), "tried": "SELECT * FROM {both0} UNION ALL SELECT * FROM {both1}",
    "mse": f"SELECT rep, {RAW_ERROR['base']} AS e0, {RAW_ERROR['months_postgx']} AS e1, {RAW_ERROR['n_gxs']} AS e2 FROM {{tried}}, {{fit}} GROUP BY 1"}, sql=" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {rx(f'avg({e} - e0)', 'importance_mean', 5)}, {rx(f'stddev_pop({e} - e0)', 'importance_std', 5)} FROM mse" for c, e in (("months_postgx", "e1"), ("n_gxs", "e2"))))
def _(spark, sf):
    train, val = parts(spark, sf)
    return I.permutation_importance(I.fit(BOTH, train), val, 2)


NUMS = ["volume", "n_gxs", "hospital_rate", "avg_vol_12m", "months_postgx"]
IMP = {"imp": " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, y_norm)) AS importance FROM {{panel}}" for c in NUMS)}


def importance(spark, sf):
    """Absolute correlation with the target as a stand-in importance table."""
    wide = fx.panel(spark, sf).agg(*[F.abs(F.corr(c, "y_norm")).alias(c) for c in NUMS])
    return wide.unpivot([], NUMS, "feature", "importance")


@query("i25_select_features_top", views="panel", ctes=IMP, sql="SELECT feature FROM imp ORDER BY importance DESC, feature LIMIT 3")
def _(spark, sf):
    return I.select_features(importance(spark, sf), top_k=3, column="importance")


@query("i25_select_features_threshold", views="panel", ctes=IMP, sql="SELECT feature FROM imp WHERE importance > 0.1")
def _(spark, sf):
    return I.select_features(importance(spark, sf), threshold=0.1, column="importance")


@query("i26_prune_features", views="panel", ctes=IMP, sql=f"""
    SELECT feature, {r('importance')}, CASE WHEN row_number() OVER (ORDER BY imp.importance, feature) <= greatest(least(floor(count(*) OVER () * 0.4), count(*) OVER () - 4), 0)
      THEN 0 ELSE 1 END AS keep FROM imp""")
def _(spark, sf):
    return I.prune_features(importance(spark, sf), 0.4, 4)


ABLATED = {**REG, **ls.split("sp", "reg"), "tr": "SELECT * FROM {sp} WHERE NOT val", "va": "SELECT * FROM {sp} WHERE val",
           **ls.solved("f0", "tr"), **ls.solved("f1", "tr", g=None), **ls.solved("f2", "tr", m=None), **ls.scored("s0", "va", "f0", keep="'baseline' AS run, 2 AS n_features"),
           **ls.scored("s1", "va", "f1", keep="'drop_generics' AS run, 1 AS n_features"), **ls.scored("s2", "va", "f2", keep="'add_generics' AS run, 1 AS n_features"),
           "runs": "SELECT * FROM {s0} UNION ALL SELECT * FROM {s1} UNION ALL SELECT * FROM {s2}",
           "err": "SELECT run, n_features, sqrt(avg(pow(p - y_norm, 2))) AS rmse, avg(abs(p - y_norm)) AS mae FROM {runs} GROUP BY 1, 2"}


@query("i27_feature_ablation", views="panel", ctes=ABLATED, digits=5, sql=f"""
    SELECT run, n_features, {r('rmse mae', 5)}, {rx("rmse - (SELECT rmse FROM err WHERE run = 'baseline')", 'impact', 5)} FROM err""")
def _(spark, sf):
    return I.feature_ablation(frame(spark, sf), BOTH, {"generics": ["n_gxs"]})


@query("i28_compare_approaches")
def _(spark, sf):
    """Errors of linear models over whole feature sets, which SQL does not repeat; the tests hold their order."""
    return I.compare_approaches(fx.panel(spark, sf), 1, {"plain": {}, "encoded": {"target_encoding": True}}, LINEAR)


MEMBERS = {"tree": I.ModelSpec("gbt_fast", {"maxIter": 4, "maxDepth": 3}, COLUMNS), "linear": LINEAR}


@query("j03_stacking", **JUDGED)
def _(spark, sf):
    train, val = parts(spark, sf)
    return judged(train, I.stacking(train, MEMBERS, 2)[0](val))


@query("j04_blending", **JUDGED)
def _(spark, sf):
    train, val = parts(spark, sf)
    return judged(train, I.blending(train, MEMBERS)[0](val))


PAIR = {"both": BOTH, "monthly": MONTHLY}
BLENDED = {**WEIGHTED, **ls.solved("fit", "wtrain", w="w"), **ls.solved("one", "wtrain", g=None, w="w"),
           "pp": f"SELECT t.*, {ls.clipped(ls.value())} AS p1 FROM {{even}} t, {{fit}}", "pq": f"SELECT t.*, {ls.clipped(ls.value())} AS p2 FROM {{pp}} t, {{one}}",
           "mix": "SELECT t.* , i / 4.0 AS w1, 1 - i / 4.0 AS w2, i, (i / 4.0) * p1 + (1 - i / 4.0) * p2 AS p FROM {pq} t, (SELECT unnest(range(5)) AS i)",
           **ls.scores("out", "mix", "i")}


@query("j08_multi_model_ensemble", views="panel", digits=4, ctes=BLENDED, sql="""
    , top AS (SELECT min(official_metric) AS s FROM out), single AS (SELECT min(official_metric) AS s FROM out WHERE i IN (0, 4))
    SELECT round((SELECT s FROM top), 4) AS score, round((SELECT s FROM single), 4) AS best_single_score,
      (SELECT count(*) FROM out WHERE official_metric = (SELECT s FROM top)) > 0 AS found""")
def _(spark, sf):
    """The best point of the grid of weights and the best member, both by the official metric."""
    train, val = parts(spark, sf)
    row = I.train_multi_model_ensemble(train, val, 1, PAIR, parts=4)
    return row.select("score", "best_single_score", (F.abs(sum(F.col(f"w_{n}") for n in PAIR) - 1) < 1e-9).alias("found"))


@query("j11_predict_batch", views="panel", digits=5, ctes={**REG, **ls.solved("one", "odd", g=None), **ls.scored("sc", "even", "one")},
       sql=f"SELECT {ROW}, {rx('p', 'prediction', 5)} FROM sc")
def _(spark, sf):
    train, val = parts(spark, sf)
    return I.predict(I.fit(MONTHLY, train), val).select(*ROW_KEY, "prediction")


def test_panel(spark, sf):
    volume, generics, med = (fx.view(spark, sf, n) for n in ("test_volume", "generics", "medicine_info"))
    return P.build_panel(volume, generics, med, is_train=False)


def _of_test() -> dict[str, str]:
    """The panel texts over the test volumes, under names that begin with t_."""
    chain = ["base", "clean0", "clean", "own", "own_area", "own_filled", "scored"]
    out = {}
    for name in chain:
        text = SHARED[name].replace("{volume}", "{test_volume}")
        for other in chain:
            text = text.replace("{" + other + "}", "{t_" + other + "}")
        out[f"t_{name}"] = text
    return out


SUBMITTED = {**_of_test(),
    "t_series": f"""SELECT {SER}, max(avg_vol_12m) AS a, min(hospital_rate) / 100 AS h, max(CASE WHEN months_postgx BETWEEN 0 AND 5 THEN 1 ELSE 0 END) AS seen
        FROM {{t_scored}} GROUP BY 1, 2""",
    "t_base": "SELECT * REPLACE (CASE WHEN a > 0 THEN a ELSE coalesce((SELECT median(avg_vol_12m) FROM {t_scored} WHERE avg_vol_12m > 0), 1000.0) END AS a) FROM {t_series}",
    "reg1": "SELECT *, months_postgx::DOUBLE AS m, hospital_rate / 100 AS g FROM {panel} WHERE bucket IS NOT NULL AND months_postgx BETWEEN 0 AND 23",
    "reg2": "SELECT *, months_postgx::DOUBLE AS m, hospital_rate / 100 AS g FROM {panel} WHERE bucket IS NOT NULL AND months_postgx BETWEEN 6 AND 23",
    **ls.solved("fit1", "reg1"), **ls.solved("fit2", "reg2"),
    "fc": f"""SELECT {SER}, a, CAST(k AS INT) AS months_postgx, {ls.clipped(ls.value('k', 'h'))} AS p, 1 AS scenario FROM {{t_base}}, {{fit1}}, (SELECT unnest(range(24)) AS k) WHERE seen = 0
        UNION ALL SELECT {SER}, a, CAST(k AS INT), {ls.clipped(ls.value('k', 'h'))}, 2 FROM {{t_base}}, {{fit2}}, (SELECT unnest(range(6, 24)) AS k) WHERE seen = 1"""}
SUBMITTED = {("t_known" if k == "t_base" and "REPLACE" in v else k): v for k, v in [*_of_test().items(), *[(k, v) for k, v in SUBMITTED.items() if k not in _of_test() or "REPLACE" in v]]}
SUBMITTED = {k: v.replace("{t_base}, {fit", "{t_known}, {fit") for k, v in SUBMITTED.items()}
RATED = I.ModelSpec("ridge", {"regParam": 0.0}, ("months_postgx", "hospital_rate_norm"))


def asked(spark, sf):
    """The test panel and the rows that its scenarios ask for."""
    test = test_panel(spark, sf)
    kinds = P.detect_test_scenarios(test)
    return test, kinds.select(*SERIES, F.explode(F.sequence(F.when(F.col("scenario") == 1, 0).otherwise(6), F.lit(23))).alias("months_postgx"))


@query("k01_generate_submission", views="panel test_volume", ctes=SUBMITTED, digits=4, sql=f"""
    SELECT {ROW}, {rx(f'greatest(0, median(p * a) OVER (PARTITION BY {SER} ORDER BY months_postgx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))', 'volume', 4)} FROM fc""")
def _(spark, sf):
    """Volumes of all test series, smoothed along each series."""
    test, template = asked(spark, sf)
    codes = E.category_codes(fx.panel(spark, sf))
    fitted = {s: I.fit(RATED, frame(spark, sf, s), codes) for s in (1, 2)}
    return forecast.generate_submission(fitted, test, template, smooth=True)


ROUTED = {**SUBMITTED, **{f"reg{s}{b}": f"SELECT * FROM {{reg{s}}} WHERE bucket = {b}" for s in (1, 2) for b in (1, 2)},
          **{k: v for s in (1, 2) for b in (1, 2) for k, v in ls.solved(f"fit{s}{b}", f"reg{s}{b}").items()},
          "fb": f"SELECT {SER}, CASE WHEN avg(p) <= 0.25 THEN 1 ELSE 2 END AS b FROM {{fc}} GROUP BY 1, 2",
          "fr": f"SELECT f.*, b, h FROM {{fc}} f JOIN {{fb}} USING ({SER}) JOIN {{t_known}} USING ({SER})",
          "rt": " UNION ALL ".join(f"SELECT {ROW}, fr.a, scenario, b, {ls.clipped(ls.value('months_postgx', 'h'))} AS p FROM {{fr}} fr, {{fit{s}{b}}} WHERE scenario = {s} AND b = {b}"
                                   for s in (1, 2) for b in (1, 2))}


@query("k01_routed_submission", views="panel test_volume", ctes=ROUTED, digits=4, sql=f"SELECT {ROW}, {rx('p * a', 'volume', 4)} FROM rt")
def _(spark, sf):
    """Each series through the model of the bucket that the base forecast puts it in."""
    test, template = asked(spark, sf)
    codes = E.category_codes(fx.panel(spark, sf))
    models = {}
    for s in (1, 2):
        rows = frame(spark, sf, s)
        models[s] = {forecast.BASE: I.fit(RATED, rows, codes), **I.bucket_models(rows, s, RATED)}
    return forecast.generate_submission(models, test, template)


@query("k01_test_category_codes", views="panel test_volume medicine_info", sql="""
    , codes AS (SELECT ther_area, row_number() OVER (ORDER BY ther_area) - 1 AS code FROM (SELECT DISTINCT ther_area FROM panel WHERE ther_area IS NOT NULL))
    SELECT t.country, t.brand_name, CAST(coalesce(max(c.code), -1) AS INT) AS ther_area_encoded
    FROM test_volume t LEFT JOIN medicine_info m USING (country, brand_name) LEFT JOIN codes c ON m.ther_area = c.ther_area
    GROUP BY 1, 2""")
def _(spark, sf):
    """The codes that the test rows of each scenario are scored with are those of the training panel."""
    test, codes = P.handle_missing_pre_entry_data(test_panel(spark, sf)), E.category_codes(fx.panel(spark, sf))
    kinds = P.detect_test_scenarios(test).select(*SERIES, "scenario")
    parts = [E.add_drug_features(test.join(kinds.where(F.col("scenario") == s).select(*SERIES), SERIES, "left_semi"), codes=codes) for s in (1, 2)]
    return parts[0].unionByName(parts[1]).select(*SERIES, "ther_area_encoded").distinct()


@query("k05_route_by_bucket", views="panel", ctes=BUCKETED, digits=4, sql=f"SELECT {ROW}, {rx('p * avg_vol_12m', 'volume', 4)} FROM routed")
def _(spark, sf):
    train, val = parts(spark, sf)
    return I.as_volume(I.route_by_bucket(I.bucket_models(train, 1, BOTH), val))


@query("f08_adversarial_validation")
def _(spark, sf):
    """AUC per fold and mean importance per feature of a forest, which SQL does not repeat."""
    train, val = parts(spark, sf)
    auc, shift = I.adversarial_validation(train, val, list(COLUMNS), 2, 10, 4)
    return auc.select(F.concat(F.lit("auc_fold_"), F.col("fold").cast("string")).alias("name"), F.col("auc").alias("value")).unionByName(
        shift.select(F.concat(F.lit("shift_"), F.col("feature")).alias("name"), F.col("importance").alias("value"))).select(
        "name", "value", F.col("value").between(0, 1).alias("in_range"))


@query("f08_adversarial_rows", views="panel", ctes=FRAME, sql=f"""
    SELECT CAST(CAST(concat('0x', substr(md5(concat_ws('|', '42', {SER})), 1, 8)) AS UBIGINT) % 2 AS INT) AS fold, CASE WHEN {ODD} THEN 0 ELSE 1 END AS label, count(*) AS n_rows
    FROM frm GROUP BY 1, 2""")
def _(spark, sf):
    """The rows that each fold tells apart."""
    train, val = parts(spark, sf)
    return I.adversarial_rows(train, val, ["months_postgx"], 2).groupBy(F.col("_fold").alias("fold"), F.col("_label").cast("int").alias("label")).agg(F.count("*").alias("n_rows"))


SWEPT = {**REG, **ls.folds("fl", "reg", 3), **ls.out_of_fold("oof", "fl", 3), **ls.scores("o1", "oof", "fold"), **ls.out_of_fold("mon", "fl", 3, g=None), **ls.scores("o2", "mon", "fold"),
         "every": "SELECT 'both' AS model, * FROM {o1} UNION ALL SELECT 'monthly', * FROM {o2}",
         "ag": "SELECT model, count(*) AS n_folds, avg(official_metric) AS mean, stddev_samp(official_metric) AS std FROM {every} GROUP BY 1"}


@query("q04_sweep_with_cv", views="panel", ctes=SWEPT, digits=4, sql=f"""
    SELECT model, n_folds, {r('mean std', 4)}, row_number() OVER (ORDER BY round(mean, 6), model) AS rank FROM ag""")
def _(spark, sf):
    return I.sweep_with_cv(frame(spark, sf), 1, {"both": BOTH, "monthly": MONTHLY}, 3, weighted=False).select("model", "n_folds", "mean", "std", "rank")
