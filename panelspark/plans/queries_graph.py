"""Queries over the similarity graph, lookback windows and run logs (SURVEY sections O, P, Q)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from panelspark.constants import ROW_KEY, SERIES
from panelspark.operators import graph as O
from panelspark.operators import runs as Q
from panelspark.operators import sequence as P
from panelspark.operators import similarity as Z
from panelspark.plans import fixtures as fx
from panelspark.plans.registry import query, r, rx
from panelspark.sources import logs

ROW = "country, brand_name, months_postgx"
SER = "country, brand_name"
FEATS = ["avg_vol_12m", "hospital_rate", "volume", "months_postgx"]
N = len(FEATS)


@lru_cache(maxsize=8)
def _graph(app: str, sf: str, spark) -> O.SeriesGraph:
    return O.build_graph(fx.panel(spark, sf), FEATS, threshold=0.8)


def graph(spark, sf) -> O.SeriesGraph:
    """The graph with its staged tables, built once per session and folder."""
    return _graph(spark.sparkContext.applicationId, str(sf), spark)


def listed(df, name="features", n=N):
    return df.select(*[c for c in df.columns if c != name], *[F.col(name)[i].alias(f"f{i}") for i in range(n)])


GRAPH = {
    "fst": f"""SELECT {SER}, concat(country, '|', brand_name) AS node, arg_min(ther_area, months_postgx) AS ther_area,
        arg_min(main_package, months_postgx) AS main_package, {', '.join(f"arg_min({c}, months_postgx)::DOUBLE AS x{i}" for i, c in enumerate(FEATS))}
        FROM {{panel}} GROUP BY 1, 2""",
    "nodes": f"""SELECT {SER}, node, ther_area, main_package, {', '.join(f"(x{i} - avg(x{i}) OVER ()) / (stddev_pop(x{i}) OVER () + 1e-6) AS f{i}" for i in range(N))}
        FROM {{fst}}""",
    "nv": f"SELECT *, [{', '.join(f'f{i}' for i in range(N))}] AS f FROM {{nodes}}",
    "np": """SELECT a.node AS src, b.node AS dst, CAST(a.ther_area = b.ther_area AS INT) AS t, CAST(a.country = b.country AS INT) AS c,
        CAST(a.main_package = b.main_package AS INT) AS p,
        list_dot_product(a.f, b.f) / (sqrt(list_dot_product(a.f, a.f)) * sqrt(list_dot_product(b.f, b.f)) + 1e-6) AS s
        FROM {nv} a JOIN {nv} b ON a.node <> b.node""",
    "aw": "SELECT src, dst, t + c + p + CASE WHEN s > 0.8 THEN s ELSE 0 END AS w FROM {np}",
    "dg": "SELECT src AS node, 1 + sum(w) AS d FROM {aw} GROUP BY 1",
    "an": """SELECT src, dst, w / sqrt(a.d * b.d) AS weight FROM {aw} JOIN {dg} a ON a.node = src JOIN {dg} b ON b.node = dst WHERE w > 0
        UNION ALL SELECT node, node, 1.0 / d FROM {dg}""",
    "asked": """SELECT a.node AS src, b.node AS dst FROM {nodes} a JOIN {nodes} b ON
        (b.brand_name = a.brand_name AND CAST(substr(b.country, 8) AS INT) = (CAST(substr(a.country, 8) AS INT) + 1) % 25)
        OR (b.country = a.country AND CAST(substr(b.brand_name, 7) AS INT) = CAST(substr(a.brand_name, 7) AS INT) % 25 + 1) OR a.node = b.node""",
}


def asked_pairs(g):
    """Each series with itself, with the next brand of its country, and with its brand in the next country."""
    brand = F.concat(F.lit("Brand#"), (F.substring("brand_name", 7, 9).cast("int") % 25 + 1).cast("string"))
    country = F.concat(F.lit("NATION_"), ((F.substring("country", 8, 9).cast("int") + 1) % 25).cast("string"))
    ways = F.array(F.col("node"), F.concat_ws("|", "country", brand), F.concat_ws("|", country, "brand_name"))
    pairs = g.nodes.select(F.col("node").alias("src"), F.explode(ways).alias("dst"))
    return pairs.join(g.nodes.select(F.col("node").alias("dst")), "dst", "left_semi").distinct()


@query("o01_graph_nodes", views="panel", ctes=GRAPH, sql=f"""
    SELECT node, {SER}, ther_area, main_package, {r(' '.join(f'f{i}' for i in range(N)))} FROM nodes""")
def _(spark, sf):
    return listed(graph(spark, sf).nodes)


@query("o01_edge_summary", views="panel", ctes=GRAPH, sql="""
    SELECT 'therapeutic' AS edge_type, CAST(sum(t) / 2 AS BIGINT) AS n_edges FROM np UNION ALL SELECT 'same_country', CAST(sum(c) / 2 AS BIGINT) FROM np
    UNION ALL SELECT 'same_package', CAST(sum(p) / 2 AS BIGINT) FROM np UNION ALL SELECT 'similar_erosion', CAST(count(*) FILTER (s > 0.8) / 2 AS BIGINT) FROM np
    UNION ALL SELECT 'temporal', count(*) FROM nodes""")
def _(spark, sf):
    return O.edge_summary(graph(spark, sf))


@query("o02_pair_edges", views="panel", ctes=GRAPH, sql=f"""
    , k AS (SELECT * FROM asked JOIN np USING (src, dst))
    SELECT src, dst, 'therapeutic' AS edge_type, 1.0::DOUBLE AS weight FROM k WHERE t = 1 UNION ALL SELECT src, dst, 'same_country', 1.0 FROM k WHERE c = 1
    UNION ALL SELECT src, dst, 'same_package', 1.0 FROM k WHERE p = 1 UNION ALL SELECT src, dst, 'similar_erosion', {rx('s', 'weight')} FROM k WHERE s > 0.8
    UNION ALL SELECT src, dst, 'temporal', 1.0 FROM asked WHERE src = dst""")
def _(spark, sf):
    g = graph(spark, sf)
    return O.pair_edges(g, asked_pairs(g))


@query("o02_cosine_edges_embeddings", views="", sql=f"""
    WITH e AS (SELECT min(vec_id) AS id, embedding::DOUBLE[] AS v FROM embeddings GROUP BY 2)
    SELECT a.id AS src, b.id AS dst, {rx('list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-6)', 'weight')}
    FROM e a JOIN e b ON a.id < b.id
    WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-6) > 0.3""")
def _(spark, sf):
    return Z.similar_pairs(fx.view(spark, sf, "embeddings"), "vec_id", "embedding", 0.3)[0]


@query("o03_adjacency", views="panel", ctes=GRAPH, sql=f"""
    SELECT src, dst, {rx('weight', 'weight', 9)} FROM asked JOIN an USING (src, dst)""", digits=9)
def _(spark, sf):
    g = graph(spark, sf)
    return O.adjacency(g, asked_pairs(g))


@query("o03_degrees", views="panel", ctes=GRAPH, sql=f"SELECT node, {rx('d', 'degree')} FROM dg")
def _(spark, sf):
    return O.degrees(graph(spark, sf))


@query("o04_node_features", views="panel", ctes={**GRAPH, "ns": f"""
        SELECT {SER}, arg_min(hospital_rate, months_postgx) AS h, arg_min(CAST(biological AS INT), months_postgx) * 1.0 AS b,
          avg(volume) AS vm, coalesce(stddev_samp(volume), 0) AS vs FROM {{panel}} GROUP BY 1, 2""",
        "dc": "SELECT src AS node, sum(t + c + p + CASE WHEN s > 0.8 THEN 1 ELSE 0 END) AS k FROM {np} GROUP BY 1"}, sql=f"""
    SELECT {SER}, {rx('(h - (SELECT avg(hospital_rate) FROM panel)) / ((SELECT stddev_samp(hospital_rate) FROM panel) + 1e-6)', 'hospital_rate')},
      {rx('b', 'biological')}, {rx('(vm - avg(vm) OVER ()) / (stddev_samp(vm) OVER () + 1e-6)', 'volume_mean')},
      {rx('(vs - avg(vs) OVER ()) / (stddev_samp(vs) OVER () + 1e-6)', 'volume_std')},
      {rx('k / max(k) OVER ()', 'degree')}, {rx('k / (count(*) OVER () - 1)', 'degree_share')}
    FROM ns JOIN dc ON node = concat(country, '|', brand_name)""")
def _(spark, sf):
    return O.node_features(fx.panel(spark, sf), ["hospital_rate", "biological"], ["volume"], graph(spark, sf))


@query("o05_centrality", views="panel", ctes=GRAPH, sql=f"""
    , dc AS (SELECT src AS node, sum(t + c + p + CASE WHEN s > 0.8 THEN 1 ELSE 0 END) AS k FROM np GROUP BY 1)
    SELECT node, {rx('k / max(k) OVER ()', 'degree')}, {rx('k / (count(*) OVER () - 1)', 'degree_share')} FROM dc""")
def _(spark, sf):
    return O.centrality(graph(spark, sf))


ONE = "NATION_3|Brand#8"


@query("o06_neighbors", views="panel", ctes=GRAPH, sql=f"""
    SELECT dst AS node FROM np WHERE src = '{ONE}' AND (t + c + p > 0 OR s > 0.8) UNION SELECT node FROM nodes WHERE node = '{ONE}'""")
def _(spark, sf):
    return O.neighbors(graph(spark, sf), ONE)


def sub_sql(keep: str) -> str:
    return f"""
    , k AS (SELECT node FROM nodes WHERE {keep}), e AS (SELECT np.* FROM np JOIN k a ON a.node = src JOIN k b ON b.node = dst)
    SELECT 'therapeutic' AS edge_type, CAST(sum(t) / 2 AS BIGINT) AS n_edges FROM e HAVING count(t) > 0 UNION ALL SELECT 'same_country', CAST(sum(c) / 2 AS BIGINT) FROM e
    UNION ALL SELECT 'same_package', CAST(sum(p) / 2 AS BIGINT) FROM e UNION ALL SELECT 'similar_erosion', CAST(count(*) FILTER (s > 0.8) / 2 AS BIGINT) FROM e
    UNION ALL SELECT 'temporal', count(*) FROM k"""


@query("o07_subgraph", views="panel", ctes=GRAPH, sql=sub_sql("main_package IN ('Tablet', 'Cream')"))
def _(spark, sf):
    g = graph(spark, sf)
    return O.edge_summary(O.subgraph(g, g.nodes.where(F.col("main_package").isin("Tablet", "Cream"))))


@query("o08_filter_by_country", views="panel", ctes=GRAPH, sql=sub_sql("country = 'NATION_5'"))
def _(spark, sf):
    return O.edge_summary(O.filter_by(graph(spark, sf), "country", "NATION_5"))


@query("o09_filter_by_ther_area", views="panel", ctes=GRAPH, sql=sub_sql("ther_area = 'AREA_2'"))
def _(spark, sf):
    return O.edge_summary(O.filter_by(graph(spark, sf), "ther_area", "AREA_2"))


@query("o10_normalize_edges", views="", digits=9, sql=f"""
    WITH e AS (SELECT concat('s', CAST(l_suppkey AS STRING)) AS src, concat('p', CAST(l_partkey AS STRING)) AS dst, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
    a AS (SELECT * FROM e UNION ALL SELECT n, n, 1 FROM (SELECT src AS n FROM e UNION SELECT dst FROM e)),
    d AS (SELECT src AS n, sum(w) AS d FROM a GROUP BY 1)
    SELECT src, dst, {rx('w / sqrt(x.d * y.d)', 'weight', 9)} FROM a JOIN d x ON x.n = src JOIN d y ON y.n = dst""")
def _(spark, sf):
    li = fx.view(spark, sf, "lineitem")
    edges = li.groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"),
                       F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).agg(
        F.sum("l_quantity").alias("weight"))
    return O.normalize_edges(edges)


PROP = {"p1": f"SELECT src AS node, {', '.join(f'sum(weight * f{i}) AS f{i}' for i in range(N))} FROM {{an}} JOIN {{nodes}} ON node = dst GROUP BY 1",
        "p2": f"SELECT src AS node, {', '.join(f'sum(weight * f{i}) AS f{i}' for i in range(N))} FROM {{an}} JOIN {{p1}} q ON q.node = dst GROUP BY 1"}


@query("o11_propagate", views="panel", ctes={**GRAPH, **PROP}, sql=f"SELECT node, {r(' '.join(f'f{i}' for i in range(N)))} FROM p2")
def _(spark, sf):
    return listed(O.propagate(graph(spark, sf), hops=2))


for _pool, _agg in (("mean", "avg"), ("max", "max"), ("sum", "sum")):
    def _register_pool(pool=_pool, agg=_agg):
        @query(f"o12_readout_{pool}", views="panel", ctes=GRAPH, sql=f"""
            SELECT country AS graph_id, {', '.join(rx(f'{agg}(f{i})', f'f{i}') for i in range(N))} FROM nodes GROUP BY 1""")
        def _(spark, sf):
            g = graph(spark, sf)
            return listed(O.readout(g.nodes.select("node", "features"), g.nodes.select("node", F.col("country").alias("graph_id")), pool))
    _register_pool()


# --- P: lookback windows ------------------------------------------------------------------------

SEQ = {"sq": f"SELECT {SER}, months_postgx AS m, volume AS v, n_gxs AS g, hospital_rate AS h, row_number() OVER (PARTITION BY {SER} ORDER BY months_postgx) AS i, count(*) OVER (PARTITION BY {SER}) AS n FROM {{panel}}",
       "win": f"""SELECT {SER}, m AS last_month, min(m) OVER w AS first_month, sum(v) OVER w AS v_sum, first_value(v) OVER w AS v_first, v AS v_last, sum(g) OVER w AS g_sum,
           lead(v, 1) OVER (PARTITION BY {SER} ORDER BY m) AS y1, lead(v, 2) OVER (PARTITION BY {SER} ORDER BY m) AS y2, i, n
           FROM {{sq}} WINDOW w AS (PARTITION BY {SER} ORDER BY m ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"""}


def total(name: str, i: int):
    return F.aggregate(F.col(name), F.lit(0.0), lambda acc, s: acc + s[i])


@query("p01_build_sequences", views="panel", ctes=SEQ, sql=f"""
    SELECT {SER}, first_month, last_month, {r('v_sum v_first v_last')}, {rx('g_sum * 1.0', 'g_sum')}, {rx('y1', 'y1')}, {rx('y2', 'y2')}
    FROM win WHERE i >= 6 AND i + 2 <= n""")
def _(spark, sf):
    out = P.build_sequences(fx.panel(spark, sf), ["volume", "n_gxs"], "volume", 6, 2)
    seq = F.col("X_seq")
    return out.select(*SERIES, F.col("months")[0].alias("first_month"), F.col("months")[5].alias("last_month"),
                      total("X_seq", 0).alias("v_sum"), seq[0][0].alias("v_first"), seq[5][0].alias("v_last"),
                      total("X_seq", 1).alias("g_sum"), F.col("y")[0].alias("y1"), F.col("y")[1].alias("y2"))


@query("p02_sequences_for_inference", views="panel", ctes=SEQ, sql=f"""
    SELECT {SER}, {rx('sum(v) FILTER (i > n - 40)', 'v_sum')}, CAST(least(max(n), 40) AS INT) AS n_real,
      {rx('CASE WHEN max(n) >= 40 THEN max(v) FILTER (i = n - 39) ELSE 0 END', 'v_first')}, {rx('max(v) FILTER (i = n)', 'v_last')} FROM sq GROUP BY 1, 2""")
def _(spark, sf):
    out = P.sequences_for_inference(fx.panel(spark, sf), ["volume", "n_gxs"], 40)
    return out.select(*SERIES, total("X_seq", 0).alias("v_sum"),
                      F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("n_real"),
                      F.col("X_seq")[0][0].alias("v_first"), F.col("X_seq")[39][0].alias("v_last"))


@query("p03_pad_sequences", views="panel", ctes=SEQ, sql=f"""
    SELECT {SER}, {rx('max(v) FILTER (i = 1)', 'v_first')}, {rx('CASE WHEN max(n) >= 20 THEN max(v) FILTER (i = 20) ELSE -1 END', 'v_last')},
      CAST(least(max(n), 20) AS INT) AS n_real, 20 AS n_steps FROM sq GROUP BY 1, 2""")
def _(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("months_postgx", "volume")))
    seqs = fx.panel(spark, sf).groupBy(*SERIES).agg(F.transform(rows, lambda s: s["volume"]).alias("seq"))
    out = P.pad_sequences(seqs, "seq", 20, -1.0, "post")
    return out.select(*SERIES, F.col("seq")[0].alias("v_first"), F.col("seq")[19].alias("v_last"),
                      F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("n_real"), F.size("seq").alias("n_steps"))


@query("p04_time_features", views="panel", sql=f"""
    , t AS (SELECT {ROW}, ((months_postgx % 12) + 12) % 12 AS t FROM panel)
    SELECT {ROW}, months_postgx + 24 AS time_relative, {rx('sin(2 * pi() * t / 12)', 'month_sin')}, {rx('cos(2 * pi() * t / 12)', 'month_cos')},
      {rx('sin(2 * pi() * (t // 3) / 4)', 'quarter_sin')}, {rx('cos(2 * pi() * (t // 3) / 4)', 'quarter_cos')} FROM t""")
def _(spark, sf):
    return P.create_time_features(fx.panel(spark, sf).select(*ROW_KEY), base_month=-24)


WINROWS = {**SEQ, "kept": "SELECT * FROM {win} WHERE i >= 6 AND i + 2 <= n",
           "cells": f"SELECT s.v, s.g FROM {{kept}} k JOIN {{sq}} s ON s.country = k.country AND s.brand_name = k.brand_name AND s.i BETWEEN k.i - 5 AND k.i",
           "ys": "SELECT y1 AS y FROM {kept} UNION ALL SELECT y2 FROM {kept}"}
SCALES = {"standard": ("avg({c})", "stddev_pop({c}) + 1e-8"), "minmax": ("min({c})", "max({c}) - min({c}) + 1e-8"),
          "robust": ("median({c})", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) + 1e-8")}

for _m, (_center, _scale) in SCALES.items():
    def _register_scaler(m=_m, center=_center, scale=_scale):
        def z(value, c, table):
            return f"({value} - (SELECT {center.format(c=c)} FROM {table})) / (SELECT {scale.format(c=c)} FROM {table})"
        y = "y1" if m == "robust" else z("y1", "y", "ys")

        @query(f"p05_sequence_scaler_{m}", views="panel", ctes=WINROWS, sql=f"""
            SELECT {SER}, last_month, {rx(z('v_first', 'v', 'cells'), 'v_first')}, {rx(z('v_last', 'v', 'cells'), 'v_last')}, {rx(y, 'y1')} FROM kept""")
        def _(spark, sf):
            made = P.build_sequences(fx.panel(spark, sf), ["volume", "n_gxs"], "volume", 6, 2)
            out = P.SequenceScaler(m).fit(made, "y").transform(made, "y")
            return out.select(*SERIES, F.col("months")[5].alias("last_month"), F.col("X_seq")[0][0].alias("v_first"),
                              F.col("X_seq")[5][0].alias("v_last"), F.col("y")[0].alias("y1"))
    _register_scaler()


@query("p06_prepare_sequences", views="panel", ctes=SEQ, sql=f"""
    , k AS (SELECT * FROM win WHERE i >= 6 AND i + 1 <= n), tr AS (SELECT * FROM k WHERE CAST(substr(brand_name, 7) AS INT) % 2 = 1),
    ty AS (SELECT avg(y1) AS m, stddev_pop(y1) + 1e-8 AS s FROM tr)
    SELECT {SER}, last_month, {rx('(y1 - m) / s', 'y1')} FROM k, ty WHERE CAST(substr(brand_name, 7) AS INT) % 2 = 0""")
def _(spark, sf):
    p = fx.panel(spark, sf)
    odd = F.substring("brand_name", 7, 9).cast("int") % 2 == 1
    _, val, _ = P.prepare_sequences(p.where(odd), ["volume", "n_gxs"], "volume", p.where(~odd), 6, 1)
    return val.select(*SERIES, F.col("months")[5].alias("last_month"), F.col("y")[0].alias("y1"))


# --- Q: run logs --------------------------------------------------------------------------------

@query("q01_grid_runs", views="", sql="""
    SELECT segment, priority, scenario, concat('segment=', segment, '_priority=', priority, '_scenario=', CAST(scenario AS STRING)) AS config_id
    FROM (SELECT DISTINCT c_mktsegment AS segment FROM customer), (SELECT DISTINCT o_orderpriority AS priority FROM orders), (SELECT unnest([1, 2]) AS scenario)""")
def _(spark, sf):
    seg = fx.view(spark, sf, "customer").agg(F.collect_set("c_mktsegment").alias("segment"))
    pri = fx.view(spark, sf, "orders").agg(F.collect_set("o_orderpriority").alias("priority"))
    return Q.grid_runs(spark.range(1).select(seg.scalar().alias("segment"), pri.scalar().alias("priority"),
                                             F.array(F.lit(1), F.lit(2)).alias("scenario")))


RUNS = {"rr": "SELECT model, run_id, avg(value) AS value FROM {metric_log} WHERE metric = 'rmse' GROUP BY 1, 2"}


def results(spark, sf):
    log = logs.load_metric_records(spark, fx.view(spark, sf, "metric_log"))
    return log.where("metric = 'rmse'").groupBy("model", "run_id").agg(F.avg("value").alias("value"))


@query("q02_best_config", views="metric_log", ctes=RUNS, sql=f"SELECT model, run_id, {r('value')} FROM rr ORDER BY rr.value, model, run_id LIMIT 1")
def _(spark, sf):
    return Q.best_run(results(spark, sf), "value")


@query("q03_summarize_runs", views="metric_log", ctes=RUNS, sql=f"""
    SELECT model AS scope, run_id, {r('value')} FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY value, run_id) AS k FROM rr) WHERE k = 1
    UNION ALL SELECT 'overall', run_id, {r('value')} FROM (SELECT *, row_number() OVER (ORDER BY value, run_id) AS k FROM rr) WHERE k = 1""")
def _(spark, sf):
    return Q.summarize_runs(results(spark, sf), "value")


@query("q05_cv_lb_variance", views="submissions", sql=f"""
    , s AS (SELECT *, lb_score - cv_score AS g FROM submissions WHERE cv_score IS NOT NULL AND lb_score IS NOT NULL)
    SELECT count(*) AS n_submissions, {rx('avg(g)', 'mean_gap')}, {rx('stddev_pop(g)', 'std_gap')}, {rx('corr(cv_score, lb_score)', 'correlation')},
      {rx('min(cv_score)', 'best_cv')}, {rx('min(lb_score)', 'best_lb')}, arg_max(submission_id, (round(g, 9), submission_id)) AS worst_gap_submission,
      CASE WHEN avg(g) > 0.05 AND count(*) >= 3 THEN 1 ELSE 0 END AS overfitting_warning FROM s""")
def _(spark, sf):
    return Q.cv_lb_variance(fx.view(spark, sf, "submissions"))


@query("q06_best_submission", views="submissions", sql=f"""
    SELECT submission_id, {r('cv_score lb_score')} FROM submissions WHERE submissions.lb_score IS NOT NULL ORDER BY submissions.lb_score, submission_id LIMIT 1""")
def _(spark, sf):
    return Q.best_submission(fx.view(spark, sf, "submissions"))


@query("q07_overfitting_submissions", views="submissions", sql=f"""
    SELECT submission_id, {r('cv_score lb_score')} FROM submissions WHERE submissions.lb_score - submissions.cv_score > 0.105""")
def _(spark, sf):
    return Q.overfitting_submissions(fx.view(spark, sf, "submissions"), 0.105)


@query("q08_experiment_metadata", views="panel", sql=f"""
    SELECT 'panel' AS part, count(*) AS n_rows, count(DISTINCT ({SER})) AS n_series FROM panel
    UNION ALL SELECT 'train', count(*), count(DISTINCT ({SER})) FROM panel WHERE bucket = 2
    UNION ALL SELECT 'val', count(*), count(DISTINCT ({SER})) FROM panel WHERE bucket = 1""")
def _(spark, sf):
    p = fx.panel(spark, sf)
    return Q.experiment_metadata({"panel": p, "train": p.where("bucket = 2"), "val": p.where("bucket = 1")})


# --- summaries of the exploratory notebooks -----------------------------------------------------

@query("eda_bucket_distribution", views="panel", sql=f"""
    SELECT bucket, count(DISTINCT ({SER})) AS n_series, {rx('avg(mean_erosion)', 'mean_erosion')} FROM panel WHERE bucket IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    return fx.panel(spark, sf).where("bucket IS NOT NULL").groupBy("bucket").agg(
        F.count_distinct(F.struct(*SERIES)).alias("n_series"), F.avg("mean_erosion").alias("mean_erosion"))


@query("eda_erosion_curve", views="panel", sql=f"""
    SELECT months_postgx, {rx('avg(y_norm) FILTER (bucket = 1)', 'bucket1')}, {rx('avg(y_norm) FILTER (bucket = 2)', 'bucket2')},
      {rx('avg(n_gxs)', 'n_gxs')} FROM panel GROUP BY 1""")
def _(spark, sf):
    p = fx.panel(spark, sf)
    return p.groupBy("months_postgx").agg(
        *[F.avg(F.when(F.col("bucket") == b, F.col("y_norm"))).alias(f"bucket{b}") for b in (1, 2)],
        F.avg("n_gxs").alias("n_gxs"))


@query("eda_series_per_country", views="panel", sql="SELECT country, count(DISTINCT brand_name) AS n_series FROM panel GROUP BY 1")
def _(spark, sf):
    return fx.panel(spark, sf).groupBy("country").agg(F.count_distinct("brand_name").alias("n_series"))


@query("eda_metric_pivot", views="metric_log", sql=f"""
    SELECT run_id, {', '.join(rx(f"avg(value) FILTER (metric = '{m}')", m) for m in ('rmse', 'mae', 'metric1_official'))} FROM metric_log GROUP BY 1""")
def _(spark, sf):
    log = logs.load_metric_records(spark, fx.view(spark, sf, "metric_log"))
    return log.groupBy("run_id").pivot("metric", ["rmse", "mae", "metric1_official"]).agg(F.avg("value"))
