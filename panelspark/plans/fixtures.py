"""Panel, event and supply tables as views over the star-schema tables.

All rows of the tables count: shipments fall on a 48-month cycle around the
event month of their series, so that a series has at most 48 months.

One text per view serves Spark and DuckDB; the few calls that are written
differently come from a small dialect object. ``{name}`` stands for a table or
for another view.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from panelspark.functions.stage import stage
from panelspark.operators import panel as panel_ops

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"]

#: Every further block of parts has brands of its own, so that series grow with the parts; promotions follow by customers.
BRANDS, PARTS, CUSTOMERS = 25, 2000, 1500


@dataclass(frozen=True)
class Dialect:
    name: str

    def days(self, end: str, start: str) -> str:
        return f"datediff({end}, {start})" if self.name == "spark" else f"datediff('day', {start}, {end})"

    def div(self, a: str, b: str) -> str:
        return f"{a} div {b}" if self.name == "spark" else f"{a} // {b}"

    def decay(self, kind: str, month: str, rates: dict[int, str]) -> str:
        """exp(-rate x month) for months from 0 to 23, by kind.

        Two engines' exponentials differ in the last digit of some values, so
        Spark gets the values of the C library, which DuckDB uses, as literals.
        """
        cases = " ".join(f"WHEN {k} THEN {{}}".format(r) for k, r in rates.items())
        if self.name != "spark":
            return f"exp(-(CASE {kind} {cases} ELSE 0.0 END) * {month})"
        tables = " ".join(f"WHEN {k} THEN array({', '.join(f'{math.exp(-(round(float(r) * 100) * m) / 100)!r}D' for m in range(24))})" for k, r in rates.items())
        return f"coalesce(element_at(CASE {kind} {tables} END, CAST({month} AS INT) + 1), 1D)"

    def month_start(self, x: str) -> str:
        return f"CAST(date_trunc('month', {x}) AS DATE)"


SPARK, DUCK = Dialect("spark"), Dialect("duckdb")


def view_texts(d: Dialect) -> dict[str, str]:
    shipped = """{lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey
        JOIN {supplier} s ON l.l_suppkey = s.s_suppkey JOIN {nation} n ON s.s_nationkey = n.n_nationkey"""
    ordered = """{orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
        JOIN {nation} n ON c.c_nationkey = n.n_nationkey"""
    bk = f"(CAST(substr(p.p_brand, 7) AS INT) + {BRANDS} * CAST({d.div('p.p_partkey', str(PARTS))} AS INT))"
    brand = f"concat('Brand#', CAST({bk} AS STRING))"
    custom = f"{BRANDS} * {d.div('o.o_custkey', str(CUSTOMERS))}"
    # Spark deals the shipments by series once; the three sums up to series_month then need no exchange of their own
    together = f"""(SELECT /*+ REPARTITION(nk, bk) */ n.n_name AS country, CAST(n.n_nationkey AS INT) AS nk, {bk} AS bk, l.l_suppkey,
              l.l_shipdate, l.l_quantity FROM {shipped})"""
    dealt = {"shipped_month": f"""
            SELECT country, nk, bk, l_suppkey,
              CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INT) AS raw_t, SUM(l_quantity) AS q
            FROM {together} GROUP BY 1, 2, 3, 4, 5"""} if d.name == "spark" else {}
    return {
        "shipped_month": f"""
            SELECT n.n_name AS country, CAST(n.n_nationkey AS INT) AS nk, {bk} AS bk, l.l_suppkey,
              CAST((year(l.l_shipdate) - 1995) * 12 + month(l.l_shipdate) - 1 AS INT) AS raw_t, SUM(l.l_quantity) AS q
            FROM {shipped} GROUP BY 1, 2, 3, 4, 5""",
        "supplied": """
            SELECT country, nk, bk, l_suppkey, CAST(30 + (nk * 7 + bk * 3) % 24 AS INT) AS start,
              CAST(((raw_t - 6 - (nk * 7 + bk * 3) % 24) % 48 + 48) % 48 - 24 AS INT) AS months_postgx, SUM(q) AS q
            FROM {shipped_month} GROUP BY 1, 2, 3, 4, 5, 6""",
        "series_month": """
            SELECT country, concat('Brand#', CAST(bk AS STRING)) AS brand_name, nk, bk, start + months_postgx AS t, months_postgx,
              SUM(q) AS q, COUNT(*) AS ns
            FROM {supplied} GROUP BY 1, 2, 3, 4, 5, 6""",
        "volume": f"""
            SELECT country, brand_name, substr('JanFebMarAprMayJunJulAugSepOctNovDec', (t % 12) * 3 + 1, 3) AS month,
              CAST(months_postgx AS INT) AS months_postgx,
              CASE WHEN months_postgx < 0 THEN q
                   ELSE q * {d.decay('bk % 3', 'months_postgx', {0: '0.30', 1: '0.05'})}
              END AS volume
            FROM {{series_month}}""",
        "generics": """
            SELECT country, brand_name, CAST(months_postgx AS INT) AS months_postgx,
              CAST(CASE WHEN months_postgx < 0 THEN 0 ELSE ns + CAST(floor(months_postgx / 6) AS INT) END AS INT) AS n_gxs
            FROM {series_month}""",
        "medicine_info": """
            SELECT DISTINCT country, brand_name,
              concat('AREA_', CAST((nk * 3 + bk) % 6 AS STRING)) AS ther_area,
              CASE (nk + bk) % 5 WHEN 0 THEN 'Tablet' WHEN 1 THEN 'Capsule' WHEN 2 THEN 'Injection vial'
                   WHEN 3 THEN 'Infusion' ELSE 'Cream' END AS main_package,
              CASE WHEN (nk * bk) % 13 = 1 THEN NULL ELSE CAST((nk * 17 + bk * 29) % 101 AS DOUBLE) END AS hospital_rate,
              CASE WHEN (nk * 5 + bk) % 19 = 0 THEN NULL ELSE (nk + bk) % 3 = 0 END AS biological,
              (nk + bk) % 3 <> 0 AS small_molecule
            FROM {series_month}""",
        "calendar": f"""
            SELECT country, brand_name, CAST(months_postgx AS INT) AS months_postgx,
              make_date(CAST(1995 + {d.div('t', '12')} AS INT), CAST(t % 12 + 1 AS INT), 1) AS date
            FROM {{series_month}}""",
        "test_volume": """
            SELECT v.* FROM {volume} v JOIN (SELECT DISTINCT country, brand_name, nk, bk FROM {series_month}) s
              ON v.country = s.country AND v.brand_name = s.brand_name
            WHERE (nk + bk) % 5 = 0
              AND v.months_postgx < CASE WHEN (nk + bk) % 10 = 0 THEN 6 ELSE 0 END""",
        "holidays": f"""
            SELECT DISTINCT CAST(o.o_orderdate AS DATE) AS date, n.n_name AS country, 'H' AS holiday_name,
              'national' AS holiday_type
            FROM {ordered}""",
        "epidemics": f"""
            SELECT CAST(o.o_orderdate AS DATE) AS start_date,
              CASE WHEN o.o_orderkey % 422 = 0 THEN NULL
                   ELSE CAST(o.o_orderdate + CAST(o.o_orderkey % 90 AS INT) * INTERVAL '1' DAY AS DATE) END AS end_date,
              n.n_name AS country, 'wave' AS event_name, CAST(1 + o.o_orderkey % 5 AS INT) AS severity
            FROM {ordered}""",
        "macro": f"""
            SELECT CAST(o.o_orderdate AS DATE) AS date, n.n_name AS country,
              CASE o.o_orderkey % 4 WHEN 0 THEN 'gdp_growth' WHEN 1 THEN 'unemployment' WHEN 2 THEN 'inflation'
                   ELSE 'healthcare_spend' END AS indicator_name,
              MAX(o.o_totalprice) / 1000 AS value, '%' AS unit
            FROM {ordered} GROUP BY 1, 2, 3""",
        "promo_policy": f"""
            SELECT CAST(o.o_orderdate AS DATE) AS start_date,
              CASE WHEN o.o_orderkey % 302 = 0 THEN NULL
                   ELSE CAST(o.o_orderdate + CAST(o.o_orderkey % 60 AS INT) * INTERVAL '1' DAY AS DATE) END AS end_date,
              n.n_name AS country,
              CASE o.o_orderkey % 4 WHEN 0 THEN 'price_cut' WHEN 1 THEN 'marketing_campaign' WHEN 2 THEN 'patent_expiry'
                   ELSE 'formulary_change' END AS event_type,
              CASE WHEN o.o_orderkey % 5 = 0 THEN ''
                   ELSE concat('Brand#', CAST(1 + o.o_orderkey % 25 + {custom} AS STRING), '|Brand#',
                               CAST(1 + (o.o_orderkey + 7) % 25 + {custom} AS STRING)) END AS affected_brands
            FROM {ordered}""",
        "vis_orders": f"""
            SELECT CAST(l.l_shipdate AS DATE) AS date, n.n_name AS country, {brand} AS brand_name,
              l.l_quantity AS order_quantity, l.l_quantity * (1 - l.l_discount) AS filled_quantity,
              {d.days('l.l_shipdate', 'o.o_orderdate')} AS lead_time_days
            FROM {shipped} JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey""",
        "vis_inventory": f"""
            SELECT CAST(l.l_shipdate AS DATE) AS date, n.n_name AS country, {brand} AS brand_name,
              l.l_extendedprice / 10 AS inventory_units, l.l_quantity AS days_of_supply, l.l_tax * 10 AS stock_out_risk
            FROM {shipped}""",
        "vis_suppliers": f"""
            SELECT {d.month_start('l.l_shipdate')} AS date, n.n_name AS country, {brand} AS brand_name,
              l.l_suppkey AS supplier_id,
              AVG(CASE WHEN l.l_returnflag = 'R' THEN 0 ELSE 1 END) AS reliability_score,
              AVG(CASE WHEN l.l_linestatus = 'F' THEN 1 ELSE 0 END) AS on_time_delivery_rate
            FROM {shipped} GROUP BY 1, 2, 3, 4""",
        "vis_distribution": f"""
            SELECT CAST(o.o_orderdate AS DATE) AS date, n.n_name AS country, o.o_custkey % 10 AS distribution_center_id,
              (o.o_totalprice % 1000) / 1000 AS capacity_utilization
            FROM {ordered}""",
        "metric_log": """
            SELECT concat('run_', CAST(o_custkey % 20 AS STRING)) AS run_id, CAST(o_orderdate AS STRING) AS timestamp,
              CASE o_orderkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'cv' ELSE 'test' END AS phase,
              CASE WHEN o_orderkey % 2 = 0 THEN 'train' ELSE 'val' END AS split,
              CAST(1 + o_orderkey % 2 AS INT) AS scenario, lower(substr(o_orderpriority, 1, 1)) AS model,
              CASE o_custkey % 3 WHEN 0 THEN 'rmse' WHEN 1 THEN 'mae' ELSE 'metric1_official' END AS metric,
              o_totalprice / 1000 AS value, CAST(o_orderkey % 5 AS INT) AS step,
              CAST(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 1 + o_orderkey % 2 END AS INT) AS bucket,
              CAST(o_custkey AS STRING) AS series_id,
              concat('{{"order":"', CAST(o_orderkey AS STRING), '"}}') AS extra
            FROM {orders}""",
        "submissions": """
            SELECT concat('sub_', CAST(c_custkey AS STRING)) AS submission_id,
              CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal / 10000 END AS cv_score,
              CASE WHEN c_custkey % 11 = 0 THEN NULL
                   ELSE c_acctbal / 10000 + (c_custkey % 17) * 0.01 - 0.02 END AS lb_score
            FROM {customer}""",
        **dealt,
    }


_NAME = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")
_kept: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture view as a Spark DataFrame.

    ``series_month`` is written once per session and folder: almost every other
    view starts from it, and it is one aggregate over the largest tables.
    """
    if name in BASE_TABLES:
        return table(spark, sf_dir, name)
    key = (spark.sparkContext.applicationId, str(sf_dir), name)
    if key in _kept:
        return _kept[key]
    text = view_texts(SPARK)[name]
    inputs = {n: view(spark, sf_dir, n) for n in set(_NAME.findall(text))}
    df = spark.sql(text, **inputs)
    if name == "series_month":
        df = stage(df)
        _kept[key] = df
    return df


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training panel, written once per session and folder as get_panel would."""
    key = (spark.sparkContext.applicationId, str(sf_dir), "panel")
    if key not in _kept:
        _kept[key] = stage(panel_ops.build_panel(*raw_tables(spark, sf_dir)))
    return _kept[key]


def raw_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [view(spark, sf_dir, n) for n in ("volume", "generics", "medicine_info")]


def duck_ctes(names, extra: dict[str, str] | None = None) -> str:
    """WITH clause that defines the named views and all they rest on, for DuckDB."""
    texts = {**view_texts(DUCK), **(extra or {})}
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done or name not in texts:
            return
        for used in _NAME.findall(texts[name]):
            add(used)
        done[name] = _NAME.sub(r"\1", texts[name]).replace("{{", "{").replace("}}", "}")

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({body})" for n, body in done.items()) + "\n" if done else ""
