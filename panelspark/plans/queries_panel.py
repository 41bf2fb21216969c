"""Queries over panel building and row selection (SURVEY sections C and D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import panel as P
from panelspark.plans import fixtures as fx
from panelspark.plans.registry import query, r, rx

PANEL_INTS = ("country, brand_name, month, months_postgx, n_gxs, ther_area, main_package, "
              "CAST(biological AS INT) AS biological, CAST(small_molecule AS INT) AS small_molecule")


def plain_flags(df):
    return df.withColumns({c: F.col(c).cast("int") for c in ("biological", "small_molecule") if c in df.columns})


@query("d01_prepare_base_panel", views="base",
       sql=f"SELECT {PANEL_INTS}, {r('volume hospital_rate')} FROM base")
def _(spark, sf):
    return plain_flags(P.prepare_base_panel(*fx.raw_tables(spark, sf)))


@query("d02_handle_missing_values", views="clean",
       sql=f"""SELECT {PANEL_INTS}, {r('volume hospital_rate')}, hospital_rate_missing, biological_missing,
               small_molecule_missing FROM clean""")
def _(spark, sf):
    return plain_flags(P.handle_missing_values(P.prepare_base_panel(*fx.raw_tables(spark, sf))))


@query("d03_compute_pre_entry_stats", views="panel",
       sql=f"""SELECT country, brand_name, months_postgx, pre_entry_months_available, bucket,
               {r('volume avg_vol_12m y_norm mean_erosion')} FROM panel""")
def _(spark, sf):
    base = P.handle_missing_values(P.prepare_base_panel(*fx.raw_tables(spark, sf)))
    return P.compute_pre_entry_stats(base).select(
        "country", "brand_name", "months_postgx", "pre_entry_months_available", "bucket",
        "volume", "avg_vol_12m", "y_norm", "mean_erosion")


def _draw(tag: str) -> str:
    key = f"concat_ws('|', '42', '{tag}', country, brand_name, CAST(months_postgx AS STRING))"
    return f"CAST(CAST(concat('0x', substr(md5({key}), 1, 8)) AS UBIGINT) AS DOUBLE) / 4294967296.0"


@query("d04_augment_panel", views="panel", sql=f"""
    , t AS (SELECT *, CASE WHEN {_draw('drop')} < 0.05 THEN 1 ELSE 0 END AS gone, {_draw('jitter')} AS u FROM panel),
    s AS (SELECT *, avg(gone) OVER (PARTITION BY country, brand_name) AS share FROM t)
    SELECT country, brand_name, months_postgx, {rx('greatest(0, volume * (1 + (2 * u - 1) * 0.05))', 'volume')} FROM s
    WHERE (gone = 0 OR share >= 0.8) AND months_postgx BETWEEN 0 AND 23""")
def _(spark, sf):
    return P.augment_panel(fx.panel(spark, sf)).select("country", "brand_name", "months_postgx", "volume")


TEST_PANEL = {
    "test_base": """SELECT v.*, g.n_gxs, m.ther_area, m.main_package, m.hospital_rate
        FROM {test_volume} v LEFT JOIN {generics} g USING (country, brand_name, months_postgx)
        LEFT JOIN {medicine_info} m USING (country, brand_name)""",
}


@query("d05_expand_panel", ctes=TEST_PANEL, sql=f"""
    , grown AS (
      SELECT country, brand_name, months_postgx, month, ther_area, main_package, hospital_rate, volume, n_gxs
      FROM test_base
      UNION ALL
      SELECT l.country, l.brand_name, h.m,
        substr('JanFebMarAprMayJunJulAugSepOctNovDec',
               ((((position(l.mon IN 'JanFebMarAprMayJunJulAugSepOctNovDec') - 1) // 3 + h.m - l.last) % 12 + 12) % 12) * 3 + 1, 3),
        l.ther_area, l.main_package, l.hospital_rate, NULL, NULL
      FROM (SELECT country, brand_name, max(months_postgx) AS last, arg_max(month, months_postgx) AS mon,
              any_value(ther_area) AS ther_area, any_value(main_package) AS main_package,
              any_value(hospital_rate) AS hospital_rate FROM test_base GROUP BY 1, 2) l,
        (SELECT unnest(range(0, 24)) AS m) h
      WHERE NOT EXISTS (SELECT 1 FROM test_base b WHERE b.country = l.country AND b.brand_name = l.brand_name
                        AND b.months_postgx = h.m))
    SELECT country, brand_name, months_postgx, month, ther_area, main_package, {r('hospital_rate volume')},
      coalesce(last_value(n_gxs IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               first_value(n_gxs IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS n_gxs
    FROM grown WINDOW w AS (PARTITION BY country, brand_name ORDER BY months_postgx)""")
def _(spark, sf):
    volume, generics, med = (fx.view(spark, sf, n) for n in ("test_volume", "generics", "medicine_info"))
    base = P.prepare_base_panel(volume, generics, med).drop("biological", "small_molecule")
    return P.expand_panel(base, 0, 23)


@query("d06_detect_test_scenarios", views="test_volume", sql="""
    SELECT country, brand_name, min(months_postgx) AS min_month, max(months_postgx) AS max_month,
      CASE WHEN max(CASE WHEN months_postgx BETWEEN 0 AND 5 THEN 1 ELSE 0 END) = 1 THEN 2 ELSE 1 END AS scenario
    FROM test_volume GROUP BY 1, 2""")
def _(spark, sf):
    return P.detect_test_scenarios(fx.view(spark, sf, "test_volume"))
