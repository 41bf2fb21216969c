"""DuckDB texts of the tables that many checks start from, written without the Spark operators."""

from __future__ import annotations

KEYS = "country, brand_name"
ROW = "country, brand_name, months_postgx"

SHARED = {
    "base": """SELECT v.*, g.n_gxs, m.ther_area, m.main_package, m.hospital_rate, m.biological, m.small_molecule
        FROM {volume} v LEFT JOIN {generics} g USING (country, brand_name, months_postgx)
        LEFT JOIN {medicine_info} m USING (country, brand_name)""",
    "clean0": """SELECT b.* EXCLUDE (n_gxs, hospital_rate, ther_area, main_package, biological, small_molecule),
          coalesce(last_value(n_gxs IGNORE NULLS) OVER (PARTITION BY country, brand_name ORDER BY months_postgx
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS n_gxs,
          coalesce(hospital_rate, median(hospital_rate) OVER (PARTITION BY ther_area)) AS hospital_rate,
          ther_area, main_package, biological, small_molecule,
          CASE WHEN hospital_rate IS NULL THEN 1 ELSE 0 END AS hospital_rate_missing,
          CASE WHEN biological IS NULL THEN 1 ELSE 0 END AS biological_missing,
          CASE WHEN small_molecule IS NULL THEN 1 ELSE 0 END AS small_molecule_missing
        FROM {base} b""",
    "clean": """SELECT * REPLACE (
          coalesce(hospital_rate, (SELECT median(hospital_rate) FROM {clean0})) AS hospital_rate,
          coalesce(ther_area, 'Unknown') AS ther_area, coalesce(main_package, 'Unknown') AS main_package,
          coalesce(biological, false) AS biological, coalesce(small_molecule, false) AS small_molecule)
        FROM {clean0}""",
    "own": """SELECT country, brand_name, count(volume) FILTER (months_postgx BETWEEN -12 AND -1) AS pre_entry_months_available,
          coalesce(avg(volume) FILTER (months_postgx BETWEEN -12 AND -1), avg(volume) FILTER (months_postgx < 0)) AS a0
        FROM {clean} GROUP BY 1, 2""",
    "own_area": """SELECT c.ther_area, median(o.a0) AS a1 FROM {clean} c JOIN {own} o USING (country, brand_name) GROUP BY 1""",
    "own_filled": """SELECT c.*, o.pre_entry_months_available, coalesce(o.a0, x.a1) AS a2
        FROM {clean} c JOIN {own} o USING (country, brand_name) LEFT JOIN {own_area} x USING (ther_area)""",
    "scored": """SELECT * EXCLUDE (a2), coalesce(a2, (SELECT median(a2) FROM {own_filled})) AS avg_vol_12m FROM {own_filled}""",
    "y": """SELECT *, coalesce(volume / nullif(avg_vol_12m, 0), 1.0) AS y_norm FROM {scored}""",
    "panel": """SELECT y.*, e.mean_erosion,
          CASE WHEN e.mean_erosion <= 0.25 THEN 1 WHEN e.mean_erosion IS NOT NULL THEN 2 END AS bucket
        FROM {y} y LEFT JOIN (SELECT country, brand_name, avg(y_norm) FILTER (months_postgx BETWEEN 0 AND 23) AS mean_erosion
          FROM {y} GROUP BY 1, 2) e USING (country, brand_name)""",
    "aux": """SELECT DISTINCT country, brand_name, avg_vol_12m AS avg_vol, bucket FROM {panel}""",
    "horizon": """SELECT unnest(range(0, 24)) AS months_postgx""",
    "pred": """SELECT country, brand_name, CAST(h.months_postgx AS INT) AS months_postgx,
          avg_vol * exp(-0.05 * h.months_postgx) AS volume FROM {aux}, {horizon} h""",
    "actual": """SELECT country, brand_name, months_postgx, volume FROM {panel} WHERE months_postgx BETWEEN 0 AND 23""",
    "actual2": """SELECT country, brand_name, months_postgx, volume FROM {panel} WHERE months_postgx BETWEEN 6 AND 23""",
    "pairs": """SELECT a.country, a.brand_name, a.months_postgx, a.volume AS va, p.volume AS vp, x.avg_vol, x.bucket
        FROM {actual} a JOIN {pred} p USING (country, brand_name, months_postgx) LEFT JOIN {aux} x USING (country, brand_name)""",
    "pe1": """SELECT country, brand_name, bucket,
          0.2 * sum(abs(va - vp)) / nullif(24 * max(avg_vol), 0)
          + 0.5 * abs(coalesce(sum(va - vp) FILTER (months_postgx <= 5), 0)) / nullif(6 * max(avg_vol), 0)
          + 0.2 * abs(coalesce(sum(va - vp) FILTER (months_postgx BETWEEN 6 AND 11), 0)) / nullif(6 * max(avg_vol), 0)
          + 0.1 * abs(coalesce(sum(va - vp) FILTER (months_postgx >= 12), 0)) / nullif(12 * max(avg_vol), 0) AS pe
        FROM {pairs} GROUP BY 1, 2, 3 HAVING min(months_postgx) = 0""",
    "pe2": """SELECT country, brand_name, bucket,
          0.2 * sum(abs(va - vp)) / nullif(18 * max(avg_vol), 0)
          + 0.5 * abs(coalesce(sum(va - vp) FILTER (months_postgx BETWEEN 6 AND 11), 0)) / nullif(6 * max(avg_vol), 0)
          + 0.3 * abs(coalesce(sum(va - vp) FILTER (months_postgx >= 12), 0)) / nullif(12 * max(avg_vol), 0) AS pe
        FROM {pairs} WHERE months_postgx >= 6 GROUP BY 1, 2, 3 HAVING min(months_postgx) = 6""",
}


def metric_sql(pe: str, by: str = "") -> str:
    """Official metric over a table of series errors, with the rule for an empty bucket."""
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}round(CASE
          WHEN n1 > 0 AND n2 > 0 THEN 2.0 / n1 * coalesce(s1, 0) + 1.0 / n2 * coalesce(s2, 0)
          WHEN n1 > 0 THEN 2 * m1 WHEN n2 > 0 THEN m2 END, 4) AS metric
        FROM (SELECT {lead}count(*) FILTER (bucket = 1) AS n1, count(*) FILTER (bucket = 2) AS n2,
          sum(pe) FILTER (bucket = 1) AS s1, sum(pe) FILTER (bucket = 2) AS s2,
          avg(pe) FILTER (bucket = 1) AS m1, avg(pe) FILTER (bucket = 2) AS m2 FROM {pe} {group})"""
