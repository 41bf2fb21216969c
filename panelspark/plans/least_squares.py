"""DuckDB texts of least squares with one or two regressors, and of the scores of what it predicts.

An unpenalised linear model solves the normal equations, so queries that fit one
can be checked value by value.
"""

from __future__ import annotations

from panelspark.plans.shared_sql import metric_sql

KEY = "country, brand_name"


def solved(name: str, rows: str, y: str = "y_norm", m: str | None = "m", g: str | None = "g", w: str = "1.0") -> dict[str, str]:
    """CTEs that end in ``name``: one row with am, ag, ay (weighted means) and the slopes bm, bg of a fit on the table ``rows``.

    A regressor of None is left out; its slope is 0.
    """
    m, g = m or "0.0", g or "0.0"
    mean = f"SELECT sum(({w}) * ({m})) / sum({w}) AS am, sum(({w}) * ({g})) / sum({w}) AS ag, sum(({w}) * ({y})) / sum({w}) AS ay FROM {{{rows}}}"
    moment = ", ".join(f"sum(({w}) * (({a}) - a{i}) * (({b}) - a{j})) AS {i}{j}" for (a, i), (b, j) in
                       (((m, "m"), (m, "m")), ((g, "g"), (g, "g")), ((m, "m"), (g, "g")), ((m, "m"), (y, "y")), ((g, "g"), (y, "y"))))
    if m == "0.0":
        slopes = "0.0 AS bm, gy / gg AS bg"
    elif g == "0.0":
        slopes = "my / mm AS bm, 0.0 AS bg"
    else:
        slopes = "(my * gg - gy * mg) / (mm * gg - mg * mg) AS bm, (gy * mm - my * mg) / (mm * gg - mg * mg) AS bg"
    return {f"{name}_a": mean, f"{name}_c": f"SELECT {moment} FROM {{{rows}}}, {{{name}_a}}",
            name: f"SELECT am, ag, ay, {slopes} FROM {{{name}_a}}, {{{name}_c}}"}


def value(m: str = "m", g: str = "g") -> str:
    """The fitted value over the columns of ``solved``."""
    return f"(ay + bm * (({m}) - am) + bg * (({g}) - ag))"


def clipped(expr: str) -> str:
    return f"greatest(0, least(2, {expr}))"


def scored(name: str, rows: str, fit: str, prediction: str | None = None, keep: str = "") -> dict[str, str]:
    """A CTE with the rows of a table and their prediction p."""
    more = f"{keep}, " if keep else ""
    return {name: f"SELECT {more}t.*, {clipped(prediction or value())} AS p FROM {{{rows}}} t, {{{fit}}}"}


def scores(name: str, rows: str, by: str) -> dict[str, str]:
    """A CTE ``name`` with rmse, mae, r2, n_rows and the official metric of scenario 1 per value of ``by``."""
    gap = "volume - p * avg_vol_12m"
    pe = f"""SELECT {by}, {KEY}, bucket, 0.2 * sum(abs({gap})) / nullif(24 * max(avg_vol_12m), 0)
          + 0.5 * abs(coalesce(sum({gap}) FILTER (months_postgx <= 5), 0)) / nullif(6 * max(avg_vol_12m), 0)
          + 0.2 * abs(coalesce(sum({gap}) FILTER (months_postgx BETWEEN 6 AND 11), 0)) / nullif(6 * max(avg_vol_12m), 0)
          + 0.1 * abs(coalesce(sum({gap}) FILTER (months_postgx >= 12), 0)) / nullif(12 * max(avg_vol_12m), 0) AS pe
        FROM {{{rows}}} GROUP BY 1, 2, 3, 4 HAVING min(months_postgx) = 0"""
    return {f"{name}_pe": pe, f"{name}_o": metric_sql(f"{{{name}_pe}}", by),
            name: f"""SELECT x.*, o.metric AS official_metric FROM (
                SELECT {by}, sqrt(avg((p - y_norm) * (p - y_norm))) AS rmse, avg(abs(p - y_norm)) AS mae,
                  1 - sum((p - y_norm) * (p - y_norm)) / (var_pop(y_norm) * count(y_norm)) AS r2, count(*) AS n_rows FROM {{{rows}}} GROUP BY 1) x
                JOIN {{{name}_o}} o USING ({by})"""}


def split(name: str, rows: str, fraction: float = 0.2) -> dict[str, str]:
    """CTEs that end in ``name``: the rows of a table with ``val`` (true for the validation series), stratified by bucket."""
    return {f"{name}_s": f"SELECT {KEY}, coalesce(CAST(min(bucket) AS STRING), 'nan') AS st FROM {{{rows}}} GROUP BY 1, 2",
            f"{name}_n": f"""SELECT st, CASE WHEN count(*) < greatest(3, floor((SELECT count(*) FROM {{{name}_s}}) * {fraction} * 0.5)) THEN 'OTHER' ELSE st END AS nm
                FROM {{{name}_s}} GROUP BY 1""",
            f"{name}_t": f"""SELECT s.*, nm, row_number() OVER (PARTITION BY nm ORDER BY md5(concat_ws('|', '42', {KEY})), {KEY}) AS k, count(*) OVER (PARTITION BY nm) AS c
                FROM {{{name}_s}} s JOIN {{{name}_n}} n USING (st)""",
            name: f"SELECT t.*, k <= round(c * {fraction}) AS val FROM {{{rows}}} t JOIN {{{name}_t}} USING ({KEY})"}


def folds(name: str, rows: str, n: int) -> dict[str, str]:
    """CTEs that end in ``name``: the rows of a table with their fold, drawn by series and stratified by bucket."""
    return {f"{name}_s": f"SELECT {KEY}, min(bucket) AS b FROM {{{rows}}} GROUP BY 1, 2",
            f"{name}_f": f"""SELECT {KEY}, CAST((row_number() OVER (PARTITION BY b ORDER BY md5(concat_ws('|', '42', {KEY})), {KEY}) - 1) % {n} AS INT) AS fold
                FROM {{{name}_s}}""",
            name: f"SELECT t.*, fold FROM {{{rows}}} t JOIN {{{name}_f}} USING ({KEY})"}


def out_of_fold(name: str, rows: str, n: int, m: str | None = "m", g: str | None = "g", intercept: bool = True) -> dict[str, str]:
    """CTEs that end in ``name``: every row of a folded table predicted by a fit on the other folds."""
    out: dict[str, str] = {}
    parts = []
    for k in range(n):
        out[f"{name}_r{k}"] = f"SELECT * FROM {{{rows}}} WHERE fold <> {k}"
        out |= solved(f"{name}_k{k}", f"{name}_r{k}", m=m, g=g)
        predicted = value(m or "0.0", g or "0.0") if intercept else value(m or "0.0", g or "0.0").replace("(ay + ", "(")
        parts.append(f"SELECT t.*, {clipped(predicted)} AS p FROM {{{rows}}} t, {{{name}_k{k}}} WHERE fold = {k}")
    out[name] = " UNION ALL ".join(parts)
    return out
