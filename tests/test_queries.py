import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = ["d03_compute_pre_entry_stats", "e03_seasonal_features", "e13_collaboration_features", "f01_validation_split",
          "g07_compute_bucket_metrics", "g24_resilience", "k07_apply_calibration", "l05_join_promo_policy",
          "m01_aggregated_visibility", "n07_monte_carlo", "o03_adjacency", "p02_sequences_for_inference"]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() == 3 and set(df.columns) == {"scope", "metric", "n_series"}


def test_every_text_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    res = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in res.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, res.fetchall())
