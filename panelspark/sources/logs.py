"""Metric log, submission files and submission log: append-only tables."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.metrics import auxiliary_file, submission_statistics
from panelspark.sources import schemas as S
from panelspark.sources.files import as_schema, empty, read_parquet_or_none

EXTRA = "MAP<STRING, STRING>"


def metric_records(spark: SparkSession, records: Iterable[dict] | DataFrame) -> DataFrame:
    """Records in the fixed column order; ``extra`` as JSON text, missing columns null."""
    schema = as_schema(S.METRIC_LOG)
    if isinstance(records, DataFrame):
        df = records
        if "extra" in df.columns and dict(df.dtypes)["extra"] != "string":
            df = df.withColumn("extra", F.to_json("extra"))
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                           for f in schema.fields])
    rows = []
    for rec in records:
        rec = dict(rec)
        if rec.get("extra") is not None:
            rec["extra"] = json.dumps(rec["extra"])
        rows.append(tuple(float(rec[f.name]) if f.name == "value" and rec.get("value") is not None else rec.get(f.name)
                          for f in schema.fields))
    return spark.createDataFrame(rows, schema)


def save_metric_records(df: DataFrame, path: str, append: bool = True) -> None:
    """Parquet by run, so a read of one run prunes to its folder."""
    metric_records(df.sparkSession, df).write.mode("append" if append else "overwrite").partitionBy("run_id").parquet(path)


def load_metric_records(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """The log with ``extra`` parsed to a map; an empty typed table if nothing lies at the path."""
    df = source if isinstance(source, DataFrame) else read_parquet_or_none(spark, source)
    if df is None:
        df = empty(spark, S.METRIC_LOG)
    known = metric_records(spark, df)
    return known.withColumn("extra", F.from_json("extra", EXTRA))


def metrics_for_run(log: DataFrame, run_id: str, **equal) -> DataFrame:
    """Rows of one run; phase, metric, scenario, split, bucket and model may narrow it."""
    rows = log.where(F.col("run_id") == run_id)
    for column, value in equal.items():
        if column not in ("phase", "metric", "scenario", "split", "bucket", "model"):
            raise ValueError(f"cannot narrow by {column!r}")
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def submission_log_row(submission: DataFrame, version: str, model_info: dict | None = None,
                       validation_score: float | None = None, notes: str | None = None) -> DataFrame:
    """One row of counts and moments for the submission log."""
    stats = submission_statistics(submission)
    return stats.select(
        F.lit(version).alias("version"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.col("total_rows").alias("n_rows"), F.col("total_series").alias("n_series"), "volume_mean", "volume_std",
        "volume_min", "volume_max", F.lit(validation_score).cast("double").alias("validation_score"),
        F.lit(json.dumps(model_info or {})).alias("model_info"), F.lit(notes or "").alias("notes"))


def save_submission(submission: DataFrame, output_dir: str, version: str, panel: DataFrame | None = None,
                    model_info: dict | None = None, validation_score: float | None = None) -> DataFrame:
    """Write submission, auxiliary table and log row under the version; returns the log row as read back."""
    folder = f"{output_dir}/version={version}"
    columns = [f.name for f in as_schema(S.PREDICTIONS).fields]
    submission.select(*columns).write.mode("overwrite").csv(f"{folder}/submission", header=True)
    if panel is not None:
        auxiliary_file(submission, panel).write.mode("overwrite").csv(f"{folder}/auxiliary", header=True)
    row = submission_log_row(submission, version, model_info, validation_score)
    row.write.mode("append").parquet(f"{output_dir}/submission_log")
    log = submission.sparkSession.read.parquet(f"{output_dir}/submission_log")
    return log.where(F.col("version") == version)
