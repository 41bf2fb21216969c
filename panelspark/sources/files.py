"""Reading CSV and parquet tables."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_schema(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], as_schema(schema))


def read_parquet_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None where nothing lies at the path."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType,
             rename: Mapping[str, str] | None = None) -> DataFrame | None:
    """A CSV file by its header names, cast to the schema; columns it lacks are left out, None if absent.

    Values are read as text first because the header decides which columns
    exist and in which order.
    """
    try:
        raw = spark.read.csv(path, header=True, inferSchema=False)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    raw = raw.withColumnsRenamed(dict(rename or {}))
    fields = [f for f in as_schema(schema).fields if f.name in raw.columns]
    return raw.select(*[F.expr(f"try_cast(trim(`{f.name}`) AS {f.dataType.simpleString()})").alias(f.name)
                        for f in fields])


def read_table(spark: SparkSession, path: str, schema: str | T.StructType,
               rename: Mapping[str, str] | None = None) -> DataFrame | None:
    """CSV where the path says so, else parquet; None if absent."""
    if path.endswith(".csv"):
        return read_csv(spark, path, schema, rename)
    df = read_parquet_or_none(spark, path)
    return None if df is None else df.withColumnsRenamed(dict(rename or {}))


def lazy_load(spark: SparkSession, path: str, schema: str | T.StructType, use_cache: bool = True) -> DataFrame:
    """Read a CSV once; later reads take the parquet copy next to it."""
    shadow = path.removesuffix(".csv") + ".parquet"
    if use_cache:
        copy = read_parquet_or_none(spark, shadow)
        if copy is not None:
            return copy
    df = read_csv(spark, path, schema)
    if df is None:
        raise FileNotFoundError(path)
    if use_cache:
        df.write.mode("overwrite").parquet(shadow)
        return spark.read.parquet(shadow)
    return df


def fingerprint(spark: SparkSession, paths) -> str:
    """What the files below the paths are: a hash over the name, size and time of each, in any order; no file is opened.

    A path without files counts as empty. One row comes to the driver.
    """
    found = []
    for path in sorted(paths):
        try:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found.append("none")
            continue
        name = F.xxhash64("path", "length", "modificationTime")
        row = files.where(~F.element_at(F.split("path", "/"), -1).rlike("^[_.]")).agg(
            F.count("*").alias("n"), F.sum("length").alias("size"), F.bit_xor(name).alias("x"), F.sum(F.pmod(name, F.lit(1 << 40))).alias("s")).first()
        found.append("|".join(str(v) for v in row))
    return hashlib.md5("\n".join(found).encode()).hexdigest()[:16]
