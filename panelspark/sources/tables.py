"""Raw tables, the stored panel and the stored features."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from panelspark.constants import require
from panelspark.operators import columns as C
from panelspark.operators import features as E
from panelspark.operators import panel as P
from panelspark.sources import schemas as S
from panelspark.sources.files import fingerprint, read_parquet_or_none, read_table


def check_raw(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Require the key columns of the three raw tables."""
    for name, keys in S.RAW_KEYS.items():
        if name not in tables:
            raise ValueError(f"raw table {name} is missing")
        require(tables[name], keys, name)
    return {name: tables[name] for name in S.RAW}


def load_raw_data(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    """Read volume, generics and medicine_info of one split from their CSV or parquet paths."""
    tables = {}
    for name, schema in S.RAW.items():
        df = read_table(spark, paths[name], schema)
        if df is None:
            raise FileNotFoundError(paths[name])
        tables[name] = df
    return check_raw(tables)


def _manifest(spark: SparkSession, path: str) -> dict[str, str]:
    row = read_parquet_or_none(spark, path)
    return {} if row is None else row.first().asDict()


def _stored(spark: SparkSession, path: str, build: Callable[[], DataFrame], version: str, force_rebuild: bool) -> DataFrame:
    """The table below ``path`` for a version of its sources, built and written where it is missing.

    A manifest beside the versions names the one that stands; it is written last,
    so a table that was cut off while it was written is built again. Old versions
    stay for readers that have them open.
    """
    table, manifest = f"{path}/version={version}", f"{path}/_manifest"
    if not force_rebuild and _manifest(spark, f"{manifest}/{version}").get("version") == version:
        stored = read_parquet_or_none(spark, table)
        if stored is not None:
            return stored
    build().write.mode("overwrite").parquet(table)
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").parquet(f"{manifest}/{version}")
    return spark.read.parquet(table)


def get_panel(spark: SparkSession, store: str, split: str, load: Callable[[], Mapping[str, DataFrame]],
              force_rebuild: bool = False, sources=()) -> DataFrame:
    """The stored panel of a split; built from the raw tables and written if absent.

    ``sources`` are the paths of the raw files. Their fingerprint (names, sizes
    and times) is part of the stored version, so a changed file gives a new
    panel without ``force_rebuild``, and an unchanged one is read as it is.
    """
    def build():
        raw = check_raw(load())
        return P.build_panel(raw["volume"], raw["generics"], raw["medicine_info"], is_train=split == "train")

    return _stored(spark, f"{store}/panel/split={split}", build, source_version(spark, sources), force_rebuild)


def source_version(spark: SparkSession, sources=()) -> str:
    return fingerprint(spark, sources) if sources else "unversioned"


def get_features(spark: SparkSession, store: str, split: str, scenario, mode: str,
                 panel: Callable[[], DataFrame], config: dict | None = None, force_rebuild: bool = False, sources=()) -> DataFrame:
    """Stored feature frame of (split, scenario, mode, options); E.split_features_target_meta names its columns.

    ``sources`` as in ``get_panel``: features of changed files are built again.
    """
    options = hashlib.md5(json.dumps(config or {}, sort_keys=True, default=str).encode()).hexdigest()[:12]

    def build():
        built = E.make_features(panel(), scenario, mode, config)
        return C.select_training_rows(built, scenario) if mode == "train" else built

    path = f"{store}/features/split={split}/scenario={scenario}/mode={mode}/options={options}"
    return _stored(spark, path, build, source_version(spark, sources), force_rebuild)
