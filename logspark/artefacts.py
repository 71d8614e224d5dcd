"""Fitted tables kept in a folder: saved once, loaded by later sessions and streams.

Each version has a folder of Parquet tables of its own. A row in the manifest names the version, its parameters and
its tables with their schemas; it is appended after all tables are written, so a version is either whole or not
there, and readers of an older version are never disturbed. The newest row counts unless a version is asked for.
"""

from __future__ import annotations

import json
import time
import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "version string, created bigint, params string, tables map<string, string>"


class Artefacts(NamedTuple):
    """A loaded version; a table that was not saved is not in ``tables``."""

    version: str
    params: dict
    tables: dict[str, DataFrame]


def save(spark: SparkSession, folder: str, tables: dict[str, DataFrame], params: dict) -> str:
    """Write the tables of a new version, then its manifest row; returns the version."""
    version = uuid.uuid4().hex
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{version}/{name}")
    schemas = {name: table.schema.json() for name, table in tables.items()}
    row = (version, time.time_ns() // 1000, json.dumps(params, sort_keys=True), schemas)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return version


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest rows, newest last; empty where nothing was saved."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").orderBy("created", "version")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def load(spark: SparkSession, folder: str, version: str | None = None) -> Artefacts:
    """The newest version, or the one asked for; without any, one with no tables and no parameters."""
    found = versions(spark, folder)
    found = found.where(F.col("version") == version) if version else found
    row = found.orderBy(F.desc("created"), F.desc("version")).first()
    if row is None:
        if version:
            raise ValueError(f"no version {version} in {folder}")
        return Artefacts("", {}, {})
    tables = {
        name: spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(f"{folder}/{row['version']}/{name}")
        for name, schema in row["tables"].items()
    }
    return Artefacts(row["version"], json.loads(row["params"]), tables)
