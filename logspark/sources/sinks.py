"""Sinks: canonical Parquet, result files, alert outbox."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_canonical(df: DataFrame, path: str, order: list[str], partition_by: list[str] = ()) -> None:
    """Parquet, range-partitioned and sorted by time, so readers can prune by time statistics."""
    out = df.repartitionByRange(*order).sortWithinPartitions(*partition_by, *order)
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Result files as ``csv`` (with header), ``json`` (one document per line) or ``parquet``."""
    writer = df.write.mode("overwrite").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def alert_documents(alerts: DataFrame) -> DataFrame:
    """One JSON document per alert, keyed by ``alert_id``."""
    return alerts.select("alert_id", F.to_json(F.struct(*alerts.columns)).alias("document"))


def outbox_writer(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink of alert documents.

    Each micro-batch owns a folder named by its id and overwrites it when replayed, and alert ids are
    derived from the alert, so a retried batch leaves no second copy.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        alert_documents(batch).write.mode("overwrite").json(f"{path}/batch={batch_id}")

    return write


def read_outbox(spark, path: str) -> DataFrame:
    """Documents of an outbox; an outbox nobody wrote to yet is empty."""
    schema, folder = "alert_id string, document string", spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*")
    written = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder)
    return spark.read.schema(schema).json(f"{path}/batch=*") if written else spark.createDataFrame([], schema)
