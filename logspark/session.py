"""Session defaults and the shared folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "logspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; cluster managers pass ``master`` themselves."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def workspace(spark: SparkSession) -> str:
    """Folder for materialised tables: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a cluster such a folder
    would live on one machine and vanish with it, so there the setting is required.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if root:
        return root.rstrip("/")
    root = sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="logspark-"))
    return sc.getCheckpointDir().rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result survives lost executors and carries the true file size, so Catalyst broadcasts it in
    later joins only when it is below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise.
    """
    spark = df.sparkSession
    path = f"{workspace(spark)}/logspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """From now on Python in tasks gets batches of at most so many rows, and of about so many bytes.

    A batch is held several times outside the JVM's heap: as vectors, as the bytes sent, and in the Python worker.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def small_table(df: DataFrame, name: str = "small") -> DataFrame:
    """A table with one row per label, source, model or the like, written before it is joined to data.

    Joins on such columns are the most uneven ones there are. With its true size known before the plan
    is made, the table is broadcast and the large side keeps its place; were it large after all,
    Catalyst would shuffle and AQE would split the uneven partitions.
    """
    return materialise(df.coalesce(1), name)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores when the scan has fewer splits than half of them.

    For row-local work that costs more than moving the row; a scan with enough splits stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if not df.isStreaming and df.rdd.getNumPartitions() * 2 <= cores else df
