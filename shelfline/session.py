"""Session defaults and the shared scratch folder."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "shelfline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are designed for; ``master`` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where it is unset, a folder inside the warehouse.

    Both are shared by the driver and all executors, so a settled table outlives a lost executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shelfline-scratch"
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/shelfline-{label}-{uuid.uuid4().hex[:12]}"


_settled: list[str] = []


def settled_at(path: str) -> None:
    """Notes a folder that was written as a settled table, for ``clear_scratch``."""
    _settled.append(path)


def clear_scratch(spark: SparkSession) -> int:
    """Deletes the tables settled so far in this process; call it when their results have been consumed."""
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), len(_settled)
    while _settled:
        path = jvm.org.apache.hadoop.fs.Path(_settled.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def settle(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of iterative or many-times-read results. The copy survives lost executors.
    """
    path = scratch_path(df.sparkSession, label)
    _settled.append(path)
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
        path = next((p for p in _settled if p.rsplit("/", 1)[1] == folder.rsplit("/", 1)[1]), None)
        if path is None:
            raise ValueError(f"{folder} was not settled in this process")
        _settled.remove(path)
        spark = tables[0].sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
