"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

_OURS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Our part of spark.checkpoint.dir. Where that is unset: a local folder if all of Spark is one process, else the
    warehouse; raises if that lies in a machine's own file system.

    It is deleted when the driver's process ends."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        alone = spark.sparkContext.master.split("[")[0] == "local"
        folder = f"file:///tmp/checkpoints/{os.getuid()}" if alone else f"{_warehouse(spark)}/_checkpoints"
    path = f"{folder.rstrip('/')}/gradewalk-{spark.sparkContext.applicationId}"
    if path not in _OURS:
        _OURS.add(path)
        atexit.register(_delete, spark._jvm, spark._jsc.hadoopConfiguration(), path)
    return path


def _warehouse(spark: SparkSession) -> str:
    """The warehouse, if executors on other machines see it."""
    folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    store = spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getScheme() or spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    if store.split(":")[0] == "file":
        raise ValueError(f"set spark.checkpoint.dir: the warehouse {folder} may be a folder of one machine")
    return folder


def _delete(jvm, conf, path: str) -> None:
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # the JVM is gone: the folder stays
        pass


def save(df: DataFrame, label: str = "table") -> DataFrame:
    """df written once and read back; a lost executor then costs no recomputation.

    A plain table instead of checkpoint(), which computes its input twice."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
