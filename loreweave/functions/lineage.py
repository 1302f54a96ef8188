"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and Spark runs in this one machine, a folder of our own."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    context = spark.sparkContext
    if context.applicationId not in _own:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.TemporaryDirectory(prefix="loreweave-", ignore_cleanup_errors=True)
        atexit.register(folder.cleanup)
        _own[context.applicationId] = f"file://{folder.name}"
        context.setCheckpointDir(_own[context.applicationId])
    return _own[context.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, computed once; a checkpoint computes it twice."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.loreweave_path = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes written tables that no later plan reads."""
    for df in tables:
        if path := getattr(df, "loreweave_path", None):
            at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
