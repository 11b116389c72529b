"""Session builder and table access shared by every job."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold at any size; partition counts stay with the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "netdrift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; keyword arguments use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder's name under spark.checkpoint.dir, which driver and executors share. A local session without that
    setting has a temporary one; on a cluster there must be one, as executors do not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[[^]]*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(found or _local_folder()).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="netdrift-")


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Have Hadoop's file system remove ``path`` when the driver ends, in whatever way."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(where)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a job has written all of ``path``, by the marker that Spark leaves last."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(marker)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back, for results that several jobs read; the folder goes with the session."""
    path = shared_folder(df.sparkSession, label)
    try:
        df.write.parquet(path)
    finally:  # what a broken job has written, too
        remove_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
