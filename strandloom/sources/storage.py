"""Tables written to storage that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_leaving: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; on a local master without it, a folder of our own."""
    conf = spark.sparkContext.getConf()
    if folder := conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    master = conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file:" + tempfile.mkdtemp(prefix="spark-"))


def new_path(spark: SparkSession, label: str) -> str:
    """A path not used before, in a folder of the application that goes when it ends."""
    folder = f"{shared_folder(spark)}/strandloom-{spark.sparkContext.applicationId}"
    if folder not in _leaving:
        _leaving.add(folder)
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(place)
        files.deleteOnExit(place)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet and read again: what follows starts from there."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
