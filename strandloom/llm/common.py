"""Helpers shared by the text operators: tables, shared storage and small column expressions."""

from __future__ import annotations

import string
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of the class [\x20\x09-\x0D], which separates words.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_own_folders: dict[str, str] = {}
_leaving: set[str] = set()


def ship(*modules: str) -> None:
    """Sends functions of these modules to executors by value, so that the package need not be installed there."""
    for name in modules:
        cloudpickle.register_pickle_by_value(sys.modules[name])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master one of our own."""
    conf = spark.sparkContext.getConf()
    if folder := conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    master = conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = "file:" + tempfile.mkdtemp(prefix="spark-")
    return _own_folders[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage and survives lost executors. It goes when the application ends."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/strandloom-text-{spark.sparkContext.applicationId}"
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if folder not in _leaving:
        _leaving.add(folder)
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; pure ASCII strings take Spark's faster lower()."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    )


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Joins on keys with null equal to null; right's keys are dropped."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = one if cond is None else cond & one
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 16, size: int = 1 << 26) -> Iterator[pa.Table]:
    """Tables of whole groups of batches sorted by keys, which are numbers: about so many rows or bytes, or one group if that is more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in keys])
        begins = np.nonzero((key[:, 1:] != key[:, :-1]).any(axis=0))[0] + 1
        full = held and (sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= size)
        if full and [held[-1].column(k)[-1].as_py() for k in keys] != key[:, 0].tolist():
            yield pa.Table.from_batches(held)
            held, full = [], False
        if full and len(begins):
            yield pa.Table.from_batches([*held, batch.slice(0, int(begins[0]))])
            held, batch = [], batch.slice(int(begins[0]))
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def group_starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each group of rows of equal keys begins, which are numbers."""
    key = np.stack([rows.column(k).to_numpy() for k in keys])
    return np.nonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))[0]
