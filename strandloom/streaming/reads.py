"""Fork detection and read summaries on a stream of read files.

A read arrives whole, in one file, so every micro-batch is analysed by the batch operators and its results are appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from strandloom.plans.forks import LETTERS, Settings, detect_forks


def read_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 100) -> DataFrame:
    """Rows of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_forks(
    signal: DataFrame, out: str, checkpoint: str, key: str, idx: str, x: str, y: str, settings: Settings = LETTERS, once: bool = True
) -> StreamingQuery:
    """Appends the tracts and events of each batch of reads to Parquet files in a folder of the batch; a batch that is run again replaces its own.

    once: work off what is there and stop, else go on as files arrive.
    """

    def batch(df: DataFrame, number: int) -> None:
        detect_forks(df, key, idx, x, y, settings).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = signal.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def filter_short(stream: DataFrame, seq: str, n: int) -> DataFrame:
    """Stateless filters of reads work on a stream as they are."""
    return stream.filter(F.length(seq) >= n)
