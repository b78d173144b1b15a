"""Structured Streaming into versioned datasets: each micro-batch is one append, and is applied once.

A batch is known by its stream and number. The stream's id is the one that Spark keeps in its checkpoint, so several
streams may write one table, and a stream that begins anew with another checkpoint is another stream.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.sources.dataset import Dataset, Files


def _batch(spark: SparkSession, path: str, table: str, checkpoint: str, apply: Callable[[Dataset, DataFrame], None]) -> Callable[[DataFrame, int], None]:
    def run(rows: DataFrame, batch: int) -> None:
        stream = json.loads(Files(spark, checkpoint).read("metadata"))["id"]
        dataset = Dataset(spark, path)
        metadata = dataset.manifest["metadata"]
        if batch <= metadata.get(f"stream:{table}:{stream}", -1) or rows.isEmpty():  # a batch that is run again after a failure
            return
        metadata[f"stream:{table}:{stream}"] = metadata[f"stream:{table}"] = batch  # the latter: the last batch of any stream
        apply(dataset, rows)

    return run


def _start(rows: DataFrame, path: str, table: str, checkpoint: str, trigger: dict | None, apply: Callable[[Dataset, DataFrame], None]):
    writer = rows.writeStream.foreachBatch(_batch(rows.sparkSession, path, table, checkpoint, apply)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def append_stream(rows: DataFrame, path: str, table: str, checkpoint: str, trigger: dict | None = None):
    """A stream's rows as appends; the batch number goes into the same manifest as the rows."""
    return _start(rows, path, table, checkpoint, trigger, lambda d, df: d.append(table, insert=df))


def upsert_stream(rows: DataFrame, path: str, table: str, keys: list[str], checkpoint: str, trigger: dict | None = None):
    """A stream's rows as upserts; the last row of a key in a batch wins."""
    return _start(rows, path, table, checkpoint, trigger, lambda d, df: d.append(table, upsert=df, key_columns=keys))


def read_files(spark: SparkSession, path: str, schema, kind: str = "parquet", per_trigger: int = 1000) -> DataFrame:
    """Files that arrive in a folder, a bounded number a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(path)


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts of a key for each window of event time; state is dropped once the watermark has passed."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))  # watermarks need an instant
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).count()


def poll(dataset: Dataset) -> Dataset | None:
    """The newer version, if there is one."""
    return dataset.refresh() if dataset.changed() else None
