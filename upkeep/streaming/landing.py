"""File-arrival ingest with Structured Streaming.

The batch upload path (``upkeep.sources.ingest``) handles a set of files at
once.  When exports of one layout keep arriving in a landing folder, this
runs the same header mapping and cleaners on every micro-batch:

    readStream.csv(landing) -> foreachBatch(clean_export -> partition write)

Each micro-batch becomes its own ``upload_batch`` partition
(``<stream>-<epoch>``) written with dynamic partition overwrite, so a replayed
epoch after a failure rewrites its partition instead of duplicating rows.
Progress lives in the checkpoint folder, which must be on shared storage.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from upkeep.sources.exports import TABLE_OF, detect_kind
from upkeep.sources.ingest import Export, clean_export


def landing_schema(headers: list[str]) -> T.StructType:
    return T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(headers))])


def ingest_batch(df: DataFrame, epoch_id: int, headers: tuple[str, ...], kind: str, target: str,
                 stream: str, uploaded_at: dt.datetime | None = None) -> None:
    batch = f"{stream}-{epoch_id}"
    typed = clean_export(Export(f"epoch-{epoch_id}", df, headers), batch, uploaded_at, kind, batch)
    (typed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("upload_batch").parquet(target))


def start_landing_ingest(spark: SparkSession, landing_dir: str, headers: list[str], target_root: str,
                         checkpoint: str, stream: str, available_now: bool = True,
                         max_files_per_trigger: int | None = None, sep: str = ",",
                         multi_line: bool = True) -> StreamingQuery:
    """Start a streaming ingest of CSV exports with the given header layout.

    ``stream`` names this stream in its batches, so that streams into one table
    never share a partition; ``checkpoint`` is its own progress folder on
    shared storage and must be the same at every restart: with another one
    the epochs would begin again and overwrite the first batches.
    """
    if not checkpoint or not stream:
        raise ValueError("a landing ingest needs its checkpoint folder and stream name")
    kind = detect_kind(headers)
    if kind == "unknown":
        raise ValueError("header row matches no export kind")
    headers = tuple(headers)
    target = f"{target_root.rstrip('/')}/{TABLE_OF[kind]}"
    reader = (spark.readStream.schema(landing_schema(list(headers))).option("header", True)
              .option("sep", sep).option("multiLine", multi_line))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    arriving = reader.csv(landing_dir)
    writer = (arriving.writeStream
              .foreachBatch(lambda df, epoch: ingest_batch(df, epoch, headers, kind, target, stream))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
