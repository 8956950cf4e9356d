"""An extension: a plan's source may be a stream of files. Projections, filters, unions and aggregates are the same there."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from millrace.plans.plan import Plan
from millrace.sources.tables import dataframe
from millrace.types import LogicalType


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType, logical: Mapping[str, LogicalType] | None = None, watermark: tuple[str, str] | None = None, files_per_batch: int | None = None) -> Plan:
    """Parquet files as they come into a folder. watermark: a time column, and how late rows may be; it bounds the state of groups by time."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    frame = reader.parquet(path)
    return dataframe(frame.withWatermark(*watermark) if watermark else frame, logical)


def run_once(plan: Plan, out: str, checkpoint: str, mode: str = "append") -> None:
    """Handles all files that there are, and stops. A run that starts again with the same checkpoint goes on where that one ended.

    mode "complete" rewrites the whole result in each batch and is for results that stay small; "append" adds rows that are final.
    """
    if mode == "append":
        writer = plan.dataframe().writeStream.outputMode("append").format("parquet").option("path", out)
    else:
        writer = plan.dataframe().writeStream.outputMode(mode).foreachBatch(lambda frame, _: frame.write.mode("overwrite").parquet(out))
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
