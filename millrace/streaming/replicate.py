"""Replication: a stream of changes through the same chain into a target."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from millrace.operators.transforms import Transform
from millrace.plans.chain import run_chain
from millrace.schema import TableId
from millrace.sinks.tables import KeyedTable


def file_stream(spark: SparkSession, path: str, schema: StructType, form: str = "parquet", files_a_batch: int = 100, **options: str) -> DataFrame:
    """Files as they arrive, each exactly once by the query's checkpoint."""
    return spark.readStream.format(form).schema(schema).options(maxFilesPerTrigger=files_a_batch, **options).load(path)


def sample_stream(spark: SparkSession, rows_a_second: int = 10) -> DataFrame:
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_a_second).load()
    return rate.select(F.sha1(F.col("value").cast("string")).alias("event_id"), F.col("timestamp").alias("event_utc_ts"), F.concat(F.lit("device-"), (F.col("value") % 100).cast("string")).alias("device_id"))


def replicate(changes: DataFrame, table: TableId, transforms: list[Transform], checkpoint: str, write: Callable[[DataFrame, int], None], errors: Callable[[DataFrame, int], None] | None = None, once: bool = True, every: str = "1 second") -> StreamingQuery:
    """Each micro-batch through the chain and to ``write(rows, batch)``, which may see a batch again and should take it once."""

    def batch(df: DataFrame, number: int) -> None:
        result = run_chain(df, table, transforms)
        write(result.rows, number)
        frame = result.errors_frame()
        if errors and frame is not None:
            errors(frame, number)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def upsert_stream(changes: DataFrame, table: TableId, transforms: list[Transform], target: KeyedTable, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Changes applied to a keyed table; the batch's number keeps a repeated batch from being applied twice."""
    return replicate(changes, table, transforms, checkpoint, lambda df, n: target.upsert(df, f"{checkpoint}#{n}"), once=once)


def windowed_counts(events: DataFrame, time: str, width: str, slide: str | None = None, late: str = "10 minutes", by: list[str] | None = None, value: Column | None = None) -> DataFrame:
    """Event-time windows with a watermark; tumbling without a slide.  Batch frames are taken as well."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    total = [F.sum(value).alias("total")] if value is not None else []
    out = rows.groupBy(F.window(time, width, slide or width), *(by or [])).agg(F.count("*").alias("events"), *total)
    return out.select(F.col("window.start").alias("window_start"), *(by or []), "events", *(["total"] if total else []))


def sessions(events: DataFrame, time: str, gap: str, user: str, late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(time, gap), user).agg(F.count("*").alias("events"))
    return out.select(user, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "events")
