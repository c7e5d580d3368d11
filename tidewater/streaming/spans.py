"""Spans as a stream: tumbling windows of service pairs, written through the same upsert as batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.operators import traces
from tidewater.sources import lens, store



def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of event files as spans."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return lens.as_spans(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "events*.parquet").parquet(folder))


def windowed_pairs(spans: DataFrame, known: list[str], minutes: int = 5, late: str = "1 hour") -> DataFrame:
    """(window_start, from_service, to_service, call_count, error_count, total_ms): one row for each pair and window.

    ``late`` bounds how long a window's row is kept in state.
    """
    timed = spans.withWatermark("ts", late)
    source = traces.service(F.col("span_attrs"), F.col("resource_attrs"), known)
    peer = F.col("span_attrs")["peer.service"]
    rows = timed.where(peer != "").select("ts", source["name"].alias("from_service"), F.trim(peer).alias("to_service"), F.greatest((F.col("end_ns") - F.col("start_ns")) / 1e6, F.lit(0.0)).alias("duration_ms"), (F.col("code") == 2).alias("is_error"))
    grouped = rows.groupBy(F.window("ts", f"{int(minutes)} minutes"), "from_service", "to_service").agg(F.count("*").alias("call_count"), F.count_if("is_error").alias("error_count"), F.sum("duration_ms").alias("total_ms"))
    return grouped.select(F.col("window.start").alias("window_start"), "from_service", "to_service", "call_count", "error_count", F.round("total_ms", 3).alias("total_ms"))


def run_to_table(stream: DataFrame, checkpoint: str, name: str, mode: str = "complete") -> DataFrame:
    """Everything there is now, through the stream into a table in memory; for tests and small results."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def latest_window(target: store.Store, name: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: of each pair, the row of the latest window replaces what the table has; a batch that comes again changes nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        newest = batch.groupBy("from_service", "to_service").agg(F.max("window_start").alias("window_start"))
        tx = target.begin()
        rows = tx.staged(batch.join(newest, ["from_service", "to_service", "window_start"]).withColumn("key", F.concat_ws("->", "from_service", "to_service")))

        def rule(old: DataFrame, new: DataFrame) -> DataFrame:
            later = old.select(F.col("key").alias("k"), F.col("window_start").alias("w"))
            fresh = new.join(later, F.col("key") == F.col("k"), "left").where("w is null or w <= window_start").drop("k", "w")
            return store.replace_columns(old, fresh.select(*old.columns), "key", [c for c in old.columns if c != "key"])

        tx.merge(name, rows, "key", rule)
        tx.commit()

    return write
