"""Structured Streaming: the events as a stream, and upserts of chunks by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.retrieval import store_points
from ledgerlens.runtime import filesystem, fresh_path

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events file as a stream; its time has no zone and is taken as UTC, since only instants carry a watermark."""
    source = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(d)
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def table_stream(spark: SparkSession, d: str, table: str, schema) -> DataFrame:
    """A table as a stream, be it one file or a folder of part files: a filter of names sees the parts, not their folder."""
    path, source = f"{d}/{table}.parquet", spark.readStream.schema(schema)
    at, fs = filesystem(spark, path)
    if fs.getFileStatus(at).isDirectory():
        return source.parquet(path)
    return source.option("pathGlobFilter", f"{table}.parquet").parquet(d)


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run the stream over what is there into a table in the shared folder, and read it."""
    spark = stream.sparkSession
    out, state = fresh_path(spark, name), fresh_path(spark, f"{name}-state")
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def tumbling(events: DataFrame, length: str = "1 hour") -> DataFrame:
    """(event_type, start, n, total): the same on a batch and on a stream with a watermark."""
    w = events.groupBy("event_type", F.window("ts", length).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "n", "total")


def sliding(events: DataFrame, length: str = "1 hour", step: str = "15 minutes") -> DataFrame:
    """(event_type, start, n) of windows that overlap."""
    w = events.groupBy("event_type", F.window("ts", length, step).alias("w")).agg(F.count("*").alias("n"))
    return w.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, events): runs of a user's events with no longer gap between them. Events without user or time belong to none."""
    s = events.filter(F.col("ts").isNotNull() & F.col("user_id").isNotNull()).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return s.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events")


def streamed(kind, spark: SparkSession, d: str, late: str = "10 minutes") -> DataFrame:
    """One of the windows above over the stream. Closed ones only: those the watermark has not passed stay open and are not written."""
    return run_once(kind(event_stream(spark, d).withWatermark("ts", late)), kind.__name__)


def streamed_tumbling(spark: SparkSession, d: str, late: str = "10 minutes") -> DataFrame:
    return streamed(tumbling, spark, d, late)


def ingest_events(spark: SparkSession, d: str) -> DataFrame:
    return run_once(event_stream(spark, d).select("event_id", "ts", "user_id", "event_type", "value"), "ingested")


def distinct_events(spark: SparkSession, d: str, late: str = "1 hour") -> DataFrame:
    """One row per event_id within the watermark; later copies are dropped with their state."""
    return run_once(event_stream(spark, d).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type"), "distinct")


def upsert_stream(points: DataFrame, path: str, checkpoint: str, document: str = "source_document"):
    """Keep the collection at path up to date: each micro-batch replaces the documents it brings; a repeated batch changes nothing.

    ``points`` streams rows of operators.retrieval.points, all chunks of a document version in one batch (a version is one
    file, and a file is never split over batches). Chunks of an earlier, longer version are gone. Without the
    column ``document``, points are replaced one by one; one row of a chunk_id in a batch wins.
    """

    def write(batch: DataFrame, _: int) -> None:
        store_points(batch.dropDuplicates(["chunk_id"]), path, document)

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_per_batch(stream: DataFrame, key: str, name: str) -> DataFrame:
    """Run a stream of updates over what is there; of each key the row of its last micro-batch."""
    spark = stream.sparkSession
    out, state = fresh_path(spark, name), fresh_path(spark, f"{name}-state")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/n={number}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out).select(key, "batch", *[c for c in stream.columns if c != key])
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in stream.columns if c != key]), "batch").alias("x"))
    return last.select(key, "x.*")


def running_accuracy(results: DataFrame) -> DataFrame:
    """(category, total, passed, accuracy) so far, one row per category and micro-batch that brings results of it.

    ``results`` streams category and passed. The state of a category is two counts, however many results there were.
    """
    from collections.abc import Iterator

    import pandas as pd

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        total, passed = state.get if state.exists else (0, 0)
        for pdf in batches:
            total, passed = total + len(pdf), passed + int(pdf["passed"].fillna(False).sum())
        state.update((total, passed))
        yield pd.DataFrame({"category": [key[0]], "total": [total], "passed": [passed], "accuracy": [100.0 * passed / total if total else 0.0]})

    shape = "category string, total bigint, passed bigint, accuracy double"
    return results.groupBy("category").applyInPandasWithState(update, shape, "total bigint, passed bigint", "update", "NoTimeout")
