from pyspark.sql import functions as F

from ledgerlens.operators.retrieval import open_collection
from ledgerlens.runtime import read
from ledgerlens.streaming import streams as S


def test_closed_windows_equal_the_batch(spark, data):
    batch = {(r.event_type, r.start): (r.n, r.total) for r in S.tumbling(read(spark, data, "events").withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    streamed = {(r.event_type, r.start): (r.n, r.total) for r in S.streamed_tumbling(spark, data).collect()}
    assert streamed and all(batch[k] == v for k, v in streamed.items())
    last = max(s for _, s in batch)
    assert {k for k in batch if k not in streamed} and all(s >= last[:10] for _, s in batch.keys() - streamed.keys())  # only the open ones are missing


def test_every_event_arrives_once(spark, data):
    n = read(spark, data, "events").count()
    assert S.ingest_events(spark, data).count() == n
    assert S.distinct_events(spark, data).select("event_id").distinct().count() == n


def test_upsert_by_micro_batch(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "chunk_id string, n int"
    spark.createDataFrame([("a", 1), ("b", 1)], schema).write.parquet(source)
    run = lambda: S.upsert_stream(spark.readStream.schema(schema).parquet(source), out, state).awaitTermination()
    run()
    spark.createDataFrame([("b", 2), ("c", 2)], schema).write.mode("append").parquet(source)
    run()
    run()
    assert sorted(tuple(r) for r in open_collection(spark, out).collect()) == [("a", 1), ("b", 2), ("c", 2)]


def test_running_accuracy_keeps_its_state(spark, tmp_path):
    source, state, seen = str(tmp_path / "in"), str(tmp_path / "state"), {}
    schema = "category string, passed boolean"

    def keep(batch, _):
        seen.update({r.category: (r.total, r.passed, r.accuracy) for r in batch.collect()})

    def run():
        S.running_accuracy(spark.readStream.schema(schema).parquet(source)).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    spark.createDataFrame([("a", True), ("a", False), ("b", None)], schema).write.parquet(source)
    run()
    assert seen == {"a": (2, 1, 50.0), "b": (1, 0, 0.0)}
    spark.createDataFrame([("a", True), ("a", True)], schema).write.mode("append").parquet(source)
    run()
    assert seen == {"a": (4, 3, 75.0), "b": (1, 0, 0.0)}


def test_accuracy_of_a_folder_of_part_files(spark, data, tmp_path):
    from ledgerlens.plans.analytics import stream_accuracy

    read(spark, data, "eval_results").repartition(3).write.parquet(str(tmp_path / "eval_results.parquet"))
    assert len(list(tmp_path.glob("eval_results.parquet/part-*.parquet"))) == 3
    want, got = (sorted(tuple(r) for r in stream_accuracy(spark, d).collect()) for d in (data, str(tmp_path)))
    assert want and got == want


def test_sliding_windows_and_sessions_as_streams(spark, data):
    events = read(spark, data, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for kind in (S.sliding, S.sessions):
        batch, stream = {tuple(r) for r in kind(events).collect()}, {tuple(r) for r in S.streamed(kind, spark, data).collect()}
        assert stream and stream < batch


def test_late_events_extend_no_closed_session(spark, tmp_path):
    """Two batches: the second brings an event behind the watermark, which is dropped, and one that opens a new session."""
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "user_id long, ts timestamp"

    def add(*rows):
        spark.createDataFrame([(u, t) for u, t in rows], "user_id long, t string").select("user_id", F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = S.sessions(spark.readStream.schema(schema).parquet(source).withWatermark("ts", "10 minutes"))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    add((1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:20:00"), (2, "2024-01-01 14:00:00"))
    run()
    assert [tuple(r) for r in spark.read.parquet(out).collect()] == [(1, "2024-01-01 10:00:00", 2)]
    add((1, "2024-01-01 10:30:00"), (1, "2024-01-01 14:10:00"), (2, "2024-01-01 18:00:00"))
    run()
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == [(1, "2024-01-01 10:00:00", 2), (1, "2024-01-01 14:10:00", 1), (2, "2024-01-01 14:00:00", 1)]
