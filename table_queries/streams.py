"""Streaming operators drained over the driver's tables with availableNow."""

from __future__ import annotations

from pyspark.sql import functions as F

from table_queries.base import query, table
from winnow.operators.gates import Gate, apply_gates
from winnow.session import scratch_path
from winnow.streaming import incremental as T

GATES = (Gate("value", ("value",), "ge", 20.0), Gate("kind", ("event_type",), "eq", "purchase"))


def _events(spark, folder):
    schema = table(spark, folder, "events").schema
    return T.read_new_files(spark, folder, schema, "events.parquet")


def _gated(df):
    return apply_gates(df, GATES).select("event_id", "user_id", "value")


@query(
    "T1_incremental_score",
    "SELECT event_id, user_id, value FROM events WHERE value >= 20 AND event_type = 'purchase'",
)
def t1(spark, folder):
    sink, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "offsets")
    # the second run finds no new file, so every row is there once
    for _ in range(2):
        T.drain(T.incremental_score(_events(spark, folder), _gated, sink, checkpoint))
    return spark.read.parquet(sink)


@query("T2_dedupe_ids", "SELECT DISTINCT user_id FROM events")
def t2(spark, folder):
    sink, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "offsets")
    unique = lambda df: T.dedupe_ids(df, "user_id").select("user_id")
    T.drain(T.incremental_score(_events(spark, folder), unique, sink, checkpoint))
    return spark.read.parquet(sink)


@query("T3_foreach_batch_upsert", "SELECT DISTINCT user_id FROM events WHERE value >= 20 AND event_type = 'purchase'")
def t3(spark, folder):
    """Two halves of the events under a checkpoint each, into one table; a third reader of the first half adds nothing."""
    target, events = scratch_path(spark, "table"), table(spark, folder, "events")
    halves = [scratch_path(spark, "half") for _ in range(2)]
    for n, half in enumerate(halves):
        events.filter(F.col("event_id") % 2 == n).write.parquet(half)
    for half in (*halves, halves[0]):
        source = T.read_new_files(spark, half, events.schema)
        picked = lambda batch: _gated(batch).select("user_id")
        T.drain(T.foreach_batch_upsert(source, picked, target, scratch_path(spark, "offsets"), "user_id"))
    return spark.read.parquet(target).select("user_id")


@query(
    "T4_progress_counts",
    "SELECT event_type, count(*) AS n_processed, count(*) FILTER (value >= 20) AS n_passed FROM events GROUP BY 1",
)
def t4(spark, folder):
    target = scratch_path(spark, "progress")
    flagged = _events(spark, folder).withColumn("passed", F.col("value") >= 20.0)
    totals = T.progress_counts(flagged, "passed", "event_type")
    query = (
        totals.writeStream.outputMode("complete")
        .option("checkpointLocation", scratch_path(spark, "offsets"))
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(target))
        .trigger(availableNow=True)
        .start()
    )
    T.drain(query)
    return spark.read.parquet(target)
