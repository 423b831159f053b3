"""Restartable scoring of candidate files: only new files are read, and results are appended once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from winnow.operators.joins import skip_done

Transform = Callable[[DataFrame], DataFrame]


def read_new_files(
    spark: SparkSession,
    folder: str,
    schema: StructType | str,
    pattern: str = "*.parquet",
    files_per_batch: int = 1000,
) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def incremental_score(source: DataFrame, transform: Transform, sink: str, checkpoint: str) -> StreamingQuery:
    """Run a stateless transform over all files not seen before, then stop. The file sink commits a batch once."""
    return (
        transform(source)
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def dedupe_ids(stream: DataFrame, key: str) -> DataFrame:
    """First row of each id. State grows with the ids seen; use `foreach_batch_upsert` for unbounded id sets."""
    return stream.dropDuplicates([key])


BUCKETS = 64


def _stored(spark: SparkSession, table: str) -> DataFrame | None:
    """The result table, or None if nothing has been written yet. Every other error is the caller's to see."""
    try:
        return spark.read.option("basePath", table).parquet(table)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _run_id(spark: SparkSession, checkpoint: str) -> str:
    """Name of a checkpoint's batches, kept beside it: batch numbers start anew with every checkpoint."""
    folder = f"{checkpoint.rstrip('/')}-run"
    try:
        return spark.read.text(folder).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    name = uuid.uuid4().hex
    spark.createDataFrame([(name,)], "value string").coalesce(1).write.text(folder)
    return name


def foreach_batch_upsert(
    source: DataFrame, transform: Transform, table: str, checkpoint: str, key: str, buckets: int = BUCKETS
) -> StreamingQuery:
    """Append only ids missing from the result table.

    A batch has a folder of its own, named by the run and the batch, so a replayed batch overwrites itself and nothing
    else. The table is partitioned by a hash of the id, and a batch reads the ids of its own buckets only. `buckets`
    must stay the same for a table. One query at a time writes a table.
    """
    run = _run_id(source.sparkSession, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = transform(batch).dropDuplicates([key]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        stored = _stored(spark, table)
        if stored is not None:
            touched = [row[0] for row in fresh.select("bucket").distinct().collect()]  # at most `buckets` numbers
            own = (F.col("run") == run) & (F.col("batch") == batch_id)
            fresh = skip_done(fresh, [stored.filter(F.col("bucket").isin(touched) & ~own).select(key)], key)
        target = f"{table}/run={run}/batch={batch_id}"
        fresh.write.mode("overwrite").partitionBy("bucket").parquet(target)

    return (
        source.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def progress_counts(stream: DataFrame, flag_col: str, group_col: str | None = None) -> DataFrame:
    """Running totals of processed and passed rows."""
    totals = [F.count(F.lit(1)).alias("n_processed"), F.count_if(F.col(flag_col)).alias("n_passed")]
    return stream.groupBy(*([group_col] if group_col else [])).agg(*totals)


def drain(query: StreamingQuery) -> None:
    """Wait for an availableNow query and raise its error, if any."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()
