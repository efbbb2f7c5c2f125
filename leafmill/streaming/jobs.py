"""Job streams: intake, deduplication, upserts and progress."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.sources.files import BUCKET_ROWS, read_store, upsert_store

JOB = "message_id string, root_id bigint, job_type string, ts timestamp"
TICK = "root_id bigint, seq bigint, processed bigint, discovered bigint, page_id string, title string"


def job_stream(spark: SparkSession, source: str | dict, schema: str = JOB, job_type: str | None = None) -> DataFrame:
    """Jobs of a folder of Parquet files, or of a Kafka topic given as reader options; value holds the job as JSON there."""
    if isinstance(source, dict):
        raw = spark.readStream.format("kafka").options(**source).load()
        jobs = raw.select(F.from_json(F.col("value").cast("string"), schema).alias("j")).select("j.*")
    else:
        jobs = spark.readStream.schema(schema).parquet(source)
    return jobs if job_type is None else jobs.where(F.col("job_type") == job_type)


def dedupe_jobs(jobs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each message once inside the watermark's delay; jobs without an id always pass."""
    cols = [F.col(c).cast("timestamp").alias(c) if c == "ts" else F.col(c) for c in jobs.columns]
    timed = jobs.select(*cols)
    named = timed.where("message_id is not null").withWatermark("ts", delay)
    once = named.dropDuplicatesWithinWatermark(["message_id"]) if jobs.isStreaming else named.dropDuplicates(["message_id"])
    return once.unionByName(timed.where("message_id is null"))


def stream_upsert(stream: DataFrame, target: str, keys: list[str], checkpoint: str, order: str = "ts", bucket_rows: int = BUCKET_ROWS):
    """Starts a query that keeps the latest row per key (by `order`) in target, a store in hash buckets of the keys.

    A batch reads and writes the buckets that it touches only, so its cost does not grow with the number of batches; one that runs again
    gives the same rows, and one that fails leaves the version before.
    """

    def write(batch: DataFrame, number: int) -> None:
        upsert_store(batch, target, keys, latest=order, bucket_rows=bucket_rows)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_target(spark: SparkSession, target: str, schema) -> DataFrame:
    """The rows of the store; none before the first batch."""
    found = read_store(spark, target)
    return spark.createDataFrame([], schema) if found is None else found.drop("bucket")


def progress_ticks(ticks: DataFrame, every: int = 25) -> DataFrame:
    """One tick per root and `every` pages: the last of ticks(root_id, n, ts) in each stretch."""
    return ticks.groupBy("root_id", F.floor(F.col("n") / every).alias("step")).agg(F.max("n").alias("n"), F.max_by("ts", "n").alias("ts"))


def crawl_ticks(ticks: DataFrame, every: int = 25) -> DataFrame:
    """Of a stream of ticks (columns of TICK) those that a progress file is written for: a tick that has reached more whole stretches of
    `every` pages discovered, or processed, than the tick written last.

    State per root are the two numbers of stretches of the last tick written, zeros at first; they outlive batches and restarts. Ticks of one
    batch go by seq, batches in their order. Counters may fall back (a crawl that starts again): only what passes the last written tick is
    written. Null counters count as zero; ticks with no root are a root of their own. A task holds the ticks of a root in one batch, which
    the reader's trigger options (maxFilesPerTrigger, maxOffsetsPerTrigger) bound.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts), ignore_index=True).sort_values("seq", kind="stable")
        marks = np.stack([rows["discovered"].to_numpy(np.int64) // every, rows["processed"].to_numpy(np.int64) // every], axis=1)
        last, keep = tuple(state.get) if state.exists else (0, 0), []
        for i in np.flatnonzero(np.r_[True, (np.diff(marks, axis=0) != 0).any(axis=1)]):  # inside a run of equal marks nothing changes
            if (marks[i] > last).any():
                last = tuple(marks[i].tolist())
                keep.append(i)
        state.update(last)
        yield rows.iloc[keep].assign(root_id=key[0])

    whole = ticks.select("root_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("seq", "processed", "discovered")], "page_id", "title")
    return whole.groupBy("root_id").applyInPandasWithState(fold, TICK, "discovered bigint, processed bigint", "append", GroupStateTimeout.NoTimeout)
