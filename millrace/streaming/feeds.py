"""Streaming twins of the feed job and the rate limiter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from millrace.operators.store import last_of_batch, upsert

#: Columns of a stored entry that a new fetch replaces.
REPLACED = ["title", "description", "content", "published_at"]


def merge_entries(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """The entry table after a batch: new ids are added, known ones get the batch's latest title, description, content and time."""
    return upsert(existing, last_of_batch(batch, ["id"], F.col("created_at")), ["id"], replace=REPLACED)


def poll_feeds(spark: SparkSession, source: str, schema, table: str, checkpoint: str):
    """Streams entry files from folder ``source`` into versions of Parquet table ``table`` (``table/v=N``), one a batch; ends when all are read."""

    def put(batch: DataFrame, number: int) -> None:
        if number:
            old = spark.read.schema(batch.schema).parquet(f"{table}/v={number - 1}")
        else:
            old = batch.limit(0)
        merge_entries(old, batch).write.mode("overwrite").parquet(f"{table}/v={number}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def limit_stream(events: DataFrame, key: str, at: str, limit: int, window_s: float) -> DataFrame:
    """(key, at, allowed) of a stream; a key's state is the at most ``limit`` times of its allowed requests. Within a micro-batch a key's events go by time."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("us")
        allowed = []
        for us in rows.us.tolist():
            kept = [t for t in kept if us - t < window_s * 1e6]
            allowed.append(len(kept) < limit)
            if allowed[-1]:
                kept.append(us)
        state.update((kept,))
        yield pd.DataFrame({"key": [k[0]] * len(rows), "us": rows.us, "allowed": allowed})

    keyed = events.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("us")).where("key is not null and us is not null")
    return keyed.groupBy("key").applyInPandasWithState(run, "key string, us long, allowed boolean", "times array<long>", "append", GroupStateTimeout.NoTimeout)


def hourly_counts(events: DataFrame, at: str, kind: str, late: str = "2 hours") -> DataFrame:
    """(start, kind, n) of event-time hours; events later than ``late`` behind the newest are dropped by the watermark."""
    return events.withColumn("ts", F.col(at).cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 hour").start.alias("start"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
