"""Keyed state over event logs: sliding-log rate limits and cache lifetimes."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class SlidingLog:
    """Times of a key's allowed requests within the window; a refused request isn't logged."""

    def __init__(self, limit: int, window: float):
        self.limit, self.window, self.kept = limit, window, deque()

    def allow(self, now: float) -> bool:
        while self.kept and now - self.kept[0] >= self.window:
            self.kept.popleft()
        if len(self.kept) >= self.limit:
            return False
        self.kept.append(now)
        return True


#: Width of the cells of time by which a key's events are spread, in pauses.
CELL = 50


def sessions(rows: DataFrame, pause_us: Column | int) -> DataFrame:
    """``rows`` (k, o, us, ...) with ``s``: how many pauses of ``pause_us`` or more microseconds a key has had before the row.

    Rows are sorted by key and cell of time only, so a hot key is spread over its cells; from cell to cell only the first and last time
    and the number of pauses of each move.
    """
    cells = rows.withColumn("cell", F.floor(F.col("us") / (pause_us * CELL)))
    w = Window.partitionBy("k", "cell").orderBy("us", "o")
    new = F.coalesce((F.col("us") - F.lag("us").over(w) >= pause_us).cast("int"), F.lit(0))
    inner = cells.withColumn("__new", new).withColumn("__in", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = cells.groupBy("k", "cell").agg(F.min("us").alias("first"), F.max("us").alias("last")).join(inner.groupBy("k", "cell").agg(F.max("__in").alias("pauses")), ["k", "cell"])
    by = Window.partitionBy("k").orderBy("cell")
    starts = ends.withColumn("__cut", F.coalesce((F.col("first") - F.lag("last").over(by) >= pause_us).cast("int"), F.lit(0)))
    starts = starts.withColumn("before", F.sum("__cut").over(by.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("pauses").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inner.join(starts.select("k", "cell", "before"), ["k", "cell"]).withColumn("s", F.col("before") + F.col("__in")).drop("cell", "__new", "__in", "before")


def rate_limit(events: DataFrame, key: str, at: str, order: str, limit: int, window_s: float) -> DataFrame:
    """(key, order, at, allowed) of every event with a key and a time; equal times go by ``order``.

    A decision depends on earlier ones, but not across a pause of a whole window. So a key's events are cut at such
    pauses into sessions, which are spread over the tasks; a session itself is replayed by one task, which reads it sorted
    and holds at most ``limit`` times.
    """
    rows = events.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(at).alias("t"), F.unix_micros(F.col(at).cast("timestamp")).alias("us")).where(F.col("k").isNotNull() & F.col("t").isNotNull())
    spread = sessions(rows, int(window_s * 1e6)).select("k", "s", "o", "t", "us").repartition("k", "s").sortWithinPartitions("k", "s", "us", "o")

    def run(batches):
        current, log = None, None
        for b in batches:
            out = []
            for k, s, us in zip(b.k.tolist(), b.s.tolist(), b.us.tolist(), strict=True):
                if (k, s) != current:
                    current, log = (k, s), SlidingLog(limit, window_s * 1e6)
                out.append(log.allow(us))
            yield pd.DataFrame({"k": b.k, "o": b.o, "t": b.t, "allowed": out})

    kinds = dict(rows.dtypes)
    made = spread.mapInPandas(run, f"k {kinds['k']}, o {kinds['o']}, t {kinds['t']}, allowed boolean")
    return made.select(F.col("k").alias(key), F.col("o").alias(order), F.col("t").alias(at), "allowed")


def cache_replay(events: DataFrame, key: str, at: str, order: str, ttl_s: Column) -> DataFrame:
    """(key, order, at, hit): reads that store on a miss. A read is a hit if the last store is at most ``ttl_s`` old; a miss stores anew.

    Like the limiter a decision depends on earlier ones only within a lifetime, here the longest of all rows, and is
    replayed in sessions. ``ttl_s`` may differ from row to row; each read goes by its own.
    """
    rows = events.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(at).alias("t"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), (ttl_s.cast("bigint") * 1_000_000).alias("ttl")).where(F.col("k").isNotNull() & F.col("t").isNotNull())
    longest = rows.agg(F.max("ttl")).first()[0] or 0
    spread = sessions(rows, max(1, longest + 1)).select("k", "s", "o", "t", "us", "ttl").repartition("k", "s").sortWithinPartitions("k", "s", "us", "o")

    def run(batches):
        current = stored = None
        for b in batches:
            out = []
            for k, s, us, ttl in zip(b.k.tolist(), b.s.tolist(), b.us.tolist(), b.ttl.tolist(), strict=True):
                if (k, s) != current:
                    current, stored = (k, s), None
                hit = stored is not None and us - stored <= ttl
                if not hit:
                    stored = us
                out.append(hit)
            yield pd.DataFrame({"k": b.k, "o": b.o, "t": b.t, "hit": out})

    kinds = dict(rows.dtypes)
    made = spread.mapInPandas(run, f"k {kinds['k']}, o {kinds['o']}, t {kinds['t']}, hit boolean")
    return made.select(F.col("k").alias(key), F.col("o").alias(order), F.col("t").alias(at), "hit")
