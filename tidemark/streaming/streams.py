"""The stateful operators as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_limited(events: DataFrame, key: str, ts: str, limit: int = 10, late: str = "1 hour") -> DataFrame:
    """Events per key and full hour with how many are over the limit; in append mode an hour comes once it is complete."""
    hours = events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"), key).agg(F.count(F.lit(1)).alias("n"))
    return hours.select(F.col("window.start").alias("hour"), key, "n", F.greatest(F.lit(0), F.col("n") - limit).alias("over"))


def once_per_day(events: DataFrame, key: str, ts: str, late: str = "3 days", day: Column | None = None) -> DataFrame:
    """The first event per key and ``day`` (of the session's zone where none is given); the mark is forgotten after ``late``."""
    dated = events.withWatermark(ts, late).withColumn("day", F.to_date(ts) if day is None else day)
    return dated.dropDuplicatesWithinWatermark([key, "day"])


def first_seen(events: DataFrame, key: str, ts: str, rest_ms: int, late: str = "1 hour", groups: int = 256) -> DataFrame:
    """(key, n, is_new) per micro-batch that has the key n times: a key is new until it was seen, and again when ``rest_ms`` have passed between its last
    event and the first one of a batch. Keys are numbers, texts, dates or truth values, or null.

    Keys are held in ``groups`` by a hash, so Python is called once per group and batch, not once per key; a checkpoint goes on with the
    ``groups`` it began with. A group's state are the last events of its keys. A resting key's goes when the watermark says that no event can come in time
    any more; whether it has gone already makes no difference to the result.
    """
    kind = dict(events.dtypes)[key]
    if kind.startswith(("binary", "timestamp", "array", "map", "struct")):
        raise ValueError(f"keys of first_seen can't be of the type {kind}")

    def advance(_: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = dict(zip(*state.get, strict=True)) if state.exists else {}
        mark, now = state.getCurrentWatermarkMs(), {}
        if not state.hasTimedOut:
            for b in batches:
                for k, ms in zip(b["__key"].tolist(), b["__ms"].tolist(), strict=True):
                    n, low, high = now.get(k, (0, ms, ms))
                    now[k] = n + 1, min(low, ms), max(high, ms)
        new = [k not in seen or low - seen[k] >= rest_ms for k, (_, low, _) in now.items()]
        for k, (_, _, high) in now.items():
            seen[k] = max(high, seen.get(k, high))
        seen = {k: last for k, last in seen.items() if last + rest_ms > mark}
        if seen:
            state.update((list(seen), list(seen.values())))
            state.setTimeoutTimestamp(max(min(seen.values()) + rest_ms, mark + 1))
        elif state.exists:
            state.remove()
        if now:
            yield pd.DataFrame({"k": pd.Series(list(now), dtype="object"), "n": [v[0] for v in now.values()], "is_new": new})

    # Keys go to Python as texts, as whole numbers beside a null would become floats, and instants as milliseconds, which no session's zone moves.
    keyed = events.withWatermark(ts, late).select(F.col(key).cast("string").alias("__key"), ts, F.unix_millis(ts).alias("__ms"), F.pmod(F.xxhash64(key), F.lit(groups)).alias("__g"))
    out = keyed.groupBy("__g").applyInPandasWithState(advance, "k string, n long, is_new boolean", "keys array<string>, lasts array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.col("k").cast(kind).alias(key), "n", "is_new")


def diffed(path: str, key: str):
    """A ``foreachBatch`` function: writes a batch's keys that the table at ``path`` doesn't hold, and so marks them seen."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(key).distinct()
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
        if there:
            rows = rows.join(spark.read.parquet(path).where(F.col("batch") != batch_id).select(key), key, "left_anti")
        rows.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return each
