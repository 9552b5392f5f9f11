"""The streaming operators over the events table, replayed to its end in one batch or in many, each with the SQL of what comes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import new_path
from ..streaming import streams
from ..streaming.replay import batches, collected, write_batches
from . import bindings as B
from .queries import query, text


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, with their time as an instant (UTC)."""
    source = f"{sf_dir}/events.parque[t]"  # a pattern, as a stream reads no single file by its name
    rows = spark.readStream.schema(B.table(spark, sf_dir, "events").schema).parquet(source)
    return rows.withColumn("ts", F.to_timestamp_ltz(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")))


def _collected(stream: DataFrame) -> DataFrame:
    """What a stream gives until its source is read to the end, as a table in the shared folder."""
    return collected(stream, new_path(stream.sparkSession), new_path(stream.sparkSession))


def _utc(instant: Column) -> Column:
    return F.to_utc_timestamp(instant, F.current_timezone()).cast("timestamp_ntz")


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, user_id, CAST(count(*) AS BIGINT) AS n, CAST(greatest(0, count(*) - 2) AS BIGINT) AS over FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""")
def rate_limited_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that the watermark has closed, with what is over two events a user."""
    out = _collected(streams.rate_limited(_replayed(spark, sf_dir), "user_id", "ts", 2))
    return out.select(text(_utc(F.col("hour"))).alias("hour"), "user_id", "n", F.col("over").cast("long").alias("over"))


def _by_days(spark: SparkSession, sf_dir: str, days: int) -> DataFrame:
    """The events as a stream of batches of so many days each."""
    rows = B.table(spark, sf_dir, "events")
    instant = F.to_timestamp_ltz(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    slot = F.floor(F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")) / days)
    path = new_path(spark)
    rows = rows.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    write_batches(rows.withColumn("ts", instant), slot, path)
    return batches(spark, path, rows.withColumn("ts", instant).schema)


@query("""SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events""")
def once_per_day_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and days of which an event came through, in batches of a week; which event depends on the order in which they come."""
    out = _collected(streams.once_per_day(_by_days(spark, sf_dir, 7), "user_id", "ts", day=F.col("day")))
    return out.select("user_id", "day")


_REST_HOURS = 36


@query(f"""WITH b AS (SELECT user_id, datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) // 3 AS slot, count(*) AS n, date_trunc('millisecond', min(ts)) AS lo, date_trunc('millisecond', max(ts)) AS hi FROM events GROUP BY 1, 2),
    p AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b)
    SELECT user_id, CAST(n AS BIGINT) AS n, before IS NULL OR lo - before >= INTERVAL {_REST_HOURS} HOUR AS is_new FROM p""")
def first_seen_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users in batches of three days: new at first and after a day and a half without an event."""
    return _collected(streams.first_seen(_by_days(spark, sf_dir, 3).select("user_id", "ts"), "user_id", "ts", _REST_HOURS * 3_600_000))
