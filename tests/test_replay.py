"""Streams over several batches: order, state, time-outs, late rows and a restart."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.streaming import streams
from tidemark.streaming.replay import batches, collected, write_batches

SCHEMA = "user string, ts timestamp, slot int"
START = datetime(2026, 3, 1)


def rows(spark, *of):
    return spark.createDataFrame([(u, START + timedelta(hours=h), slot) for u, h, slot in of], SCHEMA)


def test_state_rests_late_rows_and_a_restart(spark, tmp_path):
    path, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run():
        stream = streams.first_seen(batches(spark, path, SCHEMA), "user", "ts", 48 * 3_600_000)
        got = collected(stream, out, state).collect()
        return sorted((r["user"], r["n"], r["is_new"]) for r in got)

    assert write_batches(rows(spark, ("a", 1, 0), ("a", 2, 0), ("b", 3, 0), ("a", 26, 1)), F.col("slot"), path) == 2
    first = [("a", 1, False), ("a", 2, True), ("b", 1, True)]
    assert run() == first
    assert run() == first  # nothing new, nothing twice
    # b rests from the first day to the fourth; c's row of the first day comes when the watermark has passed it.
    write_batches(rows(spark, ("a", 50, 2), ("b", 80, 3), ("c", 0, 3), ("c", 81, 3), ("a", 100, 4), ("b", 101, 4)), F.col("slot"), path)
    more = [("a", 1, False), ("b", 1, True), ("c", 1, True), ("a", 1, True), ("b", 1, False)]
    assert run() == sorted(first + more)


def test_once_per_day_over_batches_and_a_restart(spark, tmp_path):
    path, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run():
        stream = streams.once_per_day(batches(spark, path, SCHEMA), "user", "ts", day=F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyy-MM-dd"))
        return sorted((r["user"], r["day"]) for r in collected(stream, out, state).collect())

    write_batches(rows(spark, ("a", 1, 0), ("a", 2, 0), ("a", 3, 1), ("b", 5, 1)), F.col("slot"), path)
    first = [("a", "2026-03-01"), ("b", "2026-03-01")]
    assert run() == first
    write_batches(rows(spark, ("a", 6, 2), ("a", 25, 2), ("b", 7, 3)), F.col("slot"), path)
    assert run() == [("a", "2026-03-01"), ("a", "2026-03-02"), ("b", "2026-03-01")]
