"""first_seen holds keys in groups: Python is called once per group and batch."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.streaming import streams
from tidemark.streaming.replay import batches, collected, write_batches

SCHEMA = "user long, ts timestamp, slot int"


def test_keys_share_a_call_and_rest_one_by_one(spark, tmp_path):
    path, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    start, big = datetime(2026, 3, 1), 2**60 + 1
    rows = [(u, start + timedelta(hours=1), 0) for u in range(200)] + [(None, start, 0), (None, start, 0), (big, start, 0)]
    rows += [(u, start + timedelta(hours=20 if u < 50 else 30), 1) for u in range(100)] + [(None, start + timedelta(hours=5), 1), (big, start + timedelta(hours=60), 1)]
    rows += [(7, start + timedelta(hours=90), 2)]
    write_batches(spark.createDataFrame(rows, SCHEMA), F.col("slot"), path)
    stream = streams.first_seen(batches(spark, path, SCHEMA), "user", "ts", 24 * 3_600_000, groups=8)
    got = sorted(tuple(r) for r in collected(stream, out, state).fillna(-1, "user").collect())
    want = [(u, 1, True) for u in range(200)] + [(-1, 2, True), (big, 1, True)]
    want += [(u, 1, u >= 50) for u in range(100)] + [(-1, 1, False), (big, 1, True), (7, 1, True)]
    assert got == sorted(want)
    held = spark.read.format("statestore").load(state)
    assert held.count() <= 8  # a state per group, not per key
