"""Sources, sinks, streams and the registry."""

from datetime import datetime

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.sources import readers, sinks
from tidemark.streaming import streams


def test_gtfs(spark, tmp_path):
    for name, schema in readers.GTFS.items():
        cols = [c.strip().split(" ")[0] for c in schema.split(",")]
        (tmp_path / f"{name}.txt").write_text("﻿" + ",".join(f'"{c}"' for c in cols) + "\n" + ",".join('"1"' for _ in cols) + "\n", encoding="utf-8")
    tables = readers.gtfs(spark, str(tmp_path))
    assert tables["stop_times"].first()["stop_sequence"] == 1 and tables["stops"].first()["stop_lat"] == 1.0 and len(tables) == 6


def test_ical(spark):
    text = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nSUMMARY:A\\, b\r\n  c\r\nDTSTART;TZID=Europe/Berlin:20240101T100000\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:2\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"
    rows = readers.ical_events(spark.createDataFrame([(1, text), (2, None)], "k long, t string"), "k", "t").orderBy("n").collect()
    assert [(r["uid"], r["summary"], r["dtstart"]) for r in rows] == [("1", "A, b c", "20240101T100000"), ("2", None, None)]


def test_offers_and_publish(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"id":"a","sessions":[{"start":"2024-01-01T10:00:00Z","end":"2024-01-01T11:00:00Z"}]}\nnot json\n')
    assert readers.offers(spark, str(tmp_path / "o.json"), strict=False).count() == 1
    rows = spark.range(3)
    assert sinks.publish(rows, rows.where("id > 1"), str(tmp_path / "out")) == 1 and not (tmp_path / "out").exists()
    assert sinks.publish(rows, rows.where("id > 5"), str(tmp_path / "out")) == 0 and spark.read.parquet(str(tmp_path / "out")).count() == 3


def stream(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def run(spark, df, folder):
    """All there is so far, then an end; a second call goes on where the first ended."""
    q = df.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    assert q.awaitTermination(120)
    return spark.read.parquet(f"{folder}/out").collect()


def test_rate_and_once(spark, tmp_path):
    rows = [("a", datetime(2024, 1, 1, 10, m)) for m in range(12)] + [("b", datetime(2024, 1, 2, 10)), ("a", datetime(2024, 1, 5))]
    s = stream(spark, str(tmp_path / "e"), rows, "k string, ts timestamp")
    assert {(r["k"], r["n"], r["over"]) for r in run(spark, streams.rate_limited(s, "k", "ts"), tmp_path / "rate")} >= {("a", 12, 2)}
    assert len(run(spark, streams.once_per_day(s, "k", "ts"), tmp_path / "once")) == 3


def test_first_seen(spark, tmp_path):
    path, kind = str(tmp_path / "e"), "k string, ts timestamp"
    s = stream(spark, path, [("a", datetime(2024, 1, 1)), ("a", datetime(2024, 1, 1)), ("b", datetime(2024, 1, 1))], kind)
    assert len(run(spark, streams.first_seen(s, "k", "ts", 86_400_000), tmp_path / "seen")) == 2
    spark.createDataFrame([("a", datetime(2024, 1, 1, 5)), ("c", datetime(2024, 1, 1, 5))], kind).coalesce(1).write.mode("append").parquet(path)
    got = run(spark, streams.first_seen(spark.readStream.schema(kind).parquet(path), "k", "ts", 86_400_000), tmp_path / "seen")
    assert sorted(map(tuple, got)) == [("a", 1, False), ("a", 2, True), ("b", 1, True), ("c", 1, True)]


def test_diffed_batches(spark, tmp_path):
    each, path = streams.diffed(str(tmp_path / "seen"), "k"), str(tmp_path / "seen")
    each(spark.createDataFrame([("a",), ("b",)], "k string"), 0)
    each(spark.createDataFrame([("b",), ("c",)], "k string"), 1)
    each(spark.createDataFrame([("b",), ("c",)], "k string"), 1)  # a batch that is run again
    assert {(r["k"], r["batch"]) for r in spark.read.parquet(path).collect()} == {("a", 0), ("b", 0), ("c", 1)}


def test_registry(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 55
    assert entry.entry(spark).count() > 0


def test_geojson(spark):
    row = sinks.geojson_features(spark.createDataFrame([(1.5, 2.5, "x")], "la double, lo double, n string"), "la", "lo", ["n"]).first()[0]
    assert row == '{"type":"Feature","geometry":{"type":"Point","coordinates":[2.5,1.5]},"properties":{"n":"x"}}'


def test_ics(spark):
    e = spark.createDataFrame([(1, 2, "b"), (1, 1, "a;")], "k long, t long, s string").withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz"))
    ics = sinks.ics_calendars(e, "k", ["t"], sinks.ics_event(F.col("t").cast("string"), F.col("ts"), F.col("ts"), F.col("s"), F.col("ts"))).first()["ics"]
    assert ics.index("UID:1") < ics.index("UID:2") and "SUMMARY:a\\;" in ics and ics.startswith("BEGIN:VCALENDAR\r\n")
