"""Sources with declared schemas: snapshots, feeds, timetables, calendars."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OFFER = (
    "id string, provider_id string, venue_id string, title string, summary string, category string, topics array<string>, format string, registration string, "
    "cost string, price string, age struct<min_months int, max_months int>, sessions array<struct<start timestamp, end timestamp>>, "
    "registration_window struct<opens timestamp, deadline timestamp>, url string, source_url string, listed_at timestamp"
)
GTFS: Mapping[str, str] = {
    "routes": "route_id string, agency_id string, route_short_name string, route_long_name string, route_desc string, route_type string",
    "trips": "route_id string, service_id string, trip_id string, trip_headsign string, direction_id string, block_id string",
    "stops": "stop_id string, stop_name string, stop_lat double, stop_lon double, location_type string, parent_station string",
    "stop_times": "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence int, stop_headsign string, pickup_type string, drop_off_type string",
    "calendar": "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, start_date string, end_date string",
    "calendar_dates": "service_id string, date string, exception_type int",
}


def offers(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Offers as JSON lines. ``strict`` fails on a malformed line; otherwise it is dropped."""
    return spark.read.schema(OFFER).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def raw_states(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A directory with a JSON file per provider; ``provider_id`` is the file's name."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.withColumn("provider_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))


def gtfs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The six tables of a timetable feed; columns by name, in any order; a byte-order mark is no part of the first."""
    out = {}
    for name, schema in GTFS.items():
        wanted = [c.strip().split(" ") for c in schema.split(",")]
        raw = spark.read.option("header", True).option("mode", "FAILFAST").option("encoding", "UTF-8").csv(f"{path}/{name}.txt")
        raw = raw.toDF(*[c.lstrip("﻿").strip('"') for c in raw.columns])
        out[name] = raw.select(*[(F.col(c) if c in raw.columns else F.lit(None)).cast(kind).alias(c) for c, kind in wanted])
    return out


def ical_events(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, uid, summary, dtstart, dtend, rrule, location, url, description): events of calendar texts, folded lines joined."""
    whole = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n", "\n"), "\n[ \t]", "")
    events = F.regexp_extract_all(whole, F.lit(r"(?s)BEGIN:VEVENT\n(.*?)\nEND:VEVENT"), F.lit(1))
    rows = texts.select(key, F.posexplode(events).alias("n", "__e"))
    field = lambda name: F.nullif(F.regexp_extract("__e", rf"(?m)^{name}(?:;[^:\n]*)?:(.*)$", 1), F.lit(""))
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"\\n|\\N", "\n"), r"\\([,;\\])", "$1")
    fields = [field(n.upper()).alias(n) if n not in ("summary", "location", "description") else plain(field(n.upper())).alias(n) for n in ("uid", "summary", "dtstart", "dtend", "rrule", "location", "url")]
    return rows.select(key, "n", *fields, F.substring(plain(field("DESCRIPTION")), 1, 300).alias("description"))


def feed_candidates(rows: DataFrame, source: str, source_id: str, title: str, place: str, start: str, end: str, first: str, last: str) -> DataFrame:
    """A feed's rows as candidates: one per title and place with its occurrences in a window, ascending."""
    inside = rows.where((F.to_date(start) >= F.lit(first)) & (F.to_date(start) <= F.lit(last)))
    return inside.groupBy(title, place).agg(F.lit(source).alias("source"), F.min(source_id).alias("source_id"), F.array_sort(F.collect_set(F.struct(F.col(start).alias("start"), F.col(end).alias("end")))).alias("occurrences"))
