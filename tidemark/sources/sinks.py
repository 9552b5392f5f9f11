"""Sinks: calendars, GeoJSON, and publishing all or nothing: one table, or several that belong together."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import textfn


def ics_event(uid: Column, start: Column, end: Column, title: Column, stamp: Column) -> Column:
    """One event of a calendar; times are UTC."""
    form = "yyyyMMdd'T'HHmmss'Z'"
    lines = [F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), uid), F.concat(F.lit("DTSTAMP:"), F.date_format(stamp, form)), F.concat(F.lit("DTSTART:"), F.date_format(start, form)), F.concat(F.lit("DTEND:"), F.date_format(end, form)), F.concat(F.lit("SUMMARY:"), textfn.escape_ics(title)), F.lit("END:VEVENT")]
    return F.concat_ws("\r\n", *lines)


def ics_calendars(events: DataFrame, key: str, order: Sequence[str], event: Column) -> DataFrame:
    """(key, ics): one calendar per key with its events in order."""
    rows = events.select(key, F.struct(*order, event.alias("__e")).alias("__s")).groupBy(key).agg(F.array_sort(F.collect_list("__s")).alias("__s"))
    body = F.array_join(F.transform("__s", lambda s: s["__e"]), "\r\n")
    return rows.select(key, F.concat(F.lit("BEGIN:VCALENDAR\r\nVERSION:2.0\r\n"), body, F.lit("\r\nEND:VCALENDAR\r\n")).alias("ics"))


def geojson_features(rows: DataFrame, lat: str, lon: str, properties: Sequence[str]) -> DataFrame:
    """(feature): a GeoJSON point per row."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties"))
    return rows.select(F.to_json(feature).alias("feature"))


def publish(rows: DataFrame, violations: DataFrame, path: str) -> int:
    """Writes ``rows`` as Parquet only if nothing is violated; returns the number of violations. The write itself is committed whole."""
    n = violations.count()
    if not n:
        rows.write.mode("overwrite").parquet(path)
    return n


MANIFESTS = "_manifest"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """The number of the last version that was published under ``path`` and where its tables are; 0 and none before the first."""
    at, fs = _files(spark, f"{path}/{MANIFESTS}")
    numbers = [int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit()] if fs.exists(at) else []
    if not numbers:
        return 0, {}
    last = max(numbers)
    return last, json.loads(spark.read.text(f"{path}/{MANIFESTS}/{last}", wholetext=True).first()[0])


def published(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the last version."""
    return spark.read.parquet(manifest(spark, path)[1][name])


def publish_together(tables: Mapping[str, DataFrame], path: str, violations: DataFrame | None = None) -> int:
    """Writes ``tables`` as the next version under ``path`` and returns its number; 0 if something is violated: then nothing is written.

    Each table goes to a new folder; the version counts from the moment its manifest, which is renamed into place when it is whole, names them all. So readers see
    both new tables or both old ones, whatever fails in between, and tables may be made of those of the version before. Of two writers at
    once one is refused.
    """
    spark = next(iter(tables.values())).sparkSession
    if violations is not None and not violations.isEmpty():
        return 0
    number, own = manifest(spark, path)[0] + 1, uuid.uuid4().hex
    places = {name: f"{path}/{name}/{number}-{own}" for name in tables}
    for name, table in tables.items():
        table.write.parquet(places[name])
    at, fs = _files(spark, f"{path}/{MANIFESTS}/{number}")
    draft, _ = _files(spark, f"{path}/{MANIFESTS}/.{own}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(places).encode()))
    finally:
        out.close()
    if fs.exists(at) or not fs.rename(draft, at):  # whole or not at all
        fs.delete(draft, False)
        raise RuntimeError(f"version {number} has been published by another writer")
    return number
