"""Recurrences to occurrences: dates, weekly and monthly rules, exceptions, holidays, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timefn


def _ruled(rules: DataFrame, days: Column, key: str, count: str | None, exceptions: DataFrame | None, free_days: DataFrame | None, skip_free: str | None) -> DataFrame:
    """A row per rule and day of ``days`` (ascending) without the rule's exceptions (key, day) and, where ``skip_free``, holidays (day); then the
    first ``count``: it counts kept days. A rule's days stay in its row until they are cut, so only exceptions are joined."""
    d = rules.withColumn("__days", days)
    if exceptions is not None:
        off = exceptions.groupBy(key).agg(F.collect_set("day").alias("__off"))
        d = d.join(off, key, "left").withColumn("__days", F.when(F.col("__off").isNull(), F.col("__days")).otherwise(F.array_except("__days", "__off"))).drop("__off")
    if free_days is not None:
        free = free_days.agg(F.collect_set("day").alias("__free"))  # one row: some days a year
        left = F.array_except("__days", "__free")
        d = d.crossJoin(F.broadcast(free)).withColumn("__days", F.when(F.col(skip_free), left).otherwise(F.col("__days")) if skip_free else left).drop("__free")
    if count is not None:
        d = d.withColumn("__days", F.when(F.col(count).isNull(), F.col("__days")).otherwise(F.slice("__days", F.lit(1), F.greatest(F.col(count), F.lit(0)))))
    return d.withColumn("day", F.explode("__days")).drop("__days")


def weekly(rules: DataFrame, key: str, start: str, until: str, weekdays: str, interval: str, count: str | None = None, exceptions: DataFrame | None = None, free_days: DataFrame | None = None, skip_free: str | None = None) -> DataFrame:
    """A row per rule and day: the rule's ISO weekdays in every ``interval``-th week from the Monday of its start. ``key`` tells rules apart."""
    monday = F.date_trunc("week", F.col(start)).cast("date")
    weeks = F.sequence(F.lit(0), F.floor(F.datediff(F.col(until), monday) / 7).cast("int"), F.col(interval).cast("int"))
    of_week = F.array_sort(F.array_distinct(weekdays))
    days = F.flatten(F.transform(weeks, lambda w: F.transform(of_week, lambda d: F.date_add(monday, w * 7 + d - 1))))
    fine = rules.where((F.col(until) >= F.col(start)) & (F.col(interval) >= 1))
    return _ruled(fine, F.filter(days, lambda d: d.between(F.col(start), F.col(until))), key, count, exceptions, free_days, skip_free)


def monthly(rules: DataFrame, key: str, start: str, until: str, weekday: str, nth: str, count: str | None = None, exceptions: DataFrame | None = None, free_days: DataFrame | None = None, skip_free: str | None = None) -> DataFrame:
    """A row per rule and day: the nth or last (-1) weekday of every month that has one. ``key`` tells rules apart."""
    months = F.sequence(F.trunc(F.col(start), "month"), F.trunc(F.col(until), "month"), F.expr("INTERVAL 1 MONTH"))
    days = F.transform(months, lambda m: timefn.nth_weekday(F.year(m), F.month(m), F.col(weekday), F.col(nth)))
    fine = rules.where(F.col(until) >= F.col(start))
    return _ruled(fine, F.filter(days, lambda d: d.between(F.col(start), F.col(until))), key, count, exceptions, free_days, skip_free)


def holiday_days(ranges: DataFrame, start: str = "start", end: str = "end", name: str = "name", order: Sequence[Column] = ()) -> DataFrame:
    """(day, name): ranges as days; where they overlap the first name by ``order`` counts."""
    d = ranges.where(F.col(end) >= F.col(start)).select("*", F.explode(F.sequence(F.col(start).cast("date"), F.col(end).cast("date"))).alias("day"))
    return d.groupBy("day").agg(F.min_by(name, F.struct(*(order or (F.col(start), F.col(name))))).alias(name))


def service_days(calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(service_id, day): weekday patterns (array of ISO weekdays) within their range, with days added (1) and removed (2)."""
    d = calendar.select("service_id", "weekdays", F.explode(F.sequence("start", "end")).alias("day"))
    d = d.where(F.array_contains("weekdays", F.weekday("day") + 1)).select("service_id", "day")
    gone = exceptions.where("exception_type = 2").select("service_id", "day")
    added = exceptions.where("exception_type = 1").select("service_id", "day")
    return d.join(gone, ["service_id", "day"], "left_anti").union(added).distinct()
