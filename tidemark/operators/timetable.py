"""Around the timetable: service days, validity, areas, lines of a cell, delta coding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def area_id(stop: Column) -> Column:
    """The first three parts of a stop's id."""
    return F.substring_index(stop, ":", 3)


def pick_service_day(days: DataFrame, free: DataFrame, today: Column, weekday: int = 2) -> DataFrame:
    """(day): the first given weekday at least a week ahead that runs (day) and is no free day; else the last such day that runs."""
    runs = days.select("day").distinct().where(F.weekday("day") + 1 == weekday).join(free.select("day").distinct(), "day", "left_anti")
    ahead = F.min(F.when(F.col("day") >= F.date_add(today, 7), F.col("day")))
    return runs.agg(F.coalesce(ahead, F.max("day")).alias("day"))


def feed_validity(calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(first, last): over ranges (start, end) and added days (day, exception_type 1)."""
    ranges = calendar.select(F.col("start").alias("a"), F.col("end").alias("b"))
    added = exceptions.where("exception_type = 1").select(F.col("day").alias("a"), F.col("day").alias("b"))
    return ranges.union(added).agg(F.min("a").alias("first"), F.max("b").alias("last"))


def combined(lines: Column) -> Column:
    """Lines of a journey without equal neighbours."""
    return F.filter(lines, lambda x, i: (i == 0) | (x != F.get(lines, i - 1)))


def leading_line(rows: DataFrame, group: list[str], line: str, minutes: str, value: Column) -> DataFrame:
    """(group, line): the most frequent line of a cell; of equals the smaller median, then the name. None if that median is
    off the cell's ``value`` by more than 3 minutes and a quarter of it."""
    per = rows.groupBy(*group, line).agg(F.count(F.lit(1)).alias("__n"), F.median(minutes).alias("__m"), F.max(value).alias("__v"))
    best = per.withColumn("__k", F.row_number().over(W.partitionBy(*group).orderBy(F.desc("__n"), "__m", line))).where("__k = 1")
    return best.where(F.abs(F.col("__m") - F.col("__v")) <= F.greatest(F.lit(3.0), F.col("__v") * 0.25)).select(*group, line)


def deltas(values: Column) -> Column:
    """Steps between numbers, the first as it is."""
    return F.transform(values, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(values, i - 1)))


def undeltas(steps: Column) -> Column:
    """Running sums: the inverse of ``deltas``."""
    zero = F.expr("cast(array() as array<bigint>)")
    return F.aggregate(steps, zero, lambda a, x: F.array_append(a, (F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + x).cast("bigint")))


def encoded_planes(cells: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """(row, plane): the cells (0 to 255) of each row, in the order of their columns, as base64 bytes. Cells must be complete."""
    per = cells.groupBy(row).agg(F.array_sort(F.collect_list(F.struct(column, value))).alias("__c"))
    digits = F.array_join(F.transform("__c", lambda c: F.lpad(F.hex(c[value].cast("long")), 2, "0")), "")
    return per.select(row, F.base64(F.unhex(digits)).alias("plane"))


def decoded_planes(planes: DataFrame, row: str, value: str = "value") -> DataFrame:
    """(row, i, value): the bytes of each plane with their place from 0."""
    digits = F.hex(F.unbase64("plane"))
    p = planes.select(row, digits.alias("__h"), F.posexplode(F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))).alias("i", "__at"))
    return p.select(row, "i", F.conv(F.substring("__h", F.col("__at"), F.lit(2)), 16, 10).cast("int").alias(value))
