"""Groups and pages of a list: recency, reach bands, saved order, limits across groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def listing_week(listed: Column, today: Column) -> Column:
    """this_week to 6 days ago (and in the future), last_week to 13, else (and unknown) older."""
    days = F.datediff(today, F.to_date(listed))
    return F.when(days <= 6, "this_week").when(days <= 13, "last_week").otherwise("older")


def newly_listed(listed: Column, today: Column, days: int = 14) -> Column:
    return F.coalesce(F.datediff(today, F.to_date(listed)) < days, F.lit(False))


def reach_band(minutes: Column, metres: Column) -> tuple[Column, Column]:
    """(unit, upper bound): bands of 5 minutes to an hour and open beyond, else of distance, else none."""
    by_time = F.when(minutes > 60, None).otherwise(F.greatest(F.lit(1), F.ceil(minutes / 5)) * 5)
    bounds = F.when(metres <= 500, 500).when(metres <= 1000, 1000).when(metres <= 2000, 2000).when(metres <= 5000, 5000).when(metres <= 10_000, 10_000)
    unit = F.when(minutes.isNotNull(), "minutes").when(metres.isNotNull(), "metres").otherwise("none")
    return unit, F.when(minutes.isNotNull(), by_time).otherwise(bounds).cast("int")


def band_rank(unit: Column) -> Column:
    return F.when(unit == "minutes", 0).when(unit == "metres", 1).otherwise(2)


def top_in_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group with their rank from 1."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def take_groups(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows over all groups, in order: a page. Sorted with a limit, no global window."""
    return df.orderBy(*order).limit(n)


def remaining(df: DataFrame, n: int) -> DataFrame:
    """(total, remaining) after a page of ``n``."""
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("remaining", F.greatest(F.col("total") - n, F.lit(0)))


def recently_saved(items: DataFrame, saved: DataFrame, key: str, position: str) -> DataFrame:
    """Items with the position they were saved at; order by it, descending."""
    return items.join(saved.select(key, position), key)


def canonical_mode(df: DataFrame, group: Sequence[str], value: str, canon: Sequence[str]) -> DataFrame:
    """The most frequent value per group; of equals the first in the canonical order."""
    place = F.array_position(F.array(*map(F.lit, canon)), F.col(value))
    counted = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by(value, F.struct("n", -place))
    return counted.groupBy(*group).agg(best.alias(value), F.max("n").alias("n"))
