"""Calendar views: a spine of days with what is shown, hidden and ended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def days(spark: SparkSession, start: str, end: str) -> DataFrame:
    """A row per day, both ends included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))


def range_agenda(spine: DataFrame, rows: DataFrame, day: Column, shown: Column, fits: Column) -> DataFrame:
    """Per day of the spine the rows shown, those that the filter hides and of those that pass it those that age hides."""
    per = rows.groupBy(day.alias("day")).agg(
        F.count_if(shown & fits).alias("shown"), F.count_if(~shown).alias("hidden_by_filter"), F.count_if(shown & ~fits).alias("hidden_by_age")
    )
    return spine.join(per, "day", "left").na.fill(0)


def week_rows(spine: DataFrame, counts: DataFrame, today: Column) -> DataFrame:
    """Days of a week as past, busy or free; a weekend without rows is one row, its Saturday."""
    d = spine.join(counts, "day", "left").na.fill(0, ["n"]).withColumn("weekday", F.weekday("day") + 1)
    d = d.withColumn("state", F.when(F.col("day") < today, "past").when(F.col("n") > 0, "busy").otherwise("free"))
    weekend = d.where("weekday >= 6").groupBy(F.date_trunc("week", "day").alias("week")).agg((F.count_if(F.col("state") != "free") == 0).alias("empty"))
    d = d.withColumn("week", F.date_trunc("week", "day")).join(weekend, "week", "left")
    return d.where(~(F.col("empty") & (F.col("weekday") == 7))).select("day", "weekday", "n", F.when(F.col("empty") & (F.col("weekday") == 6), "free_weekend").otherwise(F.col("state")).alias("state"))


def selection_range(kind: str, day: Column, today: Column) -> tuple[Column, Column]:
    """First and last day of the day, week or month around ``day``, not before today."""
    if kind == "week":
        first = F.date_trunc("week", day).cast("date")
        last = F.date_add(first, 6)
    elif kind == "month":
        first, last = F.trunc(day, "month"), F.last_day(day)
    else:
        first = last = day
    return F.greatest(first, today), F.greatest(last, today)
