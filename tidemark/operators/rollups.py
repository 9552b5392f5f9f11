"""Roll-ups and small relational rules: nearest, ordered categories, exports, routing, findings, overlays."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest_of(rows: DataFrame, group: Sequence[str], distance: Column, key: str) -> DataFrame:
    """(group, key, distance): the nearest row of each group, ties to the smaller key; rows without a distance don't count."""
    d = rows.withColumn("__d", distance).where("__d is not null")
    return d.groupBy(*group).agg(F.min_by(key, F.struct("__d", key)).alias(key), F.min("__d").alias("distance"))


def ordered_values(rows: DataFrame, group: Sequence[str], value: str, canon: Sequence[str]) -> DataFrame:
    """(group, values): the distinct values in canonical order; unknown ones don't count."""
    per = rows.groupBy(*group).agg(F.collect_set(value).alias("__s"))
    return per.select(*group, F.filter(F.array(*map(F.lit, canon)), lambda x: F.array_contains("__s", x)).alias("values"))


def route(rows: DataFrame, routes: Sequence[tuple[str, Column]], otherwise: str) -> DataFrame:
    """``rows`` with ``route``: the first whose condition holds."""
    return rows.withColumn("route", F.coalesce(*[F.when(c, F.lit(n)) for n, c in routes], F.lit(otherwise)))


def findings(rows: DataFrame, unit: Sequence[str], provider: str, kinds: Mapping[str, Column], rollup: str) -> DataFrame:
    """(provider, unit, kind): a row per finding. Where all units of a provider have ``rollup``, one row without a unit
    stands for all of the provider's findings."""
    hit = rows.select(provider, *unit, F.explode(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]), lambda x: x.isNotNull())).alias("kind"))
    whole = rows.groupBy(provider).agg(F.every(F.coalesce(kinds[rollup], F.lit(False))).alias("__all")).where("__all").select(provider)
    rest = hit.join(whole, provider, "left_anti")
    return rest.unionByName(whole.select(provider, *[F.lit(None).cast(dict(rows.dtypes)[u]).alias(u) for u in unit], F.lit(f"all_{rollup}").alias("kind")))


def held_back(before: DataFrame, after: DataFrame, key: str, gated: DataFrame) -> DataFrame:
    """``after``, but with the old rows of gated keys; gated keys without an old row are left out."""
    held = before.join(gated.select(key), key, "left_semi")
    return after.join(gated.select(key), key, "left_anti").unionByName(held)


def stage_of(rows: DataFrame, saved: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``stage``: off, tentative or fixed, by saved rows (key, tentative)."""
    s = saved.select(key, "tentative").dropDuplicates([key])
    return rows.join(s, key, "left").withColumn("stage", F.when(F.col("tentative").isNull(), "off").when(F.col("tentative"), "tentative").otherwise("fixed")).drop("tentative")


def lag_hours(commits: DataFrame, at: str, deployed: Column, counts: Column, now: Column) -> DataFrame:
    """(pending, hours): commits that count and are newer than the deployed one, and the age of the oldest."""
    late = commits.where((F.col(at) > deployed) & counts)
    return late.agg(F.count(F.lit(1)).alias("pending"), F.floor(F.timestamp_diff("MINUTE", F.min(at), now) / 60).alias("hours"))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
