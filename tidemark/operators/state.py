"""Per-unit state advanced once a run: refresh decisions, collapse guard, counters with rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collapsed(old: Column, new: Column) -> Column:
    """Fewer than half of three or more, or nothing left of any."""
    return ((old >= 3) & (new * 2 < old)) | ((old >= 1) & (new == 0))


def plan_refresh(units: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """(key, action) from the state (digest, held, pending) and what was fetched (digest, failed, empty).

    In this order: failed, same as the state: unchanged, same as the held one: held, same as the pending one: adopt (seen
    twice), empty, else extract. Units that weren't fetched are missing.
    """
    u, f = units.select(key, F.col("digest").alias("__d"), "held", "pending"), fetched.select(key, "digest", "failed", "empty", F.lit(True).alias("__f"))
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    action = F.when(F.col("__f").isNull(), "missing").when(F.col("failed"), "failed").when(same("digest", "__d"), "unchanged").when(same("digest", "held"), "held").when(same("digest", "pending"), "adopt").when(F.col("empty"), "empty").otherwise("extract")
    return u.join(f, key, "full_outer").select(key, action.alias("action"))


def failure_streak(failing_since: Column, failed: Column, same_class: Column, today: Column) -> Column:
    """Day since when a unit fails: kept through a streak, new when the failure's class changes, null when it works."""
    return F.when(~failed, None).when(same_class, F.coalesce(failing_since, today)).otherwise(today)


def tombstone(failing_since: Column, permanent: Column, today: Column, days: int = 14) -> Column:
    return F.coalesce(permanent & (F.datediff(today, failing_since) >= days), F.lit(False))


def same_dated_key(stored: Column, now: Column, today: Column) -> Column:
    """Are two maps date -> digest equal, without the days before today?"""
    ahead = lambda m: F.array_sort(F.map_entries(F.map_filter(m, lambda d, _: d >= today)))
    return ahead(stored) == ahead(now)


def counted(cases: DataFrame, finds: DataFrame, key: str, today: Column, most: int = 3, rest: int = 35) -> DataFrame:
    """Open cases (key, n, suspended_until) after new finds: each adds 1; at ``most`` a case rests for ``rest`` days."""
    add = finds.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    both = cases.join(add, key, "full_outer")
    n = F.coalesce("n", F.lit(0)) + F.coalesce("__n", F.lit(0))
    until = F.when((n >= most) & F.col("suspended_until").isNull(), F.date_add(today, rest)).otherwise(F.col("suspended_until"))
    return both.select(key, n.cast("long").alias("n"), until.alias("suspended_until"))


def upsert(old: DataFrame, new: DataFrame, key: str, seen: str, today: Column, rest: int = 56) -> DataFrame:
    """New rows replace old ones of their key; old ones stay for ``rest`` days after they were last seen."""
    kept = old.join(new.select(key), key, "left_anti").where(F.datediff(today, F.col(seen)) < rest)
    return new.unionByName(kept)
