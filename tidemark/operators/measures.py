"""Quotas, seeded samples, precision and recall, costs, roll-ups of states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def largest_remainder(sizes: DataFrame, key: str, size: str, n: int) -> DataFrame:
    """(key, quota): ``n`` places by size with largest remainders, ties to the larger size and smaller key; no quota above its size.
    ``sizes`` has a row per stratum; they are few, and are ranked together."""
    total = sizes.agg(F.sum(size).alias("__t"))
    q = sizes.crossJoin(F.broadcast(total)).withColumn("__x", F.least(F.lit(n), F.col("__t")) * F.col(size) / F.col("__t")).withColumn("__f", F.floor("__x").cast("long"))
    left = q.agg((F.least(F.lit(n), F.first("__t")) - F.sum("__f")).alias("__left"))
    rank = F.row_number().over(W.orderBy((F.col("__x") - F.col("__f")).desc(), F.col(size).desc(), F.col(key)))
    q = q.withColumn("__r", rank).crossJoin(F.broadcast(left))
    return q.select(key, F.least(F.col(size), F.col("__f") + (F.col("__r") <= F.col("__left")).cast("long")).alias("quota"))


def stratified(rows: DataFrame, key: str, stratum: str, quotas: DataFrame, draw: Column, most: int) -> DataFrame:
    """Per stratum as many rows as its quota, ``most`` at most, smallest ``draw`` first (a hash of key and seed): reruns agree.

    ``most`` is a constant bound of all quotas: with it each task keeps no more rows of a stratum before the shuffle."""
    w = W.partitionBy(stratum).orderBy(draw, key)
    first = rows.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most)
    return first.join(F.broadcast(quotas), stratum).where(F.col("__k") <= F.col("quota")).drop("__k", "quota")


def precision_recall(rows: DataFrame, predicted: Column, expected: Column, group: Sequence[str] = ()) -> DataFrame:
    """Micro-averaged counts and shares; a share without a base is null."""
    hits, p, e = F.count_if(predicted & expected), F.count_if(predicted), F.count_if(expected)
    share = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    return rows.groupBy(*group).agg(hits.alias("hits"), p.alias("predicted"), e.alias("expected"), share(hits, p).alias("precision"), share(hits, e).alias("recall"))


def funnel(rows: DataFrame, group: Sequence[str], rank: Column, stages: Sequence[str]) -> DataFrame:
    """Per group how many rows got at least to each stage (1, 2, ...)."""
    return rows.groupBy(*group).agg(*[F.count_if(rank >= i + 1).alias(name) for i, name in enumerate(stages)])


def cost_summary(calls: DataFrame, by: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Totals per combination and over all (nulls count as 0), by grouping sets in one pass."""
    return calls.rollup(*by).agg(F.count(F.lit(1)).alias("calls"), *[F.round(F.sum(F.coalesce(F.col(c), F.lit(0))), 6).alias(c) for c in sums])


def running_limit(calls: DataFrame, order: Sequence[str], amount: Column, limit: float, part: str) -> DataFrame:
    """Per ``part`` the calls that were made before the running sum passed the limit."""
    w = W.partitionBy(part).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return calls.withColumn("running", F.sum(amount).over(w)).where(F.col("running") <= limit)


def worst_state(rows: DataFrame, group: Sequence[str], state: Column) -> DataFrame:
    """Roll-up of unit states: failed if all failed, partial if some did, empty if all are empty, else ok."""
    failed, empty = F.count_if(state == "failed"), F.count_if(state == "empty")
    n = F.count(F.lit(1))
    return rows.groupBy(*group).agg(n.alias("units"), F.when(failed == n, "failed").when(failed > 0, "partial").when(empty == n, "empty").otherwise("ok").alias("status"))


def verdict(failed: Column, total: Column, share: float = 0.2) -> Column:
    """Traffic light: red above ``share`` failed, yellow with any, else green."""
    return F.when(failed > total * share, "red").when(failed > 0, "yellow").otherwise("green")


def plausible(current: Column, deployed: Column) -> Column:
    """Has the count not fallen by more than half?"""
    return current * 2 >= deployed


def graded_cases(expected: DataFrame, predicted: DataFrame, keys: Sequence[str], similar: Column) -> DataFrame:
    """Per case how many predicted rows (pred_id, title) meet an expected one (exp_id, title) of equal keys, one to one,
    similar titles first; with both totals. ``keys`` begin with the case; ``similar`` is over exp_title and pred_title."""
    from .joins import greedy_pairs

    case = keys[0]
    e = expected.select("exp_id", *keys, F.col("title").alias("exp_title"))
    p = predicted.select("pred_id", *keys, F.col("title").alias("pred_title"))
    pairs = e.join(p, list(keys)).select(*keys, "exp_id", "pred_id", F.coalesce(similar, F.lit(False)).cast("int").alias("score"))
    hits = greedy_pairs(pairs, keys, "exp_id", "pred_id", "score").groupBy(case).agg(F.count(F.lit(1)).alias("hits"))
    per = lambda d, name: d.groupBy(case).agg(F.count(F.lit(1)).alias(name))
    return per(e, "expected").join(per(p, "predicted"), case, "full_outer").join(hits, case, "left").na.fill(0)
