"""Sharding by weighted rendezvous hashing of stable record keys, in SQL functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless, sub_groups


def rendezvous(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """Shard 0 .. len(weights)-1 of a key: every shard draws a score from (key, shard), the best wins.

    A score depends on its own shard's weight alone, so one more shard can only take keys, and a
    shard that goes gives its keys to the others by weight. Shards of weight 0 get nothing. A null
    key is a key of its own. Equal scores go to the larger shard.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be non-negative, with one above 0")
    text = F.coalesce(key.cast("string"), F.lit("\x00"))
    scores = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            bits = F.shiftrightunsigned(F.xxhash64(text, F.lit(shard), F.lit(seed)), 11)
            unit = (bits + F.lit(0.5)) * F.lit(2.0**-53)
            scores.append(F.struct((F.log(unit) / F.lit(float(weight))).alias("score"), F.lit(shard).alias("shard")))
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]


def shard(docs: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None, columns: Sequence[Column] = (), seed: int = 0) -> DataFrame:
    """Per row its key, ``columns``, ``shard`` and the gapless place ``slot`` in it; ``grown_shard`` under ``grown``.

    Null keys share one shard. Rows of equal keys share a shard and stand by the other columns; identical rows stand in any order,
    which makes no difference. A shard is numbered in parts dealt by all these columns, so that no null or repeated key makes a large one.
    Empty input gives no rows; other columns of ``docs`` are left out, and names of ``columns`` must not be key, shard or slot.
    """
    parts = sub_groups(docs.count(), len(weights))
    placed = docs.select(F.col(key), *columns, rendezvous(F.col(key), weights, seed).alias("shard"))
    if grown is not None:
        placed = placed.withColumn("grown_shard", rendezvous(F.col(key), grown, seed))
    others = [c for c in placed.columns if c not in (key, "shard")]
    part = F.pmod(F.xxhash64(F.col(key), *map(F.col, others), F.lit("part")), F.lit(parts)).cast("int")
    return gapless(placed.withColumn("__part", part), ["shard"], "__part", [F.col(key), *map(F.col, others)], "slot").drop("__part")
