"""Mixing sources to target weights: exact block quotas dealt to shards by a splitting tree."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bounded, drop, gapless, word_count, written

GROUPS = 256  # into which sources are hashed, so that a node of the tree splits a bounded number of quotas on the driver
SMALL = 10_000  # rows per source or block that are broadcast at most


def split_quotas(quotas: Sequence[int], leaves: Sequence[int], seed: int | Sequence[int]) -> np.ndarray:
    """Blocks of each source (column) for each shard (row) by a tree of multivariate-hypergeometric splits.

    ``leaves`` are the shards' totals. A node halves its shards; the left half's blocks are drawn without replacement
    from the node's, so totals per source and per shard are exact.
    """
    rng = np.random.default_rng(seed)
    out = np.zeros((len(leaves), len(quotas)), dtype=np.int64)

    def go(lo: int, hi: int, has: np.ndarray) -> None:
        if hi - lo == 1 or not has.sum():
            out[lo] = has
            return
        mid = (lo + hi) // 2
        take, rest = int(sum(leaves[lo:mid])), int(has.sum())
        left = np.zeros_like(has)
        for i, n in enumerate(has):
            if take:
                left[i] = rng.hypergeometric(int(n), rest - int(n), take) if n and rest > n else min(int(n), take)
            rest -= int(n)
            take -= int(left[i])
        go(lo, mid, left)
        go(mid, hi, has - left)

    if len(leaves) and len(quotas):
        go(0, len(leaves), np.asarray(quotas, dtype=np.int64))
    return out


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, limit: float) -> DataFrame:
    """``sources`` (__source, n, __total) with ``target``: ``share`` times all sizes, dealt by weight, sources in code point order
    (null last) taking ``weights`` in turn; a source stops at ``limit`` times its size, and the rest is dealt again by weight until
    none is above. A source of size 0 gets 0. Sources are ranked in parts and their sums taken by Spark, however many there are.
    """
    order = [F.col("__source").isNull(), F.col("__source")]
    parts = max(1, sources.count() // 100_000)
    ranged = written(sources.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()).withColumn("__all", F.lit(0)))
    ranked = gapless(ranged, ["__all"], "__part", order, "__rank").drop("__part", "__all")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    weighed = written(ranked.withColumn("__weight", weight).drop("__rank"))
    first = weighed.agg(F.sum("__total").alias("size"), F.sum("__weight").alias("weight")).first()
    goal, stopped, free = share * (first["size"] or 0), 0, first["weight"] or 0.0
    while True:
        rate = (goal - limit * stopped) / free if free > 0 else float("inf")
        over = F.lit(rate) * F.col("__weight") >= F.lit(float(limit)) * F.col("__total")
        r = weighed.agg(F.coalesce(F.sum(F.when(over, F.col("__total"))), F.lit(0)).alias("size"), F.coalesce(F.sum(F.when(~over, F.col("__weight"))), F.lit(0.0)).alias("weight")).first()
        if (r["size"], r["weight"]) == (stopped, free) or free == 0:
            break
        stopped, free = r["size"], r["weight"]
    return weighed.withColumn("target", F.when(over, F.lit(float(limit)) * F.col("__total")).otherwise(F.lit(rate) * F.col("__weight"))).drop("__weight")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``__n``: 0, or for rows of equal ``__k`` their number. Only these are ranked, in parts."""
    again = written(rows.groupBy("__k").agg(F.count(F.lit(1)).alias("__c")).where("__c > 1").select("__k", F.lit(True).alias("__again")))
    if again.isEmpty():
        return rows.withColumn("__n", F.lit(0).cast("long"))
    marked = rows.join(bounded(again, 1_000_000), "__k", "left")
    twice = written(marked.where("__again").drop("__again").withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.lit(64))))
    once = marked.where("__again is null").drop("__again").withColumn("__n", F.lit(0).cast("long"))
    return once.unionByName(gapless(twice, ["__k"], "__part", [F.col("__part")], "__n").drop("__part"))


def _keyed(docs: DataFrame, doc_id: str, source: str, text: str) -> Column:
    """What a row is told apart by: id, source and whole text."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(source).cast("string"), F.col(text).cast("string"))


def _filled(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one block of documents in permuted order: those that still fit in the source's rest."""
    rows = rows.sort_values(["__h", "__k", "__n"])
    left, extra = int(rows["__left"].iloc[0]), []
    for size in rows["__size"]:
        extra.append(size <= left)
        left -= int(size) if size <= left else 0
    return rows.assign(__extra=extra)[["__k", "__n", "__extra"]]


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, shards: int = 16, seed: int = 0, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """A row per document: __doc, __source, __size, __k, __n, __block, source_size, target, copies (int), places array<struct<pass, shard, place>>.

    ``source_targets`` says how much of each source. One of target/size ratio r is taken floor(r) times in whole; the rest of its target
    is met by blocks of documents in permuted order, the block at the border document by document, as long as they fit. No
    document exceeds ceil(limit) copies. A source's blocks number about the root of its documents, so neither the blocks of a
    source nor the documents of a block make a large group. A tree deals each source's blocks to the shards: exact totals
    per source, at most one block of difference between shards. Inside a shard documents stand by ``place``, a random order.

    The choice depends on ids, sources, texts and ``seed``: reruns agree. Null ids and repeated rows are documents of their own
    (equal rows are interchangeable); null text has size 0; very long texts count in whole. Sources of size 0 have a target of
    0, their documents no copy. Nothing per document, source or block comes to the driver. Empty input gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("__doc"), F.col(source).cast("string").alias("__source"), word_count(F.col(text)).alias("__size"), _keyed(docs, doc_id, source, text).alias("__k"))
    first = written(rows)
    kept = written(_numbered(first))
    drop(first)
    rows = kept.withColumn("__h", F.xxhash64("__k", "__n", F.lit(seed)))
    stats = rows.groupBy("__source").agg(F.count(F.lit(1)).alias("n"), F.sum("__size").alias("__total"))
    per = source_targets(stats, weights, share, limit)
    whole = F.when(F.col("__total") > 0, F.least(F.floor(F.col("target") / F.col("__total")), F.lit(int(limit)))).otherwise(0).cast("int")
    per = per.withColumn("__whole", whole).withColumn("__rest", F.round(F.col("target") - F.col("__whole") * F.col("__total")).cast("long"))
    per = written(per.withColumn("__blocks", F.ceil(F.sqrt("n")).cast("int")).withColumnRenamed("__total", "source_size").drop("n"))
    p, r = bounded(per, SMALL).alias("p"), rows.alias("r")
    placed = r.join(p, F.col("r.__source").eqNullSafe(F.col("p.__source"))).select("r.*", *[f"p.{c}" for c in per.columns if c != "__source"])
    placed = written(placed.withColumn("__block", F.pmod(F.xxhash64("__h", F.lit("block")), F.col("__blocks")).cast("int")))
    drop(kept)
    blocks = placed.groupBy("__source", "__block").agg(F.sum("__size").alias("words"), F.first("__rest").alias("rest"), F.first("__whole").alias("whole"))
    order = W.partitionBy("__source").orderBy(F.xxhash64("__block", F.lit(seed), F.lit("order")), "__block")
    before = F.coalesce(F.sum("words").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left, held = F.col("rest") - before, F.count(F.lit(1)).over(W.partitionBy("__source"))
    state = F.when(left <= 0, "none").when(F.col("words") <= left, "full").otherwise("part")
    blocks = written(blocks.select("__source", "__block", "whole", (F.row_number().over(order) - 1).alias("rank"), held.alias("held"), left.alias("left"), state.alias("state")))
    bounds = _dealt(blocks, shards, seed)
    b, q = blocks.alias("b"), bounded(bounds, SMALL).alias("q")
    taken = b.join(q, F.col("b.__source").eqNullSafe(F.col("q.s"))).drop("s")
    # A source's draws number its passes in whole, block by block, and then the rest.
    passes = F.expr("transform(if(state = 'none', if(whole > 0, sequence(0, whole - 1), cast(array() as array<int>)), sequence(0, whole)), p -> named_struct('pass', p, 'shard', size(filter(bounds, x -> x <= p * held + rank))))")
    taken = written(taken.select("__source", "__block", "state", "left", passes.alias("passes")))
    k, t = placed.alias("k"), bounded(taken, SMALL).alias("t")
    both = k.join(t, F.col("k.__source").eqNullSafe(F.col("t.__source")) & (F.col("k.__block") == F.col("t.__block"))).select("k.*", "t.state", F.col("t.left").alias("__left"), "t.passes")
    both = written(both)
    drop(placed, blocks, taken)
    border = both.where("state = 'part'")
    chosen = border.select("__k", "__n", "__source", "__block", "__size", "__h", "__left").groupBy("__source", "__block").applyInPandas(_filled, "__k long, __n long, __extra boolean")
    part = border.join(chosen, ["__k", "__n"]).withColumn("passes", F.expr("if(__extra, passes, filter(passes, p -> p.pass < __whole))")).drop("__extra")
    done = part.unionByName(both.where("state != 'part'").select(*part.columns))
    places = F.expr("transform(passes, p -> named_struct('pass', p.pass, 'shard', p.shard, 'place', xxhash64(__h, p.pass)))")
    return done.select("__doc", "__source", "__size", "__k", "__n", "__block", "source_size", "target", F.size("passes").alias("copies"), places.alias("places"))


def _dealt(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """(s, bounds): of each source's draws the first number of each next shard. Quotas of groups of sources are split on the
    driver, a group's among its sources in a task: both are splits of one tree, as a part of a multivariate-hypergeometric draw is one again."""
    draws = blocks.groupBy("__source").agg((F.max("whole") * F.count(F.lit(1)) + F.count_if(F.col("state") != "none")).cast("long").alias("draws"))
    draws = written(draws.withColumn("grp", F.pmod(F.xxhash64("__source"), F.lit(GROUPS)).cast("int")))
    quotas = {r["grp"]: r["draws"] for r in draws.groupBy("grp").agg(F.sum("draws").alias("draws")).collect()}  # GROUPS rows at most
    groups, total = sorted(quotas), sum(quotas.values())
    leaves = [total * (k + 1) // shards - total * k // shards for k in range(shards)]
    share = dict(zip(groups, split_quotas([quotas[g] for g in groups], leaves, seed).T.tolist(), strict=True))

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__source", na_position="last")
        g = int(rows["grp"].iloc[0])
        split = split_quotas(rows["draws"].tolist(), share[g], (seed, g)).cumsum(axis=0)
        return pd.DataFrame({"s": rows["__source"].to_numpy(), "bounds": split.T.tolist()})

    return written(draws.groupBy("grp").applyInPandas(deal, "s string, bounds array<long>"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as they are taken, shard by shard, shuffled inside each. All columns stay,
    whatever their names."""
    doc_id, source, text = (options.get(k, k) for k in ("doc_id", "source", "text"))
    plan = mix(docs, **options).where("copies > 0").select("__k", "__n", F.col("__doc").alias("__id"), "places")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), F.col(doc_id).cast("long").alias("__doc"), _keyed(docs, doc_id, source, text).alias("__k"))
    out = _numbered(rows).join(plan, ["__k", "__n"]).where(F.col("__doc").eqNullSafe(F.col("__id"))).select("__row", F.explode("places").alias("__at"))
    out = out.repartition(F.col("__at.shard"), F.pmod(F.col("__at.place"), F.lit(16))).sortWithinPartitions("__at.shard", "__at.place")
    return out.select("__row.*")
