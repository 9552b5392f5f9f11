"""Exact top-k inner-product search over buckets of vectors of like length."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import drop, written

SHRINK = 0.9  # within a bucket no vector is shorter than this share of the longest
FOCUS = 4  # coordinates looked at for pruning
BLOCK, QUERY_BLOCK = 2048, 1024
LEAST = -(2**63)  # scores beyond 64 bits are cut to the ends of their range
_PAIRS = "query_id long, vec_id long, score long"


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, x as double, as whole doubles; null if the vector or a component is null or not finite."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))) & (F.abs(x * scale) != F.lit(float("inf"))))
    whole = lambda x: F.when(F.abs(x) < F.lit(2.0**53), F.floor(x).cast("double")).otherwise(x)  # noqa: E731  a larger double is whole
    return F.when(fine, F.transform(v, lambda x: whole(x * scale)))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(ids) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def search_block(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Candidates of one block that can be among a query's k best, with their exact products.

    ``floor`` of a query is a product that k rows reach at least. With lengths taken out it is a
    least cosine for this block: over 1, the block is passed over (length). Otherwise either the
    shorter rows (length) or rows outside the range that the cosine leaves for the query's largest
    coordinates (coordinate) are pruned, whichever leaves fewer; products decide on the rest.
    """
    ids = rows["vec_id"].to_numpy()
    x = np.array(rows["v"].tolist(), dtype=np.float64).reshape(len(rows), -1)
    lengths = np.sqrt((x**2).sum(axis=1))
    order = np.argsort(-lengths, kind="stable")
    ids, x, lengths = ids[order], x[order], lengths[order]
    unit = x / np.maximum(lengths, 1e-300)[:, None]
    by_coordinate = np.argsort(unit, axis=0, kind="stable") if x.shape[1] else np.zeros((len(x), 0), np.int64)
    sorted_unit = np.take_along_axis(unit, by_coordinate, axis=0)
    largest = float(np.abs(x).max(initial=0)) * max((float(np.abs(q).max(initial=0)) for q in queries["v"]), default=0.0) * max(1, x.shape[1])
    in_float = largest < 2**52  # every product and partial sum is a whole double; otherwise Python's integers count
    prune = largest < 1e300 and np.isfinite(lengths).all()
    exact = None if in_float else np.array([[int(c) for c in row] for row in x], dtype=object).reshape(x.shape)
    out_q, out_v, out_s = [], [], []
    for qid, q, floor in zip(queries["query_id"], queries["v"], queries["floor"], strict=True):
        q = np.asarray(q, dtype=np.float64)
        size = math.sqrt(float((q**2).sum()))
        at: np.ndarray | slice = slice(None)
        floor = None if floor is None or pd.isna(floor) or floor <= LEAST else int(floor)
        if floor is not None and floor > 0 and prune:
            if not size or not lengths[0]:
                continue
            t = floor / (size * lengths[0]) - 1e-9
            if t > 1:
                continue
            n = int(np.searchsorted(-lengths, -(floor / size) * (1 - 1e-9), side="right"))
            if t > 0:
                focus = np.argsort(-np.abs(q))[:FOCUS]
                ranges = []
                for f in focus:
                    c = q[f] / size
                    spread = math.sqrt(max(0.0, (1 - c * c) * (1 - t * t)))
                    # The bound holds for cosines of t and more; beyond an angle of 0 or pi the edge is 1 or -1.
                    low = -1.0 if c <= -t else c * t - spread
                    high = 1.0 if c >= t else c * t + spread
                    lo, hi = np.searchsorted(sorted_unit[:, f], (low - 1e-9, high + 1e-9), side="left")
                    ranges.append((int(hi - lo), int(f), int(lo), int(hi)))
                fewest = min(ranges, default=None)
                if fewest and fewest[0] < n:
                    near = by_coordinate[fewest[2] : fewest[3], fewest[1]]
                    at = near[near < n]
                else:
                    at = slice(0, n)
            else:
                at = slice(0, n)
        if in_float:
            scores = np.rint(x[at] @ q).astype(np.int64)
        else:
            whole = [int(c) for c in q]
            scores = np.array([min(max(sum(a * b for a, b in zip(row, whole, strict=True)), LEAST), -1 - LEAST) for row in exact[at]], dtype=np.int64)
        own = ids[at] != qid
        found, scores = ids[at][own], scores[own]
        if floor is not None:
            good = scores >= floor
            found, scores = found[good], scores[good]
        for i in _best(found, scores, k):
            out_q.append(qid), out_v.append(found[i]), out_s.append(scores[i])
    return pd.DataFrame({"query_id": np.array(out_q, np.int64), "vec_id": np.array(out_v, np.int64), "score": np.array(out_s, np.int64)})


def _length(v: str = "v") -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k largest integer products, ties to the smaller vec_id.

    ``queries`` (query_id, v) and ``rows`` (vec_id, v) hold vectors of whole doubles. A query meets rows of other ids and of its own
    dimension; rows with a null id or vector take no part; a zero vector does. Rows that share a vec_id count each. Queries that share an id
    are one query, with the results of all their vectors. Products are exact whatever the size of the components; a score beyond
    64 bits is cut to the end of its range. Fewer than k rows: all of them. Empty tables give no rows; other columns are ignored.

    Rows stand in buckets by length, cut into blocks of bounded size, which queries meet in chunks. The first blocks of the longest
    buckets give every query a floor, the rest of these buckets a better one; a block is sent on only with the queries that its greatest length
    lets reach their floor, and within it lengths or coordinates prune.
    """
    spark = rows.sparkSession
    length = _length()
    bucket = F.when(length > 0, F.floor(-F.log(length) / F.lit(-math.log(SHRINK)))).otherwise(F.lit(1 << 40)).cast("long")
    base = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).select(F.col("vec_id").cast("long"), F.col("v").cast("array<double>").alias("v"))
    base = written(base.select("*", F.size("v").alias("dim"), bucket.alias("bucket"), length.alias("length")))
    counts = base.groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias("count"), F.max("length").alias("top")).collect()  # a row per length class of each dimension
    plan, ahead = [], Counter()  # of each dimension the longest buckets lead until they hold some rows more than k
    for r in sorted(counts, key=lambda r: (r["dim"], r["bucket"])):
        plan.append((r["dim"], r["bucket"], -(-r["count"] // BLOCK), ahead[r["dim"]] < 4 * (k + 1), r["top"]))
        ahead[r["dim"]] += r["count"]
    if not plan:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = F.broadcast(spark.createDataFrame(plan, "dim int, bucket long, blocks int, leads boolean, top double"))
    placed = written(base.drop("length").join(blocks.drop("top"), ["dim", "bucket"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")))
    drop(base)
    asked = queries.where(F.col("query_id").isNotNull() & F.col("v").isNotNull()).select(F.col("query_id").cast("long"), F.col("v").cast("array<double>").alias("v"))
    asked = written(asked.dropDuplicates(["query_id", "v"]).select("*", F.size("v").alias("dim"), length.alias("length")))
    chunks = -(-asked.count() // QUERY_BLOCK) or 1
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("query_id", F.lit("chunk")), F.lit(chunks)).cast("int"))
    keys = ["dim", "bucket", "block", "chunk"]
    nth = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")

    def run(q: DataFrame, of: DataFrame) -> DataFrame:
        """What the queries (with floor, bucket and block) find in the blocks that they name."""
        q = written(q.select("query_id", "v", "floor", *keys))
        named = q.select(*[F.col(c).alias(f"__{c}") for c in keys]).distinct()
        same = [F.col(c) == F.col(f"__{c}") for c in keys[:3]]
        spread = of.select("vec_id", "v", *keys[:3]).join(named, same).select("vec_id", "v", *keys[:3], F.col("__chunk").alias("chunk"))

        def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            return search_block(a, b, k) if len(a) and len(b) else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

        found = written(q.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(one, _PAIRS))
        drop(q)
        return found

    def floored(found: DataFrame) -> DataFrame:
        """Queries with their k-th best score so far, and the blocks that can hold a better one."""
        floors = found.withColumn("rn", F.row_number().over(nth)).where(F.col("rn") == k).select("query_id", F.col("score").alias("floor"))
        q = asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(LEAST))).join(blocks, "dim")  # no null: floors stay whole numbers in tasks
        reach = (F.col("floor") <= 0) | ~(F.col("floor") > F.col("length") * F.col("top") * (1 + 1e-9))
        return q.where(reach)

    def in_blocks(q: DataFrame, first: int) -> DataFrame:
        return q.where(F.col("blocks") > first).withColumn("block", F.explode(F.sequence(F.lit(first), F.col("blocks") - 1)))

    start = asked.withColumn("floor", F.lit(LEAST)).join(blocks.where("leads"), "dim").withColumn("block", F.lit(0))
    found = run(start, placed.where("leads and block = 0"))
    if any(p[3] and p[2] > 1 for p in plan):
        found = found.unionByName(run(in_blocks(floored(found).where("leads"), 1), placed.where("leads and block > 0")))
    if not all(p[3] for p in plan):
        found = found.unionByName(run(in_blocks(floored(found).where("not leads"), 0), placed.where("not leads")))
    return found.withColumn("rank", F.row_number().over(nth)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
