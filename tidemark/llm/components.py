"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written

HEAVY = 500  # about so many centres at most hold their share of the rows or more


def _with_least(edges: DataFrame, least: DataFrame, bar: int | None) -> DataFrame:
    """``edges`` (u, v) with ``m`` of ``least`` (u, m, n). Centres with ``bar`` edges or more, of which there are HEAVY at most (each edge has two ends), are
    broadcast, so that none of them gathers its edges in one task; the others are joined. No bar: there is no such centre."""
    if bar is None:
        return edges.join(least.select("u", "m").hint("merge"), "u")
    heavy = F.broadcast(least.where(F.col("n") >= bar).select("u", F.col("m").alias("__m")))
    light = least.where(F.col("n") < bar).select("u", "m")
    marked = edges.join(heavy, "u", "left")
    return marked.where("__m is not null").select("u", "v", F.col("__m").alias("m")).unionByName(marked.where("__m is null").select("u", "v").join(light.hint("merge"), "u"))


def _large_star(edges: DataFrame, bar: int | None) -> DataFrame:
    both = edges.union(edges.select("v", "u").toDF("u", "v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _with_least(both, least, bar).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, bar: int | None) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return _with_least(down, least, bar).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def _shape(edges: DataFrame) -> tuple[int, int, bool]:
    """(edges, the most of one end, is it done: every end points at one other at most, which points at none)."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    per = ends.groupBy("id").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    open_ = F.count_if((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0))
    r = per.agg(F.coalesce(F.sum("up"), F.lit(0)).alias("rows"), F.coalesce(F.max(F.col("up") + F.col("down")), F.lit(0)).alias("most"), open_.alias("open")).first()
    return r["rows"], r["most"], not r["open"]


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for every end of an edge (u, v: long) the smallest id that it is connected with.

    Each half of a round is written to the shared folder; the rounds grow with the logarithm of a component's width. Loops (u = v) and
    repeated edges make no difference; without edges there are no rows.
    """
    now = written(edges.select("u", "v").where("u != v").distinct())
    rows, most, _ = _shape(now)
    done = not rows
    while not done:
        bar = max(64, 2 * rows // HEAVY)
        bar = bar if most >= bar else None
        # Either star is written, so that no plan holds both: small plans keep the driver small.
        large = written(_large_star(now, bar).where("u != v").distinct())
        drop(now)
        now = written(_small_star(large, bar).where("u != v").distinct())
        drop(large)
        rows, most, done = _shape(now)
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component"))
    out = now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots).distinct()
    out._scratch = now._scratch  # for ``drop``, once the components have been written elsewhere
    return out
