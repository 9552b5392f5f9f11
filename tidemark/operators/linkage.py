"""Snapshots and identity: differences, integrity, set similarity, stable ids, resting memory."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import idfn, textfn
from .joins import mutual_best, unique_pairs
from .lineage import cut


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): appeared, disappeared, changed or same."""
    b, a = before.select(key, F.col(digest).alias("__b")), after.select(key, F.col(digest).alias("__a"))
    change = F.when(F.col("__b").isNull(), "appeared").when(F.col("__a").isNull(), "disappeared").when(F.col("__a") == F.col("__b"), "same").otherwise("changed")
    return b.join(a, key, "full_outer").select(key, change.alias("change"))


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return rows.join(seen.select(key), key, "left_anti")


def carry_forward(now: DataFrame, before: DataFrame, resting: DataFrame, key: str, column: str, default: Column) -> DataFrame:
    """``column`` from the previous snapshot, else from the resting memory, else the default."""
    b = before.select(key, F.col(column).alias("__b"))
    r = resting.select(key, F.col(column).alias("__r"))
    return now.join(b, key, "left").join(r, key, "left").withColumn(column, F.coalesce("__b", "__r", default)).drop("__b", "__r")


def violations(rows: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """(key, rule): a row per broken rule; a rule that is null counts as broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return rows.select(F.col(key), F.explode(broken).alias("rule"))


def dangling(rows: DataFrame, key: str, refs: Mapping[str, tuple[str, DataFrame, str]]) -> DataFrame:
    """(key, rule) for references that lead nowhere: rule -> (column, table, its key)."""
    found = [rows.where(F.col(c).isNotNull()).join(t.select(F.col(k).alias(c)).distinct(), c, "left_anti").select(F.col(key), F.lit(rule).alias("rule")) for rule, (c, t, k) in refs.items()]
    return reduce(DataFrame.union, found)


def repeated_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def array_jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct members; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def shared_members(a: DataFrame, b: DataFrame, keys: Sequence[str], left: str, right: str, member: str) -> DataFrame:
    """Pairs within equal keys that share a member: (keys, left, right, shared, size_a, size_b, jaccard), by an inverted index.

    Where a side has one member, the pair meets once and shares one, so it is told where it meets. Only pairs of several members on
    both sides are grouped.
    """
    def sized(d: DataFrame, side: str, size: str) -> DataFrame:
        d = d.select(*keys, side, member).distinct()
        return d.withColumn(size, F.count(F.lit(1)).over(W.partitionBy(*keys, side)))

    a, b = sized(a, left, "size_a"), sized(b, right, "size_b")
    met = a.join(b, [*keys, member]).where("size_a = 1 or size_b = 1").select(*keys, left, right, F.lit(1).cast("long").alias("shared"), "size_a", "size_b")
    many = a.where("size_a > 1").join(b.where("size_b > 1"), [*keys, member])
    many = many.groupBy(*keys, left, right).agg(F.count(F.lit(1)).alias("shared"), F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"))
    return met.unionByName(many).withColumn("jaccard", F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared")))


def covers(shared: Column, size_a: Column, size_b: Column) -> Column:
    """Do two series count as one? At least 0.8 of the smaller shared, sizes within a factor of two, and three shared (or all)."""
    return (shared >= F.least(size_a, size_b) * 0.8) & (F.least(size_a, size_b) * 2 >= F.greatest(size_a, size_b)) & (shared >= F.least(F.lit(3), F.greatest(size_a, size_b)))


def link_stages(old: DataFrame, new: DataFrame, keys: Sequence[str], exact: str, member_old: DataFrame, member_new: DataFrame, least: float = 0.8) -> DataFrame:
    """(new_id, old_id, stage): stage 0 where the exact key stands once on either side; then, round by round until
    nothing changes, pairs strictly best for both by the Jaccard similarity of their members, at least ``least``.

    ``old`` (old_id, keys, exact), ``new`` (new_id, keys, exact); ``member_*`` (keys, id, member).
    """
    found = unique_pairs(old, new, [*keys, exact], "old_id", "new_id").select("new_id", "old_id", F.lit(0).alias("stage"))
    scored = shared_members(member_old, member_new, keys, "old_id", "new_id", "member").where(F.col("jaccard") >= least)
    scored = cut(scored)
    while True:
        rest = scored.join(found, "old_id", "left_anti").join(found, "new_id", "left_anti")
        more = mutual_best(rest, "old_id", "new_id", F.col("jaccard")).select("new_id", "old_id", F.lit(1).alias("stage"))
        more = cut(more)
        if more.isEmpty():
            break
        found = found.unionByName(more)
    return found


def assigned_ids(rows: DataFrame, key: str, used: DataFrame, row: str | None = None) -> DataFrame:
    """(key, id, seed), or (row, key, id, seed): short ids by hash of the key; an id claimed twice goes to the smallest row, others, and those
    whose id is in ``used``, try the next seed until every one has an id. Rows are the different keys, or what ``row`` names."""
    names = [key] if row is None else [row, key]
    left, done = cut(rows.select(*names).where(F.col(key).isNotNull()).distinct()), None
    for seed in count():
        tried = left.withColumn("id", idfn.short_id(F.col(key), seed)).withColumn("seed", F.lit(seed))
        free = tried.join(used.select("id"), "id", "left_anti")
        if done is not None:
            free = free.join(done.select("id"), "id", "left_anti")
        won = free.groupBy("id").agg(F.min(F.struct(key, *names[:-1])).alias("__w"), F.first("seed").alias("seed")).select(*[F.col(f"__w.{n}").alias(n) for n in names], "id", "seed")
        done = won if done is None else done.unionByName(won)
        done = cut(done)
        left = cut(left.join(done, names, "left_anti"))
        if left.isEmpty():
            break
    return done


def update_resting(memory: DataFrame, before: DataFrame, after: DataFrame, key: str, today: Column, days: int = 56) -> DataFrame:
    """Memory of vanished rows (key, since, last_start): they enter when they vanish with a start ahead, and leave when they
    return, after ``days`` days, or when no start is ahead."""
    gone = before.join(after.select(key), key, "left_anti").select(key, today.alias("since"), "last_start")
    kept = memory.join(after.select(key), key, "left_anti").join(gone.select(key), key, "left_anti").where(F.datediff(today, F.col("since")) < days)
    return kept.select(key, "since", "last_start").unionByName(gone).where(F.col("last_start") >= today)


def same_source_duplicates(rows: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of rows with an equal group the first by ``order``, with the number of rows it stands for."""
    w = W.partitionBy(*group)
    return rows.withColumn("__k", F.row_number().over(w.orderBy(*order))).withColumn("copies", F.count(F.lit(1)).over(w)).where("__k = 1").drop("__k")


def unique_both_ways(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs whose left and right stand in no other pair."""
    one = lambda side: pairs.groupBy(side).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").select(side)
    return pairs.join(one(left), left, "left_semi").join(one(right), right, "left_semi").select(*pairs.columns)


def link_by_title(old: DataFrame, new: DataFrame, keys: Sequence[str], similar: Column, least: float = 0.5) -> DataFrame:
    """(new_id, old_id): rows (id, keys, title, days: array) of equal keys with ``similar`` titles (over old_title and
    new_title) that share ``least`` of their days or begin on one day, where neither side has another such partner.

    Rows of equal keys, title and days are one class. Classes meet on a common day and are compared once; how many partners a row has follows
    from the classes' sizes, so rows never meet.
    """
    shape = lambda d, side: d.select(f"{side}_id", F.struct(*keys).alias("__k"), F.struct("title", "days").alias(f"__{side}"))
    member = F.explode("days") if least > 0 else F.lit(True)  # a share above 0 and a first day in common both need a common day

    def classes(d: DataFrame, side: str) -> DataFrame:
        known = d.where(reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])) if keys else d
        counted = shape(known, side).groupBy("__k", f"__{side}").agg(F.count(F.lit(1)).alias(f"n_{side}"))
        return counted.withColumn("days", F.col(f"__{side}.days")).select("__k", f"__{side}", f"n_{side}", member.alias("day"))

    o, n = classes(old, "old"), classes(new, "new")
    met = o.join(n, (o["__k"] == n["__k"]) & o["day"].eqNullSafe(n["day"])).select(o["__k"], "__old", "__new", "n_old", "n_new").distinct()
    p, q = F.col("__old.days"), F.col("__new.days")
    met = met.where((array_jaccard(p, q) >= least) | (F.array_min(p) == F.array_min(q))).withColumns({"old_title": F.col("__old.title"), "new_title": F.col("__new.title")})
    met = cut(met)
    alike = cut(met.select("old_title", "new_title").distinct())  # written, or the test would be moved before the distinct rows
    alike = alike.where(similar).toDF("__t", "__u")
    found = cut(met.join(alike, F.col("old_title").eqNullSafe(F.col("__t")) & F.col("new_title").eqNullSafe(F.col("__u")), "left_semi").select("__k", "__old", "__new", "n_old", "n_new"))

    def alone(d: DataFrame, side: str, other: str) -> DataFrame:
        """Ids with one partner in all, with both classes."""
        per = found.groupBy("__k", f"__{side}").agg(F.sum(f"n_{other}").alias("n"), F.first(f"__{other}").alias(f"__{other}"))
        rows = shape(d, side).join(per, ["__k", f"__{side}"]).groupBy(f"{side}_id").agg(F.sum("n").alias("n"), F.first(F.struct("__k", "__old", "__new")).alias("pair"))
        return rows.where("n = 1").select(f"{side}_id", "pair")

    return alone(new, "new", "old").join(alone(old, "old", "new"), "pair").select("new_id", "old_id")


def one_unit_per_row(rows: DataFrame, key: Sequence[str], unit: str, failed: Column, fit: Column, order: Column) -> DataFrame:
    """Rows that several units report, each with one unit only: one that didn't fail, then of the best fit, then with the
    most rows, then first in order."""
    sizes = rows.groupBy(F.col(unit).alias("__u")).agg(F.count(F.lit(1)).alias("__n"))  # joined: a window over units would sort all rows once more
    w = W.partitionBy(*key).orderBy(failed.cast("int"), fit.desc(), F.col("__n").desc(), order, F.col(unit))
    return rows.join(sizes, F.col(unit).eqNullSafe(F.col("__u"))).withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__u", "__n", "__k")
