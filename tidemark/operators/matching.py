"""Matching that names its reason: stages, duplicates across providers, rows used up once, positional differences."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import numbers
from . import blocks
from .lineage import cut
from .ranks import numbered


def first_reason(reasons: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first condition that holds, in order; null if none does."""
    return F.coalesce(*[F.when(holds, F.lit(name)) for name, holds in reasons])


def staged_match(stages: Sequence[tuple[str, DataFrame]], key: str, target: str, least: float = 0.5, lead: float = 0.1) -> DataFrame:
    """(key, target, stage) from candidate pairs (key, target, score) per stage. The first stage with pairs for a key
    decides: its best score must reach ``least`` and lead the next by ``lead``; otherwise the key stays unmatched."""
    rows = reduce(DataFrame.unionByName, [d.select(key, target, F.col("score").cast("double").alias("__score"), F.lit(i).alias("__rank"), F.lit(name).alias("stage")) for i, (name, d) in enumerate(stages)])
    per = rows.groupBy(key, target, "__rank", "stage").agg(F.max("__score").alias("__score"))
    per = per.withColumn("__first", F.min("__rank").over(W.partitionBy(key))).where("__rank = __first")
    w = W.partitionBy(key).orderBy(F.col("__score").desc(), target)
    per = per.withColumn("__next", F.lead("__score").over(w)).withColumn("__k", F.row_number().over(w))
    return per.where((F.col("__k") == 1) & (F.col("__score") >= least) & (F.col("__next").isNull() | (F.col("__score") - F.col("__next") >= lead))).select(key, target, "stage")


def same_start_nearby(rows: DataFrame, metres: float, same: Column | None = None) -> DataFrame:
    """(a, b, start): rows (id, provider, start, lat, lon) of different providers that start at once and are near; ``same``
    is a further test over columns of a and b other than id and provider. The start and a band of latitude, or the next one, are an equi-join, so only
    rows of one instant and about one latitude meet.

    Rows that differ in id and provider only are one class: the tests are made once per pair of classes, whose members are then paired in blocks.
    """
    band = F.floor(F.col("lat") / (metres / 111_000))
    shape = [c for c in rows.columns if c not in ("id", "provider")]
    classes = rows.groupBy(*shape).agg(F.count(F.lit(1)).alias("__n")).withColumn("__c", F.struct(*shape))
    a, b = classes.withColumn("__y", F.explode(F.array(band - 1, band, band + 1))).alias("a"), classes.withColumn("__y", band).alias("b")
    d = numbers.haversine_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    near = a.join(b, (F.col("a.start") == F.col("b.start")) & (F.col("a.__y") == F.col("b.__y"))).where(d <= metres)
    near = near if same is None else near.where(same)
    found = cut(near.select(F.col("a.__c").alias("x"), F.col("b.__c").alias("y"), F.col("a.__n").alias("n_left"), F.col("b.__n").alias("n_right"), F.col("a.start").alias("start")))
    members = blocks.blocks(rows.select(F.struct(*shape).alias("__c"), "id", "provider"), ["__c"], ["id", "provider"])
    pairs = blocks.class_pairs(members, found, "__c", "x", "y", ["start"])
    return pairs.where("l.provider < r.provider").select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), "start")


def left_uncovered(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Old rows without a new one, where each new row covers one old row of its keys at most (a multiset difference)."""
    nth = lambda d: d.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy(order)))
    return nth(old).join(nth(new).select(*keys, "__k"), [*keys, "__k"], "left_anti").drop("__k")


def append_only(before: DataFrame, after: DataFrame, position: str, digest: str) -> DataFrame:
    """(position, change): same, changed or removed where something stood before, appended beyond."""
    b, a = before.select(position, F.col(digest).alias("__b")), after.select(position, F.col(digest).alias("__a"))
    change = F.when(F.col("__b").isNull(), "appended").when(F.col("__a").isNull(), "removed").when(F.col("__a") == F.col("__b"), "same").otherwise("changed")
    return b.join(a, position, "full_outer").select(position, change.alias("change"))


def text_change(old: Column, new: Column, share: float = 0.2) -> Column:
    """same, similar (length within ``share``), shorter, longer; empty if nothing is left."""
    a, b = F.length(old), F.length(new)
    return F.when(old == new, "same").when(F.coalesce(b, F.lit(0)) == 0, "empty").when(b < a * (1 - share), "shorter").when(b > a * (1 + share), "longer").otherwise("similar")


def territory(inside: Column, outside: Column) -> Column:
    """in, out or unknown."""
    return F.when(F.coalesce(inside, F.lit(False)), "in").when(F.coalesce(outside, F.lit(False)), "out").otherwise("unknown")


def robots_allows(urls: DataFrame, rules: DataFrame, key: str, host: str, path: str) -> DataFrame:
    """(key, allowed): the longest rule (host, prefix, allow) that a path begins with wins, allow on a tie; without a rule yes."""
    u, r = urls.select(key, host, path), rules.select(F.col("host").alias(host), "prefix", "allow")
    hit = u.join(r, host).where(F.col(path).startswith(F.col("prefix"))).groupBy(key).agg(F.max_by("allow", F.struct(F.length("prefix"), "allow")).alias("allow"))
    return u.join(hit, key, "left").select(key, F.coalesce("allow", F.lit(True)).alias("allowed"))


def care_order(units: DataFrame, key: str, failing: Column, cared: Column) -> DataFrame:
    """(key, place): lasting failures first, then by the day of care (never: first), then key, numbered in ranges."""
    rows = units.select(key, F.when(failing, 0).otherwise(1).alias("__f"), cared.isNotNull().alias("__c"), cared.alias("__d"))
    return numbered(rows, [], ["__f", "__c", "__d", key], "place").select(key, F.col("place").cast("int").alias("place"))


def reachable(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """(node, depth): what is reached from ``start`` (node) over edges (frm, dst), with the fewest steps. Each round joins the
    newest nodes only; rounds end when nothing is new, or after ``most`` where it is given."""
    found = front = cut(start.select("node").distinct().withColumn("depth", F.lit(0)))
    for depth in count(1) if most is None else range(1, most + 1):
        front = cut(front.join(edges, F.col("node") == F.col("frm")).select(F.col("dst").alias("node")).distinct().join(found, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        found = found.unionByName(front)
        if depth % 10 == 0:  # a long way makes no long plan
            found = cut(found.repartition("node"))
    return found


def text_parts(text: Column, most: int) -> Column:
    """Lines packed in order into parts of ``most`` characters at most; a longer line is a part of its own."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    zero = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit(None).cast("string").alias("part"))

    def put(a: Column, line: Column) -> Column:
        fits = a["part"].isNotNull() & (F.length(a["part"]) + 1 + F.length(line) <= most)
        return F.struct(
            F.when(fits | a["part"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["part"])).alias("done"),
            F.when(fits, F.concat(a["part"], F.lit("\n"), line)).otherwise(line).alias("part"),
        )

    return F.aggregate(lines, zero, put, lambda a: F.array_append(a["done"], a["part"]))
