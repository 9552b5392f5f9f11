"""Work that grows with the rows, not with their pairs: what is compared, joined or grouped is counted."""

import random
from datetime import date, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks, joins, linkage, matching, offer_build, transit


@pytest.fixture
def counted(spark):
    """A test of two columns for equality, and the number of pairs it was asked about."""
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        seen.add(len(a))
        return a == b

    return same, seen


def test_titles_are_compared_by_classes(spark, counted):
    same, seen = counted
    rng, kind = random.Random(3), "id long, v int, title string, days array<date>"
    rows = [(i, rng.randrange(3), f"T{rng.randrange(40)}", [date(2024, 1, 1 + rng.randrange(9)) for _ in range(rng.randrange(4))]) for i in range(400)] + [(400 + i, 9, "T", [date(2024, 1, 1)]) for i in range(200)]
    old, new = (spark.createDataFrame([r for r in rows if r[0] % 2 == k], kind) for k in (0, 1))
    got = {tuple(r) for r in linkage.link_by_title(old.withColumnRenamed("id", "old_id"), new.withColumnRenamed("id", "new_id"), ["v"], same(F.col("old_title"), F.col("new_title"))).collect()}

    def close(a, b):
        a, b = set(a), set(b)
        return bool(a and b) and (len(a & b) >= 0.5 * len(a | b) or min(a) == min(b))

    pairs = [(n[0], o[0]) for n in rows if n[0] % 2 for o in rows if not o[0] % 2 and n[1:3] == o[1:3] and close(n[3], o[3])]
    left, right = [p[0] for p in pairs], [p[1] for p in pairs]
    assert got == {p for p in pairs if left.count(p[0]) == 1 and right.count(p[1]) == 1} and len(got) > 5
    assert seen.value <= 41 * 41  # by rows it would be 10,000 of the last 200 alone


def test_near_starts_are_compared_by_classes(spark, counted):
    same, seen = counted
    rng = random.Random(5)
    rows = [(i, rng.randrange(30), datetime(2024, 1, 1 + rng.randrange(3)), 49.0 + rng.randrange(3) / 3000, 11.0, f"T{rng.randrange(2)}") for i in range(300)]
    d = spark.createDataFrame(rows, "id long, provider long, start timestamp_ntz, lat double, lon double, title string")
    got = [tuple(r) for r in matching.same_start_nearby(d, 50, same(F.col("a.title"), F.col("b.title"))).select("a", "b").collect()]
    near = lambda a, b: abs(a[3] - b[3]) * 111_195 <= 50
    assert sorted(got) == sorted((a[0], b[0]) for a in rows for b in rows if a[1] < b[1] and a[2] == b[2] and near(a, b) and a[5] == b[5])
    assert seen.value <= 3 * 6 * 6  # classes; by rows it would be about 10,000


def test_pairs_in_blocks(spark):
    rng = random.Random(7)
    rows = [(i, None if i % 50 == 0 else rng.randrange(2), rng.sample(["red", "blue", "ring", "bolt"], rng.randrange(3))) for i in range(300)]
    d = spark.createDataFrame(rows, "id long, g int, w array<string>")
    within = {(r["l"]["id"], r["r"]["id"], r["r"]["g"]) for r in blocks.pairs_within(d, "g", "id", ["g"], size=40).collect()}
    pairs = [(a, b) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[1] is not None]
    assert within == {(a[0], b[0], b[1]) for a, b in pairs}
    got = sorted(tuple(r) for r in blocks.overlaps(d, "g", "id", "w").collect())
    assert got == sorted((a[0], b[0], len(set(a[2]) & set(b[2]))) for a, b in pairs if set(a[2]) & set(b[2]))
    many = blocks.expanded(spark.range(1).select(F.sequence(F.lit(1), F.lit(30)).alias("l"), F.sequence(F.lit(1), F.lit(20)).alias("r")), 600, per_task=100)
    assert many.rdd.getNumPartitions() == 6 and many.distinct().count() == 600  # tasks go by the pairs, not by the rows


def test_the_nearest_are_among_the_neighbours(spark):
    rng = random.Random(9)
    left = [(i, rng.randrange(4), None if i % 20 == 0 else rng.randrange(30) / 4) for i in range(120)]
    right = [(100 + i, rng.randrange(3), None if i % 10 == 0 else rng.randrange(30) / 4) for i in range(40)]
    a, b = spark.createDataFrame(left, "k long, g int, x double"), spark.createDataFrame(right, "t long, g int, y double")
    found = {}
    for r in joins.neighbours(a, b, ["g"], "x", "y").collect():
        found.setdefault(r["k"], []).append((r["t"], abs(r["x"] - r["y"])))
    for k, g, x in left:
        all_ = sorted(abs(x - y) for _, h, y in right if h == g and y is not None) if x is not None else []
        got = found.get(k, [])
        assert len(got) == len({t for t, _ in got}) <= 4  # four rows at most, however many the right side has
        assert sorted(d for _, d in got)[:2] == all_[:2]


def test_outranked_titles_are_compared_once(spark, counted, monkeypatch):
    same, seen = counted
    monkeypatch.setattr(offer_build.textfn, "similar_title", lambda a, b, stop: same(a, b))
    rng = random.Random(11)
    rows = [(i, 1, "v", f"T{rng.randrange(3)}", rng.randrange(3), rng.randrange(50), [f"x{i % 7}"], [(datetime(2024, 1, 1 + d), datetime(2024, 1, 2 + d)) for d in rng.sample(range(4), 2)]) for i in range(200)]
    d = spark.createDataFrame(rows, "id long, provider int, venue string, title string, rank int, ord long, topics array<string>, sessions array<struct<start timestamp_ntz, end timestamp_ntz>>")
    best = {}
    for r in rows:
        over = [(h[4], h[5], h[0]) for h in rows if h[4] < r[4] and h[3] == r[3] and {s[0] for s in h[7]} & {s[0] for s in r[7]}]
        if over:
            best[r[0]] = min(over)[2]
    want = {r[0]: set(r[6]) | {t for o in rows if best.get(o[0]) == r[0] for t in o[6]} for r in rows if r[0] not in best}
    assert {r["id"]: set(r["topics"]) for r in offer_build.drop_outranked(d).collect()} == want
    assert seen.value <= 9  # pairs of titles; by rows it would be thousands


def test_single_members_are_not_grouped(spark):
    rng = random.Random(13)
    rows = [(i % 60, rng.randrange(2), rng.randrange(6)) for i in range(160)]
    a, b = spark.createDataFrame(rows[:80], "a long, g int, m int"), spark.createDataFrame(rows[80:], "b long, g int, m int")
    out = linkage.shared_members(a, b, ["g"], "a", "b", "m")
    sets = lambda part: {(g, k): {r[2] for r in part if r[0] == k and r[1] == g} for k, g, _ in part}
    want = {(g, k, j, len(x & y), len(x), len(y), len(x & y) / len(x | y)) for (g, k), x in sets(rows[:80]).items() for (h, j), y in sets(rows[80:]).items() if g == h and x & y}
    assert {tuple(r) for r in out.select("g", "a", "b", "shared", "size_a", "size_b", "jaccard").collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 2  # members meet, once for either kind of pair; no join of pairs with sizes


def test_a_transfer_profile_needs_no_sort_for_its_least_ratings(spark):
    rides = [(1, "a", "b", 0, 10), (2, "a", "c", 0, 900), (3, "b", "c", 20, 30), (4, "a", "c", 5, 640), (5, "a", "b", 2, 12), (6, "b", "c", 10, 25)]
    stops = spark.createDataFrame([(s, s, 0) for s in "abc"], "frm string, dst string, walk long")
    out = transit.transfer_profile(spark.createDataFrame(rides, "trip long, frm string, dst string, dep long, arr long"), stops)
    got = {tuple(r) for r in out.select("frm", "dst", "dep", "arr", "rated").collect()}
    assert got == {("a", "b", 0, 10, 10), ("a", "b", 2, 12, 12), ("a", "c", 0, 25, 625), ("a", "c", 2, 30, 630), ("a", "c", 5, 640, 640), ("b", "c", 10, 25, 25), ("b", "c", 20, 30, 30)}
    assert "SortAggregate" not in out._jdf.queryExecution().toString()


def test_units_are_counted_without_a_sort_of_all_rows(spark):
    rows = spark.createDataFrame([("e1", None, False, 1), ("e1", "u2", False, 1), ("e2", None, False, 1), ("e2", "u3", True, 9)], "e string, u string, failed boolean, fit int")
    out = linkage.one_unit_per_row(rows, ["e"], "u", F.col("failed"), F.col("fit"), F.col("u"))
    assert {(r["e"], r["u"]) for r in out.collect()} == {("e1", None), ("e2", None)}  # two rows without a unit count as one unit's
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
