"""Work that findings of round 4 named: what a task holds, what is shuffled, what is joined."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import blocks, identity, offer_build, transit


def test_pairs_of_two_arrays_are_not_held_at_once(spark):
    """Rows that generated code makes of one row are kept until all are made, so it must not take both arrays apart."""
    both = spark.range(3).select("id", F.sequence("id", F.col("id") + 29).alias("l"), F.sequence("id", F.col("id") + 19).alias("r"))
    out = blocks.expanded(both, 1800, per_task=900)
    plan = out._jdf.queryExecution().executedPlan().toString()
    first, second = (plan.index(f"Generate explode({side}") for side in "lr")
    assert second < plan.index("Coalesce") < first  # the plan begins with what is done last
    assert out.rdd.getNumPartitions() == 2 and out.distinct().count() == out.count() == 1800


def _profile(rides, walks, penalty):
    """Departures with one transfer at most that no later one beats, by looking at all pairs of rides."""
    found = {}
    for _, f, d, dep, arr in rides:
        found.setdefault((f, d), []).append((dep, arr, 0, arr))
        for _, f2, d2, dep2, arr2 in rides:
            walk = walks.get((d, f2))
            if walk is not None and dep2 >= arr + walk and d2 != f:
                found.setdefault((f, d2), []).append((dep, arr2 + penalty, 1, arr2))
    out, least = set(), {}
    for pair, all_ in found.items():
        for dep, rated, _, arr in sorted(all_, key=lambda x: (-x[0], x[1], x[2])):
            if rated < least.get(pair, float("inf")):
                least[pair] = rated
                out.add((*pair, dep, arr, rated))
    return out


def test_transfer_profile_packed_and_not(spark):
    """Stops by small numbers, by numbers too far apart to be packed, and by names; at the stop itself and on foot; over hours."""
    rng = random.Random(17)
    names = {"int": lambda k: k + 3, "long": lambda k: -(2**63) + k * (2**60 + 7), "string": lambda k: f"s{k}"}
    rides = []
    for trip in range(70):
        dep = rng.randrange(0, 20000)
        rides.append((trip, *rng.sample(range(9), 2), dep, dep + rng.randrange(0, 9000)))
    walks = {(a, b): 0 if a == b else 90 * abs(a - b) for a in range(9) for b in range(9) if abs(a - b) < 2 and a != 8}
    for kind, name in names.items():
        d = spark.createDataFrame([(t, name(f), name(g), x, y) for t, f, g, x, y in rides], f"trip int, frm {kind}, dst {kind}, dep int, arr long")
        foot = spark.createDataFrame([(name(f), name(g), w) for (f, g), w in walks.items()], f"frm {kind}, dst {kind}, walk long")
        for paths, by in ((None, {(k, k): 0 for k in range(9)}), (foot, walks)):
            got = [tuple(r) for r in transit.transfer_profile(d, paths, 600, 1000).collect()]
            want = {(name(r[0]), name(r[1]), *r[2:]) for r in _profile(rides, by, 600)}
            assert len(got) == len(set(got)) and set(got) == want and any(r[4] > r[3] for r in got)


def test_a_transfer_profile_shuffles_a_row_per_ride(spark):
    rides = [(i, i, 1000, i, 500) for i in range(100)] + [(100 + i, 1000, 2000 + i, 600 + i, 900) for i in range(50)]
    d = spark.createDataFrame(rides, "trip long, frm long, dst long, dep long, arr long")
    out = transit.transfer_profile(d)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") <= 4  # twice the rides by their beginning, once by their end, once what they reach
    assert plan.rindex("Exchange hashpartitioning(frm") > plan.index("Generate explode(")  # each reached stop becomes a row after the shuffle
    assert out.count() == 100 + 50 + 100 * 50


OFFER = "provider string, venue string, title string, kind string, low int, high int, sessions array<struct<start timestamp_ntz, end timestamp_ntz>>"


def _sides(spark, rng, providers, most):
    """Offers of the night before and drafts of some providers, as the stages compare them."""
    made = []
    for name in ("old", "draft"):
        rows = []
        for p in range(providers):
            for k in range(rng.randrange(most + 1)):
                days = sorted(rng.sample(range(1, 7), rng.choice([0, 3, 5, 5])))
                starts = [datetime(2026, 3, d, rng.choice([9, 9, 9, 10])) for d in days]
                rows.append((f"{name}{p}-{k}", f"p{p}", rng.choice("vvw"), rng.choice(["Krabbelkäfer", "Musikzwerge"]), rng.choice(["regular", "course", "single"]), None, None, [(t, t + timedelta(hours=1)) for t in starts]))
        day = lambda n: F.lit(date(2026, 3, n))
        made.append(identity._side(spark.createDataFrame(rows, f"{name} string, {OFFER}"), name, day(2), day(9 if name == "old" else 20)))
    return made


def test_offers_of_small_providers_are_paired_without_their_starts(spark, monkeypatch):
    rng = random.Random(19)
    olds, drafts = _sides(spark, rng, 20, 5)
    venues, search, asked = spark.createDataFrame([("v",)], "venue string"), identity._candidates, []
    monkeypatch.setattr(identity, "_candidates", lambda *sides: asked.append(1) or search(*sides))
    shown = lambda: sorted(map(str, identity._pairs(olds, drafts, venues).collect()))
    want = shown()
    assert not asked and len(want) > 15
    for few, most in ((0, 10_000), (2, 0)):  # all by their starts; some so, and more titles than a task may hold
        monkeypatch.setattr(identity, "FEW", few)
        monkeypatch.setattr(identity, "MOST_TOLD", most)
        assert shown() == want
    assert len(asked) == 2


def test_offers_that_are_alone_at_a_place_have_no_starts_to_tell(spark):
    t = datetime(2026, 3, 2, 10)
    rows = [(i, f"p{i // 2 if i < 4 else i}", "v", "Kurs", "single", 0, i, None, None, [(t, t + timedelta(hours=1))]) for i in range(50)]
    d = spark.createDataFrame(rows, "id long, provider string, venue string, title string, kind string, rank int, ord long, low int, high int, sessions array<struct<start timestamp_ntz, end timestamp_ntz>>")
    out = offer_build.twins(d, F.lit(date(2026, 3, 1)))
    assert {tuple(r) for r in out.collect()} == {(0, 1), (2, 3)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Generate explode") < plan.rindex("Window [count(1)")  # those that are alone go before
