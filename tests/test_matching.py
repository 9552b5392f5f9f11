"""Matching, timetable and further session rules on small tables."""

import math
import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import discovery, joins, matching, sessions, timetable
from tidemark.plans import more_queries, queries

S = "array<struct<start timestamp_ntz, end timestamp_ntz>>"


def at(d, h=10):
    return (datetime(2024, 6, d, h), datetime(2024, 6, d, h + 1))


def test_staged_match(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "x", 1.0), (2, "y", 0.95), (3, "z", 0.4)], "k long, t string, score double")
    b = spark.createDataFrame([(3, "y", 0.9), (4, "y", 0.9), (4, "z", 0.7), (5, "q", 0.3)], "k long, t string, score double")
    got = {(r["k"], r["t"], r["stage"]) for r in matching.staged_match([("a", a), ("b", b)], "k", "t").collect()}
    assert got == {(1, "x", "a"), (4, "y", "b")}  # 2 is too close, 3 fails in its first stage, 5 is too weak


def test_left_uncovered_and_append_only(spark):
    old = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "i long, k string")
    new = spark.createDataFrame([(9, "a")], "i long, k string")
    assert {(r["i"], r["k"]) for r in matching.left_uncovered(old, new, ["k"], "i").collect()} == {(2, "a"), (3, "b")}
    b, a = (spark.createDataFrame(list(enumerate(v)), "p int, d string") for v in ("abc", "axcd"))
    assert {(r["p"], r["change"]) for r in matching.append_only(b, a, "p", "d").collect()} == {(0, "same"), (1, "changed"), (2, "same"), (3, "appended")}


def test_robots(spark):
    urls = spark.createDataFrame([(1, "h", "/a/b"), (2, "h", "/c"), (3, "o", "/a"), (4, "h", "/t")], "i long, host string, path string")
    rules = spark.createDataFrame([("h", "/a", False), ("h", "/a/b", True), ("h", "/c", False), ("h", "/t", True), ("h", "/t", False)], "host string, prefix string, allow boolean")
    assert {r["i"]: r["allowed"] for r in matching.robots_allows(urls, rules, "i", "host", "path").collect()} == {1: True, 2: False, 3: True, 4: True}


def test_reachable(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 1)], "frm long, dst long")
    assert {(r["node"], r["depth"]) for r in matching.reachable(edges, spark.createDataFrame([(1,)], "node long")).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}


def test_reachable_over_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(53)], "frm long, dst long").coalesce(1)
    assert {(r["node"], r["depth"]) for r in matching.reachable(edges, spark.createDataFrame([(0,)], "node long")).collect()} == {(i, i) for i in range(54)}


def test_text_parts(spark):
    d = spark.createDataFrame([(1, "aa\nbb\ncccccc\nd"), (2, None), (3, "")], "i long, t string")
    got = {r["i"]: r["p"] for r in d.select("i", matching.text_parts(F.col("t"), 5).alias("p")).collect()}
    assert got == {1: ["aa\nbb", "cccccc", "d"], 2: [""], 3: [""]}


def test_timetable(spark):
    d = spark.range(1).select(F.array(F.lit(5).cast("long"), F.lit(9).cast("long"), F.lit(7).cast("long")).alias("v"))
    assert d.select(timetable.undeltas(timetable.deltas(F.col("v")))).first()[0] == [5, 9, 7]
    assert spark.range(1).select(timetable.area_id(F.lit("de:1:2:3:4")), timetable.combined(F.array(F.lit("a"), F.lit("a"), F.lit("b")))).first()[:] == ("de:1:2", ["a", "b"])
    days = spark.createDataFrame([(date(2024, 6, d),) for d in (4, 11, 18, 25)], "day date")
    pick = lambda today, free=(): timetable.pick_service_day(days, spark.createDataFrame([(f,) for f in free], "day date"), F.lit(today).cast("date")).first()[0]
    assert (pick("2024-06-04"), pick("2024-06-04", [date(2024, 6, 11)]), pick("2024-07-01")) == (date(2024, 6, 11), date(2024, 6, 18), date(2024, 6, 25))


def test_series(spark):
    d = spark.createDataFrame([([at(1), at(8)], [at(8, 12), at(8), at(24)][:2] + [at(24)])], f"a {S}, b {S}")
    a, b = F.col("a"), F.col("b")
    row = d.select(F.size(sessions.union_sessions(a, b)), sessions.is_new_run(a, b, F.lit("2024-07-01").cast("date")), sessions.ended_on(a, F.lit("2024-06-08").cast("date"), F.lit("2024-06-08 12:00:00").cast("timestamp_ntz")), sessions.last_day(b)).first()
    assert tuple(row) == (4, False, 1, date(2024, 6, 24))


def test_same_start_nearby_and_saved(spark, tmp_path):
    rows = [(1, 1, 0, 49.0), (2, 2, 0, 49.0004), (3, 3, 0, 49.001), (4, 4, 1, 49.0), (5, 1, 0, 49.0), (6, 6, 0, 48.99961)]
    d = spark.createDataFrame(rows, "id long, provider long, start long, lat double").withColumn("lon", F.lit(11.0))
    assert {(r["a"], r["b"]) for r in matching.same_start_nearby(d, 50).collect()} == {(1, 2), (5, 2), (1, 6), (5, 6)}
    orders = [(i, i, datetime(1998, 1, 1), p) for i, p in enumerate(["1-URGENT", "5-LOW", "5-LOW", "2-HIGH"] * 300)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, 3 if i < 4 else 100 + i) for i in range(1200)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    assert [(r["a"], r["b"]) for r in more_queries.same_start_nearby(spark, str(tmp_path)).collect()] == [(1, 2)]  # not urgent; 0 and 3 have other titles
    saved = [(r["o_orderkey"], r["position"]) for r in queries.recently_saved(spark, str(tmp_path)).collect()]
    assert saved == [(i, i) for i in range(1197, -1, -7)]  # 172, over a hundred


# --- one to one within a radius


def test_matched_dates_equal_a_greedy_version_on_1000_cases(spark):
    rng = random.Random(5)
    found, reference, want = [], [], {}
    start = datetime(2026, 3, 1, 10)
    for case in range(1000):
        spot = lambda: (49.0 + rng.choice([0, 0.0004, 0.0008, 0.0012]), 11.0 + rng.choice([0, 0.0006, 0.0011]))
        f, r = ([(start + timedelta(hours=rng.randrange(2)), *spot()) for _ in range(rng.randint(0, 7))] for _ in range(2))
        found += [(case, *x) for x in f]
        reference += [(case, *x) for x in r]
        left, hits = sorted(f, key=lambda x: x[1:]), 0
        for when, lat, lon in sorted(r, key=lambda x: x[1:]):
            near = [x for x in left if x[0] == when and apart(lat, lon, *x[1:]) <= 100]
            if near:
                left.remove(near[0])
                hits += 1
        if r:
            want[case] = (hits, len(r))
    frame = lambda rows: spark.createDataFrame(rows, "provider long, start timestamp_ntz, lat double, lon double")
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    got = discovery.matched_dates(frame(found), frame(reference), day("2026-03-01"), day("2026-03-02"))
    assert {r["provider"]: (r["hits"], r["reference"]) for r in got.collect()} == want
    assert 0 < sum(h for h, _ in want.values()) < min(len(found), len(reference))


def test_two_metres_across_any_border_of_cells(spark):
    at = spark.createDataFrame([(1, datetime(2026, 3, 1), 49.00049, 11.0)], "provider long, start timestamp_ntz, lat double, lon double")
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    assert discovery.matched_dates(at.withColumn("lat", F.lit(49.00051)), at, day("2026-01-01"), day("2027-01-01")).first()["hits"] == 1


def test_pairs_of_points_at_every_latitude_and_over_the_date_line(spark):
    rng = random.Random(6)
    points = []
    for _ in range(500):
        lat, lon = rng.uniform(-90, 90), rng.choice([rng.uniform(-180, 180), rng.uniform(179.99, 180.01)])
        wide = 0.03 / max(0.001, math.cos(math.radians(lat)))
        points += [(lat, lon), (max(-90, min(90, lat + rng.uniform(-0.02, 0.02))), lon + rng.uniform(-wide, wide))]
    points += [(89.9999, 10.0), (89.9999, -170.0), (90.0, 77.0), (-90.0, 0.0), (-89.999, 120.0)]
    d = spark.createDataFrame([(i, lat, lon if lon <= 180 else lon - 360) for i, (lat, lon) in enumerate(points)], "id long, lat double, lon double")
    want = {(i, j) for i, p in enumerate(points) for j, q in enumerate(points) if abs(p[0] - q[0]) < 0.1 and apart(*p, *q) <= 2000}
    assert {(r["a"], r["b"]) for r in joins.grid_pairs(d, d, 2000).collect()} == want
    assert len(want) > len(points) + 200


def test_greedy_flow_takes_as_many_as_both_have(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for case in range(60):
        have = {("l", k): rng.randint(0, 4) for k in range(4)} | {("r", k): rng.randint(0, 4) for k in range(4)}
        pairs = [(rng.randint(0, 2), i, j) for i in range(4) for j in range(4) if rng.random() < 0.6]
        rows += [(s, f"{case}-{i}", f"{case}-{j}", have["l", i], have["r", j]) for s, i, j in pairs]
        for _, i, j in sorted(pairs):
            n = min(have["l", i], have["r", j])
            if n:
                want[f"{case}-{i}", f"{case}-{j}"] = n
                have["l", i] -= n
                have["r", j] -= n
    p = spark.createDataFrame(rows, "s int, l string, r string, p int, q int")
    assert {(r["l"], r["r"]): r["n"] for r in joins.greedy_flow(p, "l", "r", ["s"], "p", "q").collect()} == want
    assert joins.greedy_flow(p.limit(0), "l", "r").count() == 0


def apart(lat, lon, other_lat, other_lon):
    a, b = math.radians(lat), math.radians(other_lat)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(other_lon - lon) / 2) ** 2
    return 2 * 6371008.8 * math.asin(min(1, math.sqrt(h)))
