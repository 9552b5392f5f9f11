"""Operators on small tables, with plain versions for the algorithmic ones."""

import random
from collections import defaultdict
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import agenda, filters, joins, linkage, listing, measures, recurrence, sessions, state, transit

NOW = TODAY = None
S = "array<struct<start timestamp_ntz, end timestamp_ntz>>"


@pytest.fixture(scope="module", autouse=True)
def moment(spark):
    """Columns need a session."""
    global NOW, TODAY
    NOW, TODAY = F.lit("2024-06-15 12:00:00").cast("timestamp_ntz"), F.lit("2024-06-15").cast("date")


def at(d, h=10, n=1):
    s = datetime(2024, 6, 1, h) + timedelta(days=d - 1)
    return (s, s + timedelta(hours=n))


@pytest.fixture(scope="module")
def offers(spark):
    rows = [
        (1, "course", True, [at(10), at(17), at(24)]),  # begun
        (2, "course", False, [at(10), at(17)]),
        (3, "regular", True, [at(8), at(15, 11, 1), at(22, 16)]),  # one ends just now
        (4, "single", True, [at(14)]),  # over
        (5, "single", True, []),
        (6, "regular", False, [at(18), at(25), at(32)]),
        (7, "regular", False, None),
    ]
    return spark.createDataFrame(rows, f"id long, kind string, registered boolean, sessions {S}")


def by_id(df, value):
    return {r["id"]: r["v"] for r in df.select("id", value.alias("v")).collect()}


def test_sessions(offers):
    k, r, s = F.col("kind"), F.col("registered"), F.col("sessions")
    assert by_id(offers, sessions.next_session(s, NOW)["start"]) == {1: at(17)[0], 2: at(17)[0], 3: at(15, 11)[0], 4: None, 5: None, 6: at(18)[0], 7: None}
    assert by_id(offers, F.coalesce(sessions.discoverable(k, r, s, NOW), F.lit(False))) == {1: False, 2: True, 3: True, 4: False, 5: False, 6: True, 7: False}
    assert by_id(offers, sessions.course_running(k, s, NOW)) == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: False}
    assert by_id(offers, F.size(sessions.candidates(k, s, NOW))) == {1: 1, 2: 1, 3: 2, 4: 0, 5: 0, 6: 3, 7: None}
    assert by_id(offers, sessions.shown(k, s, NOW)["start"])[1] == at(17)[0]
    rule = sessions.Rule(date(2024, 6, 20), None, ("afternoon",))
    assert by_id(offers, sessions.shown(k, s, NOW, rule)["start"]) == {1: None, 2: None, 3: at(22, 16)[0], 4: None, 5: None, 6: None, 7: None}
    assert by_id(offers, sessions.reference(k, s, NOW, F.lit("2024-06-24").cast("date"))["start"])[1] == at(24)[0]
    assert by_id(offers, sessions.rhythm(s, NOW))[6] == 2
    assert by_id(offers, sessions.rhythm(s, NOW))[3] == -6
    assert by_id(offers, F.size(sessions.collapsed(s, F.try_element_at(s, F.lit(-1)), 2)))[6] == 3


def test_collect_sessions(spark):
    rows = spark.createDataFrame([(1, *at(2)), (1, *at(1)), (1, at(2)[0], at(3)[1]), (2, None, None)], "id long, a timestamp_ntz, b timestamp_ntz")
    got = sessions.collect_sessions(rows, ["id"], "a", "b").collect()
    assert [(r["id"], [tuple(s) for s in r["sessions"]]) for r in got] == [(1, [at(1), at(2)])]


def test_selection():
    allowed = {"kind": ("a", "b"), "place": ("x", "y")}
    s = filters.Selection.parse("?kind=b,a,z&from=2024-02-30&to=2024-03-01&daytime=midday,late&reach=20", allowed)
    assert s.chosen == {"kind": ("a", "b")} and s.rule == sessions.Rule(None, date(2024, 3, 1), ("midday",)) and s.limit == 20
    assert filters.Selection.parse(s.search(), allowed) == s and s.count() == 5
    assert s.toggled("kind", "a").chosen == {"kind": ("b",)} and filters.Selection.parse("reach=25", {}).limit is None
    assert filters.day_range("2024-03-02", "2024-03-01") == (date(2024, 3, 1), date(2024, 3, 2))


def test_registration_phase(spark):
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    row = spark.range(1).select(filters.registration_phase(t(None), t(None), NOW), filters.registration_phase(t("2024-07-01"), t(None), NOW), filters.registration_phase(t(None), t("2024-06-15 12:00:00"), NOW), filters.registration_phase(t("2024-01-01"), t("2024-06-01"), NOW)).first()
    assert tuple(row) == (None, "soon", "open", "over")


def test_listing(spark):
    days = spark.createDataFrame([(0,), (6,), (7,), (13,), (14,), (-3,), (None,)], "d int").withColumn("l", F.date_sub(TODAY, F.col("d")))
    assert [r[0] for r in days.select(listing.listing_week(F.col("l"), TODAY)).collect()] == ["this_week", "this_week", "last_week", "last_week", "older", "this_week", "older"]
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, "b"), (2, "b"), (2, "a"), (3, None)], "g long, v string")
    assert {(r["g"], r["v"], r["n"]) for r in listing.canonical_mode(rows, ["g"], "v", ["b", "a"]).collect()} == {(1, "b", 1), (2, "b", 2), (3, None, 1)}


def test_agenda(spark):
    spine = agenda.days(spark, "2024-06-10", "2024-06-16")
    rows = spark.createDataFrame([(date(2024, 6, 11), True, True), (date(2024, 6, 11), True, False), (date(2024, 6, 11), False, False)], "d date, a boolean, b boolean")
    got = {r["day"].day: tuple(r)[1:] for r in agenda.range_agenda(spine, rows, F.col("d"), F.col("a"), F.col("b")).collect()}
    assert len(got) == 7 and got[11] == (1, 1, 1) and got[10] == (0, 0, 0)
    week = agenda.week_rows(spine, spark.createDataFrame([(date(2024, 6, 12), 2)], "day date, n long"), F.lit("2024-06-11").cast("date")).orderBy("day").collect()
    assert [r["state"] for r in week] == ["past", "free", "busy", "free", "free", "free_weekend"]


def test_asof_and_range(spark):
    r = random.Random(1)
    left = [(i, r.randrange(3), r.randrange(100)) for i in range(80)]
    right = [(r.randrange(3), r.randrange(100), f"p{i}") for i in range(40)]
    a, b = spark.createDataFrame(left, "i long, k long, t long"), spark.createDataFrame(right, "k long, u long, p string")
    got = {x["i"]: x["u"] for x in joins.asof_next(a, b, ["k"], "t", "u", ["p"]).collect()}
    assert got == {i: min((u for q, u, _ in right if q == k and u >= t), default=None) for i, k, t in left}
    spans = spark.createDataFrame([(i, k, u, u + 9) for i, (k, u, _) in enumerate(right)], "j long, k long, lo long, hi long")
    got = {(x["i"], x["j"]) for x in joins.range_join(a, spans, "t", "lo", "hi", 10, ["k"]).select("i", "j").collect()}
    assert got == {(i, j) for i, k, t in left for j, (q, u, _) in enumerate(right) if q == k and u <= t <= u + 9}


def test_grid_pairs_are_all_pairs(spark):
    r = random.Random(2)
    points = [(i, 48.9 + r.random() / 50, 11 + r.random() / 50) for i in range(150)]
    d = spark.createDataFrame(points, "id long, lat double, lon double")
    from tidemark.functions import numbers

    a, b = d.toDF("a", "y1", "x1"), d.toDF("b", "y2", "x2")
    want = {(x["a"], x["b"]) for x in a.crossJoin(b).where(numbers.haversine_m(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2")) <= 300).collect()}
    assert {(x["a"], x["b"]) for x in joins.grid_pairs(d, d, 300).collect()} == want


def test_pairs(spark):
    p = spark.createDataFrame([(1, "a", "x", 3), (1, "a", "y", 3), (1, "b", "x", 2), (1, "c", "z", 1), (2, "a", "y", 1)], "g long, l string, r string, s long")
    got = {(x["g"], x["l"], x["r"]) for x in joins.greedy_pairs(p, ["g"], "l", "r", "s").collect()}
    assert got == {(1, "a", "x"), (1, "c", "z"), (2, "a", "y")}
    q = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.7), ("c", "z", 0.5), ("c", "w", 0.5)], "l string, r string, s double")
    assert {(x["l"], x["r"]) for x in joins.mutual_best(q, "l", "r", F.col("s")).collect()} == {("a", "x")}


def test_recurrence(spark):
    rules = spark.createDataFrame([(1, date(2024, 1, 3), date(2024, 2, 29), [1, 3], 2, 4), (2, date(2024, 1, 1), date(2024, 1, 31), [1], 1, None), (3, date(2024, 2, 1), date(2024, 1, 1), [1], 1, None)], "id long, s date, u date, days array<int>, step int, n int")
    off = spark.createDataFrame([(1, date(2024, 1, 15))], "id long, day date")
    free = recurrence.holiday_days(spark.createDataFrame([(date(2024, 1, 8), date(2024, 1, 9), "b"), (date(2024, 1, 8), date(2024, 1, 8), "a")], "start date, end date, name string"))
    assert {(r["day"].day, r["name"]) for r in free.collect()} == {(8, "a"), (9, "b")}
    got = defaultdict(list)
    for r in recurrence.weekly(rules, "id", "s", "u", "days", "step", "n", off, free).orderBy("id", "day").collect():
        got[r["id"]].append(r["day"])
    assert got == {1: [date(2024, 1, 3), date(2024, 1, 17), date(2024, 1, 29), date(2024, 1, 31)], 2: [date(2024, 1, 1), date(2024, 1, 15), date(2024, 1, 22), date(2024, 1, 29)]}
    monthly = spark.createDataFrame([(1, date(2024, 1, 10), date(2024, 4, 30), 2, 1), (2, date(2024, 1, 1), date(2024, 3, 31), 5, -1)], "id long, s date, u date, w int, n int")
    got = {(r["id"], r["day"]) for r in recurrence.monthly(monthly, "id", "s", "u", "w", "n").collect()}
    assert got == {(1, date(2024, 2, 6)), (1, date(2024, 3, 5)), (1, date(2024, 4, 2)), (2, date(2024, 1, 26)), (2, date(2024, 2, 23)), (2, date(2024, 3, 29))}


def test_linkage(spark):
    old = spark.createDataFrame([(1, "v", "k1"), (2, "v", "k2"), (3, "v", "k3")], "old_id long, v string, k string")
    new = spark.createDataFrame([(11, "v", "k1"), (12, "v", "kx"), (13, "v", "ky")], "new_id long, v string, k string")
    m_old = spark.createDataFrame([("v", i, m) for i, ms in {1: "ab", 2: "abcde", 3: "xyz"}.items() for m in ms], "v string, old_id long, member string")
    m_new = spark.createDataFrame([("v", i, m) for i, ms in {11: "ab", 12: "abcdf", 13: "xyz"}.items() for m in ms], "v string, new_id long, member string")
    got = {(r["new_id"], r["old_id"], r["stage"]) for r in linkage.link_stages(old, new, ["v"], "k", m_old, m_new, 0.6).collect()}
    assert got == {(11, 1, 0), (12, 2, 1), (13, 3, 1)}
    keys = spark.createDataFrame([(f"k{i}",) for i in range(50)], "key string")
    first = linkage.assigned_ids(keys, "key", spark.createDataFrame([], "id string"))
    taken = first.where("key = 'k7'").select("id")
    second = {r["key"]: (r["id"], r["seed"]) for r in linkage.assigned_ids(keys, "key", taken).collect()}
    one = {r["key"]: r["id"] for r in first.collect()}
    assert len(set(one.values())) == 50 and second["k7"][1] == 1 and second["k8"][0] == one["k8"]
    v = linkage.violations(keys.limit(1), "key", {"ok": F.lit(True), "no": F.lit(False), "null": F.lit(None).cast("boolean")})
    assert {r["rule"] for r in v.collect()} == {"no", "null"}


def brute_arrivals(stop_times, paths, wait):
    rides = [(t, s, s2, d, a2) for t, q, s, _, d in stop_times for t2, q2, s2, a2, _ in stop_times if t == t2 and q < q2 and s != s2 and a2 >= d]
    best = {}
    for t, f, m, d, a in rides:
        for p, q, w in paths:
            if p == m:
                for t2, f2, g, d2, a2 in rides:
                    if f2 == q and t2 != t and a + w <= d2 <= a + w + wait and g != f:
                        best[f, g, d] = min(best.get((f, g, d), 10**9), a2)
    return best


def test_transit(spark):
    r = random.Random(4)
    times = []
    for trip in range(30):
        t = r.randrange(0, 6000)
        for seq, stop in enumerate(r.sample(range(8), 4)):
            times.append((trip, seq, stop, t, t + 20))
            t += r.randrange(100, 500)
    d = spark.createDataFrame(times, "trip long, seq int, stop long, arr long, dep long")
    paths = [(i, i, 0) for i in range(8)] + [(0, 1, 60), (1, 0, 60)]
    of = transit.rides(d)
    got = {(x["frm"], x["dst"], x["dep"]): x["arr"] for x in transit.one_transfer(of, spark.createDataFrame(paths, "frm long, dst long, walk long"), wait=900).collect()}
    assert got == brute_arrivals(times, paths, 900)
    profile = defaultdict(list)
    for x in transit.direct_profile(of).collect():
        profile[x["frm"], x["dst"]].append((x["dep"], x["arr"]))
    everything = defaultdict(list)
    for x in of.collect():
        everything[x["frm"], x["dst"]].append((x["dep"], x["arr"]))
    waits = {(x["frm"], x["dst"], x["at"]): x["minutes"] for x in transit.minute_waits(transit.direct_profile(of), 0).collect()}
    for k, entries in everything.items():
        for minute in range(120):
            t = minute * 60
            assert min((a for d_, a in profile[k] if d_ >= t), default=None) == min((a for d_, a in entries if d_ >= t), default=None)
            best = min((a for d_, a in entries if d_ >= t), default=None)
            assert waits.get((*k, t)) == (None if best is None else pytest.approx((best - t) / 60))
    assert transit.cells(transit.minute_waits(transit.direct_profile(of), 0)).where("cell > 120 and cell != 255").count() == 0
    assert transit.connections(d).count() == 90


def test_transfer_profile(spark):
    r = random.Random(5)
    times = []
    for trip in range(40):
        t = r.randrange(0, 60_000)  # sparse: most waits are over an hour
        for seq, stop in enumerate(r.sample(range(8), 4)):
            times.append((trip, seq, stop, t, t + 20))
            t += r.randrange(100, 500)
    paths = [(i, i, 0) for i in range(8)] + [(0, 1, 60), (1, 0, 60)]
    of, walks = transit.rides(spark.createDataFrame(times, "trip long, seq int, stop long, arr long, dep long")), spark.createDataFrame(paths, "frm long, dst long, walk long")
    with_one = brute_arrivals(times, paths, 10**6)
    assert len(with_one) > len(brute_arrivals(times, paths, 3600))
    assert {(x["frm"], x["dst"], x["dep"]): (x["arr"], x["rated"]) for x in transit.one_transfer(of, walks).collect()} == {k: (a, a + 600) for k, a in with_one.items()}
    best = {k: (a + 600, 1) for k, a in with_one.items()}
    for x in of.collect():
        k = x["frm"], x["dst"], x["dep"]
        best[k] = min(best.get(k, (10**9, 0)), (x["arr"], 0))
    kept = {k: v for k, v in best.items() if not any(k2[:2] == k[:2] and k2[2] > k[2] and v2[0] <= v[0] for k2, v2 in best.items())}
    got = {(x["frm"], x["dst"], x["dep"]): (x["rated"], (x["rated"] - x["arr"]) // 600) for x in transit.transfer_profile(of, walks).collect()}
    assert got == kept and {n for _, n in kept.values()} == {0, 1}


def test_footpaths(spark):
    stops = spark.createDataFrame([(1, 49.0, 11.0), (2, 49.002, 11.0), (3, 49.1, 11.0)], "stop long, lat double, lon double")
    assert {(r["frm"], r["dst"]) for r in transit.footpaths(stops).collect()} == {(1, 1), (2, 2), (3, 3), (1, 2), (2, 1)}


def test_measures(spark):
    sizes = spark.createDataFrame([("a", 50), ("b", 30), ("c", 20), ("d", 1)], "k string, s long")
    assert {r["k"]: r["quota"] for r in measures.largest_remainder(sizes, "k", "s", 10).collect()} == {"a": 5, "b": 3, "c": 2, "d": 0}
    assert sum(r["quota"] for r in measures.largest_remainder(sizes, "k", "s", 1000).collect()) == 101
    rows = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "p boolean, e boolean")
    assert tuple(measures.precision_recall(rows, F.col("p"), F.col("e")).first()) == (1, 2, 2, 0.5, 0.5)
    assert measures.precision_recall(rows.where("not p"), F.col("p"), F.col("e")).first()["precision"] is None
    calls = spark.createDataFrame([(1, i, 1.0) for i in range(5)], "g long, i long, x double")
    assert measures.running_limit(calls, ["i"], F.col("x"), 3, "g").count() == 3


def test_state(spark):
    pairs = spark.createDataFrame([(3, 1), (3, 2), (1, 0), (0, 0), (2, 1), (4, 2)], "o int, n int")
    assert [r[0] for r in pairs.select(state.collapsed(F.col("o"), F.col("n"))).collect()] == [True, False, True, False, False, False]
    cases = spark.createDataFrame([("a", 2, None), ("b", 1, date(2024, 7, 1))], "k string, n long, suspended_until date")
    finds = spark.createDataFrame([("a",), ("c",), ("c",), ("c",)], "k string")
    got = {r["k"]: (r["n"], r["suspended_until"]) for r in state.counted(cases, finds, "k", TODAY).collect()}
    assert got == {"a": (3, date(2024, 7, 20)), "b": (1, date(2024, 7, 1)), "c": (3, date(2024, 7, 20))}
    m = spark.range(1).select(F.create_map(F.lit("2024-06-01"), F.lit("x"), F.lit("2024-07-01"), F.lit("y")).alias("a"), F.create_map(F.lit("2024-07-01"), F.lit("y")).alias("b"))
    assert m.select(state.same_dated_key(F.col("a"), F.col("b"), F.lit("2024-06-15"))).first()[0]
