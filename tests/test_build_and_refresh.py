"""Titles, ids, cohorts, the offer build and the refresh state on small rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import cohortfn, idfn, titlefn
from tidemark.operators import discovery, nightly, offer_build, ranks, refresh, site
from tidemark.plans import build_queries

DAY = dt.date(2024, 6, 15)


def at(day, hour=10):
    return dt.datetime(2024, 6, day, hour)


def lit(day):
    return F.lit(f"2024-06-{day:02d} 10:00:00").cast("timestamp_ntz")


def one(spark, column, **values):
    kinds = {str: "string", int: "int", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


TITLES = [
    ("Rückbildung", "Rückbildungskurs", True),  # prolonged
    ("Krabbelgruppe Maxis", "Wunder-Krabbler Maxis", False),  # one common word is not enough
    ("Miniclub Martin-Luther-Kirche", "Mini-Club (Blauer Saal, Martin-Luther-Kirche)", True),
    ("Musikgarten Gruppe A", "Musikgarten Gruppe B", False),
    ("Musikgarten 1-2 Jahre", "Musikgarten", True),  # an age is no label
    ("PEKiP Juni", "PEKiP Mai", False),
    ("Yoga Start 29.11.2026", "Yoga ab 3.1.", False),
    ("Babys 0–3 Jahre", "Babys 1–3 Jahre", False),  # no core word: tokens decide
    ("Babys dienstags 10:00 Uhr", "Babys", True),
    ("Babyschwimmen Delfine", "Babyschwimmen Robben", False),  # names after the first core word
]


@pytest.mark.parametrize("case", TITLES)
def test_same_core_title(spark, case):
    a, b, same = case
    assert one(spark, titlefn.same_core_title(F.col("a"), F.col("b")), a=a, b=b) is same
    assert one(spark, titlefn.same_core_title(F.col("a"), F.col("b")), a=b, b=a) is same


def test_names_and_relevance(spark):
    similar = lambda a, b: one(spark, titlefn.similar_name(F.col("a"), F.col("b")), a=a, b=b)
    assert similar("Die FamilienBox – Das Dorf für Familien", "Familienbox") and not similar("Musikschule Nord", "Hebamme Kern")
    assert one(spark, titlefn.is_relevant(F.col("a")), a="Krabbelgruppe ab 3 Monaten") and not one(spark, titlefn.is_relevant(F.col("a")), a="Seniorenkreis")


def plain_hash(text, seed):
    times = lambda a, b: (a * b) & 0xFFFFFFFF
    h1, h2 = 0xDEADBEEF ^ seed, 0x41C6CE57 ^ seed
    units = text.encode("utf-16-le")
    for c in (units[i] | units[i + 1] << 8 for i in range(0, len(units), 2)):
        h1, h2 = times(h1 ^ c, 2654435761), times(h2 ^ c, 1597334677)
    h1 = times(h1 ^ h1 >> 16, 2246822507) ^ times(h2 ^ h2 >> 13, 3266489909)
    h2 = times(h2 ^ h2 >> 16, 2246822507) ^ times(h1 ^ h1 >> 13, 3266489909)
    return 4294967296 * (2097151 & h2) + h1


@pytest.mark.parametrize("text", ["", "a", "provider--kurs-20240101t1000--ort", "äöü €", "🙂 x"])
def test_hash(spark, text):
    for seed in (0, 1, 9):
        assert one(spark, idfn.hash53(F.col("t"), seed), t=text) == plain_hash(text, seed)


def test_cohorts(spark):
    def age(title, day):
        got = one(spark, cohortfn.cohort_age(cohortfn.birth_cohort(F.col("t")), F.lit(day).cast("date")), t=title)
        return got and (got["low"], got["high"])

    assert age("Kurs (geb. 02-04/2024)", "2024-08-15") == (3, 6) and age("geboren im März 2024", "2024-08-15") == (4, 5)
    assert age("geb. Dez.–Feb. 2024", "2024-06-01") == (3, 6) and age("geb. 02-04/2024", "2024-01-01") is None
    assert age("geb. 11-02/2024", "2024-06-01") == (3, 7) and age("geb. 13/2024", "2024-06-01") is None and age("Kurs 2024", "2024-06-01") is None


EVENT = "provider string, venue string, title string, kind string, low int, high int, occurrences array<struct<start:timestamp_ntz,end:timestamp_ntz>>, rank int, ord long, topics array<string>"


def test_drafts(spark):
    rows = [
        ("p", "v", "course over", "course", None, None, [(at(1), None)], 0, 1, ["a"]),
        ("p", "v", "course on", "course", None, None, [(at(1), at(1, 9)), (at(20), at(20, 12))], 0, 2, ["a"]),
        ("p", "v", "single", "single", 3, 50, [(at(1), None), (at(20), None), (at(21), None)], 0, 3, ["a"]),
        ("p", "v", "too old", "regular", 40, 60, [(at(20), None)], 0, 4, ["a"]),
        ("p", "v", "in the gap", "regular", None, None, [(dt.datetime(2024, 3, 31, 2, 30), None), (at(22), None)], 0, 5, ["a"]),
        ("p", "v", "gone", "regular", None, None, [], 0, 6, ["a"]),
    ]
    got = offer_build.drafts(spark.createDataFrame(rows, EVENT), F.lit(DAY), F.lit(DAY) + F.expr("INTERVAL 1 MONTH")).collect()
    assert sorted((r["title"], len(r["sessions"]), r["high"]) for r in got) == [("course on", 2, None), ("in the gap", 1, None), ("single", 1, 36), ("single", 1, 36)]
    assert next(r for r in got if r["title"] == "course on")["sessions"][0]["end"] == at(1, 11)  # an end before the start: an hour


def offers(spark, rows):
    return spark.createDataFrame([(i, "p", "v", t, "regular", rank, i, [f"t{i}"], None, None, [(at(d), at(d, 11)) for d in days]) for i, t, rank, days in rows],
        "id long, provider string, venue string, title string, kind string, rank int, ord long, topics array<string>, low int, high int, sessions array<struct<start:timestamp_ntz,end:timestamp_ntz>>")


def test_duplicates_go(spark):
    o = offers(spark, [(1, "Musikgarten", 0, [16, 17, 18]), (2, "Musikgarten für alle", 1, [17]), (3, "Turnen", 1, [17]), (4, "Musikgarten", 1, [25])])
    left = {r["id"]: sorted(r["topics"]) for r in offer_build.drop_outranked(o).collect()}
    assert left == {1: ["t1", "t2"], 3: ["t3"], 4: ["t4"]}
    twins = offers(spark, [(1, "Musikgarten", 0, [16, 17, 18, 19]), (2, "Musikgarten", 0, [17, 18, 19, 20]), (3, "Musikgarten", 0, [17, 18, 19]), (4, "Turnen", 0, [16, 17, 18])])
    got = {r["id"]: ([s["start"].day for s in r["sessions"]], sorted(r["topics"])) for r in offer_build.drop_twins(twins, F.lit(DAY)).collect()}
    assert got == {1: ([16, 17, 18, 19, 20], ["t1", "t2", "t3"]), 4: ([16, 17, 18], ["t4"])}


def test_kept_ids(spark):
    row = spark.createDataFrame([([(at(16), at(16, 11)), (at(17), at(17, 11))], {at(17): "b", at(18): "c"})], "s array<struct<start:timestamp_ntz,end:timestamp_ntz>>, k map<timestamp_ntz,string>")
    assert row.select(offer_build.keep_of(F.col("s"), F.col("k"))).first()[0] == "b"
    ids = spark.createDataFrame([(["a", None],), (["a", "b"],), ([None],)], "i array<string>")
    assert [r[0] for r in ids.select(offer_build.merge_kept(F.col("i"))).collect()] == ["a", None, None]


def test_build_keeps_ids_and_failed_providers(spark):
    e = lambda t, k, d, o: ("p", "v", t, k, None, None, [(at(d), None)], 0, o, ["x"])
    old = spark.createDataFrame([("id1", "p", "v", "Kurs A", "regular", None, None, ["x"], [(at(16), at(16, 11))], at(1)), ("id2", "q", "v", "Kurs B", "regular", None, None, ["x"], [(at(20), at(20, 11))], at(2))],
        "id string, provider string, venue string, title string, kind string, low int, high int, topics array<string>, sessions array<struct<start:timestamp_ntz,end:timestamp_ntz>>, listed_at timestamp_ntz")
    providers = spark.createDataFrame([("p", None), ("q", "check failed")], "provider string, reason string")
    venues = spark.createDataFrame([("p", "v"), ("q", "v")], "provider string, venue string")
    new = spark.createDataFrame([e("Kurs A", "regular", 17, 1), e("Kurs C", "regular", 18, 2)], EVENT)
    out = nightly.build(new, old, spark.createDataFrame([], build_queries.MEMORY), providers, venues, F.lit(DAY), F.lit(DAY) + F.expr("INTERVAL 1 MONTH"), lit(14), lit(15)).collect()
    got = {r["title"]: (r["id"], r["listed_at"]) for r in out}
    assert got["Kurs A"] == ("id1", at(1)) and got["Kurs B"] == ("id2", at(2)) and got["Kurs C"][1] == at(15) and got["Kurs C"][0] not in ("id1", "id2")
    assert sorted((r["provider"], r["stage"]) for r in out) == [("p", "key"), ("p", "new"), ("q", "carried")]


def test_advance_new_and_removed(spark):
    none = spark.createDataFrame([], f"unit string, events {refresh.EVENTS}, digest string, model string, status string, reason string, checked_at timestamp_ntz, changed_at timestamp_ntz, failing_since timestamp_ntz, failure string, failure_since date, pending {refresh.PENDING}, empty_since timestamp_ntz, removed_at timestamp_ntz")
    event = [("e", True, True, [dt.date(2024, 6, 20)])]
    night = lambda rows: spark.createDataFrame(rows, f"unit string, kind string, reason string, failure string, digest string, model string, events {refresh.EVENTS}, baseline int")
    first = refresh.advance(none, night([("a", "extracted", None, None, "d", "m", event, 0), ("b", "empty", None, None, "d", "m", None, 5)]), F.lit(DAY), lit(15))
    got = {r["unit"]: r for r in first.collect()}
    assert got["a"]["result"] == "extracted" and got["a"]["status"] == "ok" and got["b"]["result"] == "collapse" and got["b"]["status"] == "failed" and got["b"]["pending"] is not None
    state = first.drop("result")
    for k in range(3):
        state = refresh.advance(state, night([("a", "failed", "404", "lasting", None, None, None, 0)]), F.lit(DAY + dt.timedelta(days=7 * k)), lit(15))
        row = state.where("unit = 'a'").first()
        state = state.drop("result")
    assert row["result"] == "removed" and row["events"] == [] and row["digest"] is None and row["removed_at"] is not None


def test_verdicts_and_sources(spark):
    v = spark.createDataFrame([("1", "same", "x"), ("1", "gone", None), ("2", "same", "x"), ("3", "faulty", None), ("3", "gone", None), ("4", "gone", None), ("4", "unclear", None)], "id string, kind string, target string")
    got = {r["id"]: (r["kind"], r["target"]) for r in refresh.merge_verdicts(v.withColumn("part", F.lit(1)).withColumn("reason", F.lit("r"))).collect()}
    assert got == {"1": ("unclear", None), "2": ("unclear", None), "3": ("faulty", None), "4": ("unclear", None)}


def test_catalogue_ids_and_ranks(spark):
    names = spark.createDataFrame([("Haus A",), ("Haus, A",), ("abcdefgh",)], "name string")
    taken = spark.createDataFrame([("haus-a",), ("haus-a-3",)], "id string")
    assert {r["name"]: r["id"] for r in discovery.catalogue_ids(names, taken).collect()} == {"Haus A": "haus-a-2", "Haus, A": "haus-a-4", "abcdefgh": "abcdefgh-anbieter"}
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), F.hash("id").alias("o"))
    got = ranks.numbered(rows, ["g"], ["o"], "k").collect()
    for g in range(3):
        assert [r["k"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["o"])] == list(range(1, sum(r["g"] == g for r in got) + 1))


def test_select_terms_and_free_days(spark):
    terms = spark.createDataFrame([("Krabbelgruppe",), ("Musikgarten",)], "term string")
    assert [r["term"] for r in discovery.select_terms(terms, [" musik "]).collect()] == ["Musikgarten"] and discovery.select_terms(terms, []).count() == 2
    with pytest.raises(ValueError):
        discovery.select_terms(terms, ["chor"])
    assert one(spark, site.free_day(F.col("k"), F.col("w"), F.lit("2024-06-15").cast("date"), 6), k="free", w="empty")
