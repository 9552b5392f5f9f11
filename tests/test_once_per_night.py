"""What the night before costs: its offers are made once, and titles are compared once a pair of titles."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import identity, offer_build
from tidemark.plans.build_queries import MEMORY


def test_the_night_before_is_made_once(spark):
    t = datetime(2026, 3, 2, 10)
    weeks = lambda hour: [(t + timedelta(weeks=n, hours=hour), t + timedelta(weeks=n, hours=hour + 1)) for n in range(8)]
    kind = "{} string, provider string, venue string, title string, kind string, low int, high int, sessions array<struct<start timestamp_ntz, end timestamp_ntz>>"
    # Providers 0 to 5 keep all; 6 to 8 have another title; 9 has another title and other starts.
    old = [(f"o{k}", str(k), "v", "Krabbelkäfer", "regular", None, None, weeks(0)) for k in range(10)]
    new = [(f"d{k}", str(k), "v", "Krabbelkäfer" if k < 6 else "Zwergenrunde", "regular", None, None, weeks(0 if k < 9 else 5)) for k in range(10)]
    made = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda title: made.add(1) or title)
    previous = spark.createDataFrame(old, kind.format("id")).withColumn("title", seen("title"))
    drafts = spark.createDataFrame(new, kind.format("draft")).withColumn("keep", F.lit(None).cast("string"))
    venues = spark.createDataFrame([("v",)], "venue string")
    day = lambda n: F.lit(date(2026, n, 1))
    out = identity.assign(drafts, previous, spark.createDataFrame([], MEMORY), venues, day(3), day(6))
    got = {r["draft"]: (r["id"], r["stage"]) for r in out.collect()}
    assert {d: s for d, (_, s) in got.items()} == {**{f"d{k}": "key" for k in range(6)}, **{f"d{k}": "starts" for k in range(6, 9)}, "d9": "new"}
    assert all(i == d.replace("d", "o") for d, (i, s) in got.items() if s != "new")
    assert made.value == len(old)


def test_titles_of_pairs_are_told_once_and_nulls_stay(spark):
    pairs = spark.createDataFrame([("Kurs F", "Kurs O"), ("Krabbelkäfer", "Krabbelkäfer neu"), ("Yoga Juni", "Yoga Mai"), (None, "Yoga")], "was string, title string")
    got = {r["__t"]: (r["similar"], r["opposed"], r["alike"], r["ratio"]) for r in identity._told(pairs).collect()}
    assert got["Krabbelkäfer"] == (True, False, True, 24 / 28)
    assert got["Yoga Juni"][:3] == (True, True, False)
    assert got["Kurs F"][:3] == (True, False, False)
    assert got[None][2:] == (None, 0.0) or got[None][2:] == (False, 0.0)


def test_offers_without_another_rank_do_not_meet(spark):
    t = datetime(2026, 3, 2, 10)
    rows = [
        ("a", 1, "v", 0, 1, "Krabbelkäfer", ["x"], [(t, t)]), ("b", 1, "v", 0, 2, "Krabbelkäfer", ["y"], [(t, t)]), ("c", 1, "v", 1, 3, "Krabbelkäfer", ["z"], [(t, t)]),
        ("d", 2, "v", 0, 4, "Krabbelkäfer", ["x"], [(t, t)]), ("e", 2, "v", 0, 5, "Krabbelkäfer", ["y"], [(t, t)]), ("f", None, "v", 1, 6, "Krabbelkäfer", ["y"], [(t, t)]),
    ]
    o = spark.createDataFrame(rows, "id string, provider int, venue string, rank int, ord int, title string, topics array<string>, sessions array<struct<start timestamp_ntz, end timestamp_ntz>>")
    assert {r["id"]: sorted(r["topics"]) for r in offer_build.drop_outranked(o).collect()} == {"a": ["x", "z"], "b": ["y"], "d": ["x"], "e": ["y"], "f": ["y"]}
