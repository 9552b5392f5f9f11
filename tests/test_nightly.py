"""Nights in a row: memory, losses by page, held pages, verdicts, and publishing two tables together."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import nightly
from tidemark.plans import build_queries
from tidemark.sources import sinks

OFFER = "id string, provider string, venue string, title string, kind string, low int, high int, topics array<string>, sessions array<struct<start: timestamp_ntz, end: timestamp_ntz>>, listed_at timestamp_ntz"
EVENT = "provider string, venue string, title string, kind string, low int, high int, occurrences array<struct<start: timestamp_ntz, end: timestamp_ntz>>, rank int, ord long, topics array<string>, unit string, keep string"
day = lambda d: F.lit(d).cast("date")
moment = lambda t: F.lit(t).cast("timestamp_ntz")


def weeks(first, n, hour=10):
    return [(datetime(2026, 3, first, hour) + timedelta(weeks=k), datetime(2026, 3, first, hour + 1) + timedelta(weeks=k)) for k in range(n)]


def offers(spark, *rows):
    return spark.createDataFrame([(i, "p", "v", t, "regular", None, None, [], s, datetime(2026, 1, 1)) for i, t, s in rows], OFFER)


def events(spark, *rows):
    return spark.createDataFrame([("p", "v", t, "regular", None, None, s, 0, k, ["x"], u, keep) for k, (t, s, u, keep) in enumerate(rows)], EVENT)


def night(spark, new, before, memory, first="2026-03-02"):
    providers, venues = spark.createDataFrame([("p", None)], "provider string, reason string"), spark.createDataFrame([("p", "v")], "provider string, venue string")
    return nightly.build(new, before, memory, providers, venues, day(first), day("2026-08-31"), moment(f"{first} 00:00:00"), moment(f"{first} 03:00:00"))


def test_an_offer_that_vanished_comes_back_under_its_id(spark):
    none = spark.createDataFrame([], build_queries.MEMORY)
    before = offers(spark, ("sunny001", "Spielkreis Sonne", weeks(3, 12)), ("moon0001", "Musikgarten Mond", weeks(4, 12)))
    second = night(spark, events(spark, ("Musikgarten Mond", weeks(4, 12), "u1", None)), before, none)
    rest = nightly.remember(none, before, second, moment("2026-03-02 03:00:00"), day("2026-03-02"), day("2026-08-31"))
    assert [(r["id"], r["title"], len(r["starts"]), r["horizon_to"]) for r in rest.collect()] == [("sunny001", "Spielkreis Sonne", 12, date(2026, 6, 22))]
    third = night(spark, events(spark, ("Musikgarten Mond", weeks(4, 12), "u1", None), ("Spielkreis Sonne neu", weeks(3, 12), "u2", None)), second.select(*nightly.OFFER), rest, "2026-03-09")
    got = {r["title"]: (r["id"], r["stage"], r["unit"], r["listed_at"].date()) for r in third.collect()}
    assert got == {"Musikgarten Mond": ("moon0001", "key", "u1", date(2026, 1, 1)), "Spielkreis Sonne neu": ("sunny001", "resting starts", "u2", date(2026, 1, 1))}
    assert nightly.remember(rest, second, third, moment("2026-03-09 03:00:00"), day("2026-03-09"), day("2026-08-31")).count() == 0


def test_what_the_memory_forgets(spark):
    entry = lambda i, since, last: (i, "k", "p", "v", "t", "regular", None, None, None, since, date(2026, 6, 1), [last])
    now, late = datetime(2026, 3, 1), datetime(2026, 5, 1)
    memory = spark.createDataFrame([entry("stays", now, late), entry("old", datetime(2025, 12, 1), late), entry("over", now, now), entry("back", now, late), entry("known", now, late)], build_queries.MEMORY)
    before = offers(spark, ("known", "a", weeks(1, 1)), ("gone", "b", weeks(9, 40)))
    out = nightly.remember(memory, before, offers(spark, ("back", "c", weeks(9, 2))), moment("2026-03-02 03:00:00"), day("2026-03-02"), day("2026-12-31"))
    got = {r["id"]: (r["since"].date(), len(r["starts"])) for r in out.collect()}
    assert got == {"stays": (date(2026, 3, 1), 1), "gone": (date(2026, 3, 2), 16)}  # 112 days hold 16 weekly starts


def test_losses_name_their_page_and_verdicts_release_it(spark):
    ahead, over = weeks(9, 2), [(datetime(2026, 2, 1), datetime(2026, 2, 1, 1))]
    before = offers(spark, ("a", "t", ahead), ("b", "t", ahead), ("c", "t", ahead), ("d", "t", over), ("e", "t", ahead), ("f", "t", ahead))
    built = offers(spark, ("f", "t", ahead))
    held = spark.createDataFrame([("a", "u2"), ("b", "u2"), ("c", "u9"), ("d", "u2"), ("e", None), ("f", "u2")], "id string, unit string")
    gated = spark.createDataFrame([("p", "u2"), ("p", "u3")], "provider string, unit string")
    losses = nightly.unit_losses(before, built, held, gated, day("2026-03-02"))
    assert [tuple(r) for r in losses.collect()] == [("p", "u2", ["a", "b", "c"], True)]
    own = nightly.unit_losses(before.where("id != 'c'"), built, held, gated, day("2026-03-02"))
    assert [tuple(r) for r in own.collect()] == [("p", "u2", ["a", "b"], False)]
    units, old = (spark.createDataFrame([("p", u, s) for u in ("u2", "u3")], "provider string, unit string, state string") for s in ("new", "old"))
    state = lambda l, *verdicts: {r["unit"]: (r["state"], r["held"]) for r in nightly.hold(units, old, l, spark.createDataFrame([("p", "u2", v) for v in verdicts], "provider string, unit string, id string")).collect()}
    assert state(own) == state(own, "a") == state(losses, "a", "b", "c") == {"u2": ("old", True), "u3": ("new", False)}
    assert state(own, "a", "b") == {"u2": ("new", False), "u3": ("new", False)}


def test_a_verdict_keeps_an_id_whatever_has_changed(spark):
    e = events(spark, ("Ganz anderer Name", weeks(6, 3, 18), "u1", None), ("Noch einer", weeks(5, 3, 9), "u1", None)).withColumn("n", F.col("ord"))
    verdicts = spark.createDataFrame([("p", "u1", 0, "sunny001"), ("p", "u1", 1, "x"), ("p", "u1", 1, "y")], "provider string, unit string, n long, id string")
    out = night(spark, nightly.with_verdicts(e, verdicts), offers(spark, ("sunny001", "Spielkreis Sonne", weeks(3, 12))), spark.createDataFrame([], build_queries.MEMORY))
    got = {r["title"]: (r["id"], r["stage"]) for r in out.collect()}
    assert got["Ganz anderer Name"] == ("sunny001", "kept") and got["Noch einer"][1] == "new"


def test_two_tables_are_published_together_or_not_at_all(spark, tmp_path):
    path = str(tmp_path)
    one = lambda n: {"offers": spark.range(n), "memory": spark.range(10 * n)}
    sizes = lambda: (sinks.published(spark, path, "offers").count(), sinks.published(spark, path, "memory").count())
    assert sinks.manifest(spark, path) == (0, {})
    assert sinks.publish_together(one(1), path) == 1 and sizes() == (1, 10)
    assert sinks.publish_together(one(2), path, spark.range(1)) == 0 and sizes() == (1, 10)
    bad = spark.range(3).select(F.raise_error(F.lit("broken")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        sinks.publish_together({"offers": spark.range(3), "memory": bad}, path)
    assert sizes() == (1, 10)
    more = sinks.published(spark, path, "offers").union(spark.range(5))
    assert sinks.publish_together({"offers": more, "memory": spark.range(7)}, path) == 2 and sizes() == (6, 7)
