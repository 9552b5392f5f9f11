"""Work per row that findings of round 3 named: what is done once a row, a class or a batch is counted."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tidemark.functions import timefn
from tidemark.operators import calendar_rules, offer_build


def test_sessions_are_timed_once(spark):
    t = datetime(2026, 3, 1, 10)
    rows = [
        (1, "course", "Kurs", None, None, [(t - timedelta(days=60), None), (t + timedelta(days=60), t + timedelta(days=60, hours=2))]),
        (2, "course", "Kurs", None, None, [(t - timedelta(days=60), None)]),  # over
        (3, "single", "Kurs", 3, 50, [(t, t), (t + timedelta(days=1), None), (t + timedelta(days=90), None)]),
        (4, "regular", "Kurs", 40, 50, [(t, None)]),  # for older ones
        (5, "regular", "Kurs", None, None, [(datetime(2026, 3, 29, 2, 30), None), (datetime(2026, 3, 28, 9), datetime(2026, 3, 29, 2, 30))]),  # in a gap
        (6, "regular", "Kurs", None, None, [(None, None)]),
        (7, "regular", "Kurs", None, None, []),
    ]
    kind = "id int, kind string, title string, low int, high int, occurrences array<struct<start timestamp_ntz, end timestamp_ntz>>"
    out = offer_build.drafts(spark.createDataFrame(rows, kind), F.lit(date(2026, 3, 1)), F.lit(date(2026, 3, 31)))
    hour = timedelta(hours=1)
    got = sorted((r["id"], r["low"], r["high"], [tuple(s) for s in r["sessions"]]) for r in out.collect())
    far = t + timedelta(days=60)
    assert got == [
        (1, None, None, [(t - timedelta(days=60), t - timedelta(days=60) + hour), (far, far + 2 * hour)]),
        (3, 3, 36, [(t, t + hour)]),
        (3, 3, 36, [(t + timedelta(days=1), t + timedelta(days=1) + hour)]),
        (5, None, None, [(datetime(2026, 3, 28, 9), datetime(2026, 3, 28, 10))]),
    ]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("convert_timezone") <= 6  # start, end and the hour after the start, there and back; once a mention it would be dozens


def test_civil_times_in_gaps_and_overlaps(spark):
    at = [datetime(2026, 3, 29, 1, 59), datetime(2026, 3, 29, 2, 0), datetime(2026, 3, 29, 2, 59), datetime(2026, 3, 29, 3, 0), datetime(2026, 10, 25, 2, 30), None]
    d = spark.createDataFrame([(x,) for x in at], "t timestamp_ntz")
    got = [(r["a"], r["b"]) for r in d.select(timefn.exists(F.col("t")).alias("a"), timefn.to_utc(F.col("t")).isNotNull().alias("b")).collect()]
    assert got == [(x, x) for x in (True, False, False, True, True, False)]


def test_calendar_texts_are_searched_once_and_rules_go_by_their_own_days(spark):
    event = "BEGIN:VEVENT\nUID:{0}\nDTSTART:{1}\nRRULE:{2}\nEND:VEVENT\n"
    rules = [
        ("00010103T100000", "FREQ=DAILY;INTERVAL=2000000000;COUNT=2000000000"),
        ("20260131T100000", "FREQ=MONTHLY;COUNT=3"),
        ("20240229T100000", "FREQ=YEARLY;COUNT=2"),
        ("20260101T100000", "FREQ=WEEKLY;INTERVAL=2;BYDAY=MO;COUNT=2"),
        ("20260106T100000", "FREQ=DAILY;INTERVAL=2;BYDAY=MO;COUNT=2"),
        ("20260101T100000", "FREQ=MONTHLY;BYMONTHDAY=-31,1;COUNT=3"),
    ]
    texts = spark.createDataFrame([(1, "".join(event.format(i, *r) for i, r in enumerate(rules)))], "k int, t string")
    events = calendar_rules.calendar_events(texts, "k", "t", "Europe/Berlin")
    got = {}
    for r in calendar_rules.occurrences(events, "k", "0001-01-01", "2030-12-31", "Europe/Berlin").collect():
        got.setdefault(r["n"], []).append(r["day"].isoformat())
    assert {k: sorted(v) for k, v in got.items()} == {
        0: ["0001-01-03"], 1: ["2026-01-31", "2026-03-31", "2026-05-31"], 2: ["2024-02-29", "2028-02-29"],
        3: ["2026-01-12", "2026-01-26"], 4: ["2026-01-12", "2026-01-26"], 5: ["2026-01-01", "2026-02-01", "2026-03-01"],
    }
    assert events._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 40  # once a text, not once a mention
