"""Calendar texts: properties by hand, rules against a plain walk over the days."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import calendar_rules

ZONE = "Europe/Berlin"


def calendar(*events):
    return "BEGIN:VCALENDAR\r\n" + "".join("BEGIN:VEVENT\r\n" + "\r\n".join(e) + "\r\nEND:VEVENT\r\n" for e in events) + "END:VCALENDAR\r\n"


def events(spark, *texts):
    return calendar_rules.calendar_events(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t", ZONE)


def found(spark, *texts, first="2026-01-01", last="2026-12-31"):
    rows = calendar_rules.occurrences(events(spark, *texts), "k", first, last, ZONE)
    rows = rows.select("k", "n", F.date_format("start", "yyyy-MM-dd HH:mm").alias("s"), F.date_format("end", "yyyy-MM-dd HH:mm").alias("e")).collect()
    return sorted((r["k"], r["n"], r["s"], r["e"]) for r in rows)


def test_properties(spark):
    text = calendar(
        ["UID:a", "SUMMARY:Song\\, dance", " s\\nand more", "DTSTART;TZID=America/New_York:20260310T200000", "DURATION:PT1H30M", "BEGIN:VALARM", "DURATION:PT5M", "DTSTART:20200101", "END:VALARM", "LOCATION;LANGUAGE=de:Hall: one"],
        ["UID:b", "DTSTART;VALUE=DATE:20261011", "DTEND;VALUE=DATE:20261013"],
        ["UID:c", "DTSTART:20261011T223000Z", "DTEND:20261011T233000Z"],
        ["UID:d", "DTSTART;TZID=Nowhere/City:20261011T100000", "STATUS:cancelled"],
        ["UID:e", "DTSTART:2026-10-11"],
        ["UID:f", "DTSTART:20261011T100000", "DTEND:soon"],
    )
    rows = events(spark, text, None, "").withColumn("last", calendar_rules.last_day(ZONE).cast("string")).orderBy("n").collect()
    assert [r["summary"] for r in rows][0] == "Song, dances and more" and rows[0]["location"] == "Hall: one" and rows[0]["seconds"] == 5400
    assert [r["last"] for r in rows] == ["2026-03-11", "2026-10-12", "2026-10-12", "2026-10-11", None, None]
    assert [r["problem"] for r in rows] == [None, None, None, None, "start", "end"]
    assert [x[2:] for x in found(spark, text)] == [("2026-03-11 01:00", "2026-03-11 02:30"), ("2026-10-11 00:00", "2026-10-13 00:00"), ("2026-10-12 00:30", "2026-10-12 01:30")]


def test_rules_keep_civil_time_and_exceptions(spark):
    weekly = calendar(["UID:w", "DTSTART;TZID=Europe/Berlin:20261020T180000", "DTEND;TZID=Europe/Berlin:20261020T193000", "RRULE:FREQ=WEEKLY;COUNT=4", "EXDATE;TZID=Europe/Berlin:20261027T180000,20261103T180000"])
    assert [x[2] for x in found(spark, weekly)] == ["2026-10-20 18:00", "2026-11-10 18:00"]  # the excluded days count; the clock changed on 25 October
    utc = calendar(["UID:u", "DTSTART:20261020T160000Z", "RRULE:FREQ=WEEKLY;UNTIL=20261027T160000Z"])
    assert [x[2:] for x in found(spark, utc)] == [("2026-10-20 18:00", None), ("2026-10-27 17:00", None)]
    moved = calendar(["UID:m", "DTSTART:20260105T090000", "RRULE:FREQ=DAILY;COUNT=3"], ["UID:m", "RECURRENCE-ID:20260106T090000", "DTSTART:20260108T110000"], ["UID:m", "RECURRENCE-ID:20260107T090000", "DTSTART:20260107T090000", "STATUS:CANCELLED"])
    assert [x[1:3] for x in found(spark, moved)] == [(0, "2026-01-05 09:00"), (1, "2026-01-08 11:00")]
    odd = [calendar([f"UID:{i}", "DTSTART:20260105T090000", f"RRULE:{r}"]) for i, r in enumerate(["FREQ=HOURLY", "FREQ=MONTHLY;BYSETPOS=1;BYDAY=MO", "FREQ=WEEKLY;INTERVAL=0", "FREQ=DAILY;UNTIL=later", "FREQ=WEEKLY;BYDAY=2MO", "FREQ=DAILY;COUNT=x"])]
    assert [r["problem"] for r in events(spark, *odd).orderBy("k").collect()] == ["FREQ", "BYSETPOS", "INTERVAL", "UNTIL", "BYDAY", "COUNT"] and found(spark, *odd) == []


def test_random_rules_equal_a_walk_over_the_days(spark):
    r, texts, want = random.Random(3), [], []
    names = ["MO", "TU", "WE", "TH", "FR", "SA", "SU"]
    for k in range(300):
        begin, every, freq = date(2024, 1, 1) + timedelta(r.randrange(900)), r.randint(1, 4), r.choice(["DAILY", "WEEKLY", "MONTHLY", "YEARLY"])
        rule, byday, bymonth = [f"FREQ={freq}", f"INTERVAL={every}"], None, None
        if freq in ("DAILY", "WEEKLY") and r.random() < 0.7:
            byday = [(0, w) for w in r.sample(range(7), r.randint(1, 4))]
        elif freq == "MONTHLY" and r.random() < 0.5:
            byday = [(r.choice([0, 1, 2, 5, -1, -2]), w) for w in r.sample(range(7), r.randint(1, 2))]
        elif freq in ("MONTHLY", "YEARLY") and r.random() < 0.5:
            bymonth = r.sample([1, 15, 29, 30, 31, -1, -31], 2)
        rule += ["BYDAY=" + ",".join((str(n) if n else "") + names[w] for n, w in byday)] if byday else []
        rule += ["BYMONTHDAY=" + ",".join(map(str, bymonth))] if bymonth else []
        count = r.choice([None, None, r.randint(1, 30)])
        until = begin + timedelta(r.randrange(-5, 900)) if count is None and r.random() < 0.5 else None
        rule += [f"COUNT={count}"] if count else [f"UNTIL={until:%Y%m%d}"] if until else []
        off = [begin + timedelta(7 * r.randrange(30)) for _ in range(r.randint(0, 3))]
        days, d = [], begin
        while d <= (until or date(2026, 12, 31)) and d <= date(2026, 12, 31) and (count is None or len(days) < count):
            size = ((d.replace(day=28) + timedelta(4)).replace(day=1) - timedelta(1)).day
            weeks = ((d - timedelta(d.weekday())) - (begin - timedelta(begin.weekday()))).days // 7
            months = (d.year - begin.year) * 12 + d.month - begin.month
            step = {"DAILY": (d - begin).days, "WEEKLY": weeks, "MONTHLY": months, "YEARLY": months / 12}[freq]
            if byday:
                fits = any(w == d.weekday() and (n == 0 or (n > 0 and (d.day - 1) // 7 + 1 == n) or (n < 0 and (size - d.day) // 7 + 1 == -n)) for n, w in byday)
            elif bymonth:
                fits = d.day in bymonth or d.day - size - 1 in bymonth
            else:
                fits = freq == "DAILY" or (d.weekday() == begin.weekday() if freq == "WEEKLY" else d.day == begin.day)
            if step % every == 0 and fits:
                days.append(d)
            d += timedelta(1)
        texts.append(calendar([f"UID:{k}", f"DTSTART;TZID=Europe/Berlin:{begin:%Y%m%d}T200000", "DURATION:PT5H", "RRULE:" + ";".join(rule), *(["EXDATE:" + ",".join(f"{x:%Y%m%d}T200000" for x in off)] if off else [])]))
        for x in days:
            if x not in off and x.year == 2026:
                s = datetime(x.year, x.month, x.day, 20)
                want.append((k, 0, f"{s:%Y-%m-%d %H:%M}", f"{s + timedelta(hours=5):%Y-%m-%d %H:%M}"))
    assert found(spark, *texts) == sorted(want) and len(want) > 5000


def test_no_rows(spark):
    empty = calendar_rules.calendar_events(spark.createDataFrame([], "k int, t string"), "k", "t", ZONE)
    assert empty.collect() == [] and calendar_rules.occurrences(empty, "k", "2026-01-01", "2026-12-31", ZONE).collect() == []
