"""Scalar rules on awkward values; the session's zone is Los Angeles on purpose."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import numbers, textfn, timefn, urlfn


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def ts(s):
    return F.lit(s).cast("timestamp")


def ntz(s):
    return F.lit(s).cast("timestamp_ntz")


def day(s):
    return F.lit(s).cast("date")


def test_zone(spark):
    got = one(spark, timefn.civil_date(ts("2024-03-30T23:30:00Z")), timefn.minute_key(ts("2024-07-01T10:05:00Z")), timefn.iso_with_offset(ts("2024-07-01T10:05:09Z")), timefn.iso_with_offset(ts("2024-01-01T10:05:09Z")))
    assert got == (date(2024, 3, 31), "20240701T1205", "2024-07-01T12:05:09+02:00", "2024-01-01T11:05:09+01:00")


def test_local_to_utc_in_gap_and_overlap(spark):
    got = one(spark, timefn.to_utc(ntz("2024-03-31 02:30:00")), timefn.to_utc(ntz("2024-10-27 02:30:00")), timefn.to_utc(ntz("2024-10-27 03:00:00")), timefn.to_utc(ntz("2024-07-01 12:00:00")), timefn.to_utc(ntz("2024-03-31 03:00:00")))
    assert got == (None, datetime(2024, 10, 27, 0, 30), datetime(2024, 10, 27, 2, 0), datetime(2024, 7, 1, 10, 0), datetime(2024, 3, 31, 1, 0))


@pytest.mark.parametrize(
    ("birth", "at", "months"),
    [("2024-01-30", "2024-02-28", 0), ("2023-01-30", "2023-02-28", 1), ("2024-01-31", "2024-04-30", 3), ("2024-02-29", "2025-02-28", 12), ("2024-05-10", "2024-05-09", -1), ("2024-05-10", "2024-05-10", 0), ("2024-05-10", "2025-05-09", 11)],
)
def test_age_in_months(spark, birth, at, months):
    assert one(spark, timefn.age_in_months(day(birth), day(at))) == (months,)


def test_dates(spark):
    got = one(spark, timefn.strict_date(F.lit("2024-02-30")), timefn.strict_date(F.lit("2024-2-3")), timefn.strict_date(F.lit("2024-02-29")), timefn.add_months(day("2024-01-31"), 1), timefn.iso_weekday(day("2024-01-01")), timefn.days_in_month(day("2023-02-01")))
    assert got == (None, None, date(2024, 2, 29), date(2024, 2, 29), 1, 28)
    got = one(spark, *[timefn.german_date(F.lit(s), day("2024-06-01")) for s in ("1.2.2024", "01/02/2024", "01022024", "31.2.2024", "1.7.2024", "x")])
    assert got == (date(2024, 2, 1),) * 3 + (None,) * 3


def test_nth_weekday(spark):
    got = one(spark, *[timefn.nth_weekday(F.lit(2024), F.lit(m), F.lit(w), F.lit(n)) for m, w, n in ((1, 1, 1), (2, 4, 4), (2, 4, 5), (2, 5, -1), (12, 7, -1))])
    assert got == (date(2024, 1, 1), date(2024, 2, 22), date(2024, 2, 29), date(2024, 2, 23), date(2024, 12, 29))


def test_transit_seconds(spark):
    assert one(spark, *[timefn.transit_seconds(F.lit(s)) for s in ("25:01:02", "7:00:00", "7:60:00", "")]) == (90_062, 25_200, None, None)


def test_numbers(spark):
    assert one(spark, *[numbers.half_up(F.lit(x)) for x in (-0.5, 0.5, 1.5, -1.5)]) == (0, 1, 2, -1)
    assert one(spark, *[numbers.rounded_minutes(F.lit(x)) for x in (1.0, 7.4, 7.5, 58.0, 63.0, 66.0, 121.0)]) == (5, 5, 10, 60, 60, 70, None)
    assert one(spark, *[numbers.rounded_metres(F.lit(x)) for x in (10.0, 149.0, 151.0, 9_960.0, 10_400.0)]) == (100, 100, 200, 10_000, 10_000)
    metres = one(spark, numbers.haversine_m(F.lit(49.0), F.lit(11.0), F.lit(49.0), F.lit(11.01)), numbers.plane_m(F.lit(49.0), F.lit(11.0), F.lit(49.0), F.lit(11.01)))
    assert metres[0] == pytest.approx(729.5, abs=0.2) and metres[1] == pytest.approx(metres[0], abs=0.1)
    assert one(spark, numbers.is_geo_point(F.lit(float("nan")), F.lit(1.0)), numbers.is_geo_point(F.lit(None).cast("double"), F.lit(1.0)), numbers.is_geo_point(F.lit(90.0), F.lit(-180.0))) == (False, False, True)


def test_text(spark):
    got = one(spark, textfn.fold(F.lit("Mäuse-Straße Öl née ueber")), textfn.slug(F.lit("  Über Größe & Maß ")), textfn.slug(F.lit("!!")), textfn.slug(F.lit("abc def ghi"), 8), textfn.plain_text(F.lit("<p>a&nbsp;&amp;<b>b</b><script>x</script>\n c")), textfn.escape_ics(F.lit("a,b;c\\d\ne")))
    assert got == ("mause-strasse ol nee uber", "ueber-groesse-mass", "x", "abc-def", "a & b c", "a\\,b\\;c\\\\d\\ne")
    assert one(spark, textfn.masked(F.lit("at 2024-01-02T10:11:12Z sid=abc123")), textfn.escape_html(F.lit("<a & 'b'>"))) == ("at <time> sid=<id>", "&lt;a &amp; &#39;b&#39;&gt;")
    a, b = one(spark, textfn.order_free_hash(F.lit("a\nb")), textfn.order_free_hash(F.lit("b\na")))
    assert a == b
    a, b = one(spark, textfn.content_hash(F.lit("a"), F.lit("bc")), textfn.content_hash(F.lit("ab"), F.lit("c")))
    assert a != b
    assert one(spark, textfn.address_key(F.lit("Haupt Straße 12 a, 90402 Ort"))) == one(spark, textfn.address_key(F.lit("Hauptstr. 12a, 90402 Ort")))


def test_lcs_ratio():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return 2 * t[-1][-1] / (len(a) + len(b))

    for a, b in (("kitten", "sitting"), ("abcbdab", "bdcaba"), ("a", "b"), ("aaaa", "aa"), ("Größe", "Grösse")):
        assert textfn.lcs_ratio(a, b) == pytest.approx(slow(a, b))
    assert textfn.lcs_ratio("", "") == 1.0 and textfn.lcs_ratio("", "a") == 0.0


def test_fold_line():
    parts = textfn.fold_line("ä" * 100).split("\r\n")
    assert all(len(p.encode()) <= 75 for p in parts) and "".join(p[1:] if i else p for i, p in enumerate(parts)) == "ä" * 100


def test_similar_title(spark):
    assert one(spark, textfn.similar_title(F.lit("Yoga im Park"), F.lit("Park Konzert")), textfn.similar_title(F.lit("abc"), F.lit("xyz"))) == (True, False)


def test_urls(spark):
    a, b = (F.lit(x) for x in ("https://www.Example.org/a/?utm_source=x&b=2&a=1#top", "http://example.org/a?a=1&b=2"))
    assert one(spark, urlfn.canonical(a), urlfn.canonical(b)) == ("example.org/a?a=1&b=2",) * 2
    assert one(spark, urlfn.same_site(F.lit("blog.x.org"), F.lit("x.org")), urlfn.same_site(F.lit("ax.org"), F.lit("x.org")), urlfn.is_internal(F.lit("192.168.0.1")), urlfn.is_internal(F.lit("x.org"))) == (True, False, True, False)
    assert one(spark, urlfn.under_anchor(F.lit("http://x.org/a/b?k=1&l=2"), F.lit("https://x.org/a?k=1")), urlfn.under_anchor(F.lit("http://x.org/ab"), F.lit("http://x.org/a")), urlfn.never_visit(F.lit("http://x.org/p.PDF.jpg")), urlfn.host(F.lit("nothing"))) == (True, False, True, None)
