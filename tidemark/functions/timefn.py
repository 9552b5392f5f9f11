"""Civil time as column expressions: zones with gaps and overlaps, months, weekdays, clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Berlin"


def local(instant: Column, zone: str = ZONE) -> Column:
    """Civil date-time (without zone) of an instant. The session's own zone doesn't matter."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.to_utc_timestamp(instant, F.current_timezone()).cast("timestamp_ntz"))


def civil_date(instant: Column, zone: str = ZONE) -> Column:
    return F.to_date(local(instant, zone))


def minute_key(instant: Column, zone: str = ZONE) -> Column:
    """Local minute as YYYYMMDDTHHMM."""
    return F.date_format(local(instant, zone), "yyyyMMdd'T'HHmm")


def to_utc(civil: Column, zone: str = ZONE) -> Column:
    """UTC date-time of a civil one. In an overlap the earlier instant counts; in a gap there is none: null."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), civil.cast("timestamp_ntz"))
    earlier = utc - F.expr("INTERVAL 1 HOUR")
    back = lambda x: F.convert_timezone(F.lit("UTC"), F.lit(zone), x)
    first = F.when(back(earlier) == civil.cast("timestamp_ntz"), earlier).otherwise(utc)
    return F.when(back(first) == civil.cast("timestamp_ntz"), first)


def exists(civil: Column, zone: str = ZONE) -> Column:
    """Is there such a civil time, or does it lie in a gap? As ``to_utc(...).isNotNull()``, for half the conversions."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), civil.cast("timestamp_ntz"))
    return F.coalesce(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc) == civil.cast("timestamp_ntz"), F.lit(False))


def utc_basic(utc: Column) -> Column:
    """UTC date-time in the basic form of calendars: 20240115T120000Z."""
    return F.date_format(utc, "yyyyMMdd'T'HHmmss'Z'")


def iso_with_offset(instant: Column, zone: str = ZONE) -> Column:
    """Local ISO text with its numeric offset, whole seconds."""
    here = F.date_trunc("second", local(instant, zone))
    there = F.date_trunc("second", F.to_utc_timestamp(instant, F.current_timezone())).cast("timestamp_ntz")
    minutes = F.timestamp_diff("MINUTE", there, here)
    sign = F.when(minutes < 0, "-").otherwise("+")
    clock = F.format_string("%s%02d:%02d", sign, F.floor(F.abs(minutes) / 60).cast("int"), (F.abs(minutes) % 60).cast("int"))
    return F.concat(F.date_format(here, "yyyy-MM-dd'T'HH:mm:ss"), clock)


def iso_weekday(day: Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(day) + 1


def days_in_month(day: Column) -> Column:
    return F.dayofmonth(F.last_day(day))


def add_months(day: Column, months: Column | int) -> Column:
    """A month's last day stands for days that the month lacks."""
    return F.add_months(day, months)


def strict_date(text: Column) -> Column:
    """A date of the form yyyy-mm-dd that exists, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def german_date(text: Column, today: Column) -> Column:
    """dd.mm.yyyy, also with / , or spaces between, or eight digits; null if it isn't a date or is after today."""
    pattern = r"^\s*(\d{1,2})[.,/ ]+(\d{1,2})[.,/ ]+(\d{4})\s*$"
    solid = r"^\s*(\d{2})(\d{2})(\d{4})\s*$"
    part = lambda i: F.when(text.rlike(solid), F.regexp_extract(text, solid, i)).otherwise(F.regexp_extract(text, pattern, i))
    iso = F.format_string("%s-%s-%s", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0"))
    day = strict_date(iso)
    return F.when(day <= today, day)


def german_text(day: Column) -> Column:
    return F.date_format(day, "dd.MM.yyyy")


def age_in_months(birth: Column, at: Column) -> Column:
    """Completed months; a birthday that a month lacks falls on the month's last day. Negative before birth."""
    months = (F.year(at) - F.year(birth)) * 12 + F.month(at) - F.month(birth)
    due = F.least(F.dayofmonth(birth), days_in_month(at))
    return months - F.when(F.dayofmonth(at) < due, 1).otherwise(0)


def daytime(start: Column, noon: int = 12, late: int = 15) -> Column:
    """Bucket of a civil start: before noon, before the late hour, or after."""
    return F.when(F.hour(start) < noon, "morning").when(F.hour(start) < late, "midday").otherwise("afternoon")


def same_minute(a: Column, b: Column) -> Column:
    return F.date_trunc("minute", a) == F.date_trunc("minute", b)


def transit_seconds(text: Column) -> Column:
    """Seconds of h:mm:ss, where hours may pass 24; null for another form."""
    form = r"^\s*(\d{1,2}):([0-5]\d):([0-5]\d)\s*$"
    part = lambda i: F.regexp_extract(text, form, i).cast("int")
    return F.when(text.rlike(form), F.expr("try_add(0, 0)") + part(1) * 3600 + part(2) * 60 + part(3))


def month_window(today: Column, months: int = 13) -> tuple[Column, Column]:
    """From the first of this month to ``months`` later."""
    first = F.trunc(today, "month")
    return first, F.add_months(first, months)


def nth_weekday(year: Column, month: Column, weekday: Column, nth: Column) -> Column:
    """The nth (1-4) or last (-1) given ISO weekday of a month; null if it has no such day."""
    first = F.make_date(year, month, F.lit(1))
    ahead = F.date_add(first, F.pmod(weekday - iso_weekday(first), F.lit(7)) + (nth - 1) * 7)
    last = F.last_day(first)
    behind = F.date_sub(last, F.pmod(iso_weekday(last) - weekday, F.lit(7)))
    day = F.when(nth == -1, behind).otherwise(ahead)
    return F.when(F.month(day) == month, day)
