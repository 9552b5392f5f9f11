"""Which occurrence of an offer counts. Sessions are an ascending array of struct<start, end>."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timefn

COURSE, REGULAR, SINGLE = "course", "regular", "single"


@dataclass(frozen=True)
class Rule:
    """Days (inclusive, either may be open) and times of day that a session must match; nothing set: any."""

    start: date | None = None
    end: date | None = None
    daytimes: Sequence[str] = ()

    @property
    def active(self) -> bool:
        return self.start is not None or self.end is not None or bool(self.daytimes)

    def fits(self, session: Column) -> Column:
        ok, day = F.lit(True), F.to_date(session["start"])
        if self.start is not None:
            ok = ok & (day >= F.lit(self.start))
        if self.end is not None:
            ok = ok & (day <= F.lit(self.end))
        return ok & timefn.daytime(session["start"]).isin(list(self.daytimes)) if self.daytimes else ok


def collect_sessions(rows: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """One row per key with its sessions: ascending, one per start (the shortest)."""
    all_ = F.array_sort(F.collect_list(F.struct(F.col(start).alias("start"), F.col(end).alias("end"))))
    g = rows.where(F.col(start).isNotNull()).groupBy(*keys).agg(all_.alias("__s"))  # one shuffle; repeated starts go in the row
    first = F.filter("__s", lambda s, i: (i == 0) | (F.get("__s", i - 1)["start"] != s["start"]))
    return g.select(*keys, first.alias("sessions"))


def first(sessions: Column) -> Column:
    return F.try_element_at(sessions, F.lit(1))


def upcoming(sessions: Column, now: Column) -> Column:
    """Sessions that haven't ended: end at ``now`` or later."""
    return F.filter(sessions, lambda s: s["end"] >= now)


def next_session(sessions: Column, now: Column) -> Column:
    return first(upcoming(sessions, now))


def started_course(kind: Column, registered: Column, sessions: Column, now: Column) -> Column:
    """A course that takes registrations and has begun; without a session: no."""
    return F.coalesce((kind == COURSE) & registered & (first(sessions)["start"] <= now), F.lit(False))


def course_running(kind: Column, sessions: Column, now: Column) -> Column:
    last = F.try_element_at(sessions, F.lit(-1))
    return F.coalesce((kind == COURSE) & (first(sessions)["start"] <= now) & (last["end"] >= now), F.lit(False))


def discoverable(kind: Column, registered: Column, sessions: Column, now: Column) -> Column:
    """Has a session that hasn't ended, and isn't a course already begun."""
    return (F.size(upcoming(sessions, now)) > 0) & ~started_course(kind, registered, sessions, now)


def candidates(kind: Column, sessions: Column, now: Column, rule: Rule = Rule()) -> Column:
    """Sessions that may stand for the offer: of a course its first, even if past, else those not ended; under the rule."""
    return F.filter(sessions, lambda s, i: F.when(kind == COURSE, i == 0).otherwise(s["end"] >= now) & rule.fits(s))


def shown(kind: Column, sessions: Column, now: Column, rule: Rule = Rule(), fit=None) -> Column:
    """The session to show: a course without rule shows its next, others the first candidate; one that ``fit``s goes first."""
    pool = candidates(kind, sessions, now, rule)
    if not rule.active:
        pool = F.when(kind == COURSE, upcoming(sessions, now)).otherwise(pool)
    base = first(pool)
    return base if fit is None else F.coalesce(first(F.filter(pool, fit)), base)


def on_day(sessions: Column, day: Column) -> Column:
    return first(F.filter(sessions, lambda s: F.to_date(s["start"]) == day))


def reference(kind: Column, sessions: Column, now: Column, day: Column) -> Column:
    """The session on the chosen day, else the one shown."""
    return F.coalesce(on_day(sessions, day), shown(kind, sessions, now))


def progress(sessions: Column, now: Column) -> tuple[Column, Column]:
    """(all, not ended)."""
    return F.size(sessions), F.size(upcoming(sessions, now))


def rhythm(sessions: Column, now: Column) -> Column:
    """ISO weekday if all upcoming sessions (two at least) share it and come weekly at one clock time, negative if
    they share the weekday only, null otherwise."""
    left = upcoming(sessions, now)
    days = F.transform(left, lambda s: F.datediff(F.to_date(s["start"]), F.lit("1970-01-05")))
    weekdays = F.array_distinct(F.transform(days, lambda d: F.pmod(d, F.lit(7)) + 1))
    clocks = F.array_distinct(F.transform(left, lambda s: F.date_format(s["start"], "HH:mm")))
    gaps = F.zip_with(F.slice(days, F.lit(2), F.greatest(F.size(days) - 1, F.lit(0))), F.slice(days, F.lit(1), F.greatest(F.size(days) - 1, F.lit(0))), lambda b, a: b - a)
    weekly = F.forall(gaps, lambda g: g == 7) & (F.size(clocks) == 1)
    day = F.try_element_at(weekdays, F.lit(1))
    return F.when((F.size(left) >= 2) & (F.size(weekdays) == 1), F.when(weekly, day).otherwise(-day))


def uniform_times(sessions: Column) -> Column:
    """Do all sessions have the same start and end on the clock?"""
    return F.size(F.array_distinct(F.transform(sessions, lambda s: F.concat(F.date_format(s["start"], "HH:mm"), F.date_format(s["end"], "HH:mm"))))) <= 1


def collapsed(sessions: Column, chosen: Column, n: int = 3) -> Column:
    """The first ``n``, and the chosen one if it comes later."""
    head = F.slice(sessions, 1, n)
    return F.when(chosen.isNull() | F.array_contains(head, chosen), head).otherwise(F.array_append(head, chosen))


def fits_age(low: Column, high: Column, birth: Column, at: Column) -> Column:
    """Completed months at a date within an inclusive range; without a range 0 to 36."""
    months = timefn.age_in_months(birth, at)
    return months.between(F.coalesce(low, F.lit(0)), F.coalesce(high, F.lit(36)))


def offer_fits_age(kind: Column, sessions: Column, low: Column, high: Column, birth: Column, now: Column) -> Column:
    """Courses and single events by their first session, regular ones by any that hasn't ended."""
    any_left = F.exists(upcoming(sessions, now), lambda s: fits_age(low, high, birth, F.to_date(s["start"])))
    return F.when(kind == REGULAR, any_left).otherwise(F.coalesce(fits_age(low, high, birth, F.to_date(first(sessions)["start"])), F.lit(False)))


def union_sessions(a: Column, b: Column) -> Column:
    """Sessions of both, ascending; of one start that of ``a`` counts."""
    starts = F.transform(a, lambda s: s["start"])
    return F.array_sort(F.concat(a, F.filter(b, lambda s: ~F.array_contains(starts, s["start"]))))


def shared_window(a: Column, b: Column, since: Column) -> tuple[Column, Column]:
    """(from, to) where two series' extents overlap from ``since`` on; nulls if they don't."""
    lo = F.greatest(first(a)["start"], first(b)["start"], since)
    hi = F.least(F.try_element_at(a, F.lit(-1))["start"], F.try_element_at(b, F.lit(-1))["start"])
    return F.when(lo <= hi, lo), F.when(lo <= hi, hi)


def ended_on(sessions: Column, day: Column, now: Column) -> Column:
    """How many sessions of the day are over by ``now``."""
    return F.size(F.filter(sessions, lambda s: (F.to_date(s["start"]) == day) & (s["end"] < now)))


def last_day(sessions: Column) -> Column:
    """Day of the last session."""
    return F.to_date(F.try_element_at(sessions, F.lit(-1))["start"])


def is_new_run(before: Column, after: Column, horizon: Column, gap: int = 14) -> Column:
    """Does the first session that is new start ``gap`` days or more after the last one known, within the old horizon?"""
    known = F.transform(before, lambda s: s["start"])
    fresh = F.array_min(F.array_except(F.transform(after, lambda s: s["start"]), known))
    return F.coalesce((F.datediff(F.to_date(fresh), F.to_date(F.array_max(known))) >= gap) & (F.to_date(fresh) <= horizon), F.lit(False))
