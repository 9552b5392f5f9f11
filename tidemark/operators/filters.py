"""A selection over several dimensions: parsed from and written to query strings, applied as one predicate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import date
from functools import reduce
from operator import and_
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sessions import Rule

REACH_LIMITS = (10, 20, 30, 45)  # minutes


def valid_day(text: str | None) -> date | None:
    try:
        return date.fromisoformat(text) if text and len(text) == 10 else None
    except ValueError:
        return None


def day_range(a: str | None, b: str | None) -> tuple[date | None, date | None]:
    """Bounds that are no dates count as open; reversed ones are swapped."""
    lo, hi = valid_day(a), valid_day(b)
    return (hi, lo) if lo and hi and lo > hi else (lo, hi)


@dataclass(frozen=True)
class Selection:
    """Chosen values per dimension (none: any), a rule for sessions, and a reach limit in minutes."""

    chosen: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    rule: Rule = Rule()
    limit: int | None = None

    @classmethod
    def parse(cls, search: str, allowed: Mapping[str, Sequence[str]], daytimes: Sequence[str] = ("morning", "midday", "afternoon")) -> Selection:
        """Unknown values are dropped; values stand in the order of ``allowed``."""
        q = {k: set(",".join(v).split(",")) for k, v in parse_qs(search.lstrip("?")).items()}
        chosen = {k: tuple(v for v in values if v in q[k]) for k, values in allowed.items() if k in q}
        lo, hi = day_range(*(next(iter(q.get(k, ())), None) for k in ("from", "to")))
        limit = next((n for n in REACH_LIMITS if q.get("reach") == {str(n)}), None)
        return cls({k: v for k, v in chosen.items() if v}, Rule(lo, hi, tuple(d for d in daytimes if d in q.get("daytime", ()))), limit)

    def search(self) -> str:
        """The canonical query string; ``parse`` reads it back."""
        pairs = [(k, ",".join(v)) for k, v in sorted(self.chosen.items()) if v]
        pairs += [(k, str(v)) for k, v in (("from", self.rule.start), ("to", self.rule.end), ("daytime", ",".join(self.rule.daytimes)), ("reach", self.limit)) if v]
        return urlencode(pairs, safe=",")

    def count(self) -> int:
        return sum(len(v) for v in self.chosen.values()) + len(self.rule.daytimes) + (self.rule.start is not None or self.rule.end is not None) + (self.limit is not None)

    def toggled(self, dimension: str, value: str) -> Selection:
        now = self.chosen.get(dimension, ())
        then = tuple(v for v in now if v != value) if value in now else (*now, value)
        return replace(self, chosen={**self.chosen, dimension: then})

    def matches(self, columns: Mapping[str, Column], minutes: Column | None = None) -> Column:
        """OR inside a dimension, AND between; the limit holds where minutes are known."""
        tests = [columns[k].isin(list(v)) for k, v in self.chosen.items() if v]
        if self.limit is not None and minutes is not None:
            tests.append(minutes.isNull() | (minutes <= self.limit))
        return reduce(and_, tests, F.lit(True))


def quick_months(today: Column, end: Column, n: int = 3) -> Column:
    """The next ``n`` month starts that aren't after the end of the data."""
    first = F.trunc(today, "month")
    starts = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.add_months(first, k))
    return F.filter(starts, lambda d: end.isNull() | (d <= end))


def registration_phase(opens: Column, deadline: Column, now: Column) -> Column:
    """soon, open or over; null without a window."""
    return F.when(opens.isNull() & deadline.isNull(), None).when(now > deadline, "over").when(opens > now, "soon").otherwise("open")
