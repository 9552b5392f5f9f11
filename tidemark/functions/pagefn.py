"""What a page says about events: structured data, future dates, birth cohorts, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def json_ld_events(html: Column) -> Column:
    """Events of a page's JSON-LD blocks as array of struct: single objects, lists and @graph; broken blocks are skipped."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    of = lambda kind: F.flatten(F.transform(blocks, lambda b: kind(b)))
    many = of(lambda b: F.coalesce(F.from_json(b, f"array<struct<{_fields()}>>"), F.expr("array()").cast(f"array<struct<{_fields()}>>")))
    graph = of(lambda b: F.coalesce(F.from_json(b, f"struct<`@graph`: array<struct<{_fields()}>>>")["@graph"], F.expr("array()").cast(f"array<struct<{_fields()}>>")))
    return F.filter(F.concat(many, graph), lambda e: e["@type"].rlike("(Event|Course)"))


def _fields() -> str:
    return "`@type`: string, name: string, startDate: string, endDate: string, url: string"


def future_dates(text: Column, today: Column, days: int = 310) -> Column:
    """Number of distinct dates dd.mm.yyyy in a text from today to ``days`` ahead."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b(\d{1,2}\.\d{1,2}\.20\d{2})\b"), F.lit(1))
    dates = F.transform(found, lambda d: F.try_to_date(d, "d.M.yyyy"))
    return F.size(F.array_distinct(F.filter(dates, lambda d: d.isNotNull() & (d >= today) & (d <= F.date_add(today, days)))))


def links(html: Column) -> Column:
    """Targets of a page's links, in order."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<a\b[^>]*\bhref\s*=\s*[\"']([^\"'#]*)"), F.lit(1))


def frames(html: Column) -> Column:
    """Sources of a page's frames."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<iframe\b[^>]*\bsrc\s*=\s*[\"']([^\"']*)"), F.lit(1))


# What the page in front of a protected one says, and the most characters it has.
WALL, MOST_WALL = r"Sicherheitsüberprüfung wird durchgeführt|Just a moment\.\.\.|Checking your browser|challenges\.cloudflare\.com", 5000


def bot_wall(text: Column) -> Column:
    """Is a page a challenge instead of its content? Challenges are short."""
    return F.coalesce((F.length(text) <= MOST_WALL) & text.rlike(WALL), F.lit(False))


def kind_of(content_type: Column) -> Column:
    t = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    return F.when(t.isin("text/html", "application/xhtml+xml"), "html").when(t == "text/calendar", "ical").when(t == "application/pdf", "pdf")


def failure_class(status: Column) -> Column:
    return F.when(status.isin(404, 410), "permanent").otherwise("temporary")
