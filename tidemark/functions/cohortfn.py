"""Ages from a span of birth months in a title, and placeholders for months in addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprfn import let
from .timefn import age_in_months, month_window

# Months by their first three letters.
MONTHS = {"jan": 1, "jän": 1, "feb": 2, "mär": 3, "mae": 3, "mrz": 3, "apr": 4, "mai": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "okt": 10, "nov": 11, "dez": 12}
# The written forms of a span of births, "geb. März 2025 - Mai 2025" and "geb. 02-06/2026": month, its year, last month, last year.
NAMED = r"(?i)\bgeb(?:\.|oren)\s+(?:im\s+)?([a-zäöü]{3,9})\.?(?:\s+(20\d\d))?(?:\s*(?:[-–—]|bis)\s*([a-zäöü]{3,9})\.?)?\s+(20\d\d)"
NUMBERED = r"(?i)\bgeb(?:\.|oren)\s+(?:im\s+)?(\d{1,2})(?:/(20\d\d))?(?:\s*(?:[-–—]|bis)\s*(\d{1,2}))?/(20\d\d)"


def birth_cohort(title: Column) -> Column:
    """struct<first, last>: first and last day of birth named in a title; null without a year or for an impossible span.

    Months are counted from year 0, so that a span is two numbers and "Dec. to Feb. 2026" goes back a year by taking twelve away.
    """
    number = F.create_map(*[F.lit(x) for pair in [*MONTHS.items(), *((str(k), k) for k in range(1, 13)), *((f"0{k}", k) for k in range(1, 10))] for x in pair])
    month = lambda word: F.try_element_at(number, F.left(F.lower(word), F.lit(3)))
    parts = lambda form: [F.nullif(F.regexp_extract(title, form, k), F.lit("")) for k in range(1, 5)]
    written = F.coalesce(*[F.when(title.rlike(form), F.array(*parts(form))) for form in (NAMED, NUMBERED)])

    def span(p: Column) -> Column:
        low, high = month(p[0]), F.when(p[2].isNull(), month(p[0])).otherwise(month(p[2]))
        last = p[3].cast("int") * 12 + high - 1
        first = F.coalesce(p[1].cast("int"), p[3].cast("int") - (low > high).cast("int")) * 12 + low - 1
        return F.struct(first.alias("first"), last.alias("last"))

    day = lambda n: F.make_date(F.floor(n / 12).cast("int"), (n % 12 + 1).cast("int"), F.lit(1))
    named = lambda s: F.when(s["first"] <= s["last"], F.struct(day(s["first"]).alias("first"), F.last_day(day(s["last"])).alias("last")))
    return let(let(written, span), named)


def cohort_age(cohort: Column, at: Column) -> Column:
    """struct<low, high>: completed months of the youngest (0 at least) and the oldest at a day; null before the first birth."""
    ages = lambda c: F.struct(F.greatest(F.lit(0), age_in_months(c["last"], at)).alias("low"), age_in_months(c["first"], at).alias("high"))
    return let(let(cohort, ages), lambda a: F.when(a["high"] >= 0, a))


def fill_months(text: Column, today: Column, months: int = 13) -> Column:
    """``{von}`` and ``{bis}`` in a text as the first of this month and of the one ``months`` later."""
    first, end = month_window(today, months)
    return F.replace(F.replace(text, F.lit("{von}"), F.date_format(first, "yyyy-MM-dd")), F.lit("{bis}"), F.date_format(end, "yyyy-MM-dd"))
