"""Text rules as column expressions; an Arrow function only where no built-in says it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exprfn import let

# Latin letters with marks and what they fold to.
MARKED, PLAIN = "àáâãåçèéêëìíîïñòóôõùúûýÿ", "aaaaaceeeeiiiinoooouuuyy"


def fold(text: Column) -> Column:
    """Lower case without marks; ß is ss, and ae, oe, ue are a, o, u, as are ä, ö, ü."""
    low = F.translate(F.lower(text), MARKED + "äöü", PLAIN + "aou")
    low = F.regexp_replace(low, "ß", "ss")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(low, "ae", "a"), "oe", "o"), "ue", "u")


def slug(text: Column, most: int = 60) -> Column:
    """Kebab form: ä is ae and so on, other marks go, cut at a word; ``x`` if nothing is left."""
    low = F.lower(text)
    for letter, pair in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        low = F.replace(low, F.lit(letter), F.lit(pair))
    kebab = F.regexp_replace(F.regexp_replace(F.translate(low, MARKED, PLAIN), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    head = lambda k: F.substring(k, 1, most)
    cut = lambda k: F.when(F.instr(head(k), "-") > 0, F.regexp_replace(head(k), "-[^-]*$", "")).otherwise(head(k))
    whole = lambda k: F.when(k == "", "x").when(F.length(k) <= most, k).when(F.substring(k, most + 1, 1) == "-", head(k)).otherwise(cut(k))
    return let(kebab, whole)


def squeezed(text: Column) -> Column:
    """White space of any kind to single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def plain_text(html: Column) -> Column:
    """Text of a small HTML fragment: no tags, the common entities, no soft hyphens, single spaces."""
    t = F.regexp_replace(html, r"(?s)<(script|style)\b.*?</\1>", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&shy;", ""), ("­", ""), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return squeezed(t)


def masked(text: Column) -> Column:
    """Text with volatile values masked: times of day with dates, session ids, long hex runs."""
    t = F.regexp_replace(text, r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:?\d{2})?", "<time>")
    t = F.regexp_replace(t, r"(?i)\b(phpsessid|jsessionid|sid|session(id)?|nonce|token)=[A-Za-z0-9._-]+", "$1=<id>")
    return squeezed(F.regexp_replace(t, r"\b[0-9a-f]{16,}\b", "<hex>"))


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts as JSON, so that parts can't run into one another."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts])), 256)


def order_free_hash(text: Column) -> Column:
    """SHA-256 of the lines in sorted order."""
    return F.sha2(F.array_join(F.array_sort(F.split(text, "\n", -1)), "\n"), 256)


def keywords(text: Column, stop: Sequence[str] = (), least: int = 4) -> Column:
    """Distinct lower-case words of ``least`` letters and more that aren't stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"([\p{{L}}]{{{least},}})"), F.lit(1)))
    return F.array_except(found, F.array(*map(F.lit, stop))) if stop else found


def escape_ics(text: Column) -> Column:
    """Text value of a calendar: backslash, semicolon, comma and line breaks escaped."""
    t = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    t = F.replace(F.replace(t, F.lit(";"), F.lit("\\;")), F.lit(","), F.lit("\\,"))
    return F.regexp_replace(t, r"\r\n|\r|\n", r"\\n")


def escape_html(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def fold_line(line: str, most: int = 75) -> str:
    """A calendar line in parts of 75 octets at most, whole characters, joined by line break and space."""
    out, part, size = [], "", 0
    for sign in line:
        n = len(sign.encode())
        if size + n > most:
            out.append(part)
            part, size = " ", 1
        part, size = part + sign, size + n
    return "\r\n".join([*out, part])


def address_key(address: Column) -> Column:
    """street number|postcode in folded form; null without a street with a number."""
    a = F.regexp_replace(fold(address), r"\b(strasse|str\.?)(?=\s|\d|,|$)|(?<=[a-z])(strasse|str\.?)(?=\s|\d|,|$)", "str")
    street = F.regexp_extract(a, r"([a-z][a-z .\-]*?)\s*(\d+\s*[a-z]?)(?=\s*(,|$|\s\d{5}))", 1)
    number = F.regexp_extract(a, r"([a-z][a-z .\-]*?)\s*(\d+\s*[a-z]?)(?=\s*(,|$|\s\d{5}))", 2)
    code = F.regexp_extract(a, r"\b(\d{5})\b", 1)
    return F.when(number != "", F.concat(F.regexp_replace(street, "[^a-z]", ""), F.lit(" "), F.regexp_replace(number, r"\s", ""), F.lit("|"), code))


def lcs_ratio(a: str, b: str) -> float:
    """2 * longest common subsequence / (length of both); 1 for two empty texts."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    codes = np.frombuffer(b.encode("utf-32-le"), dtype=np.uint32)
    row = np.zeros(len(codes) + 1, dtype=np.int64)
    for sign in a:
        hit = row[:-1] + (codes == ord(sign))
        row[1:] = np.maximum.accumulate(np.maximum(hit, row[1:]))
    return 2.0 * int(row[-1]) / (len(a) + len(codes))


@F.pandas_udf(T.DoubleType())
def title_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``lcs_ratio`` per row; null if either is null."""
    return pd.Series([None if x is None or y is None else lcs_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def best_ratio(a: Sequence[str], b: Sequence[str]) -> float | None:
    """The best ``lcs_ratio`` of a form of one name with a form of another, 1 where one holds the other; compared by letters only where none does."""
    pairs = [(x, y) for x in set(a) for y in set(b)]
    if any(x in y or y in x for x, y in pairs):
        return 1.0
    return max((lcs_ratio(x, y) for x, y in pairs), default=None)


@F.pandas_udf(T.DoubleType())
def forms_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``best_ratio`` per row; null if either side is null or has no form."""
    return pd.Series([None if x is None or y is None else best_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def similar_title(a: Column, b: Column, stop: Sequence[str] = (), least: float = 0.6) -> Column:
    """Do titles share a keyword, or a common subsequence of ``least``?

    A Python function under a condition is computed for all rows. So it gets nulls where it isn't needed: where a keyword is shared, and where
    the lengths alone rule the subsequence out.
    """
    shared = F.arrays_overlap(keywords(a, stop), keywords(b, stop))
    short, both = F.least(F.length(a), F.length(b)), F.length(a) + F.length(b)
    open_ = ~shared & (2 * short >= least * both)
    return shared | F.coalesce(title_ratio(F.when(open_, F.lower(a)), F.when(open_, F.lower(b))) >= least, F.lit(False))



def base36(n: Column, width: int = 8) -> Column:
    return F.lpad(F.lower(F.conv(n.cast("string"), 10, 36)), width, "0")
