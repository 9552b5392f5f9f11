"""URL rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that say nothing about the page, parts of paths that hold no programme, and pictures.
VOLATILE = r"^(utm_[^=]*|fbclid|gclid|sid|phpsessid|jsessionid|sessionid)(=|$)"
NO_PROGRAMME = r"(?i)(^|[/_\-\s.])(impressum|datenschutz|datenschutzerklaerung|privacy|agb|warenkorb|cart|login|shop|onlineshop|presse|jobs|karriere)([/_\-\s.?]|$)"
PICTURE = r"(?i)\.(jpe?g|png|gif|webp|svg|ico|bmp|tiff?)(\?|$)"


def host(url: Column) -> Column:
    """Lower-case host without ``www.``; null where there is none."""
    h = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(h != "", F.regexp_replace(h, r"^www\.", ""))


def path(url: Column) -> Column:
    """Path without a trailing slash."""
    return F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")


def parameters(url: Column) -> Column:
    """Query parameters in sorted order without volatile ones; one without a value has an empty one."""
    query = F.regexp_extract(url, r"^[^#?]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~F.lower(p).rlike(VOLATILE))
    return F.array_sort(F.transform(kept, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("=")))))


def canonical(url: Column) -> Column:
    """Host, path and sorted parameters: no scheme, ``www.``, trailing slash, fragment or volatile parameter."""
    query = F.array_join(parameters(url), "&")
    return F.concat(host(url), path(url), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def same_site(a: Column, b: Column) -> Column:
    """Is host ``a`` host ``b`` or a sub-domain of it?"""
    return (a == b) | a.endswith(F.concat(F.lit("."), b))


def is_internal(h: Column) -> Column:
    """Hosts that no public page has: local names and private or loopback addresses."""
    return h.rlike(r"^(localhost|.*\.local|.*\.internal|127\.\d+\.\d+\.\d+|10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|172\.(1[6-9]|2\d|3[01])\.\d+\.\d+|169\.254\.\d+\.\d+|\[?::1\]?)$")


def under_anchor(url: Column, anchor: Column) -> Column:
    """Same host, a path below the anchor's, and all of the anchor's parameters."""
    below = (path(url) == path(anchor)) | path(url).startswith(F.concat(path(anchor), F.lit("/")))
    return (host(url) == host(anchor)) & below & (F.size(F.array_except(parameters(anchor), parameters(url))) == 0)


def never_visit(url: Column, label: Column | None = None) -> Column:
    """Pages that hold no programme by a whole word of their path or of the link's text (imprint, privacy, terms, cart, login, shop,
    press, jobs), pictures, and what is no address."""
    words = path(url).rlike(NO_PROGRAMME) | path(url).rlike(PICTURE)
    return host(url).isNull() | words | (F.trim(label).rlike(NO_PROGRAMME) if label is not None else F.lit(False))
