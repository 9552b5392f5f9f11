"""Ids of offers, providers and units: keys, short ids by hash, and what an old id becomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprfn import let
from .textfn import base36, slug

# Forms of short ids, catalogue ids and old offer ids, and the most characters of the latter two.
SHORT, KEBAB, LEGACY = r"^[0-9a-z]{8}$", r"^[a-z0-9]+(?:-[a-z0-9]+)*$", r"^[a-z0-9-]+--[a-z0-9-]+--[a-z0-9-]+$"
MOST_KEBAB, MOST_LEGACY = 80, 240
# The constants of the 53-bit string hash behind short ids.
SEED_1, SEED_2, STEP_1, STEP_2, MIX_1, MIX_2 = 0xDEADBEEF, 0x41C6CE57, 2654435761, 1597334677, 2246822507, 3266489909
_MASK = 0xFFFFFFFF


def _times(a: Column, b: int) -> Column:
    """Product modulo 2^32 of a 32-bit number with a constant, without leaving 64 bits."""
    low, high = a * F.lit(b & 0xFFFF), (a * F.lit(b >> 16)).bitwiseAND(F.lit(0xFFFF))
    return (low + F.shiftleft(high, 16)).bitwiseAND(F.lit(_MASK))


def _xor_shift(a: Column, b: Column, n: int) -> Column:
    return a.bitwiseXOR(F.shiftrightunsigned(b, n))


def _units(text: Column) -> Column:
    """UTF-16 code units of a text."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    pair = lambda c: F.array(F.lit(0xD800) + F.shiftright(c - 0x10000, 10), F.lit(0xDC00) + (c - 0x10000).bitwiseAND(F.lit(0x3FF)))
    return F.flatten(F.transform(codes, lambda c: F.when(c > 0xFFFF, pair(c)).otherwise(F.array(c))))


def hash53(text: Column, seed: Column | int = 0) -> Column:
    """The 53-bit hash of a text (long)."""
    s = F.lit(seed).cast("long") if isinstance(seed, int) else seed.cast("long")
    run = lambda units, start, step: F.aggregate(units, F.lit(start).cast("long").bitwiseXOR(s), lambda h, c: _times(h.bitwiseXOR(c), step))
    state = let(_units(text), lambda u: F.struct(run(u, SEED_1, STEP_1).alias("a"), run(u, SEED_2, STEP_2).alias("b")))

    def finish(h: Column) -> Column:
        a = _times(_xor_shift(h["a"], h["a"], 16), MIX_1).bitwiseXOR(_times(_xor_shift(h["b"], h["b"], 13), MIX_2))
        b = _times(_xor_shift(h["b"], h["b"], 16), MIX_1).bitwiseXOR(_times(_xor_shift(a, a, 13), MIX_2))
        return b.bitwiseAND(F.lit(0x1FFFFF)) * F.lit(1 << 32) + a

    return let(state, finish)


def short_id(text: Column, seed: Column | int = 0) -> Column:
    """Eight signs of base 36; another seed gets out of the way of a collision."""
    return base36(F.pmod(hash53(text, seed), F.lit(36**8)), 8)


def offer_key(provider: Column, venue: Column, title: Column, format_: Column, first_start: Column, regular: str = "regular") -> Column:
    """provider--title--venue; courses and single events carry the local minute of their first start."""
    dated = F.concat(F.lit("-"), F.coalesce(F.date_format(first_start, "yyyyMMdd't'HHmm"), F.lit("")))
    name = F.concat(slug(title), F.when(format_ == regular, "").otherwise(dated))
    return F.concat_ws("--", provider, name, venue)


def window_key(provider: Column, venue: Column, title: Column, format_: Column, sessions: Column, since: Column, regular: str = "regular") -> Column:
    """``offer_key`` by the first session from ``since`` on, else by the first."""
    ahead = F.try_element_at(F.filter(sessions, lambda s: F.to_date(s["start"]) >= since), F.lit(1))
    return offer_key(provider, venue, title, format_, F.coalesce(ahead, F.try_element_at(sessions, F.lit(1)))["start"], regular)


def resolve_offer_id(raw: Column) -> Column:
    """A short id stays, an old key becomes one, anything else is null."""
    return F.when(raw.rlike(SHORT), raw).when((F.length(raw) <= MOST_LEGACY) & raw.rlike(LEGACY), short_id(raw))


def resolve_provider_id(raw: Column) -> Column:
    return F.when(raw.rlike(SHORT), raw).when((F.length(raw) <= MOST_KEBAB) & raw.rlike(KEBAB), short_id(raw))


def unit_id(url: Column, body: Column) -> Column:
    """A page by its address; a request's body adds eight signs of its digest."""
    return F.concat(F.lit("seite:"), url, F.coalesce(F.concat(F.lit("#"), F.substring(F.sha2(body, 256), 1, 8)), F.lit("")))


def watch_key(subject: Column, page: Column) -> Column:
    """A finding's key: its subject, with eight signs of the page's digest where it has one."""
    return F.concat(subject, F.coalesce(F.concat(F.lit("#"), F.substring(F.sha2(page, 256), 1, 8)), F.lit("")))
