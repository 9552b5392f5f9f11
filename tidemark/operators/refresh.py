"""The state of pages from night to night: what a fetch or an extraction makes of it, and what a provider's pages add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import textfn, titlefn
from .state import collapsed, failure_streak, tombstone

#: A unit's events: dated ones have days, others come back by a rule and have none.
EVENTS = "array<struct<title:string,single:boolean,dated:boolean,days:array<date>>>"
PENDING = f"struct<digest:string,model:string,events:{EVENTS}>"


def event_units(events: Column, today: Column) -> Column:
    """Events counted as offers: of dated ones those with a day ahead, single events once a day; others once each."""
    ahead = lambda e: F.size(F.filter(e["days"], lambda d: d >= today))
    each = lambda e: F.when(~e["dated"], 1).when(e["single"], ahead(e)).otherwise(F.least(ahead(e), F.lit(1)))
    return F.aggregate(events, F.lit(0), lambda a, e: a + each(e))


def has_future(events: Column, today: Column) -> Column:
    """Has one of the events a day ahead? Rules that have ended are expanded to days before."""
    return F.exists(events, lambda e: F.exists(e["days"], lambda d: d >= today))


def dated_from(dated: Column, today: Column) -> Column:
    """A map day -> digest without the days before today."""
    return F.map_filter(dated, lambda day, _: day >= today)


def advance(units: DataFrame, night: DataFrame, today: Column, now: Column, rest: int = 14) -> DataFrame:
    """The next state of every unit and its ``result``.

    ``units``: unit, events, digest, model, status, reason, checked_at, changed_at, failing_since, failure, failure_since, pending,
    empty_since, removed_at. ``night``: unit, kind (failed, unchanged, pending, extracted, empty or error), reason, failure (temporary or
    lasting), digest, model, events, baseline (offers known of a unit without a digest). Units of ``night`` alone are new; units
    without a night stay as they are, with result open.

    - failed, error: the events stay, the streak goes on; a page failing lastingly for ``rest`` days is removed, with its events.
    - unchanged: the events are confirmed; pending: what was held back is taken over, as it came twice.
    - extracted, empty: taken over, unless the offers collapse; then the old ones stay and the new ones are pending.
    - ``empty_since`` is the first night without an event ahead, if there were events before.
    """
    u = units.withColumn("__old", F.lit(True)).alias("u")
    n = night.withColumn("__n", F.lit(True)).alias("n")
    j = u.join(n, "unit", "full_outer")
    old, kind = (lambda c: F.col(f"u.{c}")), F.coalesce(F.col("n.kind"), F.lit("open"))
    none = F.from_json(F.lit("[]"), EVENTS)
    before = F.coalesce(old("events"), none)
    fresh = F.when(kind == "empty", none).otherwise(F.coalesce(F.col("n.events"), none))
    known = F.when(old("digest").isNotNull(), event_units(before, today)).otherwise(F.coalesce(F.col("n.baseline"), F.lit(0)))
    taken = kind.isin("extracted", "empty")
    falls = taken & collapsed(known, event_units(fresh, today))
    adopts, fails = (taken & ~falls) | (kind == "pending"), kind.isin("failed", "error")
    failure = F.when(kind == "failed", F.coalesce(F.col("n.failure"), F.lit("temporary")))
    failure_since = F.when(failure.isNotNull(), failure_streak(old("failure_since"), F.lit(True), F.coalesce(failure == old("failure"), F.lit(False)), today))
    removed = (kind == "failed") & (failure == "lasting") & tombstone(failure_since, failure == "lasting", today, rest)
    events = F.when(removed, none).when(adopts, F.when(kind == "pending", old("pending.events")).otherwise(fresh)).otherwise(before)
    same = old("changed_at").isNotNull() & (F.to_json(events) == F.to_json(before))
    works = adopts | (kind == "unchanged")
    filled = F.when(F.size(events) > 0, "ok").otherwise("no dates")
    new_unit = falls & old("digest").isNull()
    keep = lambda c: F.when(kind == "open", old(c))
    empty = F.when(has_future(events, today), None).otherwise(F.coalesce(old("empty_since"), F.when(F.size(before) > 0, now)))
    state = {
        "events": events,
        "digest": F.when(removed, None).when(kind == "pending", old("pending.digest")).when(adopts, F.col("n.digest")).otherwise(old("digest")),
        "model": F.when(removed, None).when(kind == "pending", old("pending.model")).when(adopts, F.col("n.model")).otherwise(old("model")),
        "status": keep("status").when(fails | new_unit, "failed").when(works, filled).otherwise(old("status")),
        "reason": keep("reason").when(removed, F.lit("removed")).when(fails, F.col("n.reason")).when(new_unit, "collapse held back").when(works, None).otherwise(old("reason")),
        "checked_at": keep("checked_at").when(works, now).otherwise(F.coalesce(old("checked_at"), now)),
        "changed_at": F.when(removed, None).when(adopts, F.when(same, old("changed_at")).otherwise(now)).otherwise(old("changed_at")),
        "failing_since": keep("failing_since").when(fails | new_unit, F.coalesce(old("failing_since"), now)).when(works, None).otherwise(old("failing_since")),
        "failure": keep("failure").when(fails, failure).when(works, None).otherwise(old("failure")),
        "failure_since": keep("failure_since").when(fails, failure_since).when(works, None).otherwise(old("failure_since")),
        "pending": keep("pending").when(removed | works, None).when(falls, F.struct(F.col("n.digest").alias("digest"), F.col("n.model").alias("model"), fresh.alias("events"))).otherwise(old("pending")),
        "empty_since": keep("empty_since").when(F.lit(True), empty),
        "removed_at": keep("removed_at").when(removed, F.coalesce(old("removed_at"), now)),
    }
    result = (
        F.when(removed, "removed").when(kind == "failed", "down").when(kind == "error", "error").when(falls, "collapse").when(kind == "unchanged", "unchanged")
        .when(kind == "pending", "pending adopted").when(kind == "empty", "empty").when(kind == "extracted", "extracted").otherwise("open")
    )
    return j.select("unit", *[c.alias(name) for name, c in state.items()], result.alias("result"))


#: Results by weight, the weightiest first; what stands for a provider whose pages didn't fail.
WEIGHT = ("collapse", "extracted", "pending adopted", "held adopted", "held", "empty", "unchanged")


def provider_result(rows: DataFrame, provider: str = "provider", result: str = "result") -> DataFrame:
    """(provider, result): open if a page is; down or error if all fail, partial if some do; else the weightiest."""
    r = F.col(result)
    fails = r.isin("down", "error", "removed")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, WEIGHT)), r), F.lit(len(WEIGHT)))
    g = rows.groupBy(provider).agg(F.bool_or(r == "open").alias("open"), F.every(fails).alias("all"), F.every(r == "down").alias("down"), F.bool_or(fails).alias("some"), F.min(F.when(~fails, rank)).alias("k"))
    name = F.when(F.col("open"), "open").when(F.col("all"), F.when(F.col("down"), "down").otherwise("error")).when(F.col("some"), "partial").otherwise(F.element_at(F.array(*map(F.lit, WEIGHT)), F.col("k").cast("int")))
    return g.select(provider, name.alias("result"))


def with_source(events: DataFrame, candidates: DataFrame, url: str = "source_url") -> DataFrame:
    """Events with ``via``: the source of the first candidate (detail_url, source, ord) whose page the event names as its origin; else null."""
    first = candidates.groupBy(F.col("detail_url").alias(url)).agg(F.min_by("source", "ord").alias("via"))
    return events.drop("via").join(first, url, "left")


def missing(fresh: DataFrame, reference: DataFrame) -> DataFrame:
    """(run, id): events of ``reference`` (run, id, venue, title, start) with a start ahead that no event of ``fresh`` covers: same venue,
    similar title, a common start. Rows are one start each."""
    f, r = fresh.alias("f"), reference.alias("r")
    near = r.join(f, [F.col(f"f.{c}") == F.col(f"r.{c}") for c in ("run", "venue", "start")]).where(textfn.similar_title(F.col("f.title"), F.col("r.title"), titlefn.GENERIC))
    return reference.select("run", "id").distinct().join(near.select("r.run", "r.id").distinct(), ["run", "id"], "left_anti")


def better_answer(first: DataFrame, second: DataFrame, before: DataFrame) -> DataFrame:
    """(run, answer): which of two answers misses fewer events of the state before and of those that only the other has found;
    the first on a tie. All three: (run, id, venue, title, start); ids of the three differ."""

    def misses(own: DataFrame, other: DataFrame, name: str) -> DataFrame:
        new = missing(before, other)
        wanted = before.unionByName(other.join(new, ["run", "id"], "left_semi"))
        return missing(own, wanted).groupBy("run").agg(F.count(F.lit(1)).alias(name))

    runs = before.select("run").union(first.select("run")).union(second.select("run")).distinct()
    both = runs.join(misses(first, second, "a"), "run", "left").join(misses(second, first, "b"), "run", "left")
    return both.select("run", F.when(F.coalesce("b", F.lit(0)) < F.coalesce("a", F.lit(0)), "second").otherwise("first").alias("answer"))


def is_gated(digest: Column, parts: Column, next_digest: Column, next_parts: Column) -> Column:
    """Does a unit take over a result of another version of the extraction than its state is of?"""
    return F.coalesce((digest != next_digest) & ~parts.eqNullSafe(next_parts), F.lit(False))


def merge_verdicts(parts: DataFrame) -> DataFrame:
    """(id, kind, target, reason) from the verdicts of the parts of a page (part, id, kind: same, faulty, gone or unclear, target, reason).

    One target said to be the same by some part holds, whatever the others say; two targets are unclear. Faulty or gone holds only
    if all parts say so, faulty before gone; else it is unclear. A target that two ids claim is unclear for both.
    """
    g = parts.groupBy("id").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == "same", F.col("target")))).alias("t"), F.every(F.col("kind").isin("faulty", "gone")).alias("all"),
        F.bool_or(F.col("kind") == "faulty").alias("faulty"), F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reason"),
    )
    kind = F.when(F.size("t") == 1, "same").when(F.size("t") > 1, "unclear").when(F.col("all"), F.when(F.col("faulty"), "faulty").otherwise("gone")).otherwise("unclear")
    one = g.select("id", kind.alias("kind"), F.when(F.size("t") == 1, F.col("t")[0]).alias("target"), "reason")
    claims = one.where("kind = 'same'").groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    out = one.join(claims, "target", "left")
    twice = F.col("n") > 1
    return out.select("id", F.when(twice, "unclear").otherwise(F.col("kind")).alias("kind"), F.when(~F.coalesce(twice, F.lit(False)), F.col("target")).alias("target"), "reason")


def kept_ids(events: DataFrame, decided: DataFrame) -> DataFrame:
    """Events (unit, ord, ...) with ``keep_ids`` (map start -> id) from decisions (unit, ord, start, id)."""
    per = decided.groupBy("unit", "ord").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("start", "id")))).alias("keep_ids"))
    return events.drop("keep_ids").join(per, ["unit", "ord"], "left")
