"""A night as a whole: the build with its ids, the memory of resting offers, and which page an id was lost with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import idfn
from . import identity, linkage, offer_build
from .lineage import cut

OFFER = ["id", "provider", "venue", "title", "kind", "low", "high", "topics", "sessions", "listed_at"]
REST_DAYS, REST_SPAN = 56, 112  # how long an offer rests, and how far ahead its starts are remembered


def build(events: DataFrame, previous: DataFrame, resting: DataFrame, providers: DataFrame, venues: DataFrame, first: Column, last: Column, cutoff: Column, generated: Column, previous_last: Column | None = None) -> DataFrame:
    """The offers of a night: OFFER, unit, stage and note.

    ``events`` as for ``offer_build.drafts`` with rank, ord, topics and, if there are, unit (the page that an event comes from) and keep (an id that
    was kept for it); ``previous`` the offers before (OFFER), ``resting`` the memory as of ``remember``; ``providers`` (provider, reason) says whose old
    offers stay, ``venues`` (provider, venue) which exist. Drafts of one key are merged, outranked and repeated ones go. Ids pass as ``identity.assign``
    says, so a changed title, time or venue keeps them; a course keeps its past sessions, the day of listing passes with the id. Old offers that stay have
    the stage ``carried``. The unit is that of the version that counted.
    """
    for column in ("unit", "keep"):
        events = events if column in events.columns else events.withColumn(column, F.lit(None).cast("string"))
    d = offer_build.drafts(events, first, last)
    d = d.withColumn("draft", idfn.window_key(F.col("provider"), F.col("venue"), F.col("title"), F.col("kind"), F.col("sessions"), first))
    d = cut(offer_build.merge_keys(d, "draft", ["low", "high"]).drop("conflict"))
    d = cut(offer_build.drop_twins(offer_build.drop_outranked(d, "draft"), first, "draft"))
    ids = identity.assign(d, previous, resting, venues, first, last, previous_last)
    named = identity.continued(d.join(ids, "draft"), previous, first)
    named = cut(linkage.carry_forward(named.drop("listed_at"), previous, resting, "id", "listed_at", generated))
    old = offer_build.carried(previous, named, providers, venues, first, cutoff)
    null = F.lit(None).cast("string")
    return named.select(*OFFER, "unit", "stage", "note").unionByName(old.select(*OFFER, null.alias("unit"), F.lit("carried").alias("stage"), F.col("reason").alias("note")))


def remember(memory: DataFrame, before: DataFrame, after: DataFrame, generated: Column, today: Column, before_last: Column, days: int = REST_DAYS, span: int = REST_SPAN) -> DataFrame:
    """The memory after a night: id, key, provider, venue, title, kind, low, high, listed_at, since, horizon_to, starts.

    An offer that is gone rests with its starts from today to ``before_last``, ``span`` days at most, if it has one. An entry goes when its id
    is back, after ``days`` days, without a start ahead, or if the night before had its id, which then counts.
    """
    end = F.least(before_last, F.date_add(today, span))
    gone = before.join(after.select("id"), "id", "left_anti")
    starts = F.transform(F.filter("sessions", lambda s: F.to_date(s["start"]).between(today, end)), lambda s: s["start"])
    key = idfn.offer_key(F.col("provider"), F.col("venue"), F.col("title"), F.col("kind"), F.try_element_at("sessions", F.lit(1))["start"])
    fresh = gone.select("id", key.alias("key"), "provider", "venue", "title", "kind", "low", "high", "listed_at", generated.alias("since"), end.alias("horizon_to"), starts.alias("starts")).where(F.size("starts") > 0)
    kept = memory.join(after.select("id").union(before.select("id")), "id", "left_anti").where(F.date_add(F.to_date("since"), days) >= today)
    kept = kept.where(F.exists("starts", lambda s: F.to_date(s) >= today))
    return kept.select(*fresh.columns).unionByName(fresh)


def unit_losses(previous: DataFrame, built: DataFrame, held: DataFrame, gated: DataFrame, today: Column) -> DataFrame:
    """(provider, unit, lost: sorted ids, crosses): which new versions of pages cost which ids.

    ``built`` (id) is the build with all new versions, ``held`` (id, unit) the one in which ``gated`` pages (provider, unit) stay as they were. An id of
    the night before with a session ahead that only the second has was lost with the page that it comes from. If that page has no new version, the loss crosses
    pages: it is told of the provider's first gated page, and nobody can judge it, so the page is to be held.
    """
    ahead = F.exists("sessions", lambda s: F.to_date(F.coalesce(s["end"], s["start"])) >= today)
    lost = previous.where(ahead).select("id", "provider").join(built.select("id"), "id", "left_anti").join(held.where("unit is not null").select("id", F.col("unit").alias("origin")), "id")
    first = gated.groupBy("provider").agg(F.min("unit").alias("first"))
    own = gated.select("provider", F.col("unit").alias("origin"), F.lit(True).alias("own")).distinct()
    told = lost.join(first, "provider").join(own, ["provider", "origin"], "left")
    unit = F.when(F.col("own"), F.col("origin")).otherwise(F.col("first"))
    return told.groupBy("provider", unit.alias("unit")).agg(F.array_sort(F.collect_list("id")).alias("lost"), F.max(F.col("own").isNull()).alias("crosses"))


def hold(units: DataFrame, before: DataFrame, losses: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``units`` (provider, unit, ...) with the states ``before`` where a loss stands: those that cross pages, and those with a lost id that no verdict
    (provider, unit, id) has settled. Adds ``held``. A page without a state before goes out."""
    settled = verdicts.select("provider", "unit", "id").distinct()
    open_ = losses.where("crosses").select("provider", "unit").union(losses.where("not crosses").select("provider", "unit", F.explode("lost").alias("id")).join(settled, ["provider", "unit", "id"], "left_anti").select("provider", "unit")).distinct()
    new = units.join(open_, ["provider", "unit"], "left_anti").withColumn("held", F.lit(False))
    return new.unionByName(before.join(open_, ["provider", "unit"], "left_semi").select(*units.columns).withColumn("held", F.lit(True)))


def with_verdicts(events: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``events`` (provider, unit, n, ...) with ``keep``: the id that a verdict (provider, unit, n, id) says the event is; null where verdicts differ."""
    ids = verdicts.groupBy("provider", "unit", "n").agg(offer_build.merge_kept(F.collect_set("id")).alias("keep"))
    return events.drop("keep").join(ids, ["provider", "unit", "n"], "left")
