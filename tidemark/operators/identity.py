"""Stable ids: a night's drafts take over ids of the night before, then of resting offers; only the rest get new ones.

Better a new id than a wrong one: an old link must never lead to another offer. So every stage asks for an unambiguous pair, and what
was ambiguous in one stage is kept out of the weaker ones after it. Stages are relational: candidate pairs come from common
starts, are judged once, and every stage chooses among those whose sides are still open.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import idfn, textfn, titlefn
from ..functions.exprfn import let
from . import linkage, offer_build, sessions
from .joins import mutual_best
from .lineage import cut

SAME_STARTS, SAME_DAYS = 0.8, 0.5  # shares of starts, and of days, that make two series one
FEW, MOST_TOLD = 8, 10_000  # offers of a provider on a side whose pairs are all compared, and pairs of titles that each task may hold
FORMS = (sessions.COURSE, sessions.REGULAR)  # kinds that one offer may be told as
#: Stages as they stand in the result, in the order in which they choose.
KEPT, KEY, STARTS, TITLE, MOVED, FRESH = "kept", "key", "starts", "title", "moved", "new"
REST = "resting "  # before the stage of an id that comes from the memory


def _minutes(sessions_: Column, first: Column, to: Column) -> Column:
    """Starts by the minute from one day to another, sorted, once each."""
    inside = F.filter(sessions_, lambda s: F.to_date(s["start"]).between(first, to))
    return F.array_sort(F.array_distinct(F.transform(inside, lambda s: F.date_trunc("minute", s["start"]).cast("timestamp_ntz"))))


def _side(offers: DataFrame, name: str, first: Column, to: Column, *others: str) -> DataFrame:
    """What comparing needs of each offer, under its ``name``, and its columns ``others``."""
    shown = [F.col(name), *others, "provider", "venue", "kind", "low", "high", "title", "sessions"]
    window = idfn.window_key(F.col("provider"), F.col("venue"), F.col("title"), F.col("kind"), F.col("sessions"), first)
    return offers.select(*shown, window.alias("window"), to.alias("to"), _minutes(F.col("sessions"), first, to).alias("minutes"))


def _candidates(olds: DataFrame, drafts: DataFrame) -> DataFrame:
    """(old, draft) of a provider with a common day at one venue, or elsewhere with so many common starts that one of the old
    offer's rarest is among them."""
    o = olds.select("old", "provider", "venue", F.explode("minutes").alias("minute"), F.size("minutes").alias("size"))
    d = drafts.select("draft", "provider", "venue", F.explode("minutes").alias("minute"))
    by_day = lambda x, c: x.select(c, "provider", "venue", F.to_date("minute").alias("day")).distinct()
    here = by_day(o, "old").join(by_day(d, "draft"), ["provider", "venue", "day"]).select("old", "draft")
    met = d.groupBy("provider", "minute").agg(F.count(F.lit(1)).alias("many"))
    rare = F.row_number().over(W.partitionBy("old").orderBy("many", "minute"))
    needed = F.col("size") - F.ceil(F.col("size") * SAME_STARTS - 1e-9) + 1
    # A pair at the threshold misses fewer than ``needed`` of the old starts, so it shares one of any ``needed`` of them; starts that no draft has come first.
    o = o.join(met, ["provider", "minute"], "left").withColumn("many", F.coalesce("many", F.lit(0))).withColumn("k", rare).where((F.col("k") <= needed) & (F.col("many") > 0))
    there = o.withColumnRenamed("venue", "was").join(d, ["provider", "minute"]).where("was != venue").select("old", "draft")
    return here.union(there).distinct()


def _met(olds: DataFrame, drafts: DataFrame) -> DataFrame:
    """(old, draft, provider, o, d): pairs that may be one offer, with what is compared of either side as a struct.

    A provider of at most ``FEW`` offers on either side has few pairs: all of them are told. Only where there are more, candidates are looked for by their starts.
    """
    many = lambda side: side.groupBy("provider").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW).select("provider")
    crowded = cut(many(olds).union(many(drafts)).distinct())
    shown = ["venue", "kind", "low", "high", "title", "minutes"]
    o, d = olds.select("old", "provider", F.struct(*shown, "to").alias("o")), drafts.select("draft", "provider", F.struct(*shown).alias("d"))
    columns = ["old", "draft", "provider", "o", "d"]
    if crowded.isEmpty():
        return o.join(d, "provider").select(*columns)
    few = o.join(crowded, "provider", "left_anti").join(d, "provider").select(*columns)
    found = _candidates(*(side.join(crowded, "provider", "left_semi") for side in (olds, drafts)))
    return few.unionByName(found.join(o, "old").join(d.drop("provider"), "draft").select(*columns))


def _pairs(olds: DataFrame, drafts: DataFrame, venues: DataFrame) -> DataFrame:
    """Pairs that a stage may choose, with what the stages ask: ``t`` (share of common starts; the draft is compared up to the old horizon), and tests. Every stage
    asks for ``SAME_STARTS`` or for a like series at one venue."""
    known = venues.select(F.col("venue").alias("known")).distinct()
    both = _met(olds, drafts).withColumn("m", F.filter("d.minutes", lambda x: F.to_date(x) <= F.col("o.to")))
    days = lambda m: F.array_distinct(F.transform(m, lambda x: F.to_date(x)))
    clocks = lambda m: F.transform(m, lambda x: F.hour(x) * 60 + F.minute(x))
    start = F.coalesce(F.try_element_at("o.minutes", F.lit(1)) == F.try_element_at("m", F.lit(1)), F.lit(False))
    switch = F.col("o.kind").isin(*FORMS) & F.col("d.kind").isin(*FORMS)
    same_kind, here = F.col("o.kind") == F.col("d.kind"), F.col("o.venue") == F.col("d.venue")
    series = F.when(same_kind, start | (linkage.array_jaccard(days(F.col("o.minutes")), days(F.col("m"))) >= SAME_DAYS)).otherwise(switch & start)
    whole = (F.col("o.minutes") == F.col("m")) & (F.size("m") > 0)  # as most are
    both = both.withColumns({"t": F.when(whole, 1.0).otherwise(linkage.array_jaccard(F.col("o.minutes"), F.col("m"))), "here": here})
    both = both.withColumn("series", F.when(F.col("here"), series).otherwise(F.lit(False))).where((F.col("t") >= SAME_STARTS) | F.col("series"))
    both = both.join(known, F.col("o.venue") == F.col("known"), "left").select(
        "old", "draft", "provider", F.col("o.title").alias("was"), F.col("d.title").alias("title"), "t", "here", (F.col("here") | F.col("known").isNull()).alias("reachable"), "series", (same_kind | (switch & start)).alias("form"),
        F.arrays_overlap(clocks(F.col("o.minutes")), clocks(F.col("m"))).alias("clock"), titlefn.compatible_age(F.col("o.low"), F.col("o.high"), F.col("d.low"), F.col("d.high")).alias("ages"),
    )
    both = cut(both)
    told = cut(_told(both.select("was", "title").distinct()))
    if told.count() <= MOST_TOLD:  # a few titles would put all pairs into as few tasks
        told = F.broadcast(told)
    same = F.col("was").eqNullSafe(F.col("__t")) & F.col("title").eqNullSafe(F.col("__u"))
    return both.join(told, same).drop("was", "__t", "__u")


def _told(titles: DataFrame) -> DataFrame:
    """``titles`` (was, title: different pairs) as __t and __u with what they say of one another: once a pair of titles, not once a pair of offers."""
    a, b = F.col("__t"), F.col("__u")
    titles = cut(titles.toDF("__t", "__u"))  # written, or the tests would be moved before the distinct rows
    profiles = F.struct(titlefn.title_profile(a).alias("p"), titlefn.title_profile(b).alias("q"))
    both = let(profiles, lambda t: F.struct(titlefn.contradict(t["p"], t["q"], 2).alias("opposed"), titlefn.alike(t["p"], t["q"]).alias("alike")))
    ratio = F.coalesce(textfn.title_ratio(F.lower(a), F.lower(b)), F.lit(0.0))
    return titles.select("__t", "__u", textfn.similar_title(a, b, titlefn.GENERIC).alias("similar"), both.alias("both"), ratio.alias("ratio")).select("__t", "__u", "similar", "both.*", "ratio")


def _without(pairs: DataFrame, olds: DataFrame | None, drafts: DataFrame | None) -> DataFrame:
    columns = pairs.columns
    for side, gone in (("old", olds), ("draft", drafts)):
        pairs = pairs if gone is None else pairs.join(gone.select(side).distinct(), side, "left_anti")
    return pairs.select(*columns)


def _open(pairs: DataFrame, matched: DataFrame, twins: DataFrame) -> DataFrame:
    """Pairs whose draft has no id yet, and whose old offer neither is matched nor has a matched twin: one match uses up all twins."""
    took = matched.select("old")
    used = took.union(twins.join(took.withColumnRenamed("old", "twin"), "twin").select("old"))
    return _without(pairs, used, matched)


def _torn(found: DataFrame, twins: DataFrame) -> DataFrame:
    """Of (old, draft) those whose old twin is found for another draft: one of the two drafts is something else, nobody knows which."""
    other = found.select(F.col("old").alias("twin"), F.col("draft").alias("other"))
    return found.join(twins, "old").join(other, "twin").where("draft != other").select("old", "draft").distinct()


def _leaders(pairs: DataFrame, twins: DataFrame) -> DataFrame:
    """(draft, old, kin): per draft the old offer whose title is most like it, then of the smallest id, and whether all of its others are twins of
    it and of one another."""
    lead = pairs.groupBy("draft").agg(F.min_by("old", F.struct(-F.col("ratio"), "old")).alias("old"), F.count(F.lit(1)).alias("n"))
    held = pairs.select("draft", F.col("old").alias("twin"))
    kin = pairs.select("draft", "old").join(twins, "old").join(held, ["draft", "twin"]).groupBy("draft").agg(F.count(F.lit(1)).alias("k"))
    return lead.join(kin, "draft", "left").select("draft", "old", (F.coalesce("k", F.lit(0)) == F.col("n") * (F.col("n") - 1)).alias("kin"))


def _led(pairs: DataFrame, twins: DataFrame) -> DataFrame:
    """(draft, old) where all others of the draft are twins of its leader, whether or not of one another."""
    lead = pairs.groupBy("draft").agg(F.min_by("old", F.struct(-F.col("ratio"), "old")).alias("old"), F.count(F.lit(1)).alias("n"))
    kin = lead.join(twins, "old").join(pairs.select("draft", F.col("old").alias("twin")), ["draft", "twin"]).groupBy("draft").agg(F.count(F.lit(1)).alias("k"))
    return lead.join(kin, "draft", "left").where(F.coalesce("k", F.lit(0)) == F.col("n") - 1).select("draft", "old")


def _by_clock(pairs: DataFrame, side: str) -> DataFrame:
    """Of a side's several candidates those at a common time of day, if there are any."""
    w = W.partitionBy(side)
    return pairs.withColumn("__any", F.max(F.col("clock").cast("int")).over(w)).where((F.col("__any") == 0) | F.col("clock")).drop("__any")


def _strictly_best(pairs: DataFrame, twins: DataFrame) -> DataFrame:
    """(old, draft): pairs whose ``t`` is above that of every other pair of either side; twins of the old offer may be level, then the leader wins."""
    own = pairs.groupBy("old", "t").agg(F.count(F.lit(1)).alias("n")).groupBy("old").agg(F.max(F.struct("t", "n")).alias("top")).where("top.n = 1").select("old", F.col("top.t").alias("t"))
    top = pairs.groupBy("draft").agg(F.max("t").alias("t"))
    level = cut(pairs.join(top, ["draft", "t"]))
    return _led(level, twins).join(level.select("old", "draft", "t"), ["old", "draft"]).join(own, ["old", "t"], "left_semi").select("old", "draft")


def twins_of(previous: DataFrame, since: Column) -> DataFrame:
    """(old, twin), both ways: offers of the night before that are the same offer twice."""
    pairs = offer_build.twins(previous.withColumns({"rank": F.lit(0), "ord": F.col("id")}), since).toDF("old", "twin")
    return pairs.union(pairs.select("twin", "old"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _first_pass(drafts: DataFrame, new: DataFrame, olds: DataFrame, venues: DataFrame, first: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(old, draft, stage) against the night before, pairs, unsure drafts, and (draft, note) of claims that don't count."""
    twins = cut(twins_of(olds.withColumnRenamed("old", "id"), first))
    # Ids that a judge or the rule for duplicates has kept: for one draft only, of the same provider; the venue may change.
    claim = drafts.where("keep is not null").select("draft", "provider", F.col("keep").alias("old")).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("old")))
    claim = cut(claim.join(olds.select("old", F.col("provider").alias("was")), "old", "left"))
    why = F.when(F.col("was").isNull(), "kept id unknown").when(F.col("n") > 1, "kept id claimed twice").when(F.col("was") != F.col("provider"), "kept id of another provider")
    matched = claim.where(why.isNull()).select("old", "draft", F.lit(KEPT).alias("stage"))
    ignored = claim.where(why.isNotNull()).select("draft", why.alias("note"))

    one = lambda side, name: side.groupBy("window").agg(F.min(name).alias(name), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    same = one(olds, "old").join(one(new, "draft"), "window").select("old", "draft", F.lit(KEY).alias("stage"))
    matched = cut(matched.unionByName(_without(same, matched, matched)))

    pairs = _pairs(olds, new, venues)
    # Where the starts agree but not the titles, the draft may be a sister that has moved up: not if its title is like another old offer's.
    pairs = cut(pairs)
    odd = pairs.where((F.col("t") >= SAME_STARTS) & F.col("reachable") & ~F.col("similar")).select("old", "draft", "provider", F.col("title").alias("t1"))
    rival = odd.join(olds.select(F.col("old").alias("other"), "provider", F.col("title").alias("t2")), "provider").where("old != other")
    rival = rival.where(textfn.similar_title(F.col("t2"), F.col("t1"), titlefn.GENERIC)).select("old", "draft", F.lit(True).alias("rival")).distinct()
    by_starts = (F.col("t") >= SAME_STARTS) & F.col("reachable") & (F.col("similar") | F.col("rival").isNull())
    judged = pairs.join(rival, ["old", "draft"], "left").select(
        "old", "draft", "t", "clock", "ratio", by_starts.alias("starts"), (F.col("here") & F.col("series") & F.col("similar") & ~F.col("opposed")).alias("named"),
        (~F.col("here") & F.col("form") & F.col("ages") & (F.col("t") >= SAME_STARTS) & F.col("alike")).alias("moved"),
    )
    judged = cut(judged.where("starts or named or moved"))

    level, split = judged.where("starts"), []
    while True:
        won = cut(_strictly_best(_open(level, matched, twins), twins))
        torn = cut(_torn(won, twins))
        split.append(torn)
        fresh = cut(won.join(torn, ["old", "draft"], "left_anti").select("old", "draft", F.lit(STARTS).alias("stage")))
        if fresh.isEmpty():
            break
        matched = cut(matched.unionByName(fresh))
    torn = _union(split).distinct()
    left = _open(level, matched, twins).select("old", "draft")
    vague = cut(left.unionByName(torn))  # ambiguous by starts: neither side goes on to "moved"; what was torn doesn't go on to "title"

    named = cut(_without(_open(judged.where("named"), matched, twins), torn, None))
    own, back = cut(_by_clock(named, "old")), cut(_by_clock(named, "draft"))
    alone = own.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("old")))
    leads = _leaders(back, twins).withColumnRenamed("old", "leader")
    asked = cut(alone.where("n = 1").join(leads, "draft").select("old", "draft", "leader", "kin"))
    found = cut(asked.where("kin and old = leader").select("old", "draft"))
    torn2 = _torn(found, twins)
    vague = cut(_union([vague, alone.where("n > 1").select("old", "draft"), asked.where("not kin").select("old", "draft"), torn2]))
    matched = cut(matched.unionByName(found.join(torn2, ["old", "draft"], "left_anti").select("old", "draft", F.lit(TITLE).alias("stage"))))

    moved = _without(_open(judged.where("moved"), matched, twins), vague, vague)
    moved = cut(linkage.unique_both_ways(moved.select("old", "draft"), "old", "draft"))
    matched = cut(matched.unionByName(moved.join(_torn(moved, twins), ["old", "draft"], "left_anti").select("old", "draft", F.lit(MOVED).alias("stage"))))
    return matched, judged, vague.select("draft").distinct(), ignored


def _second_pass(new: DataFrame, matched: DataFrame, unsure: DataFrame, olds: DataFrame, resting: DataFrame, venues: DataFrame, first: Column, last: Column) -> DataFrame:
    """(old, draft, stage) of drafts that are still open and were never ambiguous, against the resting memory. Over weeks equal starts may
    be another offer's, so title and age must agree as well."""
    memory = resting.withColumnRenamed("id", "old").withColumn("sessions", F.transform("starts", lambda s: F.struct(s.alias("start"), s.alias("end"))))
    every = cut(_side(memory, "old", first, F.least("horizon_to", last), "key"))
    # Not an entry that is a dropped duplicate of an offer that has its id: it would come back as a second version.
    starts = lambda side, name: side.select(name, "provider", "venue", "kind", F.explode(_minutes(F.col("sessions"), first, F.lit("9999-12-31").cast("date"))).alias("minute"))
    taken = new.join(matched.select("draft"), "draft", "left_semi")
    place = ["provider", "venue", "kind"]
    shared = cut(every.select(*place).distinct().join(taken.select(*place).distinct(), place))  # where neither side is alone
    rest = every.join(olds.select("old"), "old", "left_anti")
    if not shared.isEmpty():
        either = lambda side, name: starts(side.join(shared, place, "left_semi"), name)
        near = either(every, "old").join(either(taken, "draft"), [*place, "minute"]).select("old", "draft").distinct()
        double = near.join(every.alias("x"), "old").join(taken.alias("y"), "draft").where(offer_build.same_offer_twice("x", "y", first)).select("old").distinct()
        rest = rest.join(double, "old", "left_anti")
    rest = cut(rest)
    players = cut(new.join(matched.select("draft"), "draft", "left_anti").join(unsure, "draft", "left_anti"))

    def unique(column: str) -> DataFrame:
        """Pairs of an equal ``column`` that stands once among all drafts and once in the whole memory."""
        one = lambda side, name: side.groupBy(column).agg(F.min(name).alias(name), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
        both = one(every, "old").join(one(new, "draft"), column).select("old", "draft")
        return both.join(rest.select("old"), "old", "left_semi").join(players.select("draft"), "draft", "left_semi").select("old", "draft")

    found = cut(unique("window").withColumn("stage", F.lit(REST + KEY)))
    pairs = cut(_pairs(rest, players, venues))
    good = pairs.where((F.col("t") >= SAME_STARTS) & F.col("reachable") & F.col("similar") & F.col("ages"))
    while True:
        won = cut(mutual_best(_without(good, found, found).select("old", "draft", "t"), "old", "draft", F.col("t")).select("old", "draft", F.lit(REST + STARTS).alias("stage")))
        if won.isEmpty():
            break
        found = cut(found.unionByName(won))
    named = cut(_without(pairs.where("here and series and ages and alike"), found, found))
    single = lambda side: _by_clock(named, side).withColumn("n", F.count(F.lit(1)).over(W.partitionBy(side))).where("n = 1").select("old", "draft")
    found = cut(found.unionByName(single("old").join(single("draft"), ["old", "draft"]).withColumn("stage", F.lit(REST + TITLE))))
    return cut(found.unionByName(_without(unique("key"), found, found).withColumn("stage", F.lit(REST + "by its own key"))))


def assign(drafts: DataFrame, previous: DataFrame, resting: DataFrame, venues: DataFrame, first: Column, last: Column, previous_last: Column | None = None) -> DataFrame:
    """(draft, id, stage, note) of every draft.

    ``drafts`` (draft: its own key; provider, venue, title, kind, low, high, sessions, keep: an id already kept for it, or null), ``previous`` the
    same with ``id``, ``resting`` (id, key, provider, venue, title, kind, low, high, since, horizon_to, starts), ``venues`` (venue) that exist. Offers
    are compared from ``first`` to ``last``, or to ``previous_last`` if the night before looked less far.

    Stages: ids already kept; an equal key that stands once on either side; equal starts (a share of 0.8) where the pair is strictly the best for both
    sides, in rounds; a similar title with equal days or the same first start, as the only candidate on both sides, a common time of day deciding among
    several; another venue with an alike title and equal starts, only for what was never ambiguous. Old twins, two versions of one offer, are no
    rivals: the one with the better title takes the match and uses up the others; twins that point to different drafts match nothing. Then, for drafts
    that stayed open and were never ambiguous, the same against the resting memory. All others get the 53-bit hash of their key, out of the way of
    every old and resting id. ``note`` says what was ambiguous, split from an old offer, or not kept.
    """
    to = last if previous_last is None else F.least(last, previous_last)
    key = idfn.offer_key(F.col("provider"), F.col("venue"), F.col("title"), F.col("kind"), F.try_element_at("sessions", F.lit(1))["start"])
    # What follows goes by these written sides, so that neither night is made or read again.
    new = cut(_side(drafts, "draft", first, to).withColumn("key", key))
    olds = cut(_side(previous.withColumnRenamed("id", "old"), "old", first, to))
    matched, judged, unsure, ignored = _first_pass(drafts, new, olds, venues, first)
    far = new if previous_last is None else cut(_side(drafts, "draft", first, last).withColumn("key", key))
    back = _second_pass(far, matched, unsure, olds, resting, venues, first, last)
    got = matched.unionByName(back)
    open_ = cut(new.join(got.select("draft"), "draft", "left_anti").select("draft", "key"))
    used = olds.select(F.col("old").alias("id")).union(resting.select("id")).distinct()
    fresh = linkage.assigned_ids(open_, "key", used, "draft").select("draft", F.col("id").alias("old"), F.lit(FRESH).alias("stage"))
    parted = judged.where("starts or named").select("old", "draft").join(matched.select("old"), "old", "left_semi").join(open_, "draft", "left_semi").groupBy("draft").agg(F.concat(F.lit("split from "), F.min("old")).alias("split"))
    out = got.select("draft", "old", "stage").unionByName(fresh)
    vague = unsure.withColumn("vague", F.lit("ambiguous"))
    out = out.join(ignored, "draft", "left").join(vague, "draft", "left").join(parted, "draft", "left")
    note = F.concat_ws("; ", "note", F.when(F.col("stage").isin(FRESH, MOVED), F.col("vague")), "split")
    return out.select("draft", F.col("old").alias("id"), "stage", F.nullif(note, F.lit("")).alias("note"))


def continued(offers: DataFrame, previous: DataFrame, first: Column) -> DataFrame:
    """``offers`` with the past sessions, before ``first``, that a course had under its id the night before: sources forget them."""
    old = previous.where(F.col("kind") == sessions.COURSE).select("id", F.filter("sessions", lambda s: F.to_date(s["start"]) < first).alias("__past"))
    both = offers.join(old, "id", "left")
    more = (F.col("kind") == sessions.COURSE) & (F.size("__past") > 0)
    return both.withColumn("sessions", F.when(more, sessions.union_sessions(F.col("__past"), F.col("sessions"))).otherwise(F.col("sessions"))).drop("__past").select(*offers.columns)
