"""From raw events to offers: drafts in a horizon, versions of one offer merged, what failed providers keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import cohortfn, textfn, timefn, titlefn
from ..functions.exprfn import let
from . import sessions
from .lineage import cut

MINUTES, MOST_MONTHS = 60, 36  # length of a session without an end, and the age up to which offers count


def nightly_window(today: Column, months: int = 12) -> tuple[Column, Column, Column, Column]:
    """(first, last) day of the horizon, and of the free days that it needs: a year before, two years after."""
    last = timefn.add_months(today, months)
    return today, last, timefn.add_months(today, -12), timefn.add_months(last, 24)


def timed(occurrences: Column) -> Column:
    """Sessions of occurrences (struct<start, end>, civil): those whose start exists, with an end an hour later where none is
    given or it isn't later; in a gap of the clock the hour is counted in real time."""
    hour = F.expr(f"INTERVAL {MINUTES} MINUTES")
    real = F.filter(occurrences, lambda o: timefn.exists(o["start"]))
    guess = lambda o: F.when(timefn.exists(o["start"] + hour), o["start"] + hour).otherwise(o["start"] + hour + hour)
    fine = lambda o: (o["end"] > o["start"]) & timefn.exists(o["end"])
    return F.transform(real, lambda o: F.struct(o["start"].alias("start"), F.when(fine(o), o["end"]).otherwise(guess(o)).alias("end")))


def drafts(events: DataFrame, first: Column, last: Column) -> DataFrame:
    """Offers without ids from ``events`` (provider, venue, title, kind, low, high: months or null, occurrences: array<struct<start,
    end>>, and any other columns, which stay): ``sessions``, ``low`` and ``high`` in place of occurrences and age.

    Courses keep all sessions and go if over or not begun in the horizon; of others the days within it count. A birth span in the title
    beats the given age, but not for regular offers. What is only for over 36 months goes; single events are one offer a session.
    """
    day = lambda s: F.to_date(s["start"])
    course, single = F.col("kind") == sessions.COURSE, F.col("kind") == sessions.SINGLE
    occurrences, inside = F.col("occurrences"), lambda o: day(o).between(first, last)
    # What lies outside goes before any zone is asked, and what stays is timed once: a condition on timed sessions would time them again for each mention.
    meets = F.when(course, F.exists(occurrences, lambda o: day(o) >= first) & F.exists(occurrences, lambda o: day(o) <= last)).otherwise(F.exists(occurrences, inside))
    shown = timed(F.when(course, occurrences).otherwise(F.filter(occurrences, inside)))

    def parts(s: Column) -> Column:
        ends = [day(F.try_element_at(s, F.lit(k))) for k in (1, -1)]
        held = (F.size(s) > 0) & (~course | ((ends[1] >= first) & (ends[0] <= last)))
        return F.when(held, F.when(single, F.transform(s, lambda x: F.array(x))).otherwise(F.array(s)))

    cohort = F.when(F.col("kind") != sessions.REGULAR, cohortfn.birth_cohort(F.col("title")))
    own = F.when(F.col("low").isNotNull(), F.struct(F.col("low").cast("int").alias("low"), F.col("high").cast("int").alias("high")))
    d = events.where(meets).withColumn("__c", cohort).withColumn("__own", own).withColumn("__part", F.explode(let(shown, parts))).drop("occurrences")
    at = F.to_date(F.col("__part")[0]["start"])
    d = d.withColumn("__age", F.coalesce(F.when(F.col("__c").isNotNull(), cohortfn.cohort_age(F.col("__c"), at)), F.col("__own")))
    d = d.where(F.col("__age").isNull() | (F.col("__age.low") <= MOST_MONTHS))
    d = d.withColumns({"low": F.col("__age.low"), "high": F.when(F.col("__age.high").isNotNull(), F.least(F.col("__age.high"), F.lit(MOST_MONTHS))), "sessions": F.col("__part")})
    return d.drop("__c", "__own", "__part", "__age")


def _union(versions: Column) -> Column:
    """Sessions of versions (array<struct<rank, ord, sessions>>, in order), one per start: that of the first version."""
    all_ = F.array_sort(F.flatten(F.transform(versions, lambda v: F.transform(v["sessions"], lambda s: F.struct(s["start"].alias("start"), v["ord"].alias("ord"), s["end"].alias("end"))))))
    first = F.filter(all_, lambda s, i: (i == 0) | (F.try_element_at(all_, i.cast("int"))["start"] != s["start"]))
    return F.transform(first, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def merge_keys(offers: DataFrame, key: str, same: list[str]) -> DataFrame:
    """One row per ``key`` of drafts (rank, ord, kind, title, topics, sessions, ...): the version of the best rank, the first of these.

    Versions of the same rank add their sessions; all add their topics; a column ``keep``, an id kept for the version, stays if they agree on it. ``conflict`` says that a regular offer has versions of
    one rank that differ in title or in one of the columns ``same``. The versions of one key are few.
    """
    best = F.struct("rank", "ord")
    other = [c for c in offers.columns if c not in (key, "rank", "ord", "topics", "sessions", "keep")]
    kept = [merge_kept(F.collect_list("keep")).alias("keep")] if "keep" in offers.columns else []
    version = F.struct("rank", "ord", "sessions", "topics", F.struct("title", *same).alias("shape"))
    g = offers.groupBy(key).agg(F.min_by(F.struct(*other), best).alias("__o"), F.min(best).alias("__b"), F.array_sort(F.collect_list(version)).alias("__v"), *kept)
    equals = F.filter("__v", lambda v: v["rank"] == F.col("__b.rank"))
    topics = F.array_distinct(F.flatten(F.transform("__v", lambda v: v["topics"])))
    shapes = F.size(F.array_distinct(F.transform(equals, lambda v: v["shape"])))
    return g.select(key, "__b.rank", "__b.ord", "__o.*", topics.alias("topics"), _union(equals).alias("sessions"), *(["keep"] if kept else []), ((F.col("__o.kind") == sessions.REGULAR) & (shapes > 1)).alias("conflict"))


def drop_outranked(offers: DataFrame, key: str = "id") -> DataFrame:
    """Without offers of which a better ranked one of the same provider and venue has a similar title and a common start; that
    one, the best, gets their topics. Offers of equal title, rank and start are compared as one, and each pair of titles once."""
    shape = ["provider", "venue", "start", "rank", "title"]
    starts = offers.select(F.col(key).alias("__k"), "provider", "venue", "rank", "ord", "title", F.explode("sessions.start").alias("start"))
    classes = starts.groupBy(*shape).agg(F.min(F.struct("ord", "__k")).alias("first"))
    # Only where ranks differ can one outrank another: the rest goes before classes meet.
    ranks = W.partitionBy("provider", "venue", "start")
    classes = cut(classes.withColumns({"__a": F.min("rank").over(ranks), "__z": F.max("rank").over(ranks)}).where("__a < __z").drop("__a", "__z"))
    low, high = classes.alias("l"), classes.alias("h")
    on = [F.col(f"l.{c}") == F.col(f"h.{c}") for c in ("provider", "venue", "start")] + [F.col("h.rank") < F.col("l.rank")]
    met = cut(low.join(high, on).select(*[f"l.{c}" for c in shape], F.col("h.title").alias("__u"), F.struct("h.rank", "h.first").alias("h")))
    alike = cut(met.select("title", "__u").distinct())  # written, or the test would be moved before the distinct rows
    alike = alike.where(textfn.similar_title(F.col("title"), F.col("__u"), titlefn.GENERIC))
    best = met.join(alike, ["title", "__u"]).groupBy(*shape).agg(F.min("h").alias("h"))
    pairs = starts.join(best, shape).groupBy(F.col("__k").alias("low")).agg(F.min("h").alias("h")).select("low", F.col("h.first.__k").alias("high"))
    pairs = cut(pairs)
    more = pairs.join(offers.select(F.col(key).alias("low"), "topics"), "low").groupBy("high").agg(F.array_distinct(F.flatten(F.collect_set("topics"))).alias("__t"))
    left = offers.join(pairs.select(F.col("low").alias(key)), key, "left_anti").join(more.withColumnRenamed("high", key), key, "left")
    return left.withColumn("topics", F.when(F.col("__t").isNull(), F.col("topics")).otherwise(F.array_union("topics", "__t"))).drop("__t").select(*offers.columns)


def same_sessions(a: Column, b: Column, since: Column) -> Column:
    """Do two series agree where both run, from ``since`` on? At least 0.8 of the smaller's starts in the larger, at least half as many,
    and three in common (or all)."""
    own = lambda s: F.array_distinct(F.transform(F.filter(s, lambda x: F.to_date(x["start"]) >= since), lambda x: F.date_trunc("minute", x["start"])))

    def windowed(s: Column) -> Column:
        lo, hi = F.greatest(F.array_min(s["x"]), F.array_min(s["y"])), F.least(F.array_max(s["x"]), F.array_max(s["y"]))
        inside = lambda side, w: F.filter(s[side], lambda t: t.between(w["lo"], w["hi"]))
        ends = F.struct(lo.alias("lo"), hi.alias("hi"))
        return let(ends, lambda w: F.struct((w["lo"] <= w["hi"]).alias("meet"), F.greatest(F.size(s["x"]), F.size(s["y"])).alias("most"), inside("x", w).alias("x"), inside("y", w).alias("y")))

    def counted(w: Column) -> Column:
        p, q = F.size(w["x"]), F.size(w["y"])
        return F.struct(w["meet"], w["most"], F.least(p, q).alias("small"), F.greatest(p, q).alias("large"), F.size(F.array_intersect(w["x"], w["y"])).alias("both"))

    enough = lambda n: n["meet"] & (n["both"] >= F.least(F.lit(3), n["most"])) & (n["both"] >= n["small"] * 0.8) & (n["small"] >= n["large"] * 0.5)
    series = F.struct(own(a).alias("x"), own(b).alias("y"))
    return F.coalesce(let(let(let(series, windowed), counted), enough), F.lit(False))


def same_offer_twice(a: str, b: str, since: Column) -> Column:
    """Test on joined rows ``a`` and ``b`` of one provider, venue and kind: compatible age, same core title, same sessions."""
    col = lambda side, c: F.col(f"{side}.{c}")
    age = titlefn.compatible_age(col(a, "low"), col(a, "high"), col(b, "low"), col(b, "high"))
    return age & titlefn.same_core_title(col(a, "title"), col(b, "title")) & same_sessions(col(a, "sessions"), col(b, "sessions"), since)


def twins(offers: DataFrame, since: Column, key: str = "id") -> DataFrame:
    """(a, b): pairs of one provider, venue, kind and rank that are the same offer twice; ``a`` stands before ``b`` by ``ord``. Candidates
    share a start, so a place's offers don't all meet; one that is alone there has no starts to tell."""
    place = ["provider", "venue", "kind", "rank"]
    several = offers.select(F.col(key).alias("k"), *place, "ord", F.col("sessions.start").alias("starts")).withColumn("n", F.count(F.lit(1)).over(W.partitionBy(*place))).where("n > 1")
    starts = several.select("k", *place, "ord", F.explode("starts").alias("start")).where(F.to_date("start") >= since)
    same = [*place, "start"]
    pairs = starts.alias("l").join(starts.alias("h"), [F.col(f"l.{c}") == F.col(f"h.{c}") for c in same] + [F.col("h.ord") < F.col("l.ord")])
    pairs = pairs.select(F.col("h.k").alias("a"), F.col("l.k").alias("b")).distinct()
    shape = offers.select(F.col(key).alias("k"), "title", "low", "high", "sessions")
    return pairs.join(shape.alias("x"), F.col("a") == F.col("x.k")).join(shape.alias("y"), F.col("b") == F.col("y.k")).where(same_offer_twice("x", "y", since)).select("a", "b")


def drop_twins(offers: DataFrame, since: Column, key: str = "id") -> DataFrame:
    """Of offers that are the same twice the first by ``ord`` stays; one goes if it is the same as one that stays. Topics are united, and
    sessions that the one that goes has outside of both series' common window are added.

    Rounds: those without an earlier open twin stay, their later twins go; the rounds are few, as twins of twins are.
    """
    pairs = cut(twins(offers, since, key))
    open_, stays, goes = cut(pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()), None, None
    while not open_.isEmpty():
        live = pairs.join(open_.withColumnRenamed("k", "a"), "a", "left_semi").join(open_.withColumnRenamed("k", "b"), "b", "left_semi")
        first = cut(open_.join(live.select(F.col("b").alias("k")), "k", "left_anti"))
        gone = cut(live.join(first.withColumnRenamed("k", "a"), "a", "left_semi").groupBy("b").agg(F.min("a").alias("a")))
        goes = gone if goes is None else goes.unionByName(gone)
        stays = first if stays is None else stays.unionByName(first)
        open_ = cut(open_.join(first, "k", "left_anti").join(gone.select(F.col("b").alias("k")), "k", "left_anti"))
    if goes is None:
        return offers
    side = offers.select(F.col(key).alias("b"), F.col("topics").alias("t"), F.col("sessions").alias("s"))
    more = goes.join(side, "b").groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("t"), F.collect_list("s").alias("s"))
    left = offers.join(goes.select(F.col("b").alias(key)), key, "left_anti").join(more.withColumnRenamed("a", key), key, "left")
    lo = lambda s: F.array_min(F.transform(F.filter(s, lambda x: F.to_date(x["start"]) >= since), lambda x: x["start"]))
    hi = lambda s: F.array_max(F.transform(F.filter(s, lambda x: F.to_date(x["start"]) >= since), lambda x: x["start"]))
    mine = F.col("sessions")
    outside = F.flatten(F.transform("s", lambda o: F.filter(o, lambda x: ~F.coalesce(x["start"].between(F.greatest(lo(mine), lo(o)), F.least(hi(mine), hi(o))), F.lit(False)))))
    united = F.when(F.col("s").isNull(), mine).otherwise(sessions.union_sessions(mine, outside))
    topics = F.when(F.col("t").isNull(), F.col("topics")).otherwise(F.array_union("topics", "t"))
    return left.withColumns({"sessions": united, "topics": topics}).drop("s", "t").select(*offers.columns)


def carry_reason(status: Column, extracted: Column, covered_by_failed: Column) -> Column:
    """Why a provider's old offers stay: its check failed, it wasn't reached, or the calendar that covers it failed; null: they don't."""
    return F.when(F.coalesce(extracted, F.lit(False)), None).when(status == "failed", "check failed").when(status.isNull() & covered_by_failed, "source failed").when(status.isNull(), "not checked")


def carried(previous: DataFrame, built: DataFrame, providers: DataFrame, venues: DataFrame, first: Column, cutoff: Column, key: str = "id") -> DataFrame:
    """Old offers of providers with a carry reason (provider, reason) that weren't built anew, at venues (provider, venue) that still exist,
    with the sessions from ``first`` on (courses: all), if the last one ended at ``cutoff`` or later."""
    p = previous.join(providers.where("reason is not null").select("provider", "reason"), "provider")
    p = p.join(built.select(key), key, "left_anti").join(venues.select("provider", "venue").distinct(), ["provider", "venue"], "left_semi")
    kept = F.when(F.col("kind") == sessions.COURSE, F.col("sessions")).otherwise(F.filter("sessions", lambda s: F.to_date(s["start"]) >= first))
    p = p.withColumn("sessions", kept).where(F.size("sessions") > 0)
    return p.where(F.try_element_at("sessions", F.lit(-1))["end"] >= cutoff)


def keep_of(sessions_: Column, kept: Column) -> Column:
    """The id that ``kept`` (map start -> id) names for the first of the sessions that it knows."""
    return F.try_element_at(F.filter(F.transform(sessions_, lambda s: F.try_element_at(kept, s["start"])), lambda i: i.isNotNull()), F.lit(1))


def merge_kept(ids: Column) -> Column:
    """The one id that versions of an offer inherit (array of ids, nulls none); null if they inherit different ones."""
    known = F.array_distinct(F.filter(ids, lambda i: i.isNotNull()))
    return F.when(F.size(known) == 1, known[0])


def id_changes(before: DataFrame, after: DataFrame, resting: DataFrame | None = None) -> DataFrame:
    """(id, was, provider): ids that stand under another provider than before; ``before`` goes before the resting memory."""
    old = before.select("id", F.col("provider").alias("was"), F.lit(0).alias("r"))
    if resting is not None:
        old = old.unionByName(resting.select("id", F.col("provider").alias("was"), F.lit(1).alias("r")))
    old = old.groupBy("id").agg(F.min_by("was", "r").alias("was"))
    return after.join(old, "id").where("provider != was").select("id", "was", "provider")


def merge_parts(parts: DataFrame) -> DataFrame:
    """Events of several pages of a provider as one list: ``parts`` (provider, part, ord, key, shape, title, regular, starts) without those
    that an earlier part has: of an equal ``key``, or of an equal ``shape`` (place, kind, age, first session, weekdays) with a
    similar title and all starts in the earlier one. Of the latter what has further starts takes the earlier title (``title``).

    Shapes and keys are an equi-join, so only like events meet; within a part all stay.
    """
    e = parts.withColumn("__id", F.struct("part", "ord"))
    by_key = e.alias("l").join(e.select("provider", "key", "part").alias("h"), ["provider", "key"]).where("h.part < l.part").select("provider", F.col("l.__id").alias("__id")).distinct()
    left = cut(e.join(by_key, ["provider", "__id"], "left_anti"))
    like = left.alias("l").join(left.alias("h"), ["provider", "shape"]).where("h.part < l.part and size(l.starts) > 0")
    like = like.where(textfn.similar_title(F.col("l.title"), F.col("h.title"), titlefn.GENERIC))
    first = like.groupBy("provider", F.col("l.__id").alias("__id")).agg(F.min_by(F.struct(F.col("h.title").alias("title"), F.col("h.starts").alias("starts")), F.col("h.__id")).alias("__h"))
    both = left.join(first, ["provider", "__id"], "left")
    inside = F.col("regular") | (F.size(F.array_except("starts", "__h.starts")) == 0)
    return both.where(F.col("__h").isNull() | ~inside).withColumn("title", F.coalesce("__h.title", "title")).drop("__h", "__id").select(*parts.columns)
