"""Finding and keeping providers: what is known already, whose find matches whom, care of pages, outcomes by stage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import numbers, textfn, titlefn, urlfn

DURABLE_DAYS, REST_DAYS = 2, 56


def prefilter(finds: DataFrame, known: DataFrame, rejected: DataFrame, postponed: DataFrame, cases: DataFrame, today: Column) -> DataFrame:
    """(id, reason) of finds (id, name, url): why each is dropped, null if it is kept.

    In this order: a known address (``known``: provider, name, url), a rejected address or host (``rejected``: url, host), a known host with
    a similar name, postponed (url, until), a suspended case (url, until).
    """
    f = finds.select("id", "name", urlfn.canonical(F.col("url")).alias("c"), urlfn.host(F.col("url")).alias("h"))
    k = known.select(F.col("name").alias("kn"), urlfn.canonical(F.col("url")).alias("c"), urlfn.host(F.col("url")).alias("h"))
    hits = [
        f.join(k, "c", "left_semi").select("id", F.lit(0).alias("r")),
        f.join(rejected.where("url is not null").select(urlfn.canonical(F.col("url")).alias("c")), "c", "left_semi").select("id", F.lit(1).alias("r")),
        f.join(rejected.where("host is not null").select(F.lower("host").alias("h")), "h", "left_semi").select("id", F.lit(1).alias("r")),
        f.join(k.select("h", "kn").distinct(), "h").where(titlefn.similar_name(F.col("name"), F.col("kn"))).select("id", F.lit(2).alias("r")).distinct(),
        f.join(postponed.where(F.col("until") > today).select(urlfn.canonical(F.col("url")).alias("c")), "c", "left_semi").select("id", F.lit(3).alias("r")),
        f.join(cases.where(F.col("until") > today).select(urlfn.canonical(F.col("url")).alias("c")), "c", "left_semi").select("id", F.lit(4).alias("r")),
    ]
    first = reduce(DataFrame.unionByName, hits).groupBy("id").agg(F.min("r").alias("r"))
    names = F.array(*map(F.lit, ("known", "rejected", "similar name", "postponed", "suspended")))
    return finds.select("id").join(first, "id", "left").select("id", F.try_element_at(names, F.col("r") + 1).alias("reason"))


def umbrella_hosts(pages: DataFrame, least: int = 2) -> DataFrame:
    """(host, providers): hosts on which at least so many providers have pages (provider, url)."""
    per = pages.select(urlfn.host(F.col("url")).alias("host"), "provider").groupBy("host").agg(F.countDistinct("provider").alias("providers"))
    return per.where(F.col("providers") >= least)


def site_of(host: Column) -> Column:
    """The last two parts of a host."""
    return F.substring_index(host, ".", -2)


def directory_finds(links: DataFrame, own: DataFrame, foreign: Sequence[str] = ()) -> DataFrame:
    """(directory, name, url): of a directory's links (directory, ord, label, url) to other sites those whose text sounds like an organiser
    or like the youngest; the first of each address. ``own`` (directory, url): the directory's own pages."""
    label = F.trim(F.regexp_replace("label", r"\s+", " "))
    l = links.select("directory", "ord", label.alias("name"), "url", urlfn.host(F.col("url")).alias("h"), urlfn.canonical(F.col("url")).alias("c")).where("h <> ''")
    l = l.withColumn("site", site_of(F.col("h"))).where(titlefn.is_relevant(F.col("name")) | F.col("name").rlike(titlefn.ORGANISER))
    if foreign:
        l = l.where(~F.col("site").isin(list(foreign)))
    l = l.join(own.select("directory", site_of(urlfn.host(F.col("url"))).alias("site")).distinct(), ["directory", "site"], "left_anti")
    return l.groupBy("directory", "c").agg(F.min_by(F.struct("name", "url"), "ord").alias("f")).select("directory", "f.name", "f.url")


def match_scores(adopted: DataFrame, providers: DataFrame, places: DataFrame, metres: float = 100) -> DataFrame:
    """(id, provider, score) of adopted finds (id, name, url, lat, lon) and providers (provider, name, url): 3 for an equal address, 2 for one host
    with a similar name or a common place, 1 for a similar name at a common place. ``places`` (provider, lat, lon). No host alone matches."""
    from .joins import grid_pairs

    a = adopted.select("id", F.col("name").alias("an"), urlfn.canonical(F.col("url")).alias("ac"), urlfn.host(F.col("url")).alias("ah"))
    p = providers.select("provider", F.col("name").alias("pn"), urlfn.canonical(F.col("url")).alias("pc"), urlfn.host(F.col("url")).alias("ph"))
    same = a.join(p, F.col("ac") == F.col("pc")).select("id", "provider", F.lit(3).alias("s"))
    host = a.join(p, F.col("ah") == F.col("ph")).where(titlefn.similar_name(F.col("an"), F.col("pn"))).select("id", "provider", F.lit(2).alias("s"))
    spots = places.select(F.struct("provider", "lat", "lon").alias("id"), "lat", "lon")
    near = grid_pairs(adopted.select("id", "lat", "lon").where("lat is not null"), spots, metres).select(F.col("a").alias("id"), F.col("b.provider").alias("provider")).distinct()
    at = near.join(a, "id").join(p, "provider").withColumn("s", F.when(F.col("ah") == F.col("ph"), 2).when(titlefn.similar_name(F.col("an"), F.col("pn")), 1))
    found = same.unionByName(host).unionByName(at.where("s is not null").select("id", "provider", "s"))
    return found.groupBy("id", "provider").agg(F.max("s").alias("score"))


def reserved_conflicts(catalogue: DataFrame, reserved: DataFrame) -> DataFrame:
    """(provider, rule): catalogue rows (provider, public_id) that carry an id or a public id taken back (``reserved``: id, public_id)."""
    by_id = catalogue.join(reserved.where("id is not null").select(F.col("id").alias("provider")), "provider", "left_semi").select("provider", F.lit("id").alias("rule"))
    by_public = catalogue.join(reserved.where("public_id is not null").select("public_id"), "public_id", "left_semi").select("provider", F.lit("public_id").alias("rule"))
    return by_id.unionByName(by_public)


def acceptance_issues(entries: DataFrame, providers: DataFrame, today: Column) -> DataFrame:
    """(entry, rule): accepted losses (entry, provider, day) of unknown providers, or dated ahead."""
    known = entries.join(providers.select("provider"), "provider", "left_anti").select("entry", F.lit("unknown provider").alias("rule"))
    return known.unionByName(entries.where(F.col("day") > today).select("entry", F.lit("ahead").alias("rule")))


def catalogue_ids(names: DataFrame, taken: DataFrame, key: str = "name", most: int = 50) -> DataFrame:
    """(name, id): a slug for every new name, with the next free number where it is taken; slugs in the form of a short id get a suffix.

    ``taken`` (id). Names of one slug are numbered among themselves after those taken."""
    base = textfn.slug(F.col(key), most)
    n = names.select(key).distinct().withColumn("base", F.when(base.rlike("^[0-9a-z]{8}$"), F.concat(base, F.lit("-anbieter"))).otherwise(base))
    number = F.coalesce(F.try_element_at(F.transform(F.filter(F.split("id", "-"), lambda x: x.rlike(r"^\d{1,9}$")), lambda x: x.cast("int")), F.lit(-1)), F.lit(1))
    used = taken.select("id", F.regexp_replace("id", r"-\d{1,9}$", "").alias("stem"), number.alias("k"))
    both = used.select(F.col("id").alias("base"), F.lit(1).alias("k")).unionByName(used.where("stem <> id").select(F.col("stem").alias("base"), "k"))
    held = both.groupBy("base").agg(F.array_sort(F.collect_set("k")).alias("ks"))
    rank = F.row_number().over(W.partitionBy("base").orderBy(key))
    j = n.withColumn("r", rank).join(held, "base", "left").withColumn("ks", F.coalesce("ks", F.array().cast("array<int>")))
    free = F.filter(F.sequence(F.lit(1), (F.col("r") + F.size("ks")).cast("int")), lambda k: ~F.array_contains("ks", k))
    k = F.element_at(free, F.col("r").cast("int"))
    return j.select(key, F.when(k == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), k.cast("string"))).alias("id"))


def durable_units(units: DataFrame, known: DataFrame, today: Column, days: int = DURABLE_DAYS) -> DataFrame:
    """(provider, units): units in the catalogue (``known``: provider, unit) that have failed lastingly for ``days``, sorted."""
    u = units.where((F.col("failure") == "lasting") & (F.datediff(today, F.col("failure_since")) >= days)).join(known, ["provider", "unit"], "left_semi")
    return u.groupBy("provider").agg(F.array_sort(F.collect_set("unit")).alias("units"))


def care_digest(known: DataFrame, durable: DataFrame) -> DataFrame:
    """(provider, digest): what a provider's pages are compared by: the sorted units in the catalogue and those failing lastingly."""
    k = known.groupBy("provider").agg(F.array_sort(F.collect_set("unit")).alias("all"))
    j = k.join(durable, "provider", "left")
    return j.select("provider", F.substring(F.sha2(F.to_json(F.struct("all", F.coalesce("units", F.array().cast("array<string>")).alias("d"))), 256), 1, 16).alias("digest"))


def next_pages(pages: DataFrame, checked: DataFrame, seen: DataFrame, cared: DataFrame, today: Column, rest: int = REST_DAYS) -> DataFrame:
    """Pages (url, provider, checked_on) after a run of care: checked ones replace the old; of a provider cared for (provider) old ones stay
    only if the run saw them (provider, url) or their rest of ``rest`` days isn't over."""
    old = pages.join(checked.select("url"), "url", "left_anti").join(cared.select("provider", F.lit(True).alias("__c")), "provider", "left")
    old = old.join(seen.select("provider", "url", F.lit(True).alias("__s")).distinct(), ["provider", "url"], "left")
    kept = old.where("__c is null").unionByName(old.where(F.col("__c") & (F.coalesce("__s", F.lit(False)) | (F.datediff(today, F.col("checked_on")) < rest))))
    return kept.select("url", "provider", "checked_on").unionByName(checked.select("url", "provider", "checked_on"))


def open_cases(cases: DataFrame, today: Column) -> DataFrame:
    """Cases (url, until) that aren't suspended beyond today."""
    return cases.where(F.col("until").isNull() | (F.col("until") <= today))


def end_cases(cases: DataFrame, urls: DataFrame) -> DataFrame:
    """Cases whose address isn't among ``urls``; addresses are compared in their canonical form."""
    done = urls.select(urlfn.canonical(F.col("url")).alias("__c")).distinct()
    return cases.withColumn("__c", urlfn.canonical(F.col("url"))).join(done, "__c", "left_anti").drop("__c")


def select_terms(terms: DataFrame, filters: Sequence[str], column: str = "term") -> DataFrame:
    """Terms that hold one of the filters, whatever the case; all without a filter. A filter that no term holds is an error."""
    wanted = [f.strip().lower() for f in filters if f.strip()]
    if not wanted:
        return terms
    hits = [F.contains(F.lower(column), F.lit(f)) for f in wanted]
    per = terms.agg(*[F.count_if(h).alias(str(k)) for k, h in enumerate(hits)]).first()
    unknown = [f for k, f in enumerate(wanted) if not per[k]]
    if unknown:
        raise ValueError(f"no term holds {unknown}")
    return terms.where(reduce(Column.__or__, hits))


#: Stages that a hidden provider may reach again, in order.
STAGES = ("found", "kept", "fetched", "accepted", "placed")


def stage_counts(outcomes: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Per group: n, how many outcomes (stage, adopted, hits, reference, counts) reached each stage, found_again, and the mean share of hits
    among those with a reference that count (yield, yield_n)."""
    rank = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    share = F.when(F.coalesce("counts", F.lit(True)) & (F.col("reference") > 0), F.col("hits") / F.col("reference"))
    reached = [F.count_if(rank >= k + 1).alias(s) for k, s in enumerate(STAGES)]
    return outcomes.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *reached, F.count_if("adopted").alias("found_again"), F.round(F.avg(share), 6).alias("yield"), F.count(share).alias("yield_n"))


def source_counts(outcomes: DataFrame, sources: str = "sources") -> DataFrame:
    """(source, n): how many outcomes each kind of source has found."""
    return outcomes.select(F.explode(F.array_distinct(sources)).alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def misplaced(excluded: DataFrame, predicted: DataFrame) -> DataFrame:
    """Ids of predicted offers (case, id, title, start) that have a similar title and a common start with an excluded one (case, title, start),
    at whatever venue. Rows are one start each."""
    e, p = excluded.alias("e"), predicted.alias("p")
    hit = p.join(e, (F.col("p.case") == F.col("e.case")) & (F.col("p.start") == F.col("e.start")))
    return hit.where(textfn.similar_title(F.col("p.title"), F.col("e.title"), titlefn.GENERIC)).select("p.case", "p.id").distinct()


def dates_at(offers: DataFrame, venues: DataFrame, months: int = 36) -> DataFrame:
    """(provider, start, lat, lon): the dates of offers without an age or for at most ``months`` at venues with a place."""
    o = offers.where(F.col("low").isNull() | (F.col("low") <= months)).select("provider", "venue", F.explode("sessions.start").alias("start"))
    return o.join(venues.select("provider", "venue", "lat", "lon"), ["provider", "venue"]).select("provider", "start", "lat", "lon")


def matched_dates(found: DataFrame, reference: DataFrame, low: Column, high: Column, metres: float = 100) -> DataFrame:
    """(provider, hits, reference): reference dates in [low, high) matched one to one with found ones of an equal start at most ``metres`` away.

    Each reference date, by place from the south-west on, takes the first found date in reach that is left. Dates of one start and
    place are taken together, as often as both sides have them.
    """
    from .joins import greedy_flow, grid_pairs

    at = ["provider", "start", "lat", "lon"]
    spots = lambda d: d.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.struct(*at, "n"))
    wanted = spots(reference.where((F.col("start") >= low) & (F.col("start") < high)))
    near = grid_pairs(wanted, spots(found), metres, keys=["provider", "start"]).withColumns({"p": F.col("a.n"), "q": F.col("b.n")})
    hits = greedy_flow(near, "a", "b", left_n="p", right_n="q").groupBy("a.provider").agg(F.sum("n").alias("hits"))
    return wanted.groupBy("provider").agg(F.sum("n").alias("reference")).join(hits, "provider", "left").select("provider", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), "reference")


def changed(results: DataFrame, changing: Sequence[str] = ("extracted", "pending adopted", "held adopted", "removed")) -> DataFrame:
    """(run, changed): providers of each run whose result changed their offers."""
    return results.groupBy("run").agg(F.count_if(F.col("result").isin(list(changing))).alias("changed"))


#: Last parts of addresses that hold no programme, and calendars of a single date.
NO_PROGRAMME, SINGLE_DATE = r"(?i)(^|[_\-.])(gottesdienste?|kontakt|anfahrt)([_\-.]|$)", r"(?i)(event|termin|single|download)[^/]*\.ics|\.ics\?.*(id|uid|event)="


def never_candidate(url: Column, known: Column, aggregator: Column) -> Column:
    """Never a page to adopt: known or an aggregator's, a service, contact or directions page by its last part, a calendar of one date."""
    last = F.element_at(F.split(F.regexp_replace(F.coalesce(urlfn.path(url), F.lit("")), "/+$", ""), "/"), -1)
    return F.coalesce(known, F.lit(False)) | F.coalesce(aggregator, F.lit(False)) | (urlfn.host(url) == "") | last.rlike(NO_PROGRAMME) | url.rlike(SINGLE_DATE)


def best_candidates(pages: DataFrame, n: int = 5) -> DataFrame:
    """Per site (site, url, future) the ``n`` pages with the most dates ahead, then by address."""
    w = W.partitionBy("site").orderBy(F.desc("future"), "url")
    return pages.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
