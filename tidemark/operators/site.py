"""What a site shows of offers and providers: projections, places, who is hidden, what is saved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import idfn, numbers, timefn
from . import sessions

LEAST_ADDRESS, SOON_DAYS = 5, 14


def venue_address(name: Column, address: Column) -> Column:
    """The address without the venue's name before a comma or in brackets at its end, if five characters are left."""
    venue, text = F.trim(name), F.trim(address)
    low = F.lower(venue)
    head = F.when((F.lower(F.substr(text, F.lit(1), F.length(venue))) == low) & (F.substr(text, F.length(venue) + 1, F.lit(1)) == ","), F.trim(F.substr(text, F.length(venue) + 2))).otherwise(text)
    tail = F.concat(F.lit("("), low, F.lit(")"))
    cut = F.when(F.endswith(F.lower(head), tail), F.trim(F.substr(head, F.lit(1), F.length(head) - F.length(tail)))).otherwise(head)
    return F.when((venue == "") | (F.length(cut) < LEAST_ADDRESS), address).otherwise(cut)


def site_offers(offers: DataFrame, providers: DataFrame, venues: DataFrame) -> DataFrame:
    """Offers with their provider's public id and name and their venue's name, address, district and place, by first start,
    title and id. ``providers`` (provider, public_id, name, role), ``venues`` (provider, venue, venue_name, address, district, lat, lon);
    offers without either are left out."""
    p = providers.where("role = 'provider'").select("provider", "public_id", F.col("name").alias("provider_name"))
    v = venues.select("provider", "venue", "venue_name", venue_address(F.col("venue_name"), F.col("address")).alias("address"), "district", "lat", "lon")
    o = offers.join(p, "provider").join(v, ["provider", "venue"]).drop("provider").withColumnRenamed("public_id", "provider")
    return o.orderBy(F.col("sessions")[0]["start"], "title", "id")


def provider_directory(providers: DataFrame, venues: DataFrame) -> DataFrame:
    """(provider, name, url, venues) of all providers, also without offers, by name; a provider's venues in their order (ord)."""
    v = venues.select("provider", F.struct("ord", F.col("venue_name").alias("name"), venue_address(F.col("venue_name"), F.col("address")).alias("address"), "district", "lat", "lon").alias("v"))
    per = v.groupBy("provider").agg(F.transform(F.array_sort(F.collect_list("v")), lambda x: x.dropFields("ord")).alias("venues"))
    p = providers.where("role = 'provider'").join(per, "provider", "left")
    return p.select(F.col("public_id").alias("provider"), "name", "url", "venues").orderBy("name", "provider")


def provider_offers(offers: DataFrame, now: Column) -> DataFrame:
    """Offers that a provider's page lists: discoverable ones, whatever the filters."""
    return offers.where(sessions.discoverable(F.col("kind"), F.col("registered"), F.col("sessions"), now))


def hidden_offers(own: DataFrame, visible: DataFrame, provider: str, key: str) -> DataFrame:
    """(provider, hidden): does the selection hide some of a provider's offers?"""
    marked = own.select(provider, key).join(visible.select(key, F.lit(True).alias("__v")).distinct(), key, "left")
    return marked.groupBy(provider).agg(F.bool_or(F.col("__v").isNull()).alias("hidden"))


def provider_points(venues: DataFrame, offers: DataFrame, digits: int = 3) -> DataFrame:
    """(provider, lat, lon): a row per provider and place (coordinates to ``digits``), the first of each place by ``ord``. Providers without
    a venue in the directory stand at their offers' places; invalid coordinates don't count."""
    known = venues.select("provider").distinct()
    rest = offers.join(known, "provider", "left_anti").select("provider", "lat", "lon", F.lit(0).alias("ord"))
    both = venues.select("provider", "lat", "lon", "ord").unionByName(rest).where(numbers.is_geo_point(F.col("lat"), F.col("lon")))
    place = [F.round("lat", digits).alias("__y"), F.round("lon", digits).alias("__x")]
    g = both.groupBy("provider", *place).agg(F.min(F.struct("ord", "lat", "lon")).alias("p"))
    return g.select("provider", "p.lat", "p.lon")


def providers_in_bounds(points: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    return points.where(F.col("lat").between(south, north) & F.col("lon").between(west, east)).select("provider").distinct()


def places(rows: DataFrame, owner: str, key: str) -> DataFrame:
    """(lat, lon, n, owners, first): rows of one place (coordinates to three decimals), how many and of how many owners."""
    return rows.groupBy(numbers.coarsened(F.col("lat")).alias("lat"), numbers.coarsened(F.col("lon")).alias("lon")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(owner).alias("owners"), F.min(key).alias("first"))


def bounding_box(rows: DataFrame) -> DataFrame:
    """(south, west, north, east, n) of all rows."""
    return rows.agg(F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"), F.count(F.lit(1)).alias("n"))


def provider_states(providers: DataFrame, offers: DataFrame, key: str, name: str) -> DataFrame:
    """(id, name, n, state): providers with their number of offers (provider): active, without_offers, or unlisted where only offers are."""
    per = offers.groupBy(F.col("provider").alias("__p")).agg(F.count(F.lit(1)).alias("n"))
    state = F.when(F.col(key).isNull(), "unlisted").when(F.col("n").isNull(), "without_offers").otherwise("active")
    j = providers.select(key, name).join(per, F.col(key) == F.col("__p"), "full_outer")
    return j.select(F.coalesce(key, "__p").alias("id"), F.col(name).alias("name"), F.coalesce("n", F.lit(0)).alias("n"), state.alias("state"))


def reach_order(minutes: Column, metres: Column) -> Sequence[Column]:
    """Sort columns by reach: travel times before distances, the nearer first, none last."""
    return [F.when(minutes.isNotNull(), 0).when(metres.isNotNull(), 1).otherwise(2), F.coalesce(minutes, metres)]


def stop_minutes(walk: Column) -> Column:
    """Whole minutes to a stop, one at least; halves up."""
    return F.greatest(F.lit(1), numbers.half_up(walk)).cast("int")


def without_access(origins: DataFrame, stops: DataFrame, metres: float = 800) -> DataFrame:
    """Origins (id, lat, lon) without a stop (id, lat, lon) within ``metres``."""
    from .joins import grid_pairs

    return origins.join(grid_pairs(origins, stops, metres).select(F.col("a").alias("id")), "id", "left_anti")


def soon(kind: Column, registered: Column, start: Column, running: Column, today: Column, days: int = SOON_DAYS) -> Column:
    """Does the session shown start within ``days``? Running courses and regular offers without registration don't count."""
    return ~running & ~((kind == sessions.REGULAR) & ~registered) & (F.to_date(start) <= F.date_add(today, days))


def age_visibility(offers: DataFrame, birth: Column | None, now: Column, low: str, high: str, fits_filter: Column, age_only: bool, rule: sessions.Rule = sessions.Rule()) -> DataFrame:
    """``offers`` with unfit (by any session), list_unfit (of regular offers only sessions under ``rule`` count) and visible: those that
    fit the filter, and with ``age_only`` the age too. Without a birth day nothing is unfit."""
    if birth is None:
        return offers.withColumns({"unfit": F.lit(False), "list_unfit": F.lit(False), "visible": fits_filter})
    fits = sessions.offer_fits_age(F.col("kind"), F.col("sessions"), F.col(low), F.col(high), birth, now)
    under = F.exists(sessions.upcoming(F.col("sessions"), now), lambda s: rule.fits(s) & sessions.fits_age(F.col(low), F.col(high), birth, F.to_date(s["start"])))
    listed = F.when((F.col("kind") == sessions.REGULAR) & F.lit(rule.active), under).otherwise(fits)
    return offers.withColumns({"unfit": ~fits, "list_unfit": ~listed, "visible": fits_filter & (listed | F.lit(not age_only))})


def migrated_ids(saved: DataFrame, key: str, position: str, strict: bool = False) -> DataFrame:
    """Saved ids in today's form (id, position): old keys become short ids, of equal ones the first place stays. Unknown forms stay
    as they are, or go if ``strict``."""
    now = idfn.resolve_provider_id(F.col(key)) if strict else F.coalesce(idfn.resolve_offer_id(F.col(key)), F.col(key))
    return saved.select(now.alias("id"), position).where("id is not null").groupBy("id").agg(F.min(position).alias(position))


def week_days(day: Column) -> Column:
    """The seven days of the week that holds ``day``, from Monday."""
    monday = F.date_sub(day, F.weekday(day))
    return F.sequence(monday, F.date_add(monday, 6))


def month_days(day: Column) -> tuple[Column, Column]:
    """(empty columns before the first, all days) of a month in rows that begin on Monday."""
    first = F.trunc(day, "month")
    return timefn.iso_weekday(first) - 1, F.sequence(first, F.last_day(day))


def free_day(row_kind: Column, why: Column, day: Column, weekday: int) -> Column:
    """Is a row of the week a free day with nothing hidden, on this ISO weekday?"""
    return (row_kind == "free") & (why == "empty") & (timefn.iso_weekday(day) == weekday)


def egress(stops: DataFrame, places: DataFrame, metres: float = 1500, speed: float = 75 / 60 / 1.3) -> DataFrame:
    """(stop, place, walk): seconds on foot from stops (id, lat, lon) to places (id, lat, lon) within ``metres``."""
    from .joins import grid_pairs

    near = grid_pairs(stops, places, metres)
    return near.select(F.col("a").alias("stop"), F.col("b").alias("place"), F.ceil(F.col("metres") / speed).cast("long").alias("walk"))


def inside(origins: DataFrame, stops: DataFrame, metres: float = 800) -> DataFrame:
    """(origin, stop, metres): stops within reach of an origin on foot."""
    from .joins import grid_pairs

    return grid_pairs(origins, stops, metres).toDF("origin", "stop", "metres")
