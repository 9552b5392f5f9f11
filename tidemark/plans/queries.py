"""Queries of the event, schedule and transit operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import numbers, textfn, timefn, urlfn
from ..operators import agenda, blocks, discovery, filters, joins, linkage, listing, measures, ranks, recurrence, sessions, site, state, transit
from ..sources import sinks
from . import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def with_roles(sql: str) -> str:
    return f"WITH {B.SQL}, {sql.lstrip()}" if not sql.lstrip().upper().startswith("SELECT") else f"WITH {B.SQL} {sql}"


# --- sessions and filters


@query(with_roles("""
    d AS (SELECT j.*, f.first FROM j JOIN f USING (o_orderkey), now WHERE "end" >= now AND NOT (kind = 'course' AND registered AND f.first <= now)),
    p AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY start) AS r FROM d)
    SELECT o_orderkey, kind, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, strftime(start, '%Y-%m-%d') AS day
    FROM p WHERE r = 1 AND kind IN ('course', 'regular') AND hour(start) < 12 ORDER BY start, o_orderkey LIMIT 40"""))
def next_session_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next session of each discoverable offer, two kinds, in the morning, by day: the first 40."""
    o = B.offers(spark, sf_dir).where(sessions.discoverable(F.col("kind"), F.col("registered"), F.col("sessions"), B.now()))
    o = o.withColumn("s", sessions.next_session(F.col("sessions"), B.now())).where(F.col("kind").isin("course", "regular") & (timefn.daytime(F.col("s.start")) == "morning"))
    page = listing.take_groups(o.select("o_orderkey", "kind", F.col("s.start").alias("at")), ["at", "o_orderkey"], 40)
    return page.select("o_orderkey", "kind", text(F.col("at")).alias("start"), F.date_format("at", "yyyy-MM-dd").alias("day"))


@query(with_roles("""
    SELECT o_orderkey, kind, o_orderstatus FROM o JOIN f USING (o_orderkey), now
    WHERE kind IN ('course', 'single') AND o_orderstatus IN ('O', 'P') AND any_end >= now AND NOT (kind = 'course' AND registered AND f.first <= now)"""))
def filter_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = filters.Selection.parse("kind=course,single,none&status=O,P", {"kind": (sessions.COURSE, sessions.REGULAR, sessions.SINGLE), "status": ("F", "O", "P")})
    o = B.offers(spark, sf_dir).where(chosen.matches({"kind": F.col("kind"), "status": F.col("o_orderstatus")}))
    return o.where(sessions.discoverable(F.col("kind"), F.col("registered"), F.col("sessions"), B.now())).select("o_orderkey", "kind", "o_orderstatus")


@query(with_roles("""
    SELECT o_orderkey, CAST(count(*) AS BIGINT) AS n, strftime(min(start), '%Y-%m-%d %H:%M:%S') AS first_start FROM j, now
    WHERE CASE WHEN kind = 'course' THEN k = 1 ELSE "end" >= now END AND CAST(start AS DATE) BETWEEN DATE '1998-06-01' AND DATE '1998-08-31'
      AND (hour(start) < 12 OR hour(start) >= 15) GROUP BY 1"""))
def candidate_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime

    rule = sessions.Rule(datetime.date(1998, 6, 1), datetime.date(1998, 8, 31), ("morning", "afternoon"))
    o = B.offers(spark, sf_dir).withColumn("c", sessions.candidates(F.col("kind"), F.col("sessions"), B.now(), rule)).where(F.size("c") > 0)
    return o.select("o_orderkey", F.size("c").cast("long").alias("n"), text(sessions.first(F.col("c"))["start"]).alias("first_start"))


@query(with_roles("""
    SELECT o.kind, CAST(count(*) AS BIGINT) AS offers, CAST(sum(CAST(kind = 'course' AND f.first <= now AND last_end >= now AS INTEGER)) AS BIGINT) AS running,
           CAST(sum(CAST(kind = 'course' AND registered AND f.first <= now AS INTEGER)) AS BIGINT) AS started FROM o JOIN f USING (o_orderkey), now GROUP BY 1"""))
def course_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, s = B.offers(spark, sf_dir), F.col("sessions")
    return o.groupBy("kind").agg(F.count(F.lit(1)).alias("offers"), F.count_if(sessions.course_running(F.col("kind"), s, B.now())).alias("running"), F.count_if(sessions.started_course(F.col("kind"), F.col("registered"), s, B.now())).alias("started"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-02-01' AND l_shipdate < TIMESTAMP '1998-03-02'")
def date_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = filters.day_range("1998-03-01", "1998-02-01")  # reversed on purpose
    at = F.col("l_shipdate")
    end = F.date_add(F.lit(hi).cast("date"), 1).cast("timestamp_ntz")
    return B.table(spark, sf_dir, "lineitem").where((at >= F.lit(lo).cast("timestamp_ntz")) & (at < end)).select("l_orderkey", "l_linenumber")


@query(with_roles("""
    u AS (SELECT j.* FROM j, now WHERE "end" >= now)
    SELECT o_orderkey, CAST(count(*) AS BIGINT) AS remaining, CAST(max(n) AS BIGINT) AS total FROM u GROUP BY 1"""))
def course_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    total, left = sessions.progress(F.col("sessions"), B.now())
    return B.offers(spark, sf_dir).select("o_orderkey", left.cast("long").alias("remaining"), total.cast("long").alias("total")).where("remaining > 0")


@query(with_roles("""
    u AS (SELECT j.*, datediff('day', lag(CAST(start AS DATE)) OVER (PARTITION BY o_orderkey ORDER BY start), CAST(start AS DATE)) AS gap FROM j, now WHERE "end" >= now)
    SELECT o_orderkey, CAST(CASE WHEN coalesce(bool_and(gap = 7), true) AND count(DISTINCT strftime(start, '%H:%M')) = 1 THEN 1 ELSE -1 END * min(isodow(start)) AS INTEGER) AS rhythm
    FROM u GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT isodow(start)) = 1"""))
def rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.offers(spark, sf_dir).withColumn("rhythm", sessions.rhythm(F.col("sessions"), B.now()).cast("int"))
    return o.where("rhythm is not null").select("o_orderkey", "rhythm")


@query(with_roles("""SELECT o_orderkey, CAST(k AS INTEGER) AS ordinal, strftime(start, '%Y-%m-%d') AS day, CAST(row_number() OVER (PARTITION BY CAST(start AS DATE) ORDER BY start, o_orderkey) AS INTEGER) AS place FROM j"""))
def sessions_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.offers(spark, sf_dir).select("o_orderkey", F.posexplode("sessions").alias("i", "s"))
    rows = o.select("o_orderkey", (F.col("i") + 1).cast("int").alias("ordinal"), F.to_date("s.start").alias("day"), F.col("s.start").alias("start"))
    out = ranks.numbered(rows, ["day"], ["start", "o_orderkey"], "place")
    return out.select("o_orderkey", "ordinal", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("place").cast("int").alias("place"))


# --- age

_AGE = """(year(a) - year(b)) * 12 + month(a) - month(b) - CASE WHEN day(a) < least(day(b), day(last_day(a))) THEN 1 ELSE 0 END"""


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS a, CAST(o_orderdate AS DATE) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT l_orderkey, l_linenumber, CAST({_AGE} AS INTEGER) AS months FROM p""")
def age_in_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, o = B.table(spark, sf_dir, "lineitem"), B.table(spark, sf_dir, "orders")
    months = timefn.age_in_months(F.to_date("o_orderdate"), F.to_date("l_shipdate"))
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).select("l_orderkey", "l_linenumber", months.alias("months"))


@query(with_roles(f"""
    p AS (SELECT j.o_orderkey, kind, k, "end" >= now AS up, CAST(start AS DATE) AS a, CAST(o_orderdate AS DATE) AS b FROM j, now),
    m AS (SELECT *, {_AGE} BETWEEN 1 AND 36 AS fit FROM p)
    SELECT kind, CAST(count(*) FILTER (WHERE fits) AS BIGINT) AS fitting, CAST(count(*) FILTER (WHERE NOT fits) AS BIGINT) AS unfit
    FROM (SELECT o_orderkey, kind, CASE WHEN kind = 'regular' THEN bool_or(up AND fit) ELSE bool_or(k = 1 AND fit) END AS fits FROM m GROUP BY 1, 2) GROUP BY 1"""))
def age_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = sessions.offer_fits_age(F.col("kind"), F.col("sessions"), F.lit(1), F.lit(36), F.to_date("o_orderdate"), B.now())
    return B.offers(spark, sf_dir).groupBy("kind").agg(F.count_if(fits).alias("fitting"), F.count_if(~fits).alias("unfit"))


@query(with_roles(f"""
    p AS (SELECT j.o_orderkey, start, CAST(start AS DATE) AS a, CAST(o_orderdate AS DATE) AS b FROM j, now WHERE "end" >= now),
    m AS (SELECT *, {_AGE} BETWEEN 2 AND 36 AS fit FROM p)
    SELECT o_orderkey, strftime(coalesce(min(start) FILTER (WHERE fit), min(start)), '%Y-%m-%d %H:%M:%S') AS start FROM m GROUP BY 1"""))
def first_fitting_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = lambda s: sessions.fits_age(F.lit(2), F.lit(36), F.to_date("o_orderdate"), F.to_date(s["start"]))
    s = sessions.shown(F.lit(sessions.REGULAR), F.col("sessions"), B.now(), fit=fit)
    return B.offers(spark, sf_dir).select("o_orderkey", text(s["start"]).alias("start")).where("start is not null")


# --- lists


@query("""SELECT CASE WHEN datediff('day', CAST(o_orderdate AS DATE), DATE '1998-06-15') <= 6 THEN 'this_week' WHEN datediff('day', CAST(o_orderdate AS DATE), DATE '1998-06-15') <= 13 THEN 'last_week' ELSE 'older' END AS week,
    o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2""")
def listing_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = listing.listing_week(F.col("o_orderdate"), B.today())
    return B.table(spark, sf_dir, "orders").groupBy(week.alias("week"), "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice / 4000 END AS m, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice / 30 END AS d FROM orders)
    SELECT CASE WHEN m IS NOT NULL THEN 'minutes' WHEN d IS NOT NULL THEN 'metres' ELSE 'none' END AS unit,
    CAST(CASE WHEN m IS NOT NULL THEN CASE WHEN m > 60 THEN NULL ELSE greatest(1, ceil(m / 5)) * 5 END WHEN d <= 500 THEN 500 WHEN d <= 1000 THEN 1000 WHEN d <= 2000 THEN 2000 WHEN d <= 5000 THEN 5000 WHEN d <= 10000 THEN 10000 END AS INTEGER) AS bound,
    CAST(count(*) AS BIGINT) AS n FROM p GROUP BY 1, 2""")
def reach_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") / 4000)
    metres = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice") / 30)
    unit, bound = listing.reach_band(minutes, metres)
    return B.table(spark, sf_dir, "orders").groupBy(unit.alias("unit"), bound.alias("bound")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_orderpriority, CAST(o_custkey AS INTEGER) AS position FROM orders WHERE o_orderkey % 7 = 0")
def recently_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All saved rows, the latest first."""
    o = B.table(spark, sf_dir, "orders")
    saved = o.where("o_orderkey % 7 = 0").select("o_orderkey", F.col("o_custkey").cast("int").alias("position"))
    return listing.recently_saved(o, saved, "o_orderkey", "position").select("o_orderkey", "o_orderpriority", "position").orderBy(F.desc("position"), "o_orderkey")


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 250")
def take_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return listing.take_groups(o, ["o_orderpriority", F.desc("o_totalprice"), "o_orderkey"], 250)


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem)) WHERE r <= 3""")
def top_per_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice").distinct()
    return listing.top_in_group(rows, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3)


# --- agenda


@query(with_roles("""
    r AS (SELECT CAST(start AS DATE) AS day, kind <> 'single' AS ok, o_custkey % 3 <> 0 AS fit FROM j)
    SELECT strftime(d.day, '%Y-%m-%d') AS day, CAST(count(*) FILTER (WHERE ok AND fit) AS BIGINT) AS shown, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS hidden_by_filter, CAST(count(*) FILTER (WHERE ok AND NOT fit) AS BIGINT) AS hidden_by_age
    FROM (SELECT unnest(range(DATE '1998-06-15', DATE '1998-07-16', INTERVAL 1 DAY)) AS day) d LEFT JOIN r ON r.day = CAST(d.day AS DATE) GROUP BY 1"""))
def range_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    spine = agenda.days(spark, "1998-06-15", "1998-07-15")
    # Sessions begin on the day of shipping, so the scan takes the range alone; an order's line items of one start are one session.
    s = B.session_rows(spark, sf_dir, "1998-06-15", "1998-07-16").select("l_orderkey", "start").distinct()
    o = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", B.kind(F.col("o_orderpriority")).alias("kind"))
    rows = s.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    out = agenda.range_agenda(spine, rows, F.to_date("start"), F.col("kind") != "single", F.col("o_custkey") % 3 != 0)
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("""WITH d AS (SELECT CAST(unnest(range(DATE '1998-06-08', DATE '1998-06-29', INTERVAL 1 DAY)) AS DATE) AS day),
    n AS (SELECT d.day, isodow(d.day) AS weekday, count(l_orderkey) AS n FROM d LEFT JOIN lineitem ON CAST(l_shipdate AS DATE) = d.day AND l_suppkey = 3 GROUP BY 1, 2),
    s AS (SELECT *, CASE WHEN day < DATE '1998-06-15' THEN 'past' WHEN n > 0 THEN 'busy' ELSE 'free' END AS state FROM n),
    w AS (SELECT *, bool_and(state = 'free' OR weekday < 6) OVER (PARTITION BY date_trunc('week', day)) AS empty FROM s)
    SELECT strftime(day, '%Y-%m-%d') AS day, CAST(weekday AS INTEGER) AS weekday, CAST(n AS BIGINT) AS n, CASE WHEN empty AND weekday = 6 THEN 'free_weekend' ELSE state END AS state FROM w WHERE NOT (empty AND weekday = 7)""")
def week_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = B.table(spark, sf_dir, "lineitem").where("l_suppkey = 3").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    out = agenda.week_rows(agenda.days(spark, "1998-06-08", "1998-06-28"), counts, B.today())
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd")).withColumn("weekday", F.col("weekday").cast("int"))


# --- aggregates


@query("""WITH c AS (SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 4 <> 0), p AS (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY 1)
    SELECT coalesce(s_suppkey, l_suppkey) AS id, s_name AS name, CAST(coalesce(n, 0) AS BIGINT) AS n, CASE WHEN s_suppkey IS NULL THEN 'unlisted' WHEN n IS NULL THEN 'without_offers' ELSE 'active' END AS state FROM c FULL JOIN p ON s_suppkey = l_suppkey""")
def provider_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.table(spark, sf_dir, "supplier").where("s_suppkey % 4 != 0").select("s_suppkey", "s_name")
    offers = B.table(spark, sf_dir, "lineitem").where("l_suppkey % 3 != 0").select(F.col("l_suppkey").alias("provider"))
    return site.provider_states(c, offers, "s_suppkey", "s_name")


@query("""WITH s AS (SELECT s_suppkey, s_nationkey, 49.0 + (s_suppkey % 37) / 400.0 + (s_suppkey // 1961 % 100) / 10.0 AS lat, 11.0 + (s_suppkey % 53) / 300.0 + (s_suppkey // 196100 % 100) / 5.0 AS lon FROM supplier)
    SELECT round(CAST(lat AS DOUBLE), 3) AS lat, round(CAST(lon AS DOUBLE), 3) AS lon, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT s_nationkey) AS BIGINT) AS nations, min(s_suppkey) AS first FROM s GROUP BY 1, 2""")
def places_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.places(B.suppliers_at(spark, sf_dir), "s_nationkey", "s_suppkey").withColumnRenamed("owners", "nations")


@query("""WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, list_position(['3-MEDIUM', '1-URGENT', '5-LOW', '2-HIGH', '4-NOT SPECIFIED'], o_orderpriority)) AS r FROM c)
    SELECT o_custkey, o_orderpriority, CAST(n AS BIGINT) AS n FROM r WHERE r = 1""")
def main_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.canonical_mode(B.table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", ["3-MEDIUM", "1-URGENT", "5-LOW", "2-HIGH", "4-NOT SPECIFIED"])


@query("""SELECT event_type, CAST(user_id % 5 AS BIGINT) AS unit, CAST(count(*) AS BIGINT) AS calls, round(sum(coalesce(value, 0)), 6) AS value FROM events GROUP BY ROLLUP (event_type, 2)""".replace("ROLLUP (event_type, 2)", "GROUPING SETS ((event_type, user_id % 5), (event_type), ())"))
def cost_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.table(spark, sf_dir, "events").withColumn("unit", F.col("user_id") % 5)
    return measures.cost_summary(e, ["event_type", "unit"], ["value"])


@query("""WITH r AS (SELECT user_id, max(CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END) AS r FROM events WHERE ts < TIMESTAMP '2024-01-03' GROUP BY 1)
    SELECT CAST(user_id % 3 AS BIGINT) AS cohort, CAST(count(*) FILTER (WHERE r >= 1) AS BIGINT) AS signup, CAST(count(*) FILTER (WHERE r >= 2) AS BIGINT) AS "view", CAST(count(*) FILTER (WHERE r >= 3) AS BIGINT) AS click, CAST(count(*) FILTER (WHERE r >= 4) AS BIGINT) AS purchase FROM r GROUP BY 1""")
def funnel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = ["signup", "view", "click", "purchase"]
    rank = F.array_position(F.array(*map(F.lit, stages)), F.col("event_type"))
    e = B.table(spark, sf_dir, "events").where(F.col("ts") < F.lit("2024-01-03").cast("timestamp_ntz")).groupBy("user_id").agg(F.max(rank).alias("r"))
    return measures.funnel(e.withColumn("cohort", F.col("user_id") % 3), ["cohort"], F.col("r"), stages)


@query("""WITH u AS (SELECT user_id, event_id % 10 AS unit, CASE WHEN bool_and(event_type = 'error') THEN 'failed' WHEN max(value) < 20 THEN 'empty' ELSE 'ok' END AS state FROM events GROUP BY 1, 2)
    SELECT user_id, CAST(count(*) AS BIGINT) AS units, CASE WHEN count(*) FILTER (WHERE state = 'failed') = count(*) THEN 'failed' WHEN count(*) FILTER (WHERE state = 'failed') > 0 THEN 'partial' WHEN count(*) FILTER (WHERE state = 'empty') = count(*) THEN 'empty' ELSE 'ok' END AS status FROM u GROUP BY 1""")
def provider_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = F.when(F.every(F.col("event_type") == "error"), "failed").when(F.max("value") < 20, "empty").otherwise("ok")
    units = B.table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 10).alias("unit")).agg(per.alias("state"))
    return measures.worst_state(units, ["user_id"], F.col("state"))


@query("SELECT min(49.0 + (s_suppkey % 37) / 400.0 + (s_suppkey // 1961 % 100) / 10.0) AS south, min(11.0 + (s_suppkey % 53) / 300.0 + (s_suppkey // 196100 % 100) / 5.0) AS west, max(49.0 + (s_suppkey % 37) / 400.0 + (s_suppkey // 1961 % 100) / 10.0) AS north, max(11.0 + (s_suppkey % 53) / 300.0 + (s_suppkey // 196100 % 100) / 5.0) AS east, CAST(count(*) AS BIGINT) AS n FROM supplier")
def bbox_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.bounding_box(B.suppliers_at(spark, sf_dir))


# --- joins and differences


@query("""SELECT CAST(o_orderkey AS BIGINT) AS id, 'price' AS rule FROM orders WHERE NOT o_totalprice < 450000 UNION ALL SELECT o_orderkey, 'status' FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
    UNION ALL SELECT o_orderkey, 'customer' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 11 <> 0) UNION ALL SELECT o_orderkey, 'no_lines' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def integrity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")
    own = linkage.violations(o, "id", {"price": F.col("o_totalprice") < 450000, "status": F.col("o_orderstatus").isin("O", "F")})
    refs = {"customer": ("o_custkey", B.table(spark, sf_dir, "customer").where("c_custkey % 11 != 0"), "c_custkey")}
    lines = {"no_lines": ("id", B.table(spark, sf_dir, "lineitem"), "l_orderkey")}
    return own.unionByName(linkage.dangling(o, "id", refs)).unionByName(linkage.dangling(o.withColumn("__id", F.col("id")).select(F.col("__id"), "id"), "__id", lines).withColumnRenamed("__id", "id"))


@query("SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.repeated_keys(B.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""WITH b AS (SELECT o_orderkey, o_orderstatus AS v FROM orders WHERE o_orderkey % 5 <> 0), a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 7 <> 0)
    SELECT o_orderkey, CASE WHEN b.v IS NULL THEN 'appeared' WHEN a.v IS NULL THEN 'disappeared' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS change FROM b FULL JOIN a USING (o_orderkey)""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.table(spark, sf_dir, "orders")
    before = o.where("o_orderkey % 5 != 0").select("o_orderkey", textfn.content_hash(F.col("o_orderstatus")).alias("v"))
    after = o.where("o_orderkey % 7 != 0").select("o_orderkey", textfn.content_hash(F.when(F.col("o_orderkey") % 13 == 0, "X").otherwise(F.col("o_orderstatus"))).alias("v"))
    return linkage.snapshot_diff(before, after, "o_orderkey", "v")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01')")
def unseen_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = B.table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("c_custkey")).distinct()
    return linkage.unseen(B.table(spark, sf_dir, "customer"), seen, "c_custkey").select("c_custkey", "c_name")


@query("""SELECT o.o_orderkey, strftime(coalesce(b.o_orderdate, r.d, TIMESTAMP '1998-06-15'), '%Y-%m-%d') AS listed FROM orders o LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 3 = 0) b USING (o_orderkey)
    LEFT JOIN (SELECT o_orderkey, o_orderdate + INTERVAL 3 DAY AS d FROM orders WHERE o_orderkey % 4 = 0) r USING (o_orderkey)""")
def left_over_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("listed"))
    resting = o.where("o_orderkey % 4 = 0").withColumn("listed", F.col("listed") + F.expr("INTERVAL 3 DAY"))
    out = linkage.carry_forward(o.select("o_orderkey"), o.where("o_orderkey % 3 = 0"), resting, "o_orderkey", "listed", F.lit("1998-06-15").cast("timestamp_ntz"))
    return out.select("o_orderkey", F.date_format("listed", "yyyy-MM-dd").alias("listed"))


@query("""SELECT e.event_id, n.ts AS next_ts FROM (SELECT * FROM events WHERE event_type = 'view') e ASOF LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'purchase') n ON e.user_id = n.user_id AND e.ts <= n.ts""".replace("n.ts AS next_ts", "strftime(n.ts, '%Y-%m-%d %H:%M:%S') AS next_ts"))
def asof_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    buys = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"))
    out = joins.asof_next(e.where("event_type = 'view'").drop("event_type"), buys, ["user_id"], "ts", "bought")
    return out.select("event_id", text(F.col("bought")).alias("next_ts"))


@query("""WITH r AS (SELECT event_id AS r, user_id, epoch(ts) AS lo, epoch(ts) + 3600 AS hi FROM events WHERE event_type = 'signup'), p AS (SELECT event_id AS p, user_id, epoch(ts) AS t FROM events WHERE event_type = 'error')
    SELECT p, r FROM p JOIN r USING (user_id) WHERE t BETWEEN lo AND hi""")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    r = e.where("event_type = 'signup'").select(F.col("event_id").alias("r"), "user_id", F.col("t").alias("lo"), (F.col("t") + 3600).alias("hi"))
    p = e.where("event_type = 'error'").select(F.col("event_id").alias("p"), "user_id", "t")
    return joins.range_join(p, r, "t", "lo", "hi", 3600, ["user_id"]).select("p", "r")


# --- recurrence

_RULES = """r AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate AS DATE) + CAST(20 + o_custkey % 60 AS INTEGER) AS until, CAST(1 + o_orderkey % 7 AS INTEGER) AS w1, CAST(1 + o_custkey % 7 AS INTEGER) AS w2, 1 + o_orderkey % 3 AS step, CASE WHEN o_orderkey % 2 = 0 THEN 4 END AS cnt FROM orders)"""


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    return B.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), d.alias("start"), F.date_add(d, (20 + F.col("o_custkey") % 60).cast("int")).alias("until"),
        F.array((1 + F.col("o_orderkey") % 7).cast("int"), (1 + F.col("o_custkey") % 7).cast("int")).alias("days"), (1 + F.col("o_orderkey") % 3).cast("int").alias("step"), F.when(F.col("o_orderkey") % 2 == 0, 4).alias("cnt"), "o_custkey",
    )


def _free(spark: SparkSession) -> DataFrame:
    return recurrence.holiday_days(spark.createDataFrame([("1996-12-20", "1997-01-05", "winter"), ("1997-01-05", "1997-01-06", "kings"), ("1998-07-30", "1998-09-10", "summer")], "s string, e string, name string").select(F.to_date("s").alias("start"), F.to_date("e").alias("end"), "name"))


@query("""WITH r AS (SELECT CAST(o_orderdate AS DATE) AS start, CAST(o_custkey % 9 AS INTEGER) AS n, o_orderpriority || ' ' || o_custkey % 7 AS name FROM orders), d AS (SELECT start, name, CAST(unnest(range(CAST(start AS TIMESTAMP), CAST(start + n + 1 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM r)
    SELECT strftime(day, '%Y-%m-%d') AS day, name FROM d QUALIFY row_number() OVER (PARTITION BY day ORDER BY start, name) = 1""")
def holiday_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as closures of up to nine days; where they overlap the one that began first names the day."""
    start = F.to_date("o_orderdate")
    o = B.table(spark, sf_dir, "orders").select(start.alias("start"), F.date_add(start, (F.col("o_custkey") % 9).cast("int")).alias("end"), F.concat_ws(" ", "o_orderpriority", (F.col("o_custkey") % 7).cast("string")).alias("name"))
    return recurrence.holiday_days(o).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "name")


@query(f"""WITH {_RULES}, d AS (SELECT r.*, CAST(unnest(range(CAST(start AS TIMESTAMP), CAST(until AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM r),
    k AS (SELECT * FROM d WHERE isodow(day) IN (w1, w2) AND (datediff('day', CAST(date_trunc('week', start) AS DATE), day) // 7) % step = 0
          AND NOT (day BETWEEN DATE '1996-12-20' AND DATE '1997-01-06' OR day BETWEEN DATE '1998-07-30' AND DATE '1998-09-10') AND NOT (id % 10 = 0 AND day = start + 7)),
    n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY day) AS rn FROM k)
    SELECT id, strftime(day, '%Y-%m-%d') AS day FROM n WHERE cnt IS NULL OR rn <= cnt""")
def expand_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _rules(spark, sf_dir)
    off = rules.where("id % 10 = 0").select("id", F.date_add("start", 7).alias("day"))
    out = recurrence.weekly(rules, "id", "start", "until", "days", "step", "cnt", off, _free(spark))
    return out.select("id", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query(f"""WITH {_RULES}, p AS (SELECT id, start, until + 90 AS until, w1, CASE WHEN id % 5 = 4 THEN -1 ELSE 1 + id % 5 END AS nth FROM r),
    d AS (SELECT p.*, CAST(unnest(range(date_trunc('month', CAST(start AS TIMESTAMP)), date_trunc('month', CAST(until AS TIMESTAMP)) + INTERVAL 1 MONTH, INTERVAL 1 DAY)) AS DATE) AS day FROM p),
    n AS (SELECT *, row_number() OVER (PARTITION BY id, date_trunc('month', day) ORDER BY day) AS f, row_number() OVER (PARTITION BY id, date_trunc('month', day) ORDER BY day DESC) AS l FROM d WHERE isodow(day) = w1)
    SELECT id, strftime(day, '%Y-%m-%d') AS day FROM n WHERE (nth = f OR nth = -1 AND l = 1) AND day BETWEEN start AND until""")
def expand_monthly_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _rules(spark, sf_dir).select("id", "start", F.date_add("until", 90).alias("until"), F.col("days")[0].alias("weekday"), F.when(F.col("id") % 5 == 4, -1).otherwise(1 + F.col("id") % 5).cast("int").alias("nth"))
    return recurrence.monthly(rules, "id", "start", "until", "weekday", "nth").select("id", F.date_format("day", "yyyy-MM-dd").alias("day"))


# --- text and URLs


@query(r"""SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '[\s\x{00a0}]+', ' ', 'g'))) AS digest FROM documents""")
def normalized_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "documents").select("doc_id", F.sha2(textfn.squeezed(F.coalesce("text", F.lit(""))), 256).alias("digest"))


@query(r"""WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '://Some.One:pw@WWW.') WHEN 2 THEN regexp_replace(upper(regexp_extract(url, '^[^/]*//[^/]*')) || ':8080' || regexp_replace(url, '^[^/]*//[^/]*', ''), '(\?|$)', '/?UTM_Source=x&b&') ELSE regexp_replace(url, '(#.*)?$', '?SID=9&z=&a=1=2#frag?y=1') END AS url FROM pages),
    s AS (SELECT page_id, string_split(split_part(url, '#', 1), '?') AS a FROM u), n AS (SELECT page_id, split_part(a[1], '://', 2) AS rest, array_to_string(a[2:], '?') AS q FROM s),
    h AS (SELECT *, lower(split_part(string_split(split_part(rest, '/', 1), '@')[-1], ':', 1)) AS host, rest[length(split_part(rest, '/', 1)) + 1:] AS path FROM n),
    k AS (SELECT page_id, CASE WHEN starts_with(host, 'www.') THEN host[5:] ELSE host END AS host, rtrim(path, '/') AS path, list_sort(list_transform(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_')
          AND NOT list_contains(['fbclid', 'gclid', 'sid', 'phpsessid', 'jsessionid', 'sessionid'], lower(split_part(x, '=', 1)))), lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END)) AS ps FROM h)
    SELECT page_id, host, host || path || CASE WHEN len(ps) = 0 THEN '' ELSE '?' || array_to_string(ps, '&') END AS canonical FROM k""")
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as they stand, and with a user, ``www.``, a port, upper case, bare and volatile parameters and a fragment."""
    k, u = F.col("page_id") % 4, F.col("url")
    upper = F.concat(F.upper(F.regexp_extract(u, "^[^/]*//[^/]*", 0)), F.lit(":8080"), F.regexp_replace(u, "^[^/]*//[^/]*", ""))
    marked = F.when(F.contains(upper, F.lit("?")), F.concat(F.substring_index(upper, "?", 1), F.lit("/?UTM_Source=x&b&"), F.substr(upper, F.instr(upper, "?") + 1))).otherwise(F.concat(upper, F.lit("/?UTM_Source=x&b&")))
    last = F.concat(F.regexp_replace(u, "#.*$", ""), F.lit("?SID=9&z=&a=1=2#frag?y=1"))
    url = F.when(k == 0, u).when(k == 1, F.replace(u, F.lit("://"), F.lit("://Some.One:pw@WWW."))).when(k == 2, marked).otherwise(last)
    return B.table(spark, sf_dir, "pages").select("page_id", urlfn.host(url).alias("host"), urlfn.canonical(url).alias("canonical"))


@query(r"""WITH p AS (SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '') AS host, page_id % 10 AS provider FROM pages)
    SELECT host, CAST(count(DISTINCT provider) AS BIGINT) AS providers FROM p GROUP BY 1 HAVING count(DISTINCT provider) >= 2""")
def umbrella_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.umbrella_hosts(B.table(spark, sf_dir, "pages").select("url", (F.col("page_id") % 10).alias("provider")))


@query(r"""WITH k AS (SELECT p_partkey, p_size, unnest(list_distinct(regexp_extract_all(lower(p_name), '[a-z]{4,}'))) AS w FROM part)
    SELECT a.p_partkey AS a, b.p_partkey AS b, CAST(count(*) AS BIGINT) AS shared FROM k a JOIN k b USING (p_size, w) WHERE a.p_partkey < b.p_partkey GROUP BY 1, 2""")
def keyword_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = B.table(spark, sf_dir, "part").select("p_partkey", "p_size", textfn.keywords(F.col("p_name")).alias("words"))
    return blocks.overlaps(k, "p_size", "p_partkey", "words")


@query(r"""SELECT page_id, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS paragraphs, CAST(len(regexp_extract_all(html, 'href="')) AS BIGINT) AS links, regexp_matches(html, '(?i)\b\d{1,2}\.\d{1,2}\.\d{4}\b') AS dated, contains(html, '<script') AS scripted FROM pages""")
def page_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return B.table(spark, sf_dir, "pages").select("page_id", F.regexp_count(h, F.lit("<p>")).cast("long").alias("paragraphs"), F.regexp_count(h, F.lit('href="')).cast("long").alias("links"), h.rlike(r"\b\d{1,2}\.\d{1,2}\.\d{4}\b").alias("dated"), h.contains("<script").alias("scripted"))


@query("SELECT c_custkey, trim(regexp_replace(lower(c_name || ' ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "customer").select("c_custkey", textfn.slug(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("slug"))


# --- places

_AT = "(SELECT s_suppkey, s_nationkey, CAST(49.0 + (s_suppkey % 37) / 400.0 + (s_suppkey // 1961 % 100) / 10.0 AS DOUBLE) AS lat, CAST(11.0 + (s_suppkey % 53) / 300.0 + (s_suppkey // 196100 % 100) / 5.0 AS DOUBLE) AS lon FROM supplier)"
_HAV = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


@query(f"SELECT a.s_suppkey AS a, b.s_suppkey AS b, round({_HAV}, 3) AS metres FROM {_AT} a, {_AT} b WHERE a.s_suppkey < b.s_suppkey AND {_HAV} <= 400")
def grid_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.suppliers_at(spark, sf_dir)
    return joins.grid_pairs(s, s, 400, "s_suppkey").where("a < b").withColumn("metres", F.round("metres", 3))


@query(f"SELECT a.s_suppkey AS a, b.s_suppkey AS b, round({_HAV}, 3) AS metres FROM {_AT} a, {_AT} b WHERE a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def haversine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = blocks.pairs_within(B.suppliers_at(spark, sf_dir), "s_nationkey", "s_suppkey", ["lat", "lon"])
    return p.select(F.col("l.s_suppkey").alias("a"), F.col("r.s_suppkey").alias("b"), F.round(numbers.haversine_m(F.col("l.lat"), F.col("l.lon"), F.col("r.lat"), F.col("r.lon")), 3).alias("metres"))


@query(f"SELECT place, arg_min(s_suppkey, (d, s_suppkey)) AS nearest, round(min(d), 3) AS metres FROM (SELECT b.place, a.s_suppkey, {_HAV} AS d FROM {_AT} a, (VALUES ('north', 49.08, 11.1), ('south', 49.01, 11.05)) b(place, lat, lon)) GROUP BY 1")
def nearest_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = spark.createDataFrame([("north", 49.08, 11.1), ("south", 49.01, 11.05)], "place string, lat double, lon double")
    return joins.nearest(places, B.suppliers_at(spark, sf_dir), "s_suppkey").withColumn("metres", F.round("metres", 3))


# --- linkage

_MEMBERS = "SELECT DISTINCT l_partkey % 50 AS g, l_orderkey AS id, l_suppkey AS m FROM lineitem WHERE l_partkey % 2 = {r}"


@query(f"""WITH a AS ({_MEMBERS.format(r=0)}), b AS (SELECT g + 1 - 1 AS g, id, m FROM (SELECT DISTINCT (l_partkey + 1) % 50 AS g, l_orderkey AS id, l_suppkey AS m FROM lineitem WHERE l_partkey % 2 = 1)),
    n AS (SELECT g, id, count(*) AS n FROM a GROUP BY 1, 2), k AS (SELECT g, id, count(*) AS n FROM b GROUP BY 1, 2)
    SELECT CAST(g AS BIGINT) AS g, a.id AS a, b.id AS b, CAST(count(*) AS BIGINT) AS shared, round(count(*) / (max(n.n) + max(k.n) - count(*)), 6) AS jaccard FROM a JOIN b USING (g, m) JOIN n ON n.g = a.g AND n.id = a.id JOIN k ON k.g = b.g AND k.id = b.id GROUP BY g, a.id, b.id HAVING count(*) * 2 >= max(n.n) + max(k.n) - count(*)""".replace("USING (g, m)", "ON a.g = b.g AND a.m = b.m").replace("CAST(g AS", "CAST(a.g AS").replace("GROUP BY g, a.id", "GROUP BY a.g, a.id"))
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = B.table(spark, sf_dir, "lineitem")
    a = l.where("l_partkey % 2 = 0").select((F.col("l_partkey") % 50).alias("g"), F.col("l_orderkey").alias("a"), F.col("l_suppkey").alias("m"))
    b = l.where("l_partkey % 2 = 1").select(((F.col("l_partkey") + 1) % 50).alias("g"), F.col("l_orderkey").alias("b"), F.col("l_suppkey").alias("m"))
    out = linkage.shared_members(a, b, ["g"], "a", "b", "m").where("jaccard >= 0.5")
    return out.select("g", "a", "b", "shared", F.round("jaccard", 6).alias("jaccard"))


@query("""WITH a AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS old_id FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2 HAVING count(*) = 1), b AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS new_id FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1, 2 HAVING count(*) = 1)
    SELECT o_custkey, o_orderpriority, old_id, new_id FROM a JOIN b USING (o_custkey, o_orderpriority)""")
def stable_id_stage0(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey")
    return joins.unique_pairs(o.where("o_orderkey % 2 = 0").withColumnRenamed("o_orderkey", "old_id"), o.where("o_orderkey % 2 = 1").withColumnRenamed("o_orderkey", "new_id"), ["o_custkey", "o_orderpriority"], "old_id", "new_id")


@query()
def stable_id_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged linkage of two snapshots of orders by customer, then ids for what stays new."""
    l = B.table(spark, sf_dir, "lineitem").join(B.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = l.select("o_custkey", "o_orderkey", "o_orderpriority", F.to_date("l_shipdate").alias("member"))
    old = rows.where("o_orderkey % 2 = 0").withColumnRenamed("o_orderkey", "old_id")
    new = rows.where("o_orderkey % 2 = 1").withColumnRenamed("o_orderkey", "new_id")
    keyed = lambda d, k: d.select("o_custkey", "o_orderpriority", k).distinct()
    links = linkage.link_stages(keyed(old, "old_id"), keyed(new, "new_id"), ["o_custkey"], "o_orderpriority", old.select("o_custkey", "old_id", "member"), new.select("o_custkey", "new_id", "member"), 0.3)
    fresh = new.select("new_id").distinct().join(links, "new_id", "left_anti").select(F.col("new_id").cast("string").alias("key"))
    ids = linkage.assigned_ids(fresh, "key", spark.createDataFrame([], "id string"))
    return links.select(F.col("new_id").cast("string").alias("key"), F.col("old_id").cast("string").alias("id"), "stage").unionByName(ids.select("key", "id", F.lit(9).alias("stage")))


@query("""WITH gone AS (SELECT o_orderkey, DATE '1998-06-15' AS since, CAST(o_orderdate AS DATE) + 60 AS last_start FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0),
    old AS (SELECT o_orderkey, CAST(DATE '1998-06-15' - CAST(o_custkey % 90 AS INTEGER) AS DATE) AS since, CAST(o_orderdate AS DATE) + 90 AS last_start FROM orders WHERE o_orderkey % 5 = 0),
    kept AS (SELECT * FROM old WHERE o_orderkey % 3 <> 0 AND NOT o_orderkey % 2 = 0 AND datediff('day', since, DATE '1998-06-15') < 56)
    SELECT o_orderkey, strftime(since, '%Y-%m-%d') AS since, strftime(last_start, '%Y-%m-%d') AS last_start FROM (SELECT * FROM gone UNION ALL SELECT * FROM kept) WHERE last_start >= DATE '1998-06-15'""")
def resting_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))
    memory = o.where("o_orderkey % 5 = 0").select("o_orderkey", F.date_sub(B.today(), (F.col("o_custkey") % 90).cast("int")).alias("since"), F.date_add("d", 90).alias("last_start"))
    before = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.date_add("d", 60).alias("last_start"))
    out = linkage.update_resting(memory, before, o.where("o_orderkey % 3 = 0"), "o_orderkey", B.today())
    return out.select("o_orderkey", F.date_format("since", "yyyy-MM-dd").alias("since"), F.date_format("last_start", "yyyy-MM-dd").alias("last_start"))


# --- transit

_STOPS = """st AS (SELECT l_orderkey AS trip, l_linenumber AS seq, min(l_suppkey) % 40 AS stop, 25200 + (l_orderkey % 240) * 60 + l_linenumber * 300 AS arr FROM lineitem GROUP BY 1, 2),
    rd AS (SELECT a.trip, a.stop AS frm, b.stop AS dst, a.arr + 30 AS dep, b.arr AS arr FROM st a JOIN st b ON a.trip = b.trip AND a.seq < b.seq WHERE a.stop <> b.stop)"""


def _stop_times(spark: SparkSession, sf_dir: str, stop: Column | None = None) -> DataFrame:
    arr = 25200 + (F.col("l_orderkey") % 240) * 60 + F.col("l_linenumber") * 300
    lines = B.table(spark, sf_dir, "lineitem").repartition("l_orderkey")  # dealt once, for the trip's stops and what looks along the trip
    one = lines.groupBy("l_orderkey", "l_linenumber").agg((F.min("l_suppkey") % 40 if stop is None else stop).alias("stop"))
    return one.select(F.col("l_orderkey").alias("trip"), F.col("l_linenumber").alias("seq"), "stop", arr.alias("arr"), (arr + 30).alias("dep"))


@query(f"""WITH {_STOPS}, c AS (SELECT trip, seq, stop AS frm, lead(stop) OVER w AS dst, arr + 30 AS dep, lead(arr) OVER w AS arr FROM st WINDOW w AS (PARTITION BY trip ORDER BY seq)) SELECT trip, CAST(seq AS INTEGER) AS seq, frm, dst, CAST(dep AS BIGINT) AS dep, CAST(arr AS BIGINT) AS arr FROM c WHERE dst IS NOT NULL""")
def trip_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transit.connections(_stop_times(spark, sf_dir)).withColumn("seq", F.col("seq").cast("int"))


@query(f"""WITH {_STOPS}, b AS (SELECT frm, dst, dep, min(arr) AS arr FROM rd GROUP BY 1, 2, 3), p AS (SELECT *, min(arr) OVER (PARTITION BY frm, dst ORDER BY dep DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM b)
    SELECT frm, dst, CAST(dep AS BIGINT) AS dep, CAST(arr AS BIGINT) AS arr FROM p WHERE least IS NULL OR arr < least""")
def direct_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transit.direct_profile(transit.rides(_stop_times(spark, sf_dir)))


@query(f"""WITH {_STOPS.replace("min(l_suppkey) % 40", "min(l_partkey)")}, x AS (SELECT a.frm, b.dst, a.dep, min(b.arr) AS arr FROM rd a JOIN rd b ON a.dst = b.frm AND a.trip <> b.trip AND b.dep >= a.arr AND a.frm <> b.dst GROUP BY 1, 2, 3),
    u AS (SELECT frm, dst, dep, arr, arr AS rated FROM rd UNION ALL SELECT frm, dst, dep, arr, arr + 600 FROM x), b AS (SELECT frm, dst, dep, min(rated) AS rated, arg_min(arr, (rated, -arr)) AS arr FROM u GROUP BY 1, 2, 3),
    p AS (SELECT *, min(rated) OVER (PARTITION BY frm, dst ORDER BY dep DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM b)
    SELECT frm, dst, CAST(dep AS BIGINT) AS dep, CAST(arr AS BIGINT) AS arr, CAST(rated AS BIGINT) AS rated FROM p WHERE least IS NULL OR rated < least""")
def one_transfer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as stops: the network grows with the table. Rides with one transfer at most, however long the wait."""
    return transit.transfer_profile(transit.rides(_stop_times(spark, sf_dir, F.min("l_partkey"))))


@query(f"""WITH {_STOPS}, b AS (SELECT frm, dst, dep, min(arr) AS arr FROM rd GROUP BY 1, 2, 3), m AS (SELECT unnest(range(28800, 28800 + 7200, 60)) AS t),
    v AS (SELECT frm, dst, t, min(arr) - t AS w FROM b JOIN m ON dep >= t GROUP BY 1, 2, 3), n AS (SELECT frm, dst, list_sort(list(w / 60.0)) AS l FROM v GROUP BY 1, 2), k AS (SELECT frm, dst, CASE WHEN len(l) >= 61 THEN (l[60] + l[61]) / 2 END AS med FROM n)
    SELECT frm, dst, CAST(CASE WHEN med <= 120 THEN floor(med + 0.5) ELSE 255 END AS INTEGER) AS cell FROM k""".replace("ELSE 255", "ELSE 255"))
def cell_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = transit.direct_profile(transit.rides(_stop_times(spark, sf_dir)))
    return transit.cells(transit.minute_waits(profile, 28_800))


@query("""WITH p AS (SELECT l_suppkey AS g, l_partkey AS line, l_quantity * 2 AS minutes, l_discount * 100 AS walk, l_linenumber AS transfers FROM lineitem),
    s AS (SELECT *, floor(minutes / 5 + 0.5) * 5 AS m, floor(walk / 5 + 0.5) * 5 AS w, row_number() OVER (PARTITION BY g, line ORDER BY minutes, walk, transfers) AS k FROM p),
    n AS (SELECT *, min(minutes) OVER (PARTITION BY g) AS least FROM s WHERE k = 1), c AS (SELECT * FROM n WHERE minutes <= least + 15),
    q AS (SELECT a.* FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE a.g = b.g AND b.m <= a.m AND b.w <= a.w AND b.transfers <= a.transfers AND (b.m < a.m OR b.w < a.w OR b.transfers < a.transfers))),
    r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY minutes, line) AS rank FROM q)
    SELECT g, line, minutes, round(walk, 6) AS walk, CAST(transfers AS INTEGER) AS transfers, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2""")
def pareto_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_partkey").alias("line"), (F.col("l_quantity") * 2).alias("minutes"), (F.col("l_discount") * 100).alias("walk"), F.col("l_linenumber").alias("transfers"))
    return transit.ways(o, ["g"]).select("g", "line", "minutes", F.round("walk", 6).alias("walk"), "transfers", "rank")


# --- measures

_PRED = "length(coalesce(text, '')) > 1500"


@query(f"""SELECT lang, CAST(count(*) FILTER (WHERE {_PRED} AND quality = 1) AS BIGINT) AS hits, CAST(count(*) FILTER (WHERE {_PRED}) AS BIGINT) AS predicted, CAST(count(*) FILTER (WHERE quality = 1) AS BIGINT) AS expected,
    CASE WHEN count(*) FILTER (WHERE {_PRED}) > 0 THEN round(count(*) FILTER (WHERE {_PRED} AND quality = 1) / count(*) FILTER (WHERE {_PRED}), 6) END AS precision, CASE WHEN count(*) FILTER (WHERE quality = 1) > 0 THEN round(count(*) FILTER (WHERE {_PRED} AND quality = 1) / count(*) FILTER (WHERE quality = 1), 6) END AS recall FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def micro_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "documents").join(B.table(spark, sf_dir, "labels"), "doc_id")
    return measures.precision_recall(rows, F.length(F.coalesce("text", F.lit(""))) > 1500, F.col("quality") == 1, ["lang"])


_QUOTA = """t AS (SELECT o_orderpriority AS k, count(*) AS s FROM orders GROUP BY 1), x AS (SELECT k, s, least(101, sum(s) OVER ()) * s / sum(s) OVER () AS x, least(101, sum(s) OVER ()) AS n FROM t),
    r AS (SELECT *, row_number() OVER (ORDER BY x - floor(x) DESC, s DESC, k) AS r, n - sum(floor(x)) OVER () AS left_over FROM x), q AS (SELECT k, CAST(least(s, floor(x) + CASE WHEN r <= left_over THEN 1 ELSE 0 END) AS BIGINT) AS quota FROM r)"""


def _quotas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = B.table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "k")
    return o, measures.largest_remainder(o.groupBy("k").agg(F.count(F.lit(1)).alias("s")), "k", "s", 101)


@query(f"WITH {_QUOTA} SELECT k, quota FROM q")
def hamilton_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quotas(spark, sf_dir)[1]


@query(f"WITH {_QUOTA}, d AS (SELECT o_orderkey, o_orderpriority AS k, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('7:' || o_orderkey), o_orderkey) AS r FROM orders) SELECT o_orderkey, k FROM d JOIN q USING (k) WHERE r <= quota")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, quotas = _quotas(spark, sf_dir)
    return measures.stratified(o, "o_orderkey", "k", quotas, F.md5(F.concat(F.lit("7:"), F.col("o_orderkey").cast("string"))), 101).select("o_orderkey", "k")


# --- state


@query("""SELECT a.o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'missing' WHEN b.o_orderkey % 11 = 0 THEN 'failed' WHEN b.d = a.d THEN 'unchanged' WHEN b.d = a.held THEN 'held' WHEN b.d = a.pending THEN 'adopt' WHEN b.o_orderkey % 17 = 0 THEN 'empty' ELSE 'extract' END AS action
    FROM (SELECT o_orderkey, o_orderstatus AS d, CASE WHEN o_orderkey % 3 = 0 THEN 'X' END AS held, CASE WHEN o_orderkey % 2 = 0 THEN 'X' END AS pending FROM orders) a LEFT JOIN (SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS d FROM orders WHERE o_orderkey % 9 <> 0) b USING (o_orderkey)""")
def refresh_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, x, k = B.table(spark, sf_dir, "orders"), F.lit("X"), F.col("o_orderkey")
    units = o.select("o_orderkey", F.col("o_orderstatus").alias("digest"), F.when(k % 3 == 0, x).alias("held"), F.when(k % 2 == 0, x).alias("pending"))
    got = o.where("o_orderkey % 9 != 0").select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, x).otherwise(F.col("o_orderstatus")).alias("digest"), (k % 11 == 0).alias("failed"), (k % 17 == 0).alias("empty"))
    return state.plan_refresh(units, got, "o_orderkey")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, user_id, CAST(count(*) AS BIGINT) AS n, CAST(greatest(0, count(*) - 1) AS BIGINT) AS over FROM events GROUP BY 1, 2")
def rate_limit_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = B.table(spark, sf_dir, "events").groupBy(F.window(F.col("ts"), "1 hour"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return hours.select(text(F.col("window.start")).alias("hour"), "user_id", "n", F.greatest(F.lit(0), F.col("n") - 1).alias("over"))


@query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def once_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.min("event_id").alias("event_id"))


# --- sinks


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type FROM events WHERE event_type = 'purchase')
    SELECT user_id, sha256(concat('BEGIN:VCALENDAR', chr(13), chr(10), 'VERSION:2.0', chr(13), chr(10), string_agg(concat('BEGIN:VEVENT', chr(13), chr(10), 'UID:', event_id, chr(13), chr(10), 'DTSTAMP:', strftime(ts, '%Y%m%dT%H%M%SZ'), chr(13), chr(10), 'DTSTART:', strftime(ts, '%Y%m%dT%H%M%SZ'), chr(13), chr(10), 'DTEND:', strftime(ts + INTERVAL 1 HOUR, '%Y%m%dT%H%M%SZ'), chr(13), chr(10), 'SUMMARY:', event_type, chr(13), chr(10), 'END:VEVENT'), chr(13) || chr(10) ORDER BY ts, event_id), chr(13), chr(10), 'END:VCALENDAR', chr(13), chr(10))) AS digest FROM e GROUP BY 1""")
def ics_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.table(spark, sf_dir, "events").where("event_type = 'purchase'")
    event = sinks.ics_event(F.col("event_id").cast("string"), F.col("ts"), F.col("ts") + F.expr("INTERVAL 1 HOUR"), F.col("event_type"), F.col("ts"))
    return sinks.ics_calendars(e, "user_id", ["ts", "event_id"], event).select("user_id", F.sha2("ics", 256).alias("digest"))


@query("""SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || CAST(n_nationkey AS VARCHAR) || ',' || CAST(n_regionkey AS VARCHAR) || ']},"properties":{"n_name":"' || n_name || '"}}' AS feature FROM nation""")
def geojson_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.geojson_features(B.table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", ["n_name"])
