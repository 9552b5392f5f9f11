"""Queries of what a site shows and of finding and keeping providers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, pagefn, timefn, titlefn, urlfn
from ..operators import discovery, filters, sessions, site, transit
from . import bindings as B
from .queries import _AT, _HAV, query, text, with_roles

# --- projections and places


@query(with_roles("""
    s AS (SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_suppkey % 5 <> 0), x AS (SELECT l_orderkey, min(l_suppkey) AS s FROM lineitem GROUP BY 1)
    SELECT o.o_orderkey, 'p' || s_suppkey AS provider, s_name AS provider_name, n_name AS venue, n_name || ' 1' AS address, strftime(f.first, '%Y-%m-%d %H:%M:%S') AS first FROM o JOIN f USING (o_orderkey) JOIN x ON l_orderkey = o.o_orderkey JOIN s ON s_suppkey = x.s JOIN nation ON n_nationkey = s_nationkey""").replace("""s AS (SELECT l_orderkey, l_linenumber""", """s0 AS (SELECT l_orderkey, l_linenumber""").replace("FROM s GROUP BY 1, 2),", "FROM s0 GROUP BY 1, 2),"))
def site_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as offers of the first of their suppliers, at its nation; the nation's name stands before the address and in brackets."""
    first = B.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("provider"))
    o = B.offers(spark, sf_dir).join(first, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("id"), "provider", F.lit(1).alias("venue"), F.lit("t").alias("title"), "sessions")
    s = B.table(spark, sf_dir, "supplier")
    p = s.select(F.col("s_suppkey").alias("provider"), F.concat(F.lit("p"), "s_suppkey").alias("public_id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 5 == 0, "directory").otherwise("provider").alias("role"))
    v = s.join(B.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    address = F.concat(F.col("n_name"), F.lit(", "), F.col("n_name"), F.lit(" 1 ("), F.lower("n_name"), F.lit(")"))
    v = v.select(F.col("s_suppkey").alias("provider"), F.lit(1).alias("venue"), F.col("n_name").alias("venue_name"), address.alias("address"), F.lit(None).cast("string").alias("district"), F.lit(49.0).alias("lat"), F.lit(11.0).alias("lon"))
    out = site.site_offers(o, p, v)
    return out.select(F.col("id").alias("o_orderkey"), "provider", "provider_name", F.col("venue_name").alias("venue"), "address", text(F.col("sessions")[0]["start"]).alias("first"))


@query("""SELECT 'p' || n_nationkey AS provider, n_name AS name, CAST(count(s_suppkey) AS INTEGER) AS venues, arg_min(s_name, s_suppkey) AS first FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey <> 2 GROUP BY 1, 2""")
def provider_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = B.table(spark, sf_dir, "nation"), B.table(spark, sf_dir, "supplier")
    p = n.select(F.col("n_nationkey").alias("provider"), F.concat(F.lit("p"), "n_nationkey").alias("public_id"), F.col("n_name").alias("name"), F.lit("u").alias("url"), F.when(F.col("n_regionkey") == 2, "directory").otherwise("provider").alias("role"))
    v = s.select(F.col("s_nationkey").alias("provider"), F.col("s_suppkey").alias("ord"), F.col("s_name").alias("venue_name"), F.lit("Street 1").alias("address"), F.lit(None).cast("string").alias("district"), F.lit(49.0).alias("lat"), F.lit(11.0).alias("lon"))
    d = site.provider_directory(p, v)
    return d.select("provider", "name", F.coalesce(F.size("venues"), F.lit(0)).alias("venues"), F.col("venues")[0]["name"].alias("first")).withColumn("venues", F.greatest("venues", F.lit(0)))


@query(with_roles("""SELECT o_custkey AS provider, bool_or(o_orderstatus = 'P' OR o_totalprice > 300000) AS hidden FROM o JOIN f USING (o_orderkey), now WHERE any_end >= now AND NOT (kind = 'course' AND registered AND f.first <= now) GROUP BY 1"""))
def hidden_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = site.provider_offers(B.offers(spark, sf_dir), B.now()).select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    shown = own.where("o_orderstatus <> 'P' and o_totalprice <= 300000")
    return site.hidden_offers(own, shown, "o_custkey", "o_orderkey").withColumnRenamed("o_custkey", "provider")


@query("""WITH v AS (SELECT s_nationkey AS p, s_suppkey AS ord, 49.0 + (s_suppkey % 7) / 100.0 AS lat, CASE WHEN s_suppkey % 11 = 0 THEN 999.0 ELSE 11.0 END AS lon FROM supplier WHERE s_nationkey < 20), o AS (SELECT c_nationkey AS p, 0 AS ord, 48.0 + (c_custkey % 3) / 10.0 AS lat, 11.5 AS lon FROM customer WHERE c_nationkey NOT IN (SELECT p FROM v)),
    a AS (SELECT * FROM v WHERE lon < 181 UNION ALL SELECT * FROM o) SELECT CAST(p AS INTEGER) AS provider, CAST(count(DISTINCT round(CAST(lat AS DOUBLE), 3)) AS BIGINT) AS places, bool_or(lat BETWEEN 49.02 AND 49.05) AS inside FROM a GROUP BY 1""")
def provider_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    v = B.table(spark, sf_dir, "supplier").where("s_nationkey < 20").select(F.col("s_nationkey").alias("provider"), k.alias("ord"), (F.lit(49.0) + k % 7 / 100.0).alias("lat"), F.when(k % 11 == 0, 999.0).otherwise(11.0).alias("lon"))
    o = B.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("provider"), (F.lit(48.0) + F.col("c_custkey") % 3 / 10.0).alias("lat"), F.lit(11.5).alias("lon"))
    points = site.provider_points(v.withColumn("ord", F.col("ord").cast("int")), o)
    within = site.providers_in_bounds(points, 49.02, 10.0, 49.05, 12.0).withColumn("inside", F.lit(True))
    per = points.groupBy("provider").agg(F.count(F.lit(1)).alias("places"))
    return per.join(within, "provider", "left").select("provider", "places", F.coalesce("inside", F.lit(False)).alias("inside"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN s_name WHEN s_suppkey % 4 = 1 THEN 'Weg ' || s_nationkey || ', 90402 N' WHEN s_suppkey % 4 = 2 THEN 'Weg 12' ELSE s_name || ', 1 a' END AS address FROM supplier""")
def venue_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("s_suppkey") % 4, F.col("s_name")
    address = F.when(k == 0, n).when(k == 1, F.concat(F.upper(n), F.lit(", Weg "), "s_nationkey", F.lit(", 90402 N"))).when(k == 2, F.concat(F.lit("Weg 12 ("), F.lower(n), F.lit(")"))).otherwise(F.concat(n, F.lit(", 1 a")))
    return B.table(spark, sf_dir, "supplier").select("s_suppkey", site.venue_address(n, address).alias("address"))


@query(with_roles("""SELECT o_orderkey, NOT (kind = 'course' AND f.first <= now AND last_end >= now) AND NOT (kind = 'regular' AND NOT registered) AND CAST(f.first AS DATE) <= DATE '1998-06-29' AS soon FROM o JOIN f USING (o_orderkey), now"""))
def soon_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = F.col("sessions"), F.col("kind")
    running = sessions.course_running(k, s, B.now())
    return B.offers(spark, sf_dir).select("o_orderkey", site.soon(k, F.col("registered"), s[0]["start"], running, B.today()).alias("soon"))


_FIT = """(year(a) - year(b)) * 12 + month(a) - month(b) - CASE WHEN day(a) < least(day(b), day(last_day(a))) THEN 1 ELSE 0 END BETWEEN 1 AND 30"""


@query(with_roles(f"""
    p AS (SELECT j.o_orderkey, kind, k, o_orderstatus, "end" >= now AS up, CAST(start AS DATE) AS a, CAST(o_orderdate AS DATE) AS b, hour(start) < 12 AS early FROM j, now), m AS (SELECT *, {_FIT} AS fit FROM p),
    g AS (SELECT o_orderkey, kind, o_orderstatus, CASE WHEN kind = 'regular' THEN coalesce(bool_or(up AND fit), false) ELSE bool_or(k = 1 AND fit) END AS fits, bool_or(up AND fit AND early) AS listed FROM m GROUP BY o_orderkey, kind, o_orderstatus)
    SELECT o_orderkey, NOT fits AS unfit, NOT CASE WHEN kind = 'regular' THEN listed ELSE fits END AS list_unfit, o_orderstatus <> 'P' AND CASE WHEN kind = 'regular' THEN listed ELSE fits END AS visible FROM g"""))
def age_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.offers(spark, sf_dir).withColumns({"low": F.lit(1), "high": F.lit(30)})
    out = site.age_visibility(o, F.to_date("o_orderdate"), B.now(), "low", "high", F.col("o_orderstatus") != "P", True, sessions.Rule(daytimes=("morning",)))
    return out.select("o_orderkey", "unfit", "list_unfit", "visible")


@query("""SELECT DISTINCT CAST(o_orderdate AS DATE)::VARCHAR AS day, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS monday, strftime(date_trunc('week', o_orderdate) + INTERVAL 6 DAY, '%Y-%m-%d') AS sunday, CAST(isodow(date_trunc('month', o_orderdate)) - 1 AS INTEGER) AS lead, CAST(day(last_day(o_orderdate)) AS INTEGER) AS days FROM orders""")
def calendar_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    week, (lead, days) = site.week_days(day), site.month_days(day)
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    return B.table(spark, sf_dir, "orders").select(iso(day).alias("day"), iso(week[0]).alias("monday"), iso(week[6]).alias("sunday"), lead.cast("int").alias("lead"), F.size(days).alias("days")).distinct()


@query(f"""WITH p AS (SELECT CAST(c_custkey AS BIGINT) AS id, CAST(49.0 + (c_custkey % 41) / 380.0 AS DOUBLE) AS lat, CAST(11.0 + (c_custkey % 59) / 310.0 AS DOUBLE) AS lon FROM customer WHERE c_custkey % 10 = 0)
    SELECT a.s_suppkey AS stop, b.id AS place, CAST(ceil({_HAV} / (75 / 60.0 / 1.3)) AS BIGINT) AS walk FROM {_AT} a, p b WHERE {_HAV} <= 1500""")
def egress_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    places = B.table(spark, sf_dir, "customer").where(k % 10 == 0).select(k.alias("id"), (F.lit(49.0) + k % 41 / 380.0).alias("lat"), (F.lit(11.0) + k % 59 / 310.0).alias("lon"))
    return site.egress(B.suppliers_at(spark, sf_dir).withColumnRenamed("s_suppkey", "id"), places)


@query(f"""WITH p AS (SELECT CAST(c_custkey AS BIGINT) AS id, CAST(49.0 + (c_custkey % 83) / 380.0 AS DOUBLE) AS lat, CAST(11.0 + (c_custkey % 59) / 310.0 AS DOUBLE) AS lon FROM customer) SELECT id FROM p b WHERE NOT EXISTS (SELECT 1 FROM {_AT} a WHERE {_HAV} <= 800)""")
def without_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    origins = B.table(spark, sf_dir, "customer").select(k.alias("id"), (F.lit(49.0) + k % 83 / 380.0).alias("lat"), (F.lit(11.0) + k % 59 / 310.0).alias("lon"))
    return site.without_access(origins, B.suppliers_at(spark, sf_dir).withColumnRenamed("s_suppkey", "id")).select("id")


@query(f"SELECT a.s_suppkey AS frm, b.s_suppkey AS dst, CAST(CASE WHEN a.s_suppkey = b.s_suppkey THEN 0 ELSE ceil({_HAV} / (75 / 60.0 / 1.3)) END AS BIGINT) AS walk FROM {_AT} a, {_AT} b WHERE {_HAV} <= 400")
def footpaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transit.footpaths(B.suppliers_at(spark, sf_dir).withColumnRenamed("s_suppkey", "stop"))


@query("""SELECT s_suppkey, CAST(greatest(1, floor(s_acctbal / 1000 + 0.5)) AS INTEGER) AS stop, CAST(CASE WHEN abs(s_acctbal) / 60 > 120 THEN NULL WHEN abs(s_acctbal) / 60 < 7.5 THEN 5 WHEN floor(abs(s_acctbal) / 300 + 0.5) * 5 <= 60 THEN floor(abs(s_acctbal) / 300 + 0.5) * 5 ELSE floor(abs(s_acctbal) / 600 + 0.5) * 10 END AS BIGINT) AS minutes,
    CAST(CASE WHEN greatest(100, floor(abs(s_acctbal) * 2 / 100 + 0.5) * 100) < 10000 THEN greatest(100, floor(abs(s_acctbal) * 2 / 100 + 0.5) * 100) ELSE floor(abs(s_acctbal) * 2 / 1000 + 0.5) * 1000 END AS BIGINT) AS metres FROM supplier""")
def shown_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.abs("s_acctbal")
    return B.table(spark, sf_dir, "supplier").select("s_suppkey", site.stop_minutes(F.col("s_acctbal") / 1000).alias("stop"), numbers.rounded_minutes(b / 60).cast("long").alias("minutes"), numbers.rounded_metres(b * 2).cast("long").alias("metres"))


# --- time


@query("""WITH u AS (SELECT event_id, ts + INTERVAL (event_id % 300) DAY AS ts FROM events), z AS (SELECT event_id, ts, timezone('Europe/Berlin', timezone('UTC', ts)) AS l FROM u)
    SELECT event_id, strftime(l, '%Y-%m-%d') AS day, strftime(l, '%Y%m%dT%H%M') AS minute, strftime(l, '%Y-%m-%dT%H:%M:%S') || '+0' || CAST(date_diff('hour', date_trunc('second', ts), date_trunc('second', l)) AS VARCHAR) || ':00' AS iso FROM z""")
def civil_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants over a year, both changes of the clock among them."""
    ts = F.col("ts") + F.make_dt_interval((F.col("event_id") % 300).cast("int"))
    instant = F.to_timestamp_ltz(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    day = F.date_format(timefn.civil_date(instant), "yyyy-MM-dd")
    return B.table(spark, sf_dir, "events").select("event_id", day.alias("day"), timefn.minute_key(instant).alias("minute"), timefn.iso_with_offset(instant).alias("iso"))


@query("""WITH c AS (SELECT event_id, date_trunc('minute', ts) + INTERVAL (event_id % 300) DAY AS c FROM events), u AS (SELECT event_id, c, timezone('UTC', timezone('Europe/Berlin', c)) AS u FROM c)
    SELECT event_id, CASE WHEN timezone('Europe/Berlin', timezone('UTC', u)) = c THEN strftime(CASE WHEN timezone('Europe/Berlin', timezone('UTC', u - INTERVAL 1 HOUR)) = c THEN u - INTERVAL 1 HOUR ELSE u END, '%Y%m%dT%H%M%SZ') END AS utc FROM u""")
def civil_to_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Civil times to the UTC form of calendars: of two the earlier, of none a null."""
    c = F.date_trunc("minute", "ts").cast("timestamp_ntz") + F.make_dt_interval((F.col("event_id") % 300).cast("int"))
    return B.table(spark, sf_dir, "events").select("event_id", timefn.utc_basic(timefn.to_utc(c)).alias("utc"))


@query("""WITH d AS (SELECT o_orderkey, o_custkey % 5 AS k, CAST(o_orderdate AS DATE) AS d FROM orders), s AS (SELECT *, CASE k WHEN 0 THEN strftime(d, '%d.%m.%Y') WHEN 1 THEN strftime(d, '%-d/%-m/%Y') WHEN 2 THEN strftime(d, '%d%m%Y') WHEN 3 THEN '31.02.' || year(d) ELSE strftime(d, '%Y-%m-%d') END AS t FROM d)
    SELECT o_orderkey, CASE WHEN k < 3 AND d <= DATE '1998-01-01' THEN strftime(d, '%Y-%m-%d') END AS german, CASE WHEN k = 4 THEN t END AS strict, strftime(d, '%d.%m.%Y') AS shown FROM s""")
def written_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.to_date("o_orderdate"), F.col("o_custkey") % 5
    t = F.when(k == 0, F.date_format(d, "dd.MM.yyyy")).when(k == 1, F.date_format(d, "d/M/yyyy")).when(k == 2, F.date_format(d, "ddMMyyyy")).when(k == 3, F.concat(F.lit("31.02."), F.year(d))).otherwise(F.date_format(d, "yyyy-MM-dd"))
    iso = lambda x: F.date_format(x, "yyyy-MM-dd")
    return B.table(spark, sf_dir, "orders").select("o_orderkey", iso(timefn.german_date(t, F.lit("1998-01-01").cast("date"))).alias("german"), iso(timefn.strict_date(t)).alias("strict"), timefn.german_text(d).alias("shown"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST((l_orderkey % 30) * 3600 + (l_partkey % 60) * 60 + l_suppkey % 60 AS INTEGER) END AS seconds FROM lineitem""")
def clock_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.format_string("%02d:%02d:%02d", F.col("l_orderkey") % 30, F.col("l_partkey") % 60, F.col("l_suppkey") % 60)
    return B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", timefn.transit_seconds(F.when(F.col("l_linenumber") == 7, "25:61:00").otherwise(t)).alias("seconds"))


@query("""WITH w AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 <> 0 THEN o_orderdate END AS a, CASE WHEN o_custkey % 4 <> 0 THEN o_orderdate + INTERVAL 200 DAY END AS b FROM orders)
    SELECT o_orderkey, CASE WHEN a IS NULL AND b IS NULL THEN NULL WHEN b IS NOT NULL AND TIMESTAMP '1998-06-15 12:00:00' > b THEN 'over' WHEN a IS NOT NULL AND a > TIMESTAMP '1998-06-15 12:00:00' THEN 'soon' ELSE 'open' END AS phase FROM w""")
def registration_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, d = F.col("o_custkey"), F.col("o_orderdate")
    phase = filters.registration_phase(F.when(c % 3 != 0, d), F.when(c % 4 != 0, d + F.expr("INTERVAL 200 DAY")), B.now())
    return B.table(spark, sf_dir, "orders").select("o_orderkey", phase.alias("phase"))


# --- finding and keeping


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false ELSE true END AS never, page_id % 3 = 0 AS wall, page_id % 4 = 0 AS candidate FROM pages""")
def page_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that are never visited, challenges, and pages that are never adopted, by made-up endings of the pages' addresses."""
    k = F.col("page_id")
    base = F.regexp_extract("url", r"^([^/]*//[^/?#]*)", 1)
    ends = F.array(*map(F.lit, ("/de/impressum", "/workshop/baby", "/a/online_shop-presse.html", "/kurse?img=a.png", "/bild.JPG?x=1")))
    wall = F.when(k % 3 == 0, F.lit("Just a moment...\nEnable")).otherwise(F.concat(F.lit("Kurse "), F.repeat(F.lit("Just a moment... "), 400)))
    last = F.when(k % 4 == 0, "/x/anfahrt.html").when(k % 4 == 1, "/krabbelgottesdienst").when(k % 4 == 2, "/feed.ics").otherwise("/kontaktgruppe/")
    return B.table(spark, sf_dir, "pages").select("page_id", urlfn.never_visit(F.concat(base, F.element_at(ends, (k % 5 + 1).cast("int")))).alias("never"), pagefn.bot_wall(wall).alias("wall"), discovery.never_candidate(F.concat(base, last), F.lit(False), F.lit(False)).alias("candidate"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN 'known' WHEN s_suppkey % 7 = 1 THEN 'rejected' WHEN s_suppkey % 7 = 2 THEN 'similar name' WHEN s_suppkey % 7 = 3 AND s_suppkey % 2 = 0 THEN 'postponed' WHEN s_suppkey % 7 = 4 AND s_suppkey % 2 = 0 THEN 'suspended' END AS reason FROM supplier""")
def prefiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = B.table(spark, sf_dir, "supplier")
    url = lambda end: F.concat(F.lit("https://h"), k, F.lit(f".test/{end}"))
    finds = s.select(k.alias("id"), F.concat(F.lit("Haus "), "s_name").alias("name"), url("a/?utm_source=x").alias("url"))
    known = s.where(k % 7 == 0).select(k.alias("provider"), F.lit("Other").alias("name"), url("a").alias("url")).unionByName(s.where(k % 7 == 2).select(k.alias("provider"), F.concat(F.lit("Haus "), "s_name", F.lit(" – am Markt")).alias("name"), url("b").alias("url")))
    rejected = s.where(k % 7 == 1).select(F.when(k % 2 == 0, url("a")).alias("url"), F.when(k % 2 == 1, F.concat(F.lit("h"), k, F.lit(".test"))).alias("host"))
    until = F.when(k % 2 == 0, F.date_add(B.today(), 5)).otherwise(F.date_sub(B.today(), 5))
    later = lambda r: s.where(k % 7 == r).select(url("a").alias("url"), until.alias("until"))
    return discovery.prefilter(finds, known, rejected, later(3), later(4), B.today())


@query("""SELECT s_nationkey AS directory, CAST(count(*) AS BIGINT) AS n, min(s_suppkey) AS first FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 4 <> 0 GROUP BY 1""")
def directory_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as links of their nation's directory: a third sound like nothing, a quarter lead to its own site, each stands twice."""
    k = F.col("s_suppkey")
    s = B.table(spark, sf_dir, "supplier")
    host = F.when(k % 4 == 0, F.concat(F.lit("sub.dir"), "s_nationkey", F.lit(".test"))).otherwise(F.concat(F.lit("www.h"), k, F.lit(".test")))
    links = s.select(F.col("s_nationkey").alias("directory"), k.alias("ord"), F.when(k % 3 == 0, "Presse").otherwise(F.concat(F.lit("Familien  "), k)).alias("label"), F.concat(F.lit("https://"), host, F.lit("/"), k).alias("url"))
    again = links.where("ord % 3 <> 0").select("directory", (F.col("ord") + 1_000_000).alias("ord"), F.lit("Verein").alias("label"), F.concat("url", F.lit("/?gclid=1")).alias("url"))
    own = s.select(F.col("s_nationkey").alias("directory"), F.concat(F.lit("https://dir"), "s_nationkey", F.lit(".test/")).alias("url")).distinct()
    found = discovery.directory_finds(links.unionByName(again), own).withColumn("k", F.regexp_extract("url", r"/(\d+)", 1).cast("long"))
    return found.groupBy("directory").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first"))


@query("""SELECT c_custkey AS id, c_custkey % 50 AS provider, CAST(CASE c_custkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS INTEGER) AS score FROM customer WHERE c_custkey % 4 < 3 AND c_custkey < 200""")
def adoption_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty providers, and finds of their address, of their host with their name, of their name at their place, or of their name alone."""
    k, p = F.col("c_custkey"), F.col("c_custkey") % 50
    c = B.table(spark, sf_dir, "customer").where("c_custkey < 200")
    name = lambda x: F.concat(F.translate(F.md5(F.concat(F.lit("n"), x)), "0123456789", "ghijklmnop"), F.lit(" e.V."))
    url = F.when(k % 4 == 0, F.concat(F.lit("http://www.h"), p, F.lit(".test/a#x"))).when(k % 4 == 1, F.concat(F.lit("https://h"), p, F.lit(".test/b"))).otherwise(F.concat(F.lit("https://z"), k, F.lit(".test/")))
    lat = F.lit(49.0) + p / 100.0
    adopted = c.select(k.alias("id"), name(p).alias("name"), url.alias("url"), F.when(k % 4 == 2, lat).alias("lat"), F.lit(11.0).alias("lon"))
    providers = c.where("c_custkey < 50").select(k.alias("provider"), name(k).alias("name"), F.concat(F.lit("https://h"), k, F.lit(".test/a")).alias("url"))
    places = c.where("c_custkey < 50").select(k.alias("provider"), (F.lit(49.0) + k / 100.0).alias("lat"), F.lit(11.0).alias("lon"))
    return discovery.match_scores(adopted, providers, places)


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS provider, 'id' AS rule FROM supplier WHERE s_suppkey % 9 = 0 UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'public_id' FROM supplier WHERE s_suppkey % 8 = 0""")
def reserved_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = B.table(spark, sf_dir, "supplier")
    taken = s.select(F.when(k % 9 == 0, k.cast("string")).alias("id"), F.when(k % 8 == 0, F.concat(F.lit("x"), k)).alias("public_id"))
    return discovery.reserved_conflicts(s.select(k.cast("string").alias("provider"), F.concat(F.lit("x"), k).alias("public_id")), taken)


@query("""WITH n AS (SELECT DISTINCT o_orderpriority || ' ' || chr(CAST(65 + o_custkey % 4 AS INTEGER)) || CASE WHEN o_custkey % 3 = 0 THEN '!' WHEN o_custkey % 3 = 1 THEN '?' ELSE '' END AS name FROM orders), s AS (SELECT name, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS base FROM n),
    b AS (SELECT name, CASE WHEN regexp_full_match(base, '[0-9a-z]{8}') THEN base || '-anbieter' ELSE base END AS base FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY name) AS r FROM b)
    SELECT name, CASE WHEN starts_with(base, '5-low') THEN CASE r WHEN 1 THEN base || '-3' WHEN 2 THEN base || '-4' ELSE base || '-5' END ELSE base || CASE WHEN r = 1 THEN '' ELSE '-' || r END END AS id FROM r""")
def catalogue_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of one slug; of one priority the slug and its second are taken."""
    c = F.col("o_custkey")
    end = F.when(c % 3 == 0, "!").when(c % 3 == 1, "?").otherwise("")
    names = B.table(spark, sf_dir, "orders").select(F.concat("o_orderpriority", F.lit(" "), F.char((F.lit(65) + c % 4).cast("int")), end).alias("name"))
    taken = spark.range(4).select(F.explode(F.array(F.lit(""), F.lit("-2"))).alias("t"), F.char((F.lit(97) + F.col("id")).cast("int")).alias("l")).select(F.concat(F.lit("5-low-"), "l", "t").alias("id"))
    return discovery.catalogue_ids(names, taken)


@query("""SELECT o_custkey AS provider, CAST(count(*) AS INTEGER) AS n FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 AND datediff('day', CAST(o_orderdate AS DATE), DATE '1998-06-15') >= 2 GROUP BY 1""")
def durable_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    u = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("provider"), k.cast("string").alias("unit"), F.when(k % 3 == 0, "lasting").otherwise("temporary").alias("failure"), F.to_date("o_orderdate").alias("failure_since"), k.alias("k"))
    out = discovery.durable_units(u, u.where("k % 5 <> 0").select("provider", "unit"), B.today())
    return out.select("provider", F.size("units").alias("n"))


@query("""WITH p AS (SELECT o_orderkey AS k, o_custkey AS p, CAST(DATE '1998-06-15' - CAST(o_custkey % 100 AS INTEGER) AS DATE) AS d FROM orders WHERE o_orderkey % 2 = 0)
    SELECT 'u' || k AS url, p AS provider, strftime(d, '%Y-%m-%d') AS checked_on FROM p WHERE k % 5 <> 0 AND (p % 3 <> 0 OR k % 7 = 0 OR datediff('day', d, DATE '1998-06-15') < 56) UNION ALL SELECT 'u' || o_orderkey, o_custkey, '1998-06-15' FROM orders WHERE o_orderkey % 5 = 0""")
def cared_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = B.table(spark, sf_dir, "orders")
    row = lambda day: [F.concat(F.lit("u"), k).alias("url"), c.alias("provider"), day.alias("checked_on")]
    pages, checked = o.where(k % 2 == 0).select(*row(F.date_sub(B.today(), (c % 100).cast("int")))), o.where(k % 5 == 0).select(*row(B.today()))
    seen, cared = o.where(k % 7 == 0).select(c.alias("provider"), F.concat(F.lit("u"), k).alias("url")), o.where(c % 3 == 0).select(c.alias("provider")).distinct()
    return discovery.next_pages(pages, checked, seen, cared, B.today()).withColumn("checked_on", F.date_format("checked_on", "yyyy-MM-dd"))


@query("""WITH o AS (SELECT o_orderstatus AS g, o_orderkey % 6 AS r, o_orderkey % 5 = 0 AS a, o_custkey % 4 AS h, o_custkey % 7 AS n, o_orderkey % 11 <> 0 AS c FROM orders)
    SELECT g, count(*) AS n, CAST(count(*) FILTER (WHERE r >= 1) AS BIGINT) AS found, CAST(count(*) FILTER (WHERE r >= 2) AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE r >= 3) AS BIGINT) AS fetched, CAST(count(*) FILTER (WHERE r >= 4) AS BIGINT) AS accepted, CAST(count(*) FILTER (WHERE r >= 5) AS BIGINT) AS placed,
      CAST(count(*) FILTER (WHERE a) AS BIGINT) AS found_again, round(avg(CASE WHEN c AND n > 0 THEN h / n END), 6) AS yield, CAST(count(*) FILTER (WHERE c AND n > 0) AS BIGINT) AS yield_n FROM o GROUP BY 1""")
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    stage = F.try_element_at(F.array(*map(F.lit, discovery.STAGES)), F.when(k % 6 > 0, k % 6).otherwise(9).cast("int"))
    o = B.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("g"), stage.alias("stage"), (k % 5 == 0).alias("adopted"), (c % 4).alias("hits"), (c % 7).alias("reference"), (k % 11 != 0).alias("counts"))
    return discovery.stage_counts(o, ["g"])


@query("""SELECT 's' || x AS source, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(list_distinct([o_custkey % 3, o_custkey % 5])) AS x FROM orders) GROUP BY 1""")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    o = B.table(spark, sf_dir, "orders").select(F.array(F.concat(F.lit("s"), c % 3), F.concat(F.lit("s"), c % 5)).alias("sources"))
    return discovery.source_counts(o)


@query("""SELECT p.o_custkey AS "case", p.o_orderkey AS id FROM orders p WHERE p.o_orderkey % 2 = 0 AND EXISTS (SELECT 1 FROM orders e WHERE e.o_orderkey % 2 = 1 AND e.o_custkey = p.o_custkey AND e.o_orderpriority = p.o_orderpriority AND year(e.o_orderdate) = year(p.o_orderdate))""")
def misplaced_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.year("o_orderdate").alias("start"))
    return discovery.misplaced(o.where("id % 2 = 1"), o.where("id % 2 = 0"))


_SPOT = "l_suppkey % 10 AS p, l_shipdate AS s, 1 + 2 * (l_orderkey % 3) + l_partkey % 2 AS k, 49 + 0.0007 * (l_orderkey % 3) AS la, 11 + 0.0008 * (l_partkey % 2) AS lo, count(*) AS n FROM lineitem"


@query(f"""WITH RECURSIVE r AS (SELECT {_SPOT} WHERE l_returnflag = 'A' AND l_shipdate >= TIMESTAMP '1996-06-01' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY ALL), f AS (SELECT {_SPOT} WHERE l_returnflag = 'R' GROUP BY ALL),
    e AS (SELECT p, s, r.k AS i, f.k AS j, r.n AS a, f.n AS b, row_number() OVER (PARTITION BY p, s ORDER BY r.k, f.k) AS nth FROM r JOIN f USING (p, s)
          WHERE 2 * 6371008.8 * asin(sqrt(sin(radians(r.la - f.la) / 2) ** 2 + cos(radians(r.la)) * cos(radians(f.la)) * sin(radians(r.lo - f.lo) / 2) ** 2)) <= 100),
    g(p, s, nth, ua, ub, hits) AS (SELECT DISTINCT p, s, CAST(0 AS BIGINT), CAST([0, 0, 0, 0, 0, 0] AS BIGINT[]), CAST([0, 0, 0, 0, 0, 0] AS BIGINT[]), CAST(0 AS BIGINT) FROM e
      UNION ALL SELECT p, s, nth, list_transform(ua, lambda x, m: x + CASE WHEN m = i THEN t ELSE 0 END), list_transform(ub, lambda x, m: x + CASE WHEN m = j THEN t ELSE 0 END), hits + t
      FROM (SELECT g.p, g.s, e.nth, e.i, e.j, ua, ub, hits, least(e.a - ua[e.i], e.b - ub[e.j]) AS t FROM g JOIN e ON g.p = e.p AND g.s = e.s AND e.nth = g.nth + 1)),
    h AS (SELECT p, sum(hits) AS hits FROM (SELECT p, s, arg_max(hits, nth) AS hits FROM g GROUP BY 1, 2) GROUP BY 1)
    SELECT r.p AS provider, CAST(coalesce(any_value(h.hits), 0) AS BIGINT) AS hits, CAST(sum(n) AS BIGINT) AS reference FROM r LEFT JOIN h USING (p) GROUP BY 1""")
def matched_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as dates at six places of a supplier, 57 to 166 metres apart; SQL goes through the pairs one by one."""
    k, part = F.col("l_orderkey"), F.col("l_partkey")
    l = B.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("provider"), F.col("l_shipdate").alias("start"), (49 + 0.0007 * (k % 3)).alias("lat"), (11 + 0.0008 * (part % 2)).alias("lon"), "l_returnflag")
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    return discovery.matched_dates(l.where("l_returnflag = 'R'"), l.where("l_returnflag = 'A'"), t("1996-06-01"), t("1997-01-01"))


@query(with_roles("""SELECT o_custkey AS provider, CAST(count(*) AS BIGINT) AS n FROM j WHERE (o_custkey % 5 = 0 OR o_custkey % 40 <= 36) AND o_custkey % 4 <> 0 GROUP BY 1"""))
def offer_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    o = B.offers(spark, sf_dir).select(c.alias("provider"), F.lit(1).alias("venue"), F.when(c % 5 != 0, c % 40).alias("low"), "sessions")
    v = B.table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("provider"), F.lit(1).alias("venue"), F.lit(49.0).alias("lat"), F.lit(11.0).alias("lon"))
    return discovery.dates_at(o, v).groupBy("provider").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(user_id AS BIGINT) AS run, CAST(count(*) FILTER (WHERE event_type IN ('purchase', 'click')) AS BIGINT) AS changed FROM events GROUP BY 1""")
def changed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.when(F.col("event_type").isin("purchase", "click"), "extracted").otherwise("unchanged")
    return discovery.changed(B.table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), r.alias("result")))


@query("""SELECT 'https://x.test/' || o_orderkey AS url FROM orders WHERE (o_custkey % 3 = 0 OR o_orderdate <= TIMESTAMP '1998-06-15') AND o_orderkey % 4 <> 0""")
def open_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = B.table(spark, sf_dir, "orders")
    cases = o.select(F.concat(F.lit("https://x.test/"), k).alias("url"), F.when(F.col("o_custkey") % 3 != 0, F.to_date("o_orderdate")).alias("until"))
    ended = o.where(k % 4 == 0).select(F.concat(F.lit("http://www.x.test/"), k, F.lit("/#a")).alias("url"))
    return discovery.end_cases(discovery.open_cases(cases, B.today()), ended).select("url")


@query("""SELECT site, url, future, CAST(r AS INTEGER) AS rank FROM (SELECT s_nationkey AS site, s_name AS url, CAST(s_acctbal AS BIGINT) % 7 AS future, row_number() OVER (PARTITION BY s_nationkey ORDER BY CAST(s_acctbal AS BIGINT) % 7 DESC, s_name) AS r FROM (SELECT s_nationkey, s_name, trunc(s_acctbal) AS s_acctbal FROM supplier)) WHERE r <= 5""")
def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("site"), F.col("s_name").alias("url"), (F.col("s_acctbal").cast("long") % 7).alias("future"))
    return discovery.best_candidates(p)


@query("""SELECT p_partkey, p_size % 2 = 0 OR p_size % 3 = 0 AS matches, p_size % 4 = 1 AS relevant FROM part""")
def searched_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded search by parts, and what speaks of the youngest."""
    k = F.col("p_size")
    name = F.when(k % 2 == 0, "Familienzentrum Nürnberg Süd").when(k % 3 == 0, "NUERNBERG: Straße, Süd").otherwise("Fürth Süd")
    label = F.when(k % 4 == 1, "Krabbelgruppe ab 3 Monaten").otherwise("Chor")
    return B.table(spark, sf_dir, "part").select("p_partkey", titlefn.matches_query(name, F.lit("nurnberg  sud")).alias("matches"), titlefn.is_relevant(F.lit(None).cast("string"), label).alias("relevant"))
