"""Queries of column functions and small operators that the other queries don't reach, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, pagefn, textfn, timefn, urlfn
from ..operators import agenda, filters, linkage, listing, matching, measures, recurrence, sessions, state, timetable, transit
from . import bindings as B
from .queries import query, text, with_roles

# --- text


@query("""SELECT p_partkey, replace(replace(p_name, 'e', 'é'), 'i', 'ä') AS marked, translate(replace(replace(replace(replace(replace(lower(replace(replace(p_name, 'e', 'é'), 'i', 'ä')) || ' strasse', 'é', 'e'), 'ä', 'a'), 'ae', 'a'), 'oe', 'o'), 'ue', 'u'), '', '') AS folded, '&lt;' || p_name || '&gt; &amp; &quot;' AS escaped FROM part""")
def folded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.translate("p_name", "ei", "éä")
    return B.table(spark, sf_dir, "part").select("p_partkey", marked.alias("marked"), textfn.fold(F.concat(marked, F.lit(" Straße"))).alias("folded"), textfn.escape_html(F.concat(F.lit("<"), "p_name", F.lit('> & "'))).alias("escaped"))


@query("""SELECT c_custkey, 'Text & ' || c_name || ' "x" <b' AS plain, c_name || ' at <time> ?sid=<id>&x=1' AS masked FROM customer""")
def plain_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit("<style>p{}</style><p class='x'>Text&nbsp;&amp;\n "), "c_name", F.lit("</p><script>var a;</script> &quot;x&quot; &lt;b"))
    volatile = F.concat("c_name", F.lit("  at 2024-01-02T10:"), F.lpad((F.col("c_custkey") % 60).cast("string"), 2, "0"), F.lit("Z ?sid=abc"), "c_custkey", F.lit("&x=1"))
    return B.table(spark, sf_dir, "customer").select("c_custkey", textfn.plain_text(html).alias("plain"), textfn.masked(volatile).alias("masked"))


@query("""SELECT doc_id, sha256(array_to_string(list_sort(string_split(coalesce(text, ''), chr(10))), chr(10))) AS digest FROM documents""")
def order_free_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "documents").select("doc_id", textfn.order_free_hash(F.coalesce("text", F.lit(""))).alias("digest"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN NULL ELSE 'hauptstr ' || s_nationkey || 'a|90402' END AS key FROM supplier""")
def address_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    a = F.when(k == 0, F.concat(F.lit("Hauptstraße "), "s_nationkey", F.lit(" a, 90402 Nürnberg"))).when(k == 1, F.concat(F.lit("HAUPTSTR. "), "s_nationkey", F.lit("A, 90402 N"))).otherwise("Am Markt")
    return B.table(spark, sf_dir, "supplier").select("s_suppkey", textfn.address_key(a).alias("key"))


@query("""SELECT page_id, CAST(page_id % 3 AS INTEGER) AS frames, CASE page_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'ical' WHEN 2 THEN 'pdf' END AS kind, CASE WHEN page_id % 5 = 0 THEN 'permanent' ELSE 'temporary' END AS failure, page_id % 6 IN (0, 1, 2) AS under, CAST(page_id % 7 AS INTEGER) AS future FROM pages""")
def page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames, kinds, failures, dates ahead and anchors, on made-up parts of pages."""
    k, today = F.col("page_id"), F.lit("2024-06-15").cast("date")
    html = F.concat(F.lit("<p>"), F.repeat(F.lit('<IFRAME width=1 src="https://a.test/x"></iframe>'), (k % 3).cast("int")))
    kind = F.element_at(F.array(*map(F.lit, ("text/html; charset=utf-8", "TEXT/calendar", "application/pdf", "image/png"))), (k % 4 + 1).cast("int"))
    paths = F.element_at(F.array(*map(F.lit, ("/a?k=1", "/a/b?x=2&k=1", "/a/b/c?k=1&utm_source=z", "/ab?k=1", "/a/b", "/"))), (k % 6 + 1).cast("int"))
    dates = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i < k % 7, F.date_format(F.date_add(today, i * 30), "d.M.yyyy")).otherwise("1.1.2001 31.2.2025")), " und ")
    under = urlfn.under_anchor(F.concat(F.lit("https://www.s.test"), paths), F.lit("http://s.test/a/?k=1"))
    return B.table(spark, sf_dir, "pages").select("page_id", F.size(pagefn.frames(html)).alias("frames"), pagefn.kind_of(kind).alias("kind"), pagefn.failure_class(F.when(k % 5 == 0, 410).otherwise(503)).alias("failure"), under.alias("under"), pagefn.future_dates(dates, today).alias("future"))


# --- sessions and lists


@query(with_roles("""
    d AS (SELECT o_orderkey, min(start) AS s FROM j WHERE CAST(start AS DATE) = DATE '1998-06-20' GROUP BY 1), u AS (SELECT o_orderkey, min(start) FILTER (WHERE "end" >= now) AS nxt FROM j, now GROUP BY 1),
    t AS (SELECT o_orderkey, count(DISTINCT strftime(start, '%H:%M') || strftime("end", '%H:%M')) <= 1 AS uniform, max(n) AS n FROM j GROUP BY 1)
    SELECT o_orderkey, strftime(coalesce(d.s, u.nxt), '%Y-%m-%d %H:%M:%S') AS start, uniform, CAST(least(n, 3) AS INTEGER) AS head FROM t JOIN u USING (o_orderkey) LEFT JOIN d USING (o_orderkey)"""))
def reference_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("sessions")
    ref = sessions.reference(F.lit(sessions.REGULAR), s, B.now(), F.lit("1998-06-20").cast("date"))
    return B.offers(spark, sf_dir).select("o_orderkey", text(ref["start"]).alias("start"), sessions.uniform_times(s).alias("uniform"), F.size(sessions.collapsed(s, s[0])).alias("head"))


@query("""SELECT o_orderkey, datediff('day', CAST(o_orderdate AS DATE), DATE '1998-06-15') < 14 AS new, CASE WHEN o_custkey % 4 = 0 THEN 0 WHEN o_custkey % 4 < 3 THEN 1 ELSE 2 END AS band, o_totalprice / 4000 <= 45 OR o_custkey % 4 <> 0 AS near,
    strftime(greatest(date_trunc('week', o_orderdate), TIMESTAMP '1996-01-01'), '%Y-%m-%d') AS first, strftime(greatest(last_day(o_orderdate), DATE '1996-01-01'), '%Y-%m-%d') AS last FROM orders""")
def list_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, day = F.col("o_custkey") % 4, F.to_date("o_orderdate")
    unit = F.when(c == 0, "minutes").when(c < 3, "metres").otherwise("none")
    near = filters.Selection(limit=45).matches({}, F.when(c == 0, F.col("o_totalprice") / 4000))
    floor = F.lit("1996-01-01").cast("date")
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    week, month = agenda.selection_range("week", day, floor), agenda.selection_range("month", day, floor)
    return B.table(spark, sf_dir, "orders").select("o_orderkey", listing.newly_listed(F.col("o_orderdate"), B.today()).alias("new"), listing.band_rank(unit).alias("band"), near.alias("near"), iso(week[0]).alias("first"), iso(month[1]).alias("last"))


@query("""SELECT o_orderkey, CAST(len(list_filter([1, 2, 3], lambda k: o_custkey % 5 = 0 OR date_trunc('month', o_orderdate) + to_months(k) <= o_orderdate + INTERVAL 50 DAY)) AS INTEGER) AS months, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m-%d') AS first FROM orders""")
def quick_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    months = filters.quick_months(day, F.when(F.col("o_custkey") % 5 != 0, F.date_add(day, 50)))
    return B.table(spark, sf_dir, "orders").select("o_orderkey", F.size(months).alias("months"), F.date_format(F.coalesce(F.try_element_at(months, F.lit(1)), timefn.add_months(F.trunc(day, "month"), 1)), "yyyy-MM-dd").alias("first"))


# --- places and rounding


@query("""SELECT s_suppkey, s_suppkey % 4 <> 3 AS valid, round(s_acctbal * 1.3 / 75, 6) AS walk, s_acctbal BETWEEN 0 AND 5000 AS inside, CASE WHEN s_acctbal < 0 THEN 'in' WHEN s_suppkey % 2 = 0 THEN 'out' ELSE 'unknown' END AS territory FROM supplier""")
def place_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, b = F.col("s_suppkey"), F.col("s_acctbal")
    lat = F.when(k % 4 == 3, F.when(k % 8 == 3, 91.0).otherwise(float("nan"))).otherwise(49.0)
    return B.table(spark, sf_dir, "supplier").select("s_suppkey", numbers.is_geo_point(lat, F.lit(11.0)).alias("valid"), F.round(numbers.walk_minutes(b), 6).alias("walk"), numbers.in_box(b, F.lit(1.0), 0, 0, 5000, 2).alias("inside"), matching.territory(b < 0, k % 2 == 0).alias("territory"))


# --- timetables


@query("""SELECT l_orderkey AS trip, l_linenumber AS seq, CAST(sum(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity ROWS UNBOUNDED PRECEDING) AS BIGINT) AS at FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, 0 AS l_partkey, 0 AS l_quantity FROM lineitem GROUP BY 1, 2)""")
def running_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trip"), F.col("l_linenumber").alias("seq")).agg(F.min("l_suppkey").alias("step"))
    return transit.absolute_times(steps, "trip", "seq", "step").select("trip", "seq", "at")


@query("""SELECT s_nationkey AS row, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS i, CAST(s_suppkey % 256 AS INTEGER) AS value FROM supplier""")
def byte_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells to planes of bytes and back."""
    cells = B.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("row"), "s_suppkey", (F.col("s_suppkey") % 256).alias("v"))
    return timetable.decoded_planes(timetable.encoded_planes(cells, "row", "s_suppkey", "v"), "row")


@query("""WITH l AS (SELECT l_orderkey, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS v FROM lineitem GROUP BY 1) SELECT l_orderkey, CAST(v[1] AS BIGINT) AS first, CAST(v[-1] - coalesce(v[-2], 0) AS BIGINT) AS step, CAST(list_sum(v[1:1]) + coalesce(v[-1] - v[1], 0) AS BIGINT) AS back, 'de:1:' || l_orderkey AS area FROM l""")
def delta_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = B.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"]).alias("v"))
    d, back = timetable.deltas(F.col("v")), timetable.undeltas(timetable.deltas(F.col("v")))
    return l.select("l_orderkey", d[0].alias("first"), F.element_at(d, -1).alias("step"), F.element_at(back, -1).alias("back"), timetable.area_id(F.concat(F.lit("de:1:"), "l_orderkey", F.lit(":9:2"))).alias("area"))


@query("""WITH c AS (SELECT s_suppkey AS id, CAST(unnest(range(DATE '1998-06-01', DATE '1998-06-22', INTERVAL 1 DAY)) AS DATE) AS d FROM supplier), r AS (SELECT id, d FROM c WHERE isodow(d) IN (id % 7 + 1, 6) AND NOT (id % 3 = 0 AND d = DATE '1998-06-06') UNION SELECT s_suppkey, DATE '1998-07-01' FROM supplier WHERE s_suppkey % 4 = 0)
    SELECT id, CAST(count(*) AS BIGINT) AS days, strftime(max(d), '%Y-%m-%d') AS last FROM r GROUP BY 1""")
def service_calendars(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = B.table(spark, sf_dir, "supplier")
    day = lambda t: F.lit(t).cast("date")
    calendar = s.select(k.alias("service_id"), F.array((k % 7 + 1).cast("int"), F.lit(6)).alias("weekdays"), day("1998-06-01").alias("start"), day("1998-06-21").alias("end"))
    off = s.where(k % 3 == 0).select(k.alias("service_id"), day("1998-06-06").alias("day"), F.lit(2).alias("exception_type"))
    added = s.where(k % 4 == 0).select(k.alias("service_id"), day("1998-07-01").alias("day"), F.lit(1).alias("exception_type"))
    days = recurrence.service_days(calendar, off.unionByName(added))
    return days.groupBy(F.col("service_id").alias("id")).agg(F.count(F.lit(1)).alias("days"), F.date_format(F.max("day"), "yyyy-MM-dd").alias("last"))


# --- linkage, measures and state


@query("""SELECT a.o_custkey, a.o_orderkey AS id, CAST(n AS BIGINT) AS copies FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS n FROM orders) a WHERE r = 1""")
def source_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = linkage.same_source_duplicates(B.table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], [F.col("o_totalprice"), F.col("o_orderkey")])
    return o.select("o_custkey", F.col("o_orderkey").alias("id"), "copies")


@query("""WITH p AS (SELECT DISTINCT l_orderkey % 3000 AS a, l_partkey AS b FROM lineitem WHERE l_linenumber = 1 AND l_quantity >= 48) SELECT a, b FROM p WHERE a IN (SELECT a FROM p GROUP BY 1 HAVING count(*) = 1) AND b IN (SELECT b FROM p GROUP BY 1 HAVING count(*) = 1)""")
def unique_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.table(spark, sf_dir, "lineitem").where("l_linenumber = 1 and l_quantity >= 48").select((F.col("l_orderkey") % 3000).alias("a"), F.col("l_partkey").alias("b")).distinct()
    return linkage.unique_both_ways(p, "a", "b")


@query("""WITH d AS (SELECT o_orderkey AS id, o_custkey % 300 AS k, o_orderstatus AS t, o_orderpriority AS p, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders), x AS (SELECT n.id AS new_id, o.id AS old_id FROM d n JOIN d o ON n.k = o.k AND n.p = o.p AND n.m = o.m WHERE n.id % 2 = 1 AND o.id % 2 = 0)
    SELECT new_id, old_id FROM x WHERE new_id IN (SELECT new_id FROM x GROUP BY 1 HAVING count(*) = 1) AND old_id IN (SELECT old_id FROM x GROUP BY 1 HAVING count(*) = 1)""")
def title_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 300).alias("k"), F.col("o_orderpriority").alias("title"), F.array(F.trunc("o_orderdate", "month")).alias("days"))
    similar = textfn.similar_title(F.col("old_title"), F.col("new_title"))
    return linkage.link_by_title(o.where("id % 2 = 0").withColumnRenamed("id", "old_id"), o.where("id % 2 = 1").withColumnRenamed("id", "new_id"), ["k"], similar)


@query("""WITH r AS (SELECT l_partkey AS key, l_suppkey AS unit, l_returnflag = 'A' AS failed, l_discount AS fit, l_orderkey AS ord, l_linenumber AS ln FROM lineitem), n AS (SELECT *, count(*) OVER (PARTITION BY unit) AS n FROM r),
    k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY failed, fit DESC, n DESC, ord, unit) AS k FROM n) SELECT key, unit FROM k WHERE k = 1""")
def one_unit_per_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = B.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("unit"), "l_returnflag", "l_discount", "l_orderkey")
    return linkage.one_unit_per_row(l, ["key"], "unit", F.col("l_returnflag") == "A", F.col("l_discount"), F.col("l_orderkey")).select("key", "unit")


@query("""SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > count(*) * 0.2 THEN 'red' WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'yellow' ELSE 'green' END AS light, count(*) FILTER (WHERE event_type = 'view') * 2 >= count(*) FILTER (WHERE event_type = 'click') AS plausible FROM events GROUP BY 1""")
def run_lights(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    return B.table(spark, sf_dir, "events").groupBy("user_id").agg(measures.verdict(n("error"), F.count(F.lit(1))).alias("light"), measures.plausible(n("view"), n("click")).alias("plausible"))


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 3 AS n, CASE WHEN c_custkey % 10 = 0 THEN DATE '1998-06-20' END AS u FROM customer WHERE c_custkey % 2 = 0), f AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 9 = 0 GROUP BY 1)
    SELECT k AS case_id, CAST(coalesce(c.n, 0) + coalesce(f.n, 0) AS BIGINT) AS n, strftime(coalesce(u, CASE WHEN coalesce(c.n, 0) + coalesce(f.n, 0) >= 3 THEN DATE '1998-06-15' + 35 END), '%Y-%m-%d') AS until FROM c FULL JOIN f USING (k)""")
def counted_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    cases = B.table(spark, sf_dir, "customer").where(k % 2 == 0).select(k.alias("case_id"), (k % 3).alias("n"), F.when(k % 10 == 0, F.lit("1998-06-20").cast("date")).alias("suspended_until"))
    finds = B.table(spark, sf_dir, "orders").where("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("case_id"))
    return state.counted(cases, finds, "case_id", B.today()).select("case_id", "n", F.date_format("suspended_until", "yyyy-MM-dd").alias("until"))


@query("""WITH o AS (SELECT o_orderkey AS k, CAST(DATE '1998-06-15' - CAST(o_custkey % 90 AS INTEGER) AS DATE) AS d FROM orders WHERE o_orderkey % 2 = 0) SELECT k, strftime(d, '%Y-%m-%d') AS seen FROM o WHERE k % 3 <> 0 AND datediff('day', d, DATE '1998-06-15') < 56 UNION ALL SELECT o_orderkey, '1998-06-15' FROM orders WHERE o_orderkey % 3 = 0""")
def postponed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.table(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.date_sub(B.today(), (F.col("o_custkey") % 90).cast("int")).alias("seen"))
    new = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"), B.today().alias("seen"))
    return state.upsert(old, new, "k", "seen", B.today()).withColumn("seen", F.date_format("seen", "yyyy-MM-dd"))


@query("""SELECT o_orderkey, strftime(CASE WHEN o_custkey % 3 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN CASE WHEN o_custkey % 5 = 0 THEN DATE '1998-06-15' ELSE CAST(o_orderdate AS DATE) END ELSE DATE '1998-06-15' END, '%Y-%m-%d') AS since, o_custkey % 7 = 0 AND datediff('day', CAST(o_orderdate AS DATE), DATE '1998-06-15') >= 14 AS gone, o_custkey % 4 = 0 OR o_orderdate < TIMESTAMP '1998-06-15' AS same FROM orders""")
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, d = F.col("o_custkey"), F.to_date("o_orderdate")
    since = state.failure_streak(F.when(c % 5 != 0, d), c % 3 != 0, c % 2 == 0, B.today())
    now = F.create_map(d, F.when(c % 4 == 0, "a").otherwise("b"))
    return B.table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(since, "yyyy-MM-dd").alias("since"), state.tombstone(d, c % 7 == 0, B.today()).alias("gone"), state.same_dated_key(F.create_map(d, F.lit("a")), now, B.today()).alias("same"))
