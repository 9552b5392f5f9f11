"""Queries of matching, timetable and further session operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import textfn, urlfn
from ..operators import calendar_rules, joins, matching, measures, sessions, splitting, timetable
from . import bindings as B
from .queries import query, text, with_roles


@query(with_roles("SELECT o_orderkey, strftime(CAST(last AS DATE), '%Y-%m-%d') AS day FROM f"))
def last_session_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.offers(spark, sf_dir).select("o_orderkey", F.date_format(sessions.last_day(F.col("sessions")), "yyyy-MM-dd").alias("day"))


@query(with_roles("""SELECT kind, CAST(sum(CAST(CAST(start AS DATE) = DATE '1998-06-15' AND "end" < now AS INTEGER)) AS BIGINT) AS ended FROM j, now GROUP BY 1"""))
def ended_on_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.offers(spark, sf_dir).groupBy("kind").agg(F.sum(sessions.ended_on(F.col("sessions"), B.today(), B.now())).alias("ended"))


_TWO = """b AS (SELECT * FROM s WHERE l_linenumber <= 3), a AS (SELECT * FROM s WHERE l_linenumber >= 3),
    fa AS (SELECT l_orderkey, min(start) AS lo, max(start) AS hi FROM a GROUP BY 1), fb AS (SELECT l_orderkey, min(start) AS lo, max(start) AS hi FROM b GROUP BY 1)"""


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of an order's series: the first lines and the last ones, which share the third."""
    s = B.session_rows(spark, sf_dir)
    before = sessions.collect_sessions(s.where("l_linenumber <= 3"), ["l_orderkey"], "start", "end").withColumnRenamed("sessions", "before")
    return before.join(sessions.collect_sessions(s.where("l_linenumber >= 3"), ["l_orderkey"], "start", "end").withColumnRenamed("sessions", "after"), "l_orderkey")


@query(with_roles(f"""{_TWO}, n AS (SELECT l_orderkey, start FROM b UNION SELECT l_orderkey, start FROM a) SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n FROM n JOIN fa USING (l_orderkey) JOIN fb USING (l_orderkey) GROUP BY 1"""))
def union_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two(spark, sf_dir).select("l_orderkey", F.size(sessions.union_sessions(F.col("before"), F.col("after"))).cast("long").alias("n"))


@query(with_roles(f"""{_TWO}, w AS (SELECT l_orderkey, greatest(fa.lo, fb.lo, TIMESTAMP '1996-01-01') AS lo, least(fa.hi, fb.hi) AS hi FROM fa JOIN fb USING (l_orderkey))
    SELECT l_orderkey, strftime(lo, '%Y-%m-%d %H:%M:%S') AS lo, strftime(hi, '%Y-%m-%d %H:%M:%S') AS hi FROM w WHERE lo <= hi"""))
def shared_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = sessions.shared_window(F.col("before"), F.col("after"), F.lit("1996-01-01").cast("timestamp_ntz"))
    return _two(spark, sf_dir).select("l_orderkey", text(lo).alias("lo"), text(hi).alias("hi")).where("lo is not null")


@query(with_roles(f"""{_TWO}, n AS (SELECT a.l_orderkey, min(a.start) AS s FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.l_orderkey = a.l_orderkey AND b.start = a.start) GROUP BY 1)
    SELECT n.l_orderkey FROM n JOIN fb USING (l_orderkey) WHERE datediff('day', CAST(fb.hi AS DATE), CAST(n.s AS DATE)) >= 14 AND CAST(n.s AS DATE) <= DATE '2000-01-01'"""))
def new_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two(spark, sf_dir).where(sessions.is_new_run(F.col("before"), F.col("after"), F.lit("2000-01-01").cast("date"))).select("l_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_totalprice > 400000 THEN 'dear' WHEN o_custkey % 10 = 0 THEN 'rejected' END AS reason FROM orders""")
def first_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = [("closed", F.col("o_orderstatus") == "F"), ("dear", F.col("o_totalprice") > 400000), ("rejected", F.col("o_custkey") % 10 == 0)]
    return B.table(spark, sf_dir, "orders").select("o_orderkey", matching.first_reason(reasons).alias("reason"))


@query("""WITH p AS (SELECT c_custkey AS k, s_suppkey AS t, 1 - abs(c_acctbal - s_acctbal) / 2000 AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey),
    x AS (SELECT k, t, 1.0 AS s, 0 AS r, 'nation' AS stage FROM p WHERE s >= 0.95 UNION ALL SELECT k, t, s, 1, 'balance' FROM p WHERE s > 0),
    m AS (SELECT *, min(r) OVER (PARTITION BY k) AS f FROM x), o AS (SELECT *, lead(s) OVER (PARTITION BY k ORDER BY s DESC, t) AS nxt, row_number() OVER (PARTITION BY k ORDER BY s DESC, t) AS n FROM m WHERE r = f)
    SELECT k, t, stage FROM o WHERE n = 1 AND s >= 0.5 AND (nxt IS NULL OR s - nxt >= 0.1)""")
def staged_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages ask for the best score and the next one only, and the score falls with the distance, so the two suppliers on either side of a balance are enough."""
    c = B.table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "nation").select("nation", "c_custkey", "c_acctbal")
    s = B.table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "nation").select("nation", "s_suppkey", "s_acctbal")
    p = joins.neighbours(c, s, ["nation"], "c_acctbal", "s_acctbal").select(F.col("c_custkey").alias("k"), F.col("s_suppkey").alias("t"), (1 - F.abs(F.col("c_acctbal") - F.col("s_acctbal")) / 2000).alias("score"))
    return matching.staged_match([("nation", p.where("score >= 0.95").withColumn("score", F.lit(1.0))), ("balance", p.where("score > 0"))], "k", "t")


@query("""WITH old AS (SELECT l_suppkey, l_shipdate, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2), new AS (SELECT l_suppkey, l_shipdate, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
    SELECT l_suppkey, CAST(sum(greatest(0, old.n - coalesce(new.n, 0))) AS BIGINT) AS n FROM old LEFT JOIN new USING (l_suppkey, l_shipdate) GROUP BY 1 HAVING sum(greatest(0, old.n - coalesce(new.n, 0))) > 0""")
def left_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = B.table(spark, sf_dir, "lineitem")
    left = matching.left_uncovered(l.where("l_returnflag = 'A'"), l.where("l_returnflag = 'R'"), ["l_suppkey", "l_shipdate"], "l_orderkey")
    return left.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(coalesce(b.p_partkey, a.p_partkey) AS BIGINT) AS p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'appended' WHEN a.p_partkey IS NULL THEN 'removed' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS change
    FROM (SELECT p_partkey, p_name AS v FROM part WHERE p_size < 40) b FULL JOIN (SELECT p_partkey, CASE WHEN p_size = 10 THEN 'new' ELSE p_name END AS v FROM part WHERE p_size > 5) a ON a.p_partkey = b.p_partkey""")
def append_only_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.table(spark, sf_dir, "part")
    after = p.where("p_size > 5").select("p_partkey", F.when(F.col("p_size") == 10, "new").otherwise(F.col("p_name")).alias("v"))
    return matching.append_only(p.where("p_size < 40").select("p_partkey", F.col("p_name").alias("v")), after, "p_partkey", "v")


@query("""SELECT page_id, coalesce(arg_max(allow, (length(prefix), allow)), true) AS allowed FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\\.', '') AS host, regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM pages)
    LEFT JOIN (VALUES ('', false), ('/en', false), ('/en/6', true), ('/fr', true), ('/fr/8', false)) r(prefix, allow) ON starts_with(path, prefix) GROUP BY 1""")
def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = B.table(spark, sf_dir, "pages").select("page_id", urlfn.host(F.col("url")).alias("host"), urlfn.path(F.col("url")).alias("path"))
    rules = spark.createDataFrame([("", False), ("/en", False), ("/en/6", True), ("/fr", True), ("/fr/8", False)], "prefix string, allow boolean")
    return matching.robots_allows(urls, urls.select("host").distinct().join(F.broadcast(rules)), "page_id", "host", "path")


@query("""SELECT s_suppkey, CAST(row_number() OVER (ORDER BY CASE WHEN s_acctbal < 0 THEN 0 ELSE 1 END, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_nationkey END NULLS FIRST, s_suppkey) AS INTEGER) AS place FROM supplier""")
def care_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.care_order(B.table(spark, sf_dir, "supplier"), "s_suppkey", F.col("s_acctbal") < 0, F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey")))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS dst, l_suppkey + 1000 AS frm FROM lineitem WHERE l_quantity >= 49 UNION SELECT DISTINCT l_suppkey + 1000, l_partkey FROM lineitem WHERE l_quantity <= 2),
    r(node, depth) USING KEY (node) AS (SELECT CAST(1003 AS BIGINT), 0 UNION SELECT dst, min(depth + 1) FROM r JOIN e ON node = frm WHERE dst NOT IN (SELECT node FROM recurring.r) GROUP BY 1)
    SELECT node, CAST(depth AS INTEGER) AS depth FROM r""")
def reverse_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = B.table(spark, sf_dir, "lineitem")
    edges = l.where("l_quantity >= 49").select((F.col("l_suppkey") + 1000).alias("frm"), F.col("l_partkey").alias("dst")).union(l.where("l_quantity <= 2").select(F.col("l_partkey"), F.col("l_suppkey") + 1000)).distinct()
    return matching.reachable(edges, spark.createDataFrame([(1003,)], "node long"))


@query(r"""WITH l AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {'done': CAST([] AS VARCHAR[]), 'part': x}) AS l FROM documents),
    f AS (SELECT doc_id, list_reduce(l, lambda a, b: CASE WHEN length(a.part) + 1 + length(b.part) <= 2000 THEN {'done': a.done, 'part': a.part || chr(10) || b.part} ELSE {'done': list_append(a.done, a.part), 'part': b.part} END) AS r FROM l),
    p AS (SELECT doc_id, list_append(r.done, r.part) AS p FROM f), u AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS t FROM p)
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS part, CAST(length(t) AS INTEGER) AS n_chars, sha256(t) AS digest FROM u""")
def text_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = matching.text_parts(F.col("text"), 2000)
    return B.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parts).alias("part", "t")).select("doc_id", "part", F.length("t").alias("n_chars"), F.sha2("t", 256).alias("digest"))


@query("""WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_linenumber = 1), r AS (SELECT day FROM d WHERE isodow(day) = 2 AND day NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 400 = 0))
    SELECT strftime(coalesce(min(day) FILTER (WHERE day >= DATE '1998-06-22'), max(day)), '%Y-%m-%d') AS day FROM r""")
def service_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = B.table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.to_date("l_shipdate").alias("day"))
    free = B.table(spark, sf_dir, "orders").where("o_orderkey % 400 = 0").select(F.to_date("o_orderdate").alias("day"))
    return timetable.pick_service_day(days, free, B.today()).select(F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("""WITH p AS (SELECT l_suppkey AS g, l_partkey % 7 AS line, count(*) AS n, median(l_quantity) AS m FROM lineitem GROUP BY 1, 2), v AS (SELECT l_suppkey AS g, median(l_quantity) AS v FROM lineitem GROUP BY 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, m, line) AS k FROM p) SELECT g, CAST(line AS BIGINT) AS line FROM r JOIN v USING (g) WHERE k = 1 AND abs(m - v) <= greatest(3.0, v * 0.25)""")
def cell_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = B.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), (F.col("l_partkey") % 7).alias("line"), "l_quantity")
    value = l.groupBy("g").agg(F.median("l_quantity").alias("v"))
    return timetable.leading_line(l.join(value, "g"), ["g"], "line", "l_quantity", F.col("v"))


@query("""SELECT a.o_orderkey AS a, b.o_orderkey AS b, strftime(a.o_orderdate, '%Y-%m-%d') AS start FROM (SELECT o_orderkey, o_custkey, o_orderdate, c_nationkey, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey) a
    JOIN (SELECT o_orderkey, o_custkey, o_orderdate, c_nationkey, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey) b ON a.o_orderdate = b.o_orderdate AND a.o_orderpriority = b.o_orderpriority AND a.o_custkey < b.o_custkey AND a.c_nationkey = b.c_nationkey""")
def same_start_nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as places: only rows of one nation are near each other. Priorities as titles."""
    o = B.table(spark, sf_dir, "orders").join(B.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("provider"), F.col("o_orderdate").alias("start"), (F.lit(49.0) + F.col("c_nationkey") / 10).alias("lat"), F.lit(11.0).alias("lon"), F.col("o_orderpriority").alias("title"))
    return matching.same_start_nearby(rows, 50, textfn.similar_title(F.col("a.title"), F.col("b.title"))).select("a", "b", F.date_format("start", "yyyy-MM-dd").alias("start"))


@query("""SELECT user_id, CAST(count(*) AS BIGINT) AS made FROM (SELECT user_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id) AS running FROM events) WHERE running <= 500 GROUP BY 1""")
def running_brake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.running_limit(B.table(spark, sf_dir, "events"), ["event_id"], F.col("value"), 500, "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("made"))


@query("""SELECT doc_id, CASE WHEN t = n THEN 'same' WHEN coalesce(length(n), 0) = 0 THEN 'empty' WHEN length(n) < length(t) * 0.8 THEN 'shorter' WHEN length(n) > length(t) * 1.2 THEN 'longer' ELSE 'similar' END AS change
    FROM (SELECT doc_id, text AS t, CASE WHEN lang = 'en' THEN text WHEN lang = 'de' THEN '' WHEN lang = 'fr' THEN split_part(text, chr(10), 1) ELSE text || text END AS n FROM documents)""")
def text_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    new = F.when(F.col("lang") == "en", t).when(F.col("lang") == "de", "").when(F.col("lang") == "fr", F.substring_index(t, "\n", 1)).otherwise(F.concat(t, t))
    return B.table(spark, sf_dir, "documents").select("doc_id", matching.text_change(t, new).alias("change"))


def _greedy(pieces: str, most: str) -> str:
    """SQL: neighbours of a list of texts put together while they stay within ``most`` characters."""
    step = f"lambda kept, item: CASE WHEN length(kept.part) + 1 + length(item.part) <= {most} THEN {{'done': kept.done, 'part': kept.part || chr(10) || item.part}} ELSE {{'done': list_append(kept.done, kept.part), 'part': item.part}} END"
    return f"list_reduce(list_transform({pieces}, lambda x: {{'done': CAST([] AS VARCHAR[]), 'part': x}}), {step})"


def _all(packed: str) -> str:
    return f"list_append({packed}.done, {packed}.part)"


@query(f"""WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
    l AS (SELECT o_custkey, list(CASE WHEN i = 1 THEN '## TEXT' || chr(10) ELSE '' END || concat_ws(chr(10), 'Order ' || o_orderkey, 'Status ' || o_orderstatus, 'Day:', strftime(o_orderdate, '%Y-%m-%d'), 'Print') ORDER BY i) AS a,
        list_append(list(CASE WHEN i = 1 THEN '[' || chr(10) ELSE '' END || concat_ws(chr(10), '{{', '"order": ' || o_orderkey || ',', '"note": "}} ["', CASE WHEN i < n THEN '}},' ELSE '}}' END) ORDER BY i), ']') AS b FROM o GROUP BY 1),
    f AS (SELECT o_custkey, {_greedy("a", "300")} AS ra, {_greedy("b", "292")} AS rb FROM l),
    g AS (SELECT o_custkey, {_all("ra")} AS pa, {_all("rb")} AS pb FROM f), h AS (SELECT o_custkey, list_concat(pa, ['## DATA' || chr(10) || pb[1]], pb[2:]) AS p FROM g),
    r AS (SELECT o_custkey, {_greedy("p", "300")} AS r FROM h), u AS (SELECT o_custkey, {_all("r")} AS p FROM r), v AS (SELECT o_custkey, generate_subscripts(p, 1) AS i, unnest(p) AS t FROM u)
    SELECT o_custkey, CAST(i - 1 AS INTEGER) AS part, length(t) AS n_chars, sha256(t) AS digest, CAST(0 AS BIGINT) AS line_cuts FROM v""")
def structured_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as a page of two sections, a list with a closing line and JSON: both are cut between orders only."""
    o = B.table(spark, sf_dir, "orders")
    row = F.struct("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    per = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    entry = lambda r: F.concat_ws("\n", F.concat(F.lit("Order "), r["o_orderkey"]), F.concat(F.lit("Status "), r["o_orderstatus"]), F.lit("Day:"), r["day"], F.lit("Print"))
    item = lambda r: F.concat(F.lit('{\n"order": '), r["o_orderkey"], F.lit(',\n"note": "} ["\n}'))
    listing, data = F.array_join(F.transform("rows", entry), "\n"), F.array_join(F.transform("rows", item), ",\n")
    texts = per.select("o_custkey", F.concat(F.lit("## TEXT\n"), listing, F.lit("\n## DATA\n[\n"), data, F.lit("\n]")).alias("t"))
    return splitting.split_structured(texts, "o_custkey", "t", 300).select("o_custkey", "part", "n_chars", F.sha2("part_text", 256).alias("digest"), "line_cuts")


@query("""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d0 FROM orders), d AS (SELECT k, d0, CAST(d0 + CAST(unnest(range(0, 100)) AS INTEGER) AS DATE) AS d FROM o),
    r AS (SELECT k, d0, d, row_number() OVER (PARTITION BY k ORDER BY d) AS i FROM d WHERE CASE k % 4 WHEN 0 THEN d = d0
        WHEN 1 THEN isodow(d) IN (1, 4) AND date_diff('day', date_trunc('week', d0), d) // 7 % 2 = 0
        WHEN 2 THEN isodow(d) = 2 AND (day(d) BETWEEN 8 AND 14 OR day(last_day(d)) - day(d) < 7) AND d <= d0 + 70
        ELSE (d - d0) % 3 = 0 END)
    SELECT k AS o_orderkey, strftime(d, '%Y-%m-%d') || CASE k % 4 WHEN 0 THEN ' 00:00' ELSE ' 18:30' END AS start, CASE k % 4 WHEN 0 THEN strftime(d + 2, '%Y-%m-%d') || ' 00:00' ELSE strftime(d, '%Y-%m-%d') || ' 20:00' END AS "end" FROM r
    WHERE (k % 4 <> 1 OR i <= 6) AND (k % 4 <> 3 OR (i <= 5 AND d <> d0 + 3)) AND d BETWEEN DATE '1995-01-01' AND DATE '1997-12-31'""")
def calendar_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a calendar with one event: whole days, a fortnight's days with a count, days of a month with an end, or every third day without one."""
    key, day = F.col("o_orderkey"), lambda n: F.date_format(F.date_add("o_orderdate", n), "yyyyMMdd")
    rule = (
        F.when(key % 4 == 1, "RRULE:FREQ=WEEKLY;INTERVAL=2;BYDAY=MO,TH;COUNT=6")
        .when(key % 4 == 2, F.concat(F.lit("RRULE:FREQ=MONTHLY;BYDAY=2TU,-1TU;UNTIL="), day(70)))
        .otherwise(F.concat(F.lit("RRULE:FREQ=DAILY;INTERVAL=3;COUNT=5\r\nEXDATE;TZID=Europe/Berlin:"), day(3), F.lit("T183000")))
    )
    timed = F.concat(F.lit("DTSTART;TZID=Europe/Berlin:"), day(0), F.lit("T183000\r\nDURATION:PT1H\r\n 30M\r\n"), rule)
    dated = F.concat(F.lit("DTSTART;VALUE=DATE:"), day(0), F.lit("\r\nDTEND;VALUE=DATE:"), day(2))
    text = F.concat(F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:"), key, F.lit("\r\n"), F.when(key % 4 == 0, dated).otherwise(timed), F.lit("\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"))
    texts = B.table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t"))
    rows = calendar_rules.occurrences(calendar_rules.calendar_events(texts, "o_orderkey", "t", "Europe/Berlin"), "o_orderkey", "1995-01-01", "1997-12-31", "Europe/Berlin")
    return rows.select("o_orderkey", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm").alias("end"))
