"""Queries of roll-ups and page rules, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pagefn
from ..operators import listing, rollups, timetable
from . import bindings as B
from .queries import query


@query("""SELECT s_nationkey, arg_min(s_suppkey, (s_acctbal, s_suppkey)) AS s_suppkey, min(s_acctbal) AS distance FROM supplier WHERE s_acctbal > 0 GROUP BY 1""")
def nearest_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.nearest_of(B.table(spark, sf_dir, "supplier"), ["s_nationkey"], F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")), "s_suppkey")


@query("""SELECT o_custkey, array_to_string(list_filter(['3-MEDIUM', '1-URGENT', '5-LOW'], lambda x: list_contains(s, x)), ',') AS "values" FROM (SELECT o_custkey, list(DISTINCT o_orderpriority) AS s FROM orders GROUP BY 1)""")
def provider_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rollups.ordered_values(B.table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", ["3-MEDIUM", "1-URGENT", "5-LOW"])
    return out.withColumn("values", F.array_join("values", ","))


@query("""SELECT CASE WHEN s_acctbal < 0 THEN 'skipped' WHEN s_suppkey % 5 = 0 THEN 'adapter' WHEN s_nationkey < 5 THEN 'candidate' ELSE 'page' END AS route, CAST(count(*) AS BIGINT) AS n FROM supplier GROUP BY 1""")
def plan_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = [("skipped", F.col("s_acctbal") < 0), ("adapter", F.col("s_suppkey") % 5 == 0), ("candidate", F.col("s_nationkey") < 5)]
    return rollups.route(B.table(spark, sf_dir, "supplier"), routes, "page").groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH w AS (SELECT l_suppkey FROM lineitem WHERE l_linenumber = 1 GROUP BY 1 HAVING bool_and(l_quantity >= 4)), f AS (SELECT l_suppkey, l_orderkey, unnest(list_filter([CASE WHEN l_quantity >= 4 THEN 'big' END, CASE WHEN l_discount > 0.09 THEN 'cheap' END], lambda x: x IS NOT NULL)) AS kind FROM lineitem WHERE l_linenumber = 1)
    SELECT l_suppkey, l_orderkey, kind FROM f WHERE l_suppkey NOT IN (SELECT l_suppkey FROM w) UNION ALL SELECT l_suppkey, NULL, 'all_big' FROM w""")
def watch_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = B.table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_suppkey", "l_orderkey", "l_quantity", "l_discount")
    return rollups.findings(l, ["l_orderkey"], "l_suppkey", {"big": F.col("l_quantity") >= 4, "cheap": F.col("l_discount") > 0.09}, "big")


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, 'old' FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 3 = 0""")
def held_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    before = o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("old"))
    return rollups.held_back(before, o.where("o_orderkey % 4 != 0"), "o_orderkey", o.where("o_orderkey % 5 = 0"))


@query("""SELECT CASE WHEN c_custkey % 6 <> 0 THEN 'off' WHEN c_custkey % 12 = 0 THEN 'tentative' ELSE 'fixed' END AS stage, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1""")
def saved_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.table(spark, sf_dir, "customer")
    saved = c.where("c_custkey % 6 = 0").select("c_custkey", (F.col("c_custkey") % 12 == 0).alias("tentative"))
    return rollups.stage_of(c, saved, "c_custkey").groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(count(*) AS BIGINT) AS pending, CAST(floor(datediff('minute', min(ts), TIMESTAMP '2024-01-30 12:00:00') / 60.0) AS BIGINT) AS hours FROM events WHERE ts > TIMESTAMP '2024-01-29 06:00:00' AND event_type <> 'view' AND second(ts) >= 0""".replace("datediff('minute', min(ts), TIMESTAMP '2024-01-30 12:00:00')", "floor(epoch(TIMESTAMP '2024-01-30 12:00:00' - min(ts)) / 60)"))
def live_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    return rollups.lag_hours(B.table(spark, sf_dir, "events"), "ts", t("2024-01-29 06:00:00"), F.col("event_type") != "view", t("2024-01-30 12:00:00"))


@query("""SELECT strftime(least(min(a), (SELECT min(CAST(l_shipdate AS DATE)) FROM lineitem WHERE l_linenumber = 7)), '%Y-%m-%d') AS first, strftime(greatest(max(b), (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem WHERE l_linenumber = 7)), '%Y-%m-%d') AS last FROM (SELECT CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 30 AS b FROM orders)""")
def feed_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    cal = B.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("start"), F.date_add(F.to_date("o_orderdate"), 30).alias("end"))
    added = B.table(spark, sf_dir, "lineitem").where("l_linenumber = 7").select(F.to_date("l_shipdate").alias("day"), F.lit(1).alias("exception_type"))
    return timetable.feed_validity(cal, added).select(*[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first", "last")])


@query(r"""SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref\s*=\s*["'']([^"''#]*)', 1)) AS BIGINT) AS links, CAST(len(list_distinct(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref\s*=\s*["'']([^"''#]*)', 1))) AS BIGINT) AS targets FROM pages""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pagefn.links(F.col("html"))
    return B.table(spark, sf_dir, "pages").select("page_id", F.size(found).cast("long").alias("links"), F.size(F.array_distinct(found)).cast("long").alias("targets"))


@query("""WITH w AS (SELECT o_orderkey, CASE WHEN datediff('day', CAST(o_orderdate AS DATE), DATE '1998-06-15') <= 6 THEN 'this_week' WHEN datediff('day', CAST(o_orderdate AS DATE), DATE '1998-06-15') <= 13 THEN 'last_week' ELSE 'older' END AS week, o_totalprice FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY o_totalprice DESC, o_orderkey) AS r FROM w) SELECT week, o_orderkey, CAST(r AS INTEGER) AS rank FROM r WHERE r <= 20""")
def group_by_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.table(spark, sf_dir, "orders").withColumn("week", listing.listing_week(F.col("o_orderdate"), B.today()))
    return listing.top_in_group(o, ["week"], [F.desc("o_totalprice"), F.col("o_orderkey")], 20).select("week", "o_orderkey", "rank")
