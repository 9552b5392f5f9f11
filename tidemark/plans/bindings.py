"""The driver's tables in the roles of offers, sessions, places and timetables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sessions

NOW, TODAY = "1998-06-15 12:00:00", "1998-06-15"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def today() -> Column:
    return F.lit(TODAY).cast("date")


def kind(priority: Column) -> Column:
    """Urgent and high orders are courses, medium ones single events, others regular."""
    return F.when(priority.isin("1-URGENT", "2-HIGH"), sessions.COURSE).when(priority == "3-MEDIUM", sessions.SINGLE).otherwise(sessions.REGULAR)


def session_rows(spark: SparkSession, sf_dir: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """A row per line item: session from the ship date, at the hour of its line number, of as many hours as its quantity; of ship
    dates from ``since`` to before ``until``."""
    start = F.col("l_shipdate") + F.make_dt_interval(F.lit(0), F.col("l_linenumber") + 8)
    rows = table(spark, sf_dir, "lineitem")
    if since is not None and until is not None:
        rows = rows.where((F.col("l_shipdate") >= F.lit(since).cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit(until).cast("timestamp_ntz")))
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", start.alias("start"), (start + F.make_dt_interval(F.lit(0), F.col("l_quantity").cast("int"))).alias("end"))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their sessions, kind, and whether they take registrations."""
    per = sessions.collect_sessions(session_rows(spark, sf_dir), ["l_orderkey"], "start", "end")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "o_totalprice", kind(F.col("o_orderpriority")).alias("kind"), (F.col("o_orderstatus") != "F").alias("registered"))
    return orders.join(per, orders["o_orderkey"] == per["l_orderkey"]).drop("l_orderkey")


def suppliers_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with made-up coordinates: 37 by 53 of them in a field, and more fields as there are more suppliers."""
    k = F.col("s_suppkey")
    lat = F.lit(49.0) + (k % 37) / 400.0 + (F.floor(k / 1961) % 100) / 10.0
    lon = F.lit(11.0) + (k % 53) / 300.0 + (F.floor(k / 196100) % 100) / 5.0
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", lat.alias("lat"), lon.alias("lon"))


#: The same roles in SQL, to be put before a query.
SQL = f"""
    now AS (SELECT TIMESTAMP '{NOW}' AS now),
    s AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate + to_hours(l_linenumber + 8) AS start, l_shipdate + to_hours(l_linenumber + 8 + CAST(l_quantity AS INTEGER)) AS end FROM lineitem),
    sess AS (SELECT l_orderkey AS o_orderkey, start, min("end") AS "end" FROM s GROUP BY 1, 2),
    o AS (SELECT *, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'course' WHEN o_orderpriority = '3-MEDIUM' THEN 'single' ELSE 'regular' END AS kind, o_orderstatus <> 'F' AS registered FROM orders),
    j AS (SELECT o.*, sess.start, sess."end", row_number() OVER (PARTITION BY o.o_orderkey ORDER BY start) AS k, count(*) OVER (PARTITION BY o.o_orderkey) AS n FROM o JOIN sess USING (o_orderkey)),
    f AS (SELECT o_orderkey, min(start) AS first, max(start) AS last, arg_max("end", start) AS last_end, max("end") AS any_end FROM j GROUP BY 1)"""
