"""Queries of title, id and age rules, the offer build and the refresh state, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cohortfn, idfn, titlefn
from ..operators import identity, nightly, offer_build, refresh, sessions
from ..operators.lineage import cut
from . import bindings as B
from .queries import query, text, with_roles

# --- titles, ids, ages


@query("""SELECT p_partkey, array_to_string(list_filter(regexp_extract_all(p_name, '[a-z]+'), lambda w: length(w) >= 4), ' ') AS core, chr(CAST(65 + p_size % 3 AS INTEGER)) AS label, p_size % 3 <> (p_size // 2) % 3 OR p_size % 5 = 0 AS conflicting,
    len(list_filter(regexp_extract_all(p_name, '[a-z]+'), lambda w: length(w) >= 4)) > 0 AND NOT (p_size % 3 <> (p_size // 2) % 3 OR p_size % 5 = 0 OR p_size % 7 = 0) AS same FROM part""")
def title_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two titles per part: with a group's label, some with months that differ or dates that differ."""
    n, size = F.col("p_name"), F.col("p_size")
    letter = lambda k: F.char((F.lit(65) + k).cast("int"))
    month = lambda m: F.when(size % 5 == 0, F.lit(f" {m}")).otherwise("")
    day = lambda d: F.when(size % 7 == 0, F.lit(f" ab {d}")).otherwise("")
    a = F.concat(n, F.lit(" Gruppe "), letter(size % 3), month("Juni"), day("21.02."))
    b = F.concat(n, F.lit(" Kurs Gruppe "), letter(F.floor(size / 2) % 3), month("Mai"), day("1.3.1998"))
    told = B.table(spark, sf_dir, "part").select("p_partkey", titlefn.title_profile(a).alias("p"), titlefn.title_profile(b).alias("q"))
    return told.select("p_partkey", F.array_join("p.core", " ").alias("core"), F.col("p.facets")[0][0].alias("label"), titlefn.contradict(F.col("p"), F.col("q"), 2).alias("conflicting"), titlefn.alike(F.col("p"), F.col("q")).alias("same"))


@query("""SELECT c_custkey, CASE WHEN a.l IS NULL OR b.l IS NULL THEN true ELSE (b.l <= a.l AND a.h <= b.h) OR (a.l <= b.l AND b.h <= a.h) END AS compatible FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE {'l': c_custkey % 12, 'h': c_custkey % 12 + 6} END AS a, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE {'l': c_custkey % 11, 'h': c_custkey % 11 + c_custkey % 9} END AS b FROM customer)""")
def age_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    one = lambda off, v: F.when(k % off != 0, v)
    ok = titlefn.compatible_age(one(5, k % 12), one(5, k % 12 + 6), one(7, k % 11), one(7, k % 11 + k % 9))
    return B.table(spark, sf_dir, "customer").select("c_custkey", ok.alias("compatible"))


_IMUL = "CAST(({a}::HUGEINT * {b}) % 4294967296 AS BIGINT)"
_M1, _M2 = (lambda a, n: _IMUL.format(a=f"xor({a}, {a} >> {n})", b=2246822507)), (lambda a, n: _IMUL.format(a=f"xor({a}, {a} >> {n})", b=3266489909))


@query(f"""WITH t AS (SELECT c_custkey, c_name || ' ä' AS t, CAST(c_custkey % 3 AS BIGINT) AS seed FROM customer), u AS (SELECT *, list_transform(string_split(t, ''), lambda c: CAST(unicode(c) AS BIGINT)) AS u FROM t),
    h AS (SELECT c_custkey, list_reduce(u, lambda h, c: {_IMUL.format(a="xor(h, c)", b=2654435761)}, xor(3735928559::BIGINT, seed)) AS a, list_reduce(u, lambda h, c: {_IMUL.format(a="xor(h, c)", b=1597334677)}, xor(1103547991::BIGINT, seed)) AS b FROM u),
    x AS (SELECT c_custkey, xor({_M1("a", 16)}, {_M2("b", 13)}) AS a, b FROM h), y AS (SELECT c_custkey, a, xor({_M1("b", 16)}, {_M2("a", 13)}) AS b FROM x), n AS (SELECT c_custkey, (b & 2097151) * 4294967296 + a AS n FROM y)
    SELECT c_custkey, CAST(n AS BIGINT) AS hash, array_to_string(list_transform([78364164096, 2176782336, 60466176, 1679616, 46656, 1296, 36, 1], lambda p: substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST((n % 2821109907456) // p % 36 AS INTEGER) + 1, 1)), '') AS id FROM n""")
def short_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat("c_name", F.lit(" ä"))
    return B.table(spark, sf_dir, "customer").select("c_custkey", idfn.hash53(t, F.col("c_custkey") % 3).alias("hash"), idfn.short_id(t, F.col("c_custkey") % 3).alias("id"))


@query(with_roles("""
    k AS (SELECT o_orderkey, 'c' || o_custkey AS p, trim(regexp_replace(lower(o_orderpriority || ' Kurs'), '[^a-z0-9]+', '-', 'g'), '-') AS t, kind, lower(strftime(coalesce(min(start) FILTER (WHERE CAST(start AS DATE) >= DATE '1998-06-15'), min(start)), '%Y%m%dT%H%M')) AS m FROM j GROUP BY ALL)
    SELECT o_orderkey, p || '--' || t || CASE WHEN kind = 'regular' THEN '' ELSE '-' || m END || '--v1' AS key FROM k"""))
def window_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat("o_orderpriority", F.lit(" Kurs"))
    key = idfn.window_key(F.concat(F.lit("c"), F.col("o_custkey")), F.lit("v1"), title, F.col("kind"), F.col("sessions"), B.today())
    return B.offers(spark, sf_dir).select("o_orderkey", key.alias("key"))


@query("""SELECT CASE WHEN c_custkey % 3 = 0 THEN lpad(CAST(c_custkey % 50 AS VARCHAR), 8, 'a') ELSE 'No id ' || c_custkey % 40 END AS id, CAST(min(c_custkey) AS BIGINT) AS position FROM customer WHERE c_custkey % 3 <> 1 GROUP BY 1""")
def migrated_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved ids of today's form and of none; an old key's hash is in ``short_ids``."""
    from ..operators import site

    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, F.lpad((k % 50).cast("string"), 8, "a")).otherwise(F.concat(F.lit("No id "), k % 40))
    return site.migrated_ids(B.table(spark, sf_dir, "customer").where(k % 3 != 1).select(raw.alias("raw"), k.alias("position")), "raw", "position")


_MONTHS = "['Januar', 'Februar', 'März', 'April', 'Mai', 'Juni', 'Juli', 'August', 'September', 'Oktober', 'November', 'Dezember']"
_AGE = "(year(d) - year({b})) * 12 + month(d) - month({b}) - CASE WHEN day(d) < least(day({b}), day(last_day(d))) THEN 1 ELSE 0 END"


@query(f"""WITH o AS (SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(year(o_orderdate) + 6 AS INTEGER) AS y, DATE '2003-06-15' + CAST(o_custkey % 400 AS INTEGER) AS d FROM orders),
    c AS (SELECT o_orderkey, d, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN make_date(y - 1, 12, 1) ELSE make_date(y, m, 1) END AS a, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN last_day(make_date(y, 2, 1)) WHEN 1 THEN last_day(make_date(y, m, 1)) ELSE last_day(make_date(y, least(12, m + 2), 1)) END AS b FROM o)
    SELECT o_orderkey, CAST(CASE WHEN h >= 0 THEN greatest(0, {_AGE.format(b="b")}) END AS INTEGER) AS low, CAST(CASE WHEN h >= 0 THEN h END AS INTEGER) AS high FROM (SELECT *, {_AGE.format(b="a")} AS h FROM c)""")
def cohort_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that name birth months in numbers, in words, over the turn of a year, or none."""
    m, y, k = F.month("o_orderdate"), F.year("o_orderdate") + 6, F.col("o_orderkey") % 4
    names = F.split(F.lit("Januar Februar März April Mai Juni Juli August September Oktober November Dezember"), " ")
    two = F.format_string("Kurs geb. %02d-%02d/%d", m, F.least(F.lit(12), m + 2), y)
    words = F.concat(F.lit("Kurs (geb. im "), F.element_at(names, m), F.lit(" "), y, F.lit(")"))
    title = F.when(k == 0, two).when(k == 1, words).when(k == 2, F.concat(F.lit("geboren Dez.–Feb. "), y)).otherwise(F.concat(F.lit("Kurs 3/"), y))
    age = cohortfn.cohort_age(cohortfn.birth_cohort(title), F.date_add(F.lit("2003-06-15").cast("date"), (F.col("o_custkey") % 400).cast("int")))
    return B.table(spark, sf_dir, "orders").select("o_orderkey", age["low"].cast("int").alias("low"), age["high"].cast("int").alias("high"))


@query("""SELECT o_orderkey, 'https://x.test/?a=' || strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') || '&b=' || strftime(date_trunc('month', o_orderdate) + INTERVAL 13 MONTH, '%Y-%m-%d') AS url FROM orders""")
def month_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "orders").select("o_orderkey", cohortfn.fill_months(F.lit("https://x.test/?a={von}&b={bis}"), F.to_date("o_orderdate")).alias("url"))


# --- the offer build

_OFFER = "o.o_orderkey, kind, o_custkey, o_orderstatus"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events: occurrences without an end for every third line, with one before the start for every fifth; ages for most."""
    s = B.session_rows(spark, sf_dir)
    end = F.when(F.col("l_linenumber") % 3 == 0, None).when(F.col("l_linenumber") % 5 == 0, F.col("start") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("end"))
    occ = s.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("start", end.alias("end")))).alias("occurrences"))
    o = B.table(spark, sf_dir, "orders")
    low = F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey") % 40)
    return o.join(occ, o["o_orderkey"] == occ["l_orderkey"]).select("o_orderkey", F.col("o_custkey").alias("provider"), F.lit(1).alias("venue"), F.col("o_orderstatus").alias("title"), B.kind(F.col("o_orderpriority")).alias("kind"), low.alias("low"), (low + 10).alias("high"), "occurrences")


@query(with_roles("""
    e AS (SELECT o_orderkey, kind, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey % 40 END AS low, s.start, CASE WHEN l_linenumber % 3 = 0 OR l_linenumber % 5 = 0 OR timezone('Europe/Berlin', timezone('Europe/Berlin', s."end")) <> s."end" THEN s.start + INTERVAL 1 HOUR ELSE s."end" END AS fin FROM o JOIN s ON l_orderkey = o_orderkey),
    k AS (SELECT * FROM e WHERE kind = 'course' OR CAST(start AS DATE) BETWEEN DATE '1998-06-01' AND DATE '1998-09-30'),
    g AS (SELECT o_orderkey, kind, low, count(*) AS n, min(start) AS a, max(start) AS z, max(fin) AS fin FROM k WHERE kind <> 'single' GROUP BY ALL UNION ALL SELECT o_orderkey, kind, low, 1, start, start, fin FROM k WHERE kind = 'single')
    SELECT o_orderkey, kind, CAST(low AS INTEGER) AS low, CAST(CASE WHEN low IS NOT NULL THEN least(36, low + 10) END AS INTEGER) AS high, CAST(n AS INTEGER) AS n, strftime(a, '%Y-%m-%d %H:%M:%S') AS first, strftime(fin, '%Y-%m-%d %H:%M:%S') AS fin FROM g
    WHERE (kind <> 'course' OR (CAST(z AS DATE) >= DATE '1998-06-01' AND CAST(a AS DATE) <= DATE '1998-09-30')) AND (low IS NULL OR low <= 36)"""))
def offer_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda t: F.lit(t).cast("date")
    d = offer_build.drafts(_events(spark, sf_dir), day("1998-06-01"), day("1998-09-30"))
    fin = F.array_max(F.transform("sessions", lambda s: s["end"]))
    return d.select("o_orderkey", "kind", "low", "high", F.size("sessions").alias("n"), text(F.col("sessions")[0]["start"]).alias("first"), text(fin).alias("fin"))


@query(with_roles("""
    k AS (SELECT j.*, o_custkey || '-' || o_orderpriority AS key, CAST(o_orderkey % 3 AS INTEGER) AS rank FROM j), b AS (SELECT key, min(rank) AS rank, kind FROM k GROUP BY 1, kind),
    g AS (SELECT key, min(o_orderkey) AS ord FROM k JOIN b USING (key, rank) GROUP BY 1), t AS (SELECT key, count(DISTINCT o_orderstatus) AS topics FROM k GROUP BY 1)
    SELECT key, CAST(rank AS INTEGER) AS rank, ord, CAST(count(DISTINCT start) AS INTEGER) AS n, CAST(any_value(topics) AS INTEGER) AS topics, any_value(b.kind) = 'regular' AND count(DISTINCT o_orderkey % 2) > 1 AS conflict FROM k JOIN b USING (key, rank) JOIN g USING (key) JOIN t USING (key) GROUP BY ALL"""))
def merged_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders of one priority as versions of one offer, ranked; the parity of the order stands for the title."""
    o = B.offers(spark, sf_dir)
    d = o.select(F.concat_ws("-", "o_custkey", "o_orderpriority").alias("key"), (F.col("o_orderkey") % 3).cast("int").alias("rank"), F.col("o_orderkey").alias("ord"), "kind", (F.col("o_orderkey") % 2).cast("string").alias("title"), F.array("o_orderstatus").alias("topics"), "sessions")
    m = offer_build.merge_keys(d, "key", [])
    return m.select("key", "rank", "ord", F.size("sessions").alias("n"), F.size("topics").alias("topics"), "conflict")


@query("""WITH o AS (SELECT o_orderkey, o_custkey % 50 AS p, o_orderstatus AS v, o_orderdate AS d, o_orderpriority AS t, o_orderkey % 3 AS r FROM orders), x AS (SELECT l.o_orderkey AS low, arg_min(h.o_orderkey, (h.r, h.o_orderkey)) AS high FROM o l JOIN o h USING (p, v, d, t) WHERE h.r < l.r GROUP BY 1),
    m AS (SELECT high, list_distinct(list('x' || low % 4)) AS more FROM x GROUP BY 1)
    SELECT o_orderkey, CAST(len(list_distinct(list_concat([t, 'x' || o_orderkey % 4], coalesce(more, [])))) AS INTEGER) + CAST(more IS NOT NULL AND false AS INTEGER) AS topics FROM o LEFT JOIN m ON high = o_orderkey WHERE o_orderkey NOT IN (SELECT low FROM x)""")
def outranked_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    one = F.array(F.struct(at.alias("start"), (at + F.expr("INTERVAL 1 HOUR")).alias("end")))
    o = B.table(spark, sf_dir, "orders").select(k.alias("id"), (F.col("o_custkey") % 50).alias("provider"), F.col("o_orderstatus").alias("venue"), F.col("o_orderpriority").alias("title"), (k % 3).cast("int").alias("rank"), k.alias("ord"), F.array("o_orderpriority", F.concat(F.lit("x"), k % 4)).alias("topics"), one.alias("sessions"))
    return offer_build.drop_outranked(o).select(F.col("id").alias("o_orderkey"), F.size("topics").alias("topics"))


@query(with_roles("""
    p AS (SELECT *, CASE o_custkey % 4 WHEN 0 THEN 'check failed' WHEN 1 THEN 'not checked' END AS reason FROM j WHERE o_orderkey % 3 <> 0 AND o_custkey % 6 <> 0 AND (kind = 'course' OR CAST(start AS DATE) >= DATE '1998-06-15'))
    SELECT o_orderkey, CAST(count(*) AS INTEGER) AS n, reason FROM p WHERE reason IS NOT NULL GROUP BY 1, reason HAVING arg_max("end", start) >= TIMESTAMP '1998-06-14 12:00:00'"""))
def carried_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old offers of customers whose check failed or that weren't reached; a third was built anew, a sixth has no venue any more."""
    k = F.col("o_custkey")
    old = B.offers(spark, sf_dir).select(F.col("o_orderkey").alias("id"), k.alias("provider"), F.lit(1).alias("venue"), "kind", "sessions")
    status = F.when(k % 4 == 0, "failed").when(k % 4 == 2, "ok")
    reason = offer_build.carry_reason(status, k % 4 == 3, F.lit(False))
    providers = B.table(spark, sf_dir, "orders").select(k.alias("provider"), reason.alias("reason")).distinct()
    out = offer_build.carried(old, old.where("id % 3 = 0").select("id"), providers, providers.where("provider % 6 != 0").withColumn("venue", F.lit(1)), B.today(), F.lit("1998-06-14 12:00:00").cast("timestamp_ntz"))
    return out.select(F.col("id").alias("o_orderkey"), F.size("sessions").alias("n"), "reason")


@query("""WITH s AS (SELECT DISTINCT l_suppkey % 20 AS p, l_orderkey % 7 AS id, CAST(date_trunc('week', l_shipdate) AS DATE) AS d FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'),
    x AS (SELECT p, id, min(d) AS lo, max(d) AS hi, count(*) AS n FROM s GROUP BY 1, 2), w AS (SELECT a.p, a.id AS a, b.id AS b, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi, greatest(a.n, b.n) AS most FROM x a JOIN x b ON a.p = b.p AND a.id < b.id),
    c AS (SELECT w.*, (SELECT count(*) FROM s WHERE s.p = w.p AND s.id = w.a AND d BETWEEN lo AND hi) AS m, (SELECT count(*) FROM s WHERE s.p = w.p AND s.id = w.b AND d BETWEEN lo AND hi) AS n,
          (SELECT count(*) FROM s u JOIN s v USING (p, d) WHERE u.p = w.p AND u.id = w.a AND v.id = w.b AND d BETWEEN lo AND hi) AS shared FROM w WHERE lo <= hi)
    SELECT p, a, b FROM c WHERE shared >= least(3, most) AND shared >= 0.8 * least(m, n) AND least(m, n) >= 0.5 * greatest(m, n)""")
def same_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of weeks of one place that agree in their common window."""
    week = F.date_trunc("week", "l_shipdate").cast("date").cast("timestamp_ntz")
    l = B.table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    s = l.select((F.col("l_suppkey") % 20).alias("p"), (F.col("l_orderkey") % 7).alias("id"), week.alias("start"), F.col("l_shipdate").alias("end"))
    per = sessions.collect_sessions(s, ["p", "id"], "start", "end")
    a, b = per.select("p", F.col("id").alias("a"), F.col("sessions").alias("x")), per.select("p", F.col("id").alias("b"), F.col("sessions").alias("y"))
    return a.join(b, "p").where("a < b").where(offer_build.same_sessions(F.col("x"), F.col("y"), F.lit("1997-12-01").cast("date"))).select("p", "a", "b")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + 1 ELSE o_custkey END AS provider, CAST(CASE WHEN o_orderkey % 4 = 0 THEN o_custkey ELSE o_custkey + 2 END AS BIGINT) AS was FROM orders WHERE o_orderkey % 4 < 2 AND CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + 1 ELSE o_custkey END <> CASE WHEN o_orderkey % 4 = 0 THEN o_custkey ELSE o_custkey + 2 END""")
def id_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = B.table(spark, sf_dir, "orders")
    after = o.select(k.alias("id"), F.when(k % 10 == 0, c + 1).otherwise(c).alias("provider"))
    resting = o.where(k % 4 < 2).select(k.alias("id"), (c + 2).alias("provider"))
    return offer_build.id_changes(o.where(k % 4 == 0).select(k.alias("id"), c.alias("provider")), after, resting)


MEMORY = "id string, key string, provider string, venue string, title string, kind string, low int, high int, listed_at timestamp_ntz, since timestamp_ntz, horizon_to date, starts array<timestamp_ntz>"


@query()
def built_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build over orders as events: a part of the customers failed and keeps its old offers."""
    day = lambda t: F.lit(t).cast("date")
    e = _events(spark, sf_dir).select(F.col("provider").cast("string").alias("provider"), F.lit("v1").alias("venue"), F.concat(F.lit("Kurs "), "title").alias("title"), "kind", "low", "high", "occurrences", F.lit(0).alias("rank"), F.col("o_orderkey").alias("ord"), F.array("title").alias("topics"))
    e = cut(e)  # written, as what is read of it several times would be grouped from the lines each time
    first, last = day("1998-06-15"), day("1998-12-31")
    kept = e.where(F.col("ord") % 3 == 0)
    old = offer_build.drafts(kept, first, last).withColumn("id", idfn.short_id(F.concat(F.lit("old"), "ord", F.lit("-"), F.col("sessions")[0]["start"].cast("string")))).withColumn("listed_at", F.lit("1998-06-01 03:00:00").cast("timestamp_ntz")).drop("rank", "ord")
    old = cut(old)
    providers = e.select("provider", F.when(F.col("provider").cast("long") % 4 == 0, "check failed").alias("reason")).distinct()
    venues = providers.select("provider", F.lit("v1").alias("venue"))
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    none = spark.createDataFrame([], MEMORY)
    out = nightly.build(e.where(F.col("provider").cast("long") % 4 != 0), old, none, providers, venues, first, last, t("1998-06-14 03:00:00"), t("1998-06-15 03:00:00"))
    return out.select("id", "provider", "title", "kind", F.size("sessions").alias("n"), text(F.col("listed_at")).alias("listed"), "stage")


@query("""SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'key' WHEN 1 THEN 'starts' WHEN 2 THEN 'title' WHEN 3 THEN 'moved' WHEN 5 THEN 'resting key' WHEN 6 THEN 'resting starts' WHEN 7 THEN 'resting title' ELSE 'new' END AS stage, o_orderkey % 9 NOT IN (4, 8) AS same_id FROM orders""")
def id_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as offers of a provider each, a part of them resting; what has changed since the night before goes by the key."""
    day, k = lambda t: F.lit(t).cast("date"), F.col("k")
    start = lambda hour: F.expr(f"timestamp_ntz'1998-06-15 {hour}:00:00' + make_interval(0, 0, 0, CAST(o_orderkey % 5 AS INT))")
    series = lambda hour: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda n: F.struct((start(hour) + F.make_interval(weeks=n)).alias("start"), (start(hour) + F.make_interval(weeks=n, hours=F.lit(1))).alias("end")))
    o = B.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("provider"), (F.col("o_orderkey") % 9).alias("k"))
    later, course = k.isin(2, 7), F.when(k.isin(2, 7), "course").otherwise("regular")
    none = [F.lit(None).cast("int").alias(c) for c in ("low", "high")]
    old = o.select("k", F.concat(F.lit("o"), "provider").alias("id"), "provider", F.lit("v").alias("venue"), F.lit("Krabbelkäfer").alias("title"), course.alias("kind"), *none, series(10).alias("sessions"))
    title = F.when(k.isin(1, 4, 8), "Zwergenrunde").when(k.isin(6, 7), "Krabbelkäfer neu").otherwise("Krabbelkäfer")
    new = o.select(F.col("provider").alias("draft"), "provider", F.when(k.isin(3, 4), "w").otherwise("v").alias("venue"), title.alias("title"), course.alias("kind"), *none, F.when(later, series(11)).when(k.isin(4, 8), series(15)).otherwise(series(10)).alias("sessions"), F.lit(None).cast("string").alias("keep"))
    rest = old.where("k between 5 and 8").withColumns({"key": F.concat(F.lit("k"), "id"), "since": F.lit("1998-06-01 03:00:00").cast("timestamp_ntz"), "horizon_to": day("1998-09-30"), "starts": F.col("sessions.start")})
    venues = spark.range(2).select(F.element_at(F.array(F.lit("v"), F.lit("w")), (F.col("id") + 1).cast("int")).alias("venue"))
    out = identity.assign(new, old.where("k < 5"), rest, venues, day("1998-06-15"), day("1998-12-31"))
    return out.select(F.col("draft").cast("long").alias("o_orderkey"), "stage", (F.col("id") == F.concat(F.lit("o"), "draft")).alias("same_id"))


@query("""WITH g AS (SELECT s_nationkey AS provider, min(s_suppkey) AS first FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY 1),
    l AS (SELECT o_custkey % 25 AS provider, o_orderkey AS id, s_suppkey AS origin, s_suppkey % 3 = 0 AS own FROM orders JOIN supplier ON s_suppkey = 1 + o_orderkey % (SELECT count(*) FROM supplier) AND s_nationkey = o_custkey % 25 WHERE o_orderkey % 7 = 1 AND o_orderdate >= TIMESTAMP '1996-01-01')
    SELECT provider, CASE WHEN own THEN origin ELSE first END AS unit, CAST(count(*) AS BIGINT) AS lost, min(id) AS first_id, bool_or(NOT own) AS crosses FROM l JOIN g USING (provider) GROUP BY 1, 2""")
def lost_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as offers of 25 providers, suppliers as pages; of every seventh offer the new versions make another one."""
    o, s = B.table(spark, sf_dir, "orders"), B.table(spark, sf_dir, "supplier")
    d = F.col("o_orderdate").cast("timestamp_ntz")
    shown = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 25).alias("provider"), F.array(F.struct(d.alias("start"), d.alias("end"))).alias("sessions"))
    pages = s.select(F.col("s_suppkey").alias("unit"), F.col("s_nationkey").alias("provider"))
    at = shown.withColumn("unit", F.lit(1) + F.col("id") % F.lit(s.count())).join(pages, ["unit", "provider"]).select("id", "unit")
    losses = nightly.unit_losses(shown, shown.where("id % 7 != 1"), at, pages.where("unit % 3 = 0"), F.lit("1996-01-01").cast("date"))
    return losses.select("provider", "unit", F.size("lost").cast("long").alias("lost"), F.col("lost")[0].alias("first_id"), "crosses")


# --- the refresh state

_NIGHT = """n AS (SELECT s_suppkey AS unit, CASE WHEN s_suppkey % 8 = 0 THEN 'failed' WHEN s_suppkey % 8 = 1 THEN 'unchanged' WHEN s_suppkey % 8 = 2 THEN 'pending' WHEN s_suppkey % 8 = 3 THEN 'empty' WHEN s_suppkey % 8 = 4 THEN 'error' WHEN s_suppkey % 8 = 7 THEN 'open' ELSE 'extracted' END AS kind, s_nationkey % 6 AS fresh, s_nationkey % 5 AS old, s_suppkey % 3 = 0 AS future, CAST(s_suppkey % 25 AS INTEGER) AS since FROM supplier)"""


def _dated(n: Column, day: Column) -> Column:
    event = F.struct(F.lit("e").alias("title"), F.lit(True).alias("single"), F.lit(True).alias("dated"), F.array(day).alias("days"))
    return F.when(n > 0, F.array_repeat(event, n.cast("int"))).otherwise(F.from_json(F.lit("[]"), refresh.EVENTS))


@query(f"""WITH {_NIGHT}, x AS (SELECT *, CASE WHEN future THEN old ELSE 0 END AS known, kind IN ('empty', 'extracted') AS taken, CASE WHEN kind = 'empty' THEN 0 WHEN kind = 'pending' THEN 1 ELSE fresh END AS got FROM n),
    y AS (SELECT *, taken AND ((known >= 3 AND got * 2 < known) OR (known >= 1 AND got = 0)) AS falls, kind = 'failed' AND since >= 14 AS gone FROM x), z AS (SELECT *, CASE WHEN gone THEN 0 WHEN (taken AND NOT falls) OR kind = 'pending' THEN got ELSE old END AS n FROM y)
    SELECT unit, CASE WHEN gone THEN 'removed' WHEN kind = 'failed' THEN 'down' WHEN kind = 'error' THEN 'error' WHEN falls THEN 'collapse' WHEN kind = 'pending' THEN 'pending adopted' ELSE kind END AS result, CAST(n AS INTEGER) AS events,
      CASE WHEN kind IN ('failed', 'error') THEN 'failed' WHEN kind = 'open' OR falls THEN 'ok' WHEN n > 0 THEN 'ok' ELSE 'no dates' END AS status, falls OR kind = 'open' OR (kind IN ('failed', 'error') AND NOT gone) AS pending,
      kind <> 'open' AND NOT CASE WHEN (taken AND NOT falls) OR kind = 'pending' THEN n > 0 ELSE future AND n > 0 END AND old > 0 AS empty FROM z""")
def refresh_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as pages: their night by the key, old and new events by the nation."""
    s, k = B.table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    today, now = B.today(), B.now()
    ahead, past = F.date_add(today, 5), F.date_sub(today, 5)
    null = lambda kind: F.lit(None).cast(kind)
    pending = F.struct(F.lit("p").alias("digest"), F.lit("m").alias("model"), _dated(F.lit(1), ahead).alias("events"))
    units = s.select(
        k.alias("unit"), _dated(F.col("s_nationkey") % 5, F.when(k % 3 == 0, ahead).otherwise(past)).alias("events"), F.lit("d").alias("digest"), F.lit("m").alias("model"), F.lit("ok").alias("status"), null("string").alias("reason"), now.alias("checked_at"), now.alias("changed_at"),
        null("timestamp_ntz").alias("failing_since"), F.lit("lasting").alias("failure"), F.date_sub(today, (k % 25).cast("int")).alias("failure_since"), pending.alias("pending"), null("timestamp_ntz").alias("empty_since"), null("timestamp_ntz").alias("removed_at"),
    )
    kinds = F.array(*map(F.lit, ("failed", "unchanged", "pending", "empty", "error", "extracted", "extracted")))
    night = s.where(k % 8 != 7).select(k.alias("unit"), F.element_at(kinds, (k % 8 + 1).cast("int")).alias("kind"), F.lit("r").alias("reason"), F.lit("lasting").alias("failure"), F.lit("e").alias("digest"), F.lit("m").alias("model"), _dated(F.col("s_nationkey") % 6, ahead).alias("events"), F.lit(0).alias("baseline"))
    out = refresh.advance(units, night, today, now)
    return out.select("unit", "result", F.size("events").alias("events"), "status", F.col("pending").isNotNull().alias("pending"), F.col("empty_since").isNotNull().alias("empty"))


@query("""WITH r AS (SELECT user_id, CASE event_id % 9 WHEN 0 THEN 'down' WHEN 1 THEN 'error' WHEN 2 THEN 'unchanged' WHEN 3 THEN 'extracted' WHEN 4 THEN 'empty' WHEN 5 THEN 'removed' WHEN 6 THEN 'collapse' WHEN 7 THEN 'held' ELSE 'open' END AS r, event_id % 40 AS g FROM events)
    SELECT CAST(user_id * 40 + g AS BIGINT) AS provider, CASE WHEN bool_or(r = 'open') THEN 'open' WHEN bool_and(r IN ('down', 'error', 'removed')) THEN CASE WHEN bool_and(r = 'down') THEN 'down' ELSE 'error' END WHEN bool_or(r IN ('down', 'error', 'removed')) THEN 'partial'
      WHEN bool_or(r = 'collapse') THEN 'collapse' WHEN bool_or(r = 'extracted') THEN 'extracted' WHEN bool_or(r = 'held') THEN 'held' WHEN bool_or(r = 'empty') THEN 'empty' ELSE 'unchanged' END AS result FROM r GROUP BY 1""")
def provider_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    names = F.array(*map(F.lit, ("down", "error", "unchanged", "extracted", "empty", "removed", "collapse", "held", "open")))
    rows = B.table(spark, sf_dir, "events").select((F.col("user_id") * 40 + k % 40).alias("provider"), F.element_at(names, (k % 9 + 1).cast("int")).alias("result"))
    return refresh.provider_result(rows)


@query(with_roles("""SELECT o_orderkey, CAST(CASE WHEN o_custkey % 4 = 0 THEN 1 WHEN kind = 'single' THEN count(*) FILTER (WHERE CAST(start AS DATE) >= DATE '1998-06-15') ELSE least(1, count(*) FILTER (WHERE CAST(start AS DATE) >= DATE '1998-06-15')) END AS INTEGER) AS units, bool_or(CAST(start AS DATE) >= DATE '1998-06-15') AS future FROM j GROUP BY o_orderkey, o_custkey, kind"""))
def event_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.transform("sessions", lambda s: F.to_date(s["start"]))
    e = F.array(F.struct(F.lit("t").alias("title"), (F.col("kind") == "single").alias("single"), (F.col("o_custkey") % 4 != 0).alias("dated"), days.alias("days")))
    return B.offers(spark, sf_dir).select("o_orderkey", refresh.event_units(e, B.today()).alias("units"), refresh.has_future(e, B.today()).alias("future"))


@query("""WITH c AS (SELECT s_nationkey AS u, arg_min(s_name, s_suppkey) AS via FROM supplier GROUP BY 1) SELECT c_custkey, via FROM customer LEFT JOIN c ON u = c_nationkey""")
def event_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("detail_url"), F.col("s_name").alias("source"), F.col("s_suppkey").alias("ord"))
    return refresh.with_source(B.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("source_url")), c).select("c_custkey", "via")


_ANSWER = "SELECT o_custkey AS run, o_orderkey AS id, o_orderpriority AS title, CAST(date_trunc('month', o_orderdate) AS DATE) AS start FROM orders WHERE o_orderkey % 3 = {k}"


@query(f"""WITH p AS ({_ANSWER.format(k=0)}), a AS ({_ANSWER.format(k=1)}), b AS ({_ANSWER.format(k=2)}),
    na AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.run = a.run AND p.title = a.title AND p.start = a.start)), nb AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.run = b.run AND p.title = b.title AND p.start = b.start)),
    ma AS (SELECT run, count(*) AS n FROM (SELECT * FROM p UNION ALL SELECT * FROM nb) w WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.run = w.run AND a.title = w.title AND a.start = w.start) GROUP BY 1),
    mb AS (SELECT run, count(*) AS n FROM (SELECT * FROM p UNION ALL SELECT * FROM na) w WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.run = w.run AND b.title = w.title AND b.start = w.start) GROUP BY 1)
    SELECT run, CASE WHEN coalesce(mb.n, 0) < coalesce(ma.n, 0) THEN 'second' ELSE 'first' END AS answer FROM (SELECT DISTINCT o_custkey AS run FROM orders) r LEFT JOIN ma USING (run) LEFT JOIN mb USING (run)""")
def gap_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as the state before and two answers, matched by priority and month."""
    o = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("id"), F.lit(1).alias("venue"), F.col("o_orderpriority").alias("title"), F.trunc("o_orderdate", "month").alias("start"))
    return refresh.better_answer(o.where("id % 3 = 1"), o.where("id % 3 = 2"), o.where("id % 3 = 0"))


@query("""WITH v AS (SELECT user_id % 200 * 50 + event_id % 50 AS id, event_id % 3 AS part, CASE event_type WHEN 'purchase' THEN 'same' WHEN 'error' THEN 'faulty' WHEN 'signup' THEN 'gone' WHEN 'view' THEN 'same' ELSE 'unclear' END AS kind, event_id % 400 AS target FROM events),
    g AS (SELECT id, list_distinct(list(target) FILTER (WHERE kind = 'same')) AS t, bool_and(kind IN ('faulty', 'gone')) AS a, bool_or(kind = 'faulty') AS f FROM v GROUP BY 1),
    k AS (SELECT id, t, CASE WHEN len(t) = 1 THEN 'same' WHEN len(t) > 1 THEN 'unclear' WHEN a THEN CASE WHEN f THEN 'faulty' ELSE 'gone' END ELSE 'unclear' END AS kind FROM g), c AS (SELECT t[1] AS target, count(*) AS n FROM k WHERE kind = 'same' GROUP BY 1)
    SELECT id, CASE WHEN n > 1 THEN 'unclear' ELSE kind END AS kind, CASE WHEN kind = 'same' AND n = 1 THEN t[1] END AS target FROM k LEFT JOIN c ON kind = 'same' AND c.target = t[1]""")
def merged_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = F.col("event_type"), F.col("event_id")
    kind = F.when(e.isin("purchase", "view"), "same").when(e == "error", "faulty").when(e == "signup", "gone").otherwise("unclear")
    v = B.table(spark, sf_dir, "events").select((F.col("user_id") % 200 * 50 + k % 50).alias("id"), (k % 3).alias("part"), kind.alias("kind"), (k % 400).alias("target"), e.alias("reason"))
    return refresh.merge_verdicts(v).select("id", "kind", "target")


@query("""SELECT o_orderkey, o_orderstatus <> CASE WHEN o_custkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AND CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 'a' END IS DISTINCT FROM CASE WHEN o_custkey % 5 = 0 THEN 'b' ELSE 'a' END AS gated FROM orders""")
def gated_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    gated = refresh.is_gated(F.col("o_orderstatus"), F.when(c % 3 != 0, "a"), F.when(c % 2 == 0, "X").otherwise(F.col("o_orderstatus")), F.when(c % 5 == 0, "b").otherwise("a"))
    return B.table(spark, sf_dir, "orders").select("o_orderkey", gated.alias("gated"))


@query("""WITH e AS (SELECT o_custkey AS provider, CAST(o_orderkey % 3 AS INTEGER) AS part, o_orderkey AS ord, o_orderpriority AS title, o_orderstatus AS shape, CAST(date_trunc('month', o_orderdate) AS DATE) AS start, o_orderpriority || o_orderstatus || strftime(o_orderdate, '%Y%m') AS key, o_orderpriority = '5-LOW' AS regular FROM orders),
    k AS (SELECT e.* FROM e WHERE NOT EXISTS (SELECT 1 FROM e h WHERE h.provider = e.provider AND h.key = e.key AND h.part < e.part)),
    t AS (SELECT l.provider, l.ord, arg_min(h.start, (h.part, h.ord)) AS start FROM k l JOIN k h ON l.provider = h.provider AND l.shape = h.shape AND h.part < l.part AND l.title = h.title GROUP BY 1, 2)
    SELECT k.provider, part, k.ord FROM k LEFT JOIN t ON t.provider = k.provider AND t.ord = k.ord WHERE t.ord IS NULL OR NOT (regular OR k.start = t.start)""")
def merged_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as events of three pages; status as their shape, the month as their date."""
    start = F.trunc("o_orderdate", "month")
    e = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("provider"), (F.col("o_orderkey") % 3).cast("int").alias("part"), F.col("o_orderkey").alias("ord"), F.concat("o_orderpriority", "o_orderstatus", F.date_format("o_orderdate", "yyyyMM")).alias("key"), F.col("o_orderstatus").alias("shape"), F.col("o_orderpriority").alias("title"), (F.col("o_orderpriority") == "5-LOW").alias("regular"), F.array(start).alias("starts"))
    return offer_build.merge_parts(e).select("provider", "part", "ord")
