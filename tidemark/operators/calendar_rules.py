"""Calendar texts to events with their rules, and events to occurrences in the civil time of one zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprfn import let
from .lineage import cut

# The format's names of weekdays, Monday first, and the parts of a rule that are understood.
DAYS = ("MO", "TU", "WE", "TH", "FR", "SA", "SU")
PARTS = ("FREQ", "INTERVAL", "BYDAY", "BYMONTHDAY", "UNTIL", "COUNT", "WKST")
STAMP = r"^(\d{4})(\d\d)(\d\d)(?:T(\d\d)(\d\d)(\d\d)(Z)?)?$"
PARAMS = r'((?:;[^;:="\n]+=(?:"[^"\n]*"|[^";:\n]*))*)'
DURATION = r"^([+-]?)P(?=\d|T\d)(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$"


def _empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _stamp(value: Column, zone: Column, target: Column) -> Column:
    """The civil time (timestamp_ntz) in ``target`` of a stamp that is UTC with a Z and else in ``zone``; a date is its midnight, in any
    zone; null if it can't be read."""
    of = lambda *at: F.substring(value, *at)
    clock = F.when(F.length(value) == 8, F.lit("00:00:00")).otherwise(F.concat_ws(":", of(10, 2), of(12, 2), of(14, 2)))
    civil = F.concat(F.concat_ws("-", of(1, 4), of(5, 2), of(7, 2)), F.lit(" "), clock).try_cast("timestamp_ntz")
    moved = F.convert_timezone(F.when(F.endswith(value, F.lit("Z")), F.lit("UTC")).otherwise(zone), target, civil)
    return F.when(value.rlike(STAMP), F.when(F.length(value) == 8, civil).otherwise(moved))


def _zone(params: Column, default: str) -> Column:
    """The zone that a property names; one that isn't known counts as ``default``."""
    known = lambda z: F.concat(F.lit("2000-01-01 00:00:00 "), z).try_cast("timestamp").isNotNull()
    named = let(_empty(F.regexp_extract(params, r'(?i);TZID="?([^";:\n]+)', 1)), lambda z: F.when(known(z), z).otherwise(F.lit(default)))
    return F.when(params == "", F.lit(default)).otherwise(named)


def calendar_events(texts: DataFrame, key: str, text: str, zone: str) -> DataFrame:
    """A row per event of calendar texts: (key, n, uid, summary, location, url, status, start_zone, starts, all_day, seconds, rule, excluded,
    replaces, problem).

    Folded lines are joined; what is nested in an event (alarms) is no part of it. ``starts`` is the civil time (timestamp_ntz) in the event's own
    zone: UTC with a Z, else the one named by TZID, else ``zone``. ``seconds`` is the civil length, by DTEND or DURATION; without either a day for
    a date and null for a time. ``rule`` is null for a single event. ``excluded`` are the days of EXDATE, ``replaces`` the day of RECURRENCE-ID,
    both in the event's zone. ``problem`` names the first thing that can't be read (``start``, ``end``, or a part or value of the rule); such an
    event has no occurrences. Null and empty texts have no events.
    """
    whole = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n"), "\n[ \t]", "")
    found = F.regexp_extract_all(whole, F.lit(r"(?s)(?<=^|\n)BEGIN:VEVENT\n(.*?)(?<=\n)END:VEVENT(?=\n|$)"), F.lit(1))
    d = texts.select(F.col(key).alias("key"), F.posexplode(found).alias("n", "e"))
    d = d.withColumn("e", F.regexp_replace("e", r"(?s)(?<=^|\n)BEGIN:(\w+)\n.*?(?<=\n)END:\1(?=\n|$)", ""))
    params = lambda name: F.regexp_extract("e", rf"(?m)^{name}{PARAMS}:", 1)
    field = lambda name: _empty(F.regexp_extract("e", rf"(?m)^{name}{PARAMS}:(.*)$", 2))
    words = lambda name: F.regexp_replace(F.regexp_replace(field(name), r"\\[nN]", " "), r"\\([,;\\])", "$1")
    # What is named several times is a column of its own first, so that no text is searched once a mention.
    d = d.select(
        "key", "n", field("UID").alias("uid"), words("SUMMARY").alias("summary"), words("LOCATION").alias("location"), field("URL").alias("url"),
        F.upper(field("STATUS")).alias("status"), field("DTSTART").alias("s"), field("DTEND").alias("t"), field("DURATION").alias("dur"), F.upper(field("RRULE")).alias("r"),
        params("DTSTART").alias("s_params"), params("DTEND").alias("t_params"), field("RECURRENCE-ID").alias("rid"), params("RECURRENCE-ID").alias("rid_params"),
        F.regexp_extract_all("e", F.lit(rf"(?m)^EXDATE{PARAMS}:.*$"), F.lit(0)).alias("ex"),
    ).withColumns({
        "start_zone": F.when(F.endswith("s", F.lit("Z")), F.lit("UTC")).otherwise(_zone(F.col("s_params"), zone)),
        "end_zone": _zone(F.col("t_params"), zone), "rid_zone": _zone(F.col("rid_params"), zone),
    })
    own = F.col("start_zone")
    day = lambda value, z: _stamp(value, z, own).cast("date")
    listed = lambda x: F.struct(_zone(F.regexp_extract(x, f"^EXDATE{PARAMS}:", 1), zone).alias("z"), F.split(F.regexp_extract(x, rf"^EXDATE{PARAMS}:(.*)$", 2), ",").alias("v"))
    off = F.transform("ex", lambda x: let(listed(x), lambda y: F.transform(y["v"], lambda v: day(F.trim(v), y["z"]))))
    d = d.withColumn("starts", _stamp(F.col("s"), own, own)).withColumn("all_day", F.length("s") == 8).withColumn("excluded", F.filter(F.flatten(off), lambda x: x.isNotNull()))
    unit = lambda i, many: F.coalesce(_empty(F.regexp_extract("dur", DURATION, i)).try_cast("long"), F.lit(0)) * many
    lasting = F.when(F.col("dur").rlike(DURATION), (unit(2, 604800) + unit(3, 86400) + unit(4, 3600) + unit(5, 60) + unit(6, 1)) * F.when(F.regexp_extract("dur", DURATION, 1) == "-", -1).otherwise(1))
    until_end = (F.expr("timestampdiff(SECOND, starts, ends)")).cast("long")
    d = d.withColumn("ends", _stamp(F.col("t"), F.col("end_zone"), own)).withColumn("lasting", F.when(F.col("dur").isNotNull(), lasting))
    length = F.when(F.col("t").isNotNull(), until_end).when(F.col("dur").isNotNull(), F.col("lasting")).when(F.col("all_day"), F.lit(86400))
    d = d.withColumn("seconds", F.when(length.isNotNull(), F.greatest(length.cast("long"), F.lit(0))))
    # The rule: a map of its parts; each is read, and what isn't understood is named.
    pairs = F.filter(F.split("r", ";"), lambda x: x != "")
    part = F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^=]*=?", "")).alias("v")))
    d = d.withColumn("p", F.when(F.col("r").isNotNull(), part))
    said = lambda k: F.get(F.filter("p", lambda x: x["k"] == k), F.lit(0))["v"]
    d = d.withColumns({f"r_{k}": said(k) for k in PARTS} | {"r_odd": F.get(F.filter("p", lambda x: ~x["k"].isin(*PARTS)), F.lit(0))["k"]})
    of = lambda k: F.col(f"r_{k}")
    by_day = F.transform(F.split(of("BYDAY"), ","), lambda x: F.struct(F.coalesce(F.nullif(F.regexp_extract(x, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("int"), F.lit(0)).alias("nth"), F.array_position(F.array(*map(F.lit, DAYS)), F.regexp_extract(x, r"([A-Z]{2})\s*$", 1)).cast("int").alias("weekday")))
    by_month = F.transform(F.split(of("BYMONTHDAY"), ","), lambda x: F.trim(x).try_cast("int"))
    until = F.when(F.length(of("UNTIL")) == 8, _stamp(of("UNTIL"), own, own) + F.expr("INTERVAL '86399' SECOND")).otherwise(_stamp(of("UNTIL"), own, own))
    rule = F.struct(of("FREQ").alias("freq"), F.coalesce(of("INTERVAL").try_cast("int"), F.lit(1)).alias("every"), by_day.alias("by_day"), by_month.alias("by_month_day"), until.alias("until"), of("COUNT").try_cast("int").alias("count"))
    d = d.withColumn("rule", F.when(F.col("r").isNotNull(), rule))
    q, odd = F.col("rule"), F.col("r_odd")
    bad_number = lambda k, c: of(k).isNotNull() & (c.isNull() | (c < 1))
    ordinal = F.exists(q["by_day"], lambda b: b["nth"] != 0)
    problem = (
        F.when(F.col("starts").isNull(), "start")
        .when((F.col("t").isNotNull() & F.col("ends").isNull()) | (F.col("t").isNull() & F.col("dur").isNotNull() & F.col("lasting").isNull()), "end")
        .when(q.isNull(), F.lit(None))
        .when(~F.coalesce(q["freq"].isin("DAILY", "WEEKLY", "MONTHLY", "YEARLY"), F.lit(False)), "FREQ")
        .when(odd.isNotNull(), odd)
        .when(bad_number("INTERVAL", of("INTERVAL").try_cast("int")), "INTERVAL")
        .when(bad_number("COUNT", q["count"]), "COUNT")
        .when(of("UNTIL").isNotNull() & q["until"].isNull(), "UNTIL")
        .when((of("WKST") != "MO") & (q["freq"] == "WEEKLY") & (q["every"] > 1), "WKST")
        .when(F.exists(q["by_day"], lambda b: b["weekday"] == 0) | (ordinal & (q["freq"] != "MONTHLY")) | (q["by_day"].isNotNull() & (q["freq"] == "YEARLY")), "BYDAY")
        .when(F.exists(q["by_month_day"], lambda m: m.isNull() | (m == 0) | (F.abs(m) > 31)) | (q["by_month_day"].isNotNull() & ~q["freq"].isin("MONTHLY", "YEARLY")) | (q["by_month_day"].isNotNull() & q["by_day"].isNotNull()), "BYMONTHDAY")
    )
    replaces = day(F.col("rid"), F.when(F.col("rid").endswith("Z"), F.lit("UTC")).otherwise(F.col("rid_zone")))
    d = d.withColumn("problem", problem).withColumn("replaces", replaces)
    return d.select(F.col("key").alias(key), "n", "uid", "summary", "location", "url", "status", "start_zone", "starts", "all_day", "seconds", "rule", "excluded", "replaces", "problem")


def occurrences(events: DataFrame, key: str, first: str, last: str, zone: str) -> DataFrame:
    """(key, n, uid, day, start, end, all_day): what ``calendar_events`` gave, as occurrences whose first day in ``zone`` is from ``first`` to ``last``.

    A rule goes by the civil days of the event's own zone from its start on (weeks from Monday; months and years without the day are left out; days
    of the start that the rule doesn't name are none); UNTIL and COUNT end it, and COUNT counts the excluded days too. Cancelled events
    are none, a cancelled or moved day of a series (the same uid and text, RECURRENCE-ID) takes the series' day away. ``start`` and ``end``
    are civil times of ``zone``; the end of a date is the midnight after it. A rule without an end goes on to ``last``.
    """
    rows = cut(events).filter(F.col("problem").isNull())  # read twice, parsed once
    gone = rows.filter("replaces is not null and uid is not null").groupBy(key, "uid").agg(F.collect_set("replaces").alias("away"))
    rows = rows.join(gone, [key, "uid"], "left").filter(F.coalesce(F.col("status"), F.lit("")) != "CANCELLED")
    q, d0 = F.col("rule"), F.col("starts").cast("date")
    monday = F.date_trunc("week", d0).cast("date")
    month = lambda d: F.year(d) * 12 + F.month(d)
    weekday = lambda d: F.weekday(d) + 1

    def in_month(d: Column) -> Column:
        number, back = F.dayofmonth(d), F.dayofmonth(F.last_day(d)) - F.dayofmonth(d) + 1
        nth = lambda b: (b["nth"] == 0) | (b["nth"] == F.ceil(number / 7)) | (-b["nth"] == F.ceil(back / 7))
        named = F.exists(q["by_day"], lambda b: (b["weekday"] == weekday(d)) & nth(b))
        return F.when(q["by_day"].isNotNull(), named).when(q["by_month_day"].isNotNull(), F.exists(q["by_month_day"], lambda m: (m == number) | (-m == back))).otherwise(number == F.dayofmonth(d0))

    def holds(d: Column) -> Column:
        on = F.exists(q["by_day"], lambda b: b["weekday"] == weekday(d))
        return (
            F.when(q["freq"] == "DAILY", (F.datediff(d, d0) % q["every"] == 0) & F.coalesce(on, F.lit(True)))
            .when(q["freq"] == "WEEKLY", (F.floor(F.datediff(d, monday) / 7) % q["every"] == 0) & F.coalesce(on, weekday(d) == weekday(d0)))
            .when(q["freq"] == "MONTHLY", ((month(d) - month(d0)) % q["every"] == 0) & in_month(d))
            .otherwise(((F.year(d) - F.year(d0)) % q["every"] == 0) & (F.month(d) == F.month(d0)) & in_month(d))
        )

    end = F.least(F.coalesce(q["until"].cast("date"), F.lit("9999-12-31").cast("date")), F.date_add(F.lit(last).cast("date"), 2))  # zones lie up to two dates apart
    clock = F.col("starts") - d0.cast("timestamp_ntz")
    at = lambda d: d.cast("timestamp_ntz") + clock
    # Only days that can hold are looked at: every n-th day or the named days of every n-th week, month or year, and with a COUNT no longer than that
    # many take. A cycle of 7 n days holds one day of each weekday; a week after the first holds all its named days.
    far = lambda n: F.least(n.cast("long"), F.lit(4_000_000))  # noqa: E731  # days beyond every date that is read
    every, named = far(q["every"]), q["by_day"].isNotNull()
    upto = lambda n: F.least(end, F.date_add(d0, far(n).cast("int")))
    bound = lambda n: F.when(q["count"].isNull(), end).otherwise(upto(n))
    count = far(q["count"])
    steps = lambda begin, to, n: F.when(to >= begin, F.transform(F.sequence(F.lit(0).cast("long"), F.floor(F.datediff(to, begin) / n)), lambda i: F.date_add(begin, (i * n).cast("int"))))
    daily = steps(d0, bound(F.when(named, count * every * 7).otherwise((count - 1) * every)), every)
    weekdays = F.array_sort(F.array_distinct(F.when(named, F.transform(q["by_day"], lambda b: b["weekday"])).otherwise(F.array(weekday(d0)))))
    weekly = F.flatten(F.transform(steps(monday, bound((count + 1) * every * 7), every * 7), lambda w: F.transform(weekdays, lambda x: F.date_add(w, x - 1))))
    period = F.when(q["freq"] == "MONTHLY", every).otherwise(every * 12)
    firsts = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((month(end) - month(d0)) / period)), lambda i: F.add_months(F.trunc(d0, "month"), (i * period).cast("int")))

    def of_month(m: Column) -> Column:
        """The days of a month, by its first, that may hold: all of the named weekdays, the named days, or the start's day."""
        length, number = F.dayofmonth(F.last_day(m)), F.dayofmonth(d0)
        of_weekday = lambda b: F.transform(F.sequence(F.pmod(b["weekday"] - weekday(m), F.lit(7)), length - 1, F.lit(7)), lambda n: F.date_add(m, n))
        by_number = F.transform(F.filter(F.coalesce(q["by_month_day"], F.array(number)), lambda n: F.abs(n) <= length), lambda n: F.date_add(m, F.when(n > 0, n - 1).otherwise(length + n)))
        return F.array_sort(F.array_distinct(F.when(named, F.flatten(F.transform(q["by_day"], of_weekday))).otherwise(by_number)))

    monthly = F.flatten(F.transform(firsts, of_month))
    may = F.when(q["freq"] == "DAILY", daily).when(q["freq"] == "WEEKLY", weekly).otherwise(monthly)
    days = F.filter(F.when(end >= d0, may), lambda d: d.between(d0, end) & holds(d) & F.coalesce(at(d) <= q["until"], F.lit(True)))
    days = F.when(q["count"].isNull(), days).otherwise(F.slice(days, F.lit(1), q["count"]))
    days = F.array_except(F.when(q.isNull(), F.array(d0)).otherwise(days), F.col("excluded"))
    days = F.when(F.col("away").isNotNull() & F.col("replaces").isNull(), F.array_except(days, F.col("away"))).otherwise(days)
    rows = rows.withColumn("own", F.explode(days)).withColumn("own", at(F.col("own")))
    span = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("seconds").cast("decimal(18,6)"))
    here = lambda c: F.when(F.col("all_day"), c).otherwise(F.convert_timezone(F.col("start_zone"), F.lit(zone), c))
    rows = rows.select(key, "n", "uid", here(F.col("own")).alias("start"), here(F.col("own") + span).alias("end"), "all_day").withColumn("day", F.col("start").cast("date"))
    return rows.filter(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).select(key, "n", "uid", "day", "start", "end", "all_day")


def last_day(zone: str) -> Column:
    """The last day in ``zone`` of an event of ``calendar_events`` without a rule: the day before the exclusive end of dates, never before its first
    day; null for series and for what can't be read."""
    here = lambda c: F.when(F.col("all_day"), c).otherwise(F.convert_timezone(F.col("start_zone"), F.lit(zone), c))
    span = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.coalesce(F.col("seconds"), F.lit(0)).cast("decimal(18,6)"))
    end = here(F.col("starts") + span).cast("date")
    end = F.when(F.col("all_day"), F.date_sub(end, 1)).otherwise(end)
    return F.when(F.col("rule").isNull() & F.col("problem").isNull(), F.greatest(end, here(F.col("starts")).cast("date")))
