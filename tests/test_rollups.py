"""Roll-ups and page rules."""

from pyspark.sql import functions as F

from tidemark.functions import pagefn
from tidemark.operators import rollups


def test_rollups(spark):
    rows = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("b", 3, None)], "g string, i long, d double")
    assert {(r["g"], r["i"], r["distance"]) for r in rollups.nearest_of(rows, ["g"], F.col("d"), "i").collect()} == {("a", 1, 5.0)}
    v = spark.createDataFrame([(1, "x"), (1, "z"), (1, "x"), (2, None), (2, "q")], "g long, v string")
    assert {r["g"]: r["values"] for r in rollups.ordered_values(v, ["g"], "v", ["z", "y", "x"]).collect()} == {1: ["z", "x"], 2: []}
    u = spark.createDataFrame([("p", 1, 9), ("p", 2, 9), ("q", 1, 9), ("q", 2, 1), ("r", 1, None)], "p string, u long, n int")
    got = {(r["p"], r["u"], r["kind"]) for r in rollups.findings(u, ["u"], "p", {"big": F.col("n") > 5, "odd": F.col("u") == 1}, "big").collect()}
    assert got == {("p", None, "all_big"), ("q", 1, "big"), ("q", 1, "odd"), ("r", 1, "odd")}
    saved = spark.createDataFrame([(1, True), (2, False)], "i long, tentative boolean")
    assert {r["i"]: r["stage"] for r in rollups.stage_of(spark.createDataFrame([(1,), (2,), (3,)], "i long"), saved, "i").collect()} == {1: "tentative", 2: "fixed", 3: "off"}
    old, new = (spark.createDataFrame(x, "k long, v string") for x in ([(1, "o"), (2, "o")], [(1, "n"), (3, "n"), (4, "n")]))
    gated = spark.createDataFrame([(1,), (4,)], "k long")
    assert {(r["k"], r["v"]) for r in rollups.held_back(old, new, "k", gated).collect()} == {(1, "o"), (3, "n")}


def test_pages(spark):
    page = """<a href="/x#t">x</a><a class=q HREF='/y'>y</a><iframe src="/f"></iframe>
      <script type="application/ld+json">{"@type": "Event", "name": "A", "startDate": "2024-01-01"}</script>
      <script type="application/ld+json">[{"@type": "Course", "name": "B"}, {"@type": "Place", "name": "no"}]</script>
      <script type="application/ld+json">{"@graph": [{"@type": "MusicEvent", "name": "C"}]}</script><script type="application/ld+json">{broken</script>"""
    d = spark.createDataFrame([(page, "am 1.7.2024, 01.07.2024, 31.6.2024, 2.1.2024 und 5.12.2026")], "h string, t string")
    row = d.select(pagefn.links(F.col("h")), pagefn.frames(F.col("h")), F.transform(pagefn.json_ld_events(F.col("h")), lambda e: e["name"]), pagefn.future_dates(F.col("t"), F.lit("2024-06-01").cast("date"))).first()
    assert row[0] == ["/x", "/y"] and row[1] == ["/f"] and sorted(row[2]) == ["A", "B", "C"] and row[3] == 1
    row = spark.range(1).select(pagefn.kind_of(F.lit("Text/HTML; charset=utf-8")), pagefn.kind_of(F.lit("image/png")), pagefn.failure_class(F.lit(410)), pagefn.failure_class(F.lit(500)), *[pagefn.bot_wall(F.lit(t)) for t in ("Just a moment...\nEnable JavaScript", "Kurse und Performance, sicher", "Checking your browser" + " x" * 3000)]).first()
    assert tuple(row) == ("html", None, "permanent", "temporary", True, False, False)
