"""Later linkage stages, planes and graded cases."""

from datetime import date

from pyspark.sql import functions as F

from tidemark.functions import textfn
from tidemark.operators import linkage, measures, timetable


def days(*d):
    return [date(2024, 6, x) for x in d]


def test_link_by_title(spark):
    kind = "id long, v string, title string, days array<date>"
    old = spark.createDataFrame([(1, "a", "Yoga Park", days(1, 8, 15)), (2, "a", "Chor Abend", days(2)), (3, "a", "Chor Abend", days(2)), (4, "b", "Kino", days(3))], kind).withColumnRenamed("id", "old_id")
    new = spark.createDataFrame([(11, "a", "Park Yoga", days(8, 15)), (12, "a", "Chor Abend neu", days(2, 9)), (13, "b", "Theater", days(3))], kind).withColumnRenamed("id", "new_id")
    similar = F.arrays_overlap(textfn.keywords(F.col("old_title")), textfn.keywords(F.col("new_title")))
    assert {tuple(r) for r in linkage.link_by_title(old, new, ["v"], similar).collect()} == {(11, 1)}  # the choirs are ambiguous


def test_one_unit_per_row(spark):
    rows = spark.createDataFrame([("e1", "u1", True, 9), ("e1", "u2", False, 1), ("e1", "u3", False, 1), ("e2", "u3", False, 1), ("e3", "u1", True, 1)], "e string, u string, failed boolean, fit int")
    got = {(r["e"], r["u"]) for r in linkage.one_unit_per_row(rows, ["e"], "u", F.col("failed"), F.col("fit"), F.col("u")).collect()}
    assert got == {("e1", "u3"), ("e2", "u3"), ("e3", "u1")}


def test_planes(spark):
    cells = spark.createDataFrame([("r", i, (i * 37) % 256) for i in range(20)] + [("s", 0, 255)], "r string, c long, v int")
    planes = timetable.encoded_planes(cells, "r", "c", "v")
    assert {tuple(x) for x in timetable.decoded_planes(planes, "r").collect()} == {("r", i, (i * 37) % 256) for i in range(20)} | {("s", 0, 255)}


def test_graded_cases(spark):
    e = spark.createDataFrame([(1, "c", "t1", "Yoga"), (2, "c", "t1", "Chor"), (3, "c", "t2", "Kino"), (4, "d", "t1", "x")], "exp_id long, k string, t string, title string")
    p = spark.createDataFrame([(1, "c", "t1", "Chor"), (2, "c", "t1", "Malen"), (3, "c", "t3", "Kino"), (4, "f", "t1", "y")], "pred_id long, k string, t string, title string")
    got = {r["k"]: (r["expected"], r["predicted"], r["hits"]) for r in measures.graded_cases(e, p, ["k", "t"], F.col("exp_title") == F.col("pred_title")).collect()}
    assert got == {"c": (3, 3, 2), "d": (1, 0, 0), "f": (0, 1, 0)}
