"""What several corpus operators share: scratch tables, word and line rules, ranks."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# The ASCII white space that parts words and pads lines.
SPACE = " \t\n\x0b\x0c\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_own: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder that the session names; in a folder of our own only where it names none, in local mode (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="spark-")
        base = _own[app]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts the lineage and outlives executors."""
    path = scratch(df.sparkSession)
    out = df.write.partitionBy(partition_by) if partition_by else df.write
    out.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def drop(*tables: DataFrame | None) -> None:
    """Deletes written tables that nothing reads any more: what was made of them has been written."""
    for table in tables:
        path = getattr(table, "_scratch", None)
        if path is not None:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as it takes to be no column of ``df`` (names don't tell capitals apart)."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a written table, to be broadcast if it has at most ``rows`` rows, else for an ordinary join."""
    return F.broadcast(df) if df.count() <= rows else df


def words(text: Column) -> Column:
    """Words of a text (null: none) as an array: runs without ASCII white space."""
    parts = F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE)), WORD_BREAK, -1)
    return F.when(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE)) == "", F.expr("array()").cast("array<string>")).otherwise(parts)


def word_count(text: Column) -> Column:
    """Number of words, without making an array of them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def sub_groups(n: int, per: int = 1) -> int:
    """Into how many parts a group of ``n`` is split so that parts and members per part both grow as its root."""
    return max(1, math.ceil(math.sqrt(n / max(1, per))))


def gapless(df: DataFrame, group: list[str], sub: str, order: list[Column], name: str, counts: DataFrame | None = None) -> DataFrame:
    """Adds ``name``: a gapless rank from 0 inside ``group``, which ``sub`` splits into bounded parts.

    No window holds a whole group: parts are counted, the counts are summed up over the parts,
    and rows are numbered inside their part. ``counts`` may give rows with the same keys from a
    cheaper scan.
    """
    keys = [*group, sub]
    per = (df if counts is None else counts).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*group).orderBy(sub).rowsBetween(W.unboundedPreceding, -1))
    per = per.select(*[F.col(k).alias(f"__{k}") for k in keys], F.coalesce(before, F.lit(0)).alias("__before"))
    ranked = df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    joined = ranked.join(per, same, "left")
    return joined.withColumn(name, F.col("__before") + F.col("__rn") - 1).drop("__before", "__rn", *[f"__{k}" for k in keys])
