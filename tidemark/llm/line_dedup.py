"""Line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, LOWER, SPACE, UPPER, drop, written


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


class LineRuns:
    """Sorted runs (hash, n_docs, holder) in levels; a level of ``fanout`` runs is merged into the next.

    ``n_docs`` counts documents holding the line; ``holder`` is the document that first brought it,
    null in a run that only adds to a count. Every run is a Parquet table sorted by hash.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]

    def _union(self, runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        return self._union(runs).groupBy("hash").agg(F.sum("n_docs").alias("n_docs"), F.max("holder").alias("holder"))

    def add(self, batch: DataFrame) -> DataFrame:
        """Takes a batch of (hash, doc_id) and adds a run; returns the run, which lasts until it is compacted.

        The batch's hashes are merge-anti-joined with the runs: those that no run knows get the
        batch's largest doc_id as their holder, the others only add to the count.
        """
        per = batch.distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("holder"))
        runs = [r for level in self.levels for r in level]
        alone = None
        if runs:
            alone = per = written(per)
            known = self._union(runs).where(F.col("holder").isNotNull()).select("hash")
            fresh = per.join(known.hint("merge"), "hash", "left_anti")
            seen = per.join(known.hint("merge"), "hash", "left_semi").withColumn("holder", F.lit(None).cast("long"))
            per = fresh.unionByName(seen)
        run = written(per.sortWithinPartitions("hash"))
        drop(alone)
        self.levels[0].append(run)
        self.compact()
        return run

    def compact(self) -> None:
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                merged = written(self._merged(self.levels[k]).sortWithinPartitions("hash"))
                drop(*self.levels[k])
                self.levels[k] = []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(merged)

    def all(self) -> DataFrame:
        """One row per hash over all levels."""
        runs = [r for level in self.levels for r in level]
        return self._merged(runs) if runs else self.spark.createDataFrame([], "hash binary, n_docs long, holder long")


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3) -> DataFrame:
    """``docs`` with their kept text in ``text``, and n_lines and n_dropped (long); columns of these two names are replaced.

    A line whose key has at least ``min_chars`` code points and stands in at least ``min_docs`` documents stays only in the largest
    doc_id holding it. Keys are compared by their MD5 (128 bits). Documents go in batches of falling doc_id, so that the first batch with
    a line holds it in its largest document. Null or empty text is one empty line and becomes ""; very long texts count in whole.
    Rows sharing a doc_id count as one document; their lines are judged alike. Rows with a null doc_id count as document -2^63.
    Other columns stay as they are; an empty table gives no rows.
    """
    docs = docs.drop("n_lines", "n_dropped")
    spark = docs.sparkSession
    columns = docs.columns
    whole = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.xxhash64(whole).alias("text_hash"), F.posexplode(F.split(whole, "\n", -1)).alias("pos", "line")
    ).withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    lines = keyed.select("doc_id", "text_hash", "pos", F.unhex(F.md5("key")).alias("hash"))
    cuts = docs.select(F.col(doc_id).cast("long").alias("d")).approxQuantile("d", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    batch = F.lit(0)
    for cut in sorted(set(cuts)):
        batch = batch + F.when(F.col("doc_id") <= F.lit(int(cut)), 1).otherwise(0)
    lines = written(lines.withColumn("batch", batch.cast("int")), "batch")
    runs = LineRuns(spark, fanout)
    for b in range(len(set(cuts)) + 1):
        runs.add(lines.where(F.col("batch") == b).select("hash", "doc_id"))
    common = written(runs.all().where(F.col("n_docs") >= min_docs).select("hash", "holder"))
    drop(*[run for level in runs.levels for run in level])
    dropped = written(
        lines.join(bounded(common, 100_000), "hash")  # a line of very many documents is no task of its own
        .where(F.col("doc_id") != F.col("holder"))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("pos").alias("dropped"))
    )
    drop(lines, common)
    # The row travels as one value, so that no column of it can clash with ours.
    rows = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), F.coalesce(docs[doc_id].cast("long"), F.lit(-(2**63))).alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("whole"))
    rows = rows.withColumns({"text_hash": F.xxhash64("whole"), "lines": F.split("whole", "\n", -1)})
    both = rows.join(dropped, ["doc_id", "text_hash"], "left")
    left = F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), dropped), i -> lines[i]), '\\n')")
    kept = F.when(F.col("dropped").isNull(), F.col("whole")).otherwise(left)
    rest = [F.col("row").getField(c).alias(c) if c != text else kept.alias(text) for c in columns]
    gone = F.when(F.col("dropped").isNull(), F.lit(0)).otherwise(F.size("dropped"))
    return both.select(*rest, F.size("lines").cast("long").alias("n_lines"), gone.cast("long").alias("n_dropped"))
