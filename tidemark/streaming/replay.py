"""Replaying a table as a stream of several batches, so that state, time-outs and restarts are met."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_batches(rows: DataFrame, slot: Column, path: str) -> int:
    """Writes ``rows`` under ``path``, a file per ``slot`` (whole numbers), for a stream to read in that order; returns their number.

    A stream takes files by their time of change, so these times are set, a second apart, to rise with the slot. Later slots may be added to a folder.
    """
    spark = rows.sparkSession
    dealt = rows.withColumn("slot", slot.cast("long"))
    dealt.repartition("slot").write.partitionBy("slot").mode("append").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = fs.listFiles(at, True)
    n = 0
    while files.hasNext():  # a file per batch, not per row
        file = files.next().getPath()
        if file.getName().endswith(".parquet"):
            fs.setTimes(file, 1_000_000_000_000 + 1000 * int(file.getParent().getName().removeprefix("slot=")), -1)
            n += 1
    return n


def batches(spark: SparkSession, path: str, schema, per: int = 1) -> DataFrame:
    """The files of ``write_batches`` as a stream, ``per`` of them a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per).option("recursiveFileLookup", "true").parquet(path)


def collected(stream: DataFrame, out: str, state: str) -> DataFrame:
    """Runs a stream over what its source holds by now, one batch after the other, and returns all that ``out`` has got so far. A later run
    with the same ``state`` goes on where this one ended."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
