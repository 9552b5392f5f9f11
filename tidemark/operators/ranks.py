"""Places in an order without a task that holds all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .lineage import cut


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Adds ``name``: the place from 1 in the ``order`` (ascending, nulls first), within each ``group``.

    Rows are dealt to ranges of group and order; each range numbers its own, after the counts of the ranges before it.
    """
    parts = cut(rows.repartitionByRange(*group, *order).withColumn("__p", F.spark_partition_id()))
    counts = parts.groupBy(*group, "__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*group).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__p").alias("__q"), before.alias("__before"))
    ranked = parts.withColumn("__rn", F.row_number().over(W.partitionBy(*group, "__p").orderBy(*order)))
    same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group] + [F.col("__p") == F.col("__q")]
    return ranked.join(counts, same).select(*rows.columns, (F.col("__rn") + F.col("__before")).alias(name))
