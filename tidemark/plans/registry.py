"""Every query of the library over the driver's tables, with SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import build_queries as _build  # noqa: F401  registers its queries
from . import function_queries as _functions  # noqa: F401  registers its queries
from . import more_queries as _more  # noqa: F401  registers its queries
from . import queries as q
from . import rollup_queries as _rollups  # noqa: F401  registers its queries
from . import site_queries as _site  # noqa: F401  registers its queries
from . import stream_queries as _streams  # noqa: F401  registers its queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(q.ORACLE_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.next_session_by_day(spark, sf_dir)
