"""All queries of the core library and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from strataleaf.plans import dealt, records, streams, texts
from strataleaf.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dealt.QUERIES | texts.R.queries | records.R.queries | streams.R.queries
ORACLES: dict[str, str] = dealt.ORACLES | texts.R.oracles | records.R.oracles | streams.R.oracles


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query``, with this package sent to the workers first."""

    @wraps(query)
    def run(spark: SparkSession, directory: str) -> DataFrame:
        ship(spark)
        return query(spark, directory)

    return run
