"""Readers for the table directory a query is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Table ``name`` of ``directory``: a Parquet file or folder."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
