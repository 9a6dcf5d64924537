"""Queries that run a stream over all that has come and return what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataleaf.functions.references import hash_value, page_url
from strataleaf.plans.records import R as RECORDS
from strataleaf.plans.registry import Registry
from strataleaf.sources.tables import table
from strataleaf.session import shared_folder
from strataleaf.streaming import ledger_stream as T

R = Registry()


def stream_folder(spark: SparkSession) -> str:
    """A new folder below the one all executors share."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _ledger_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "ledger").schema
    log = T.read_log(spark, f"{d}/ledger.parque[t]", schema=schema)  # a pattern, as the table may be one file
    return log.select(
        F.col("ledger_id").alias("fetch_id"), page_url(F.col("url")).alias("url"), "status", hash_value(F.col("sha256")).alias("sha256"), "fetched_at"
    )


@R.query(RECORDS.oracles["refreshes"])
def streamed_refreshes(spark: SparkSession, d: str) -> DataFrame:
    """ST1, ST2: the refreshes of all fetches, folded by a stream with state; equal to the batch operator's."""
    folder = stream_folder(spark)
    T.run_available(T.refresh_stream(_ledger_stream(spark, d)), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").select(F.col("fetch_id").alias("ledger_id"), "refresh")


@R.query("SELECT epoch_ms(date_trunc('hour', make_timestamp(epoch_us(fetched_at)))) AS hour_ms, status, count(*) AS n FROM ledger WHERE fetched_at IS NOT NULL GROUP BY ALL")
def streamed_hours(spark: SparkSession, d: str) -> DataFrame:
    """Fetches of each status in each hour, by a windowed stream with a watermark."""
    folder = stream_folder(spark)
    hours = T.fetches_by_hour(_ledger_stream(spark, d).where("fetched_at IS NOT NULL"))

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    query = hours.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(F.unix_millis("hour.start").alias("hour_ms"), "status", "n")
