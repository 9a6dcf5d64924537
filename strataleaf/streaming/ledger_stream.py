"""The mirror's ledger kept by Structured Streaming: new fetches fold into the state of each page."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOG = "fetch_id bigint, url string, status int, sha256 string, fetched_at timestamp"


def read_log(spark: SparkSession, path: str, files: int = 1000, schema: str | T.StructType = LOG) -> DataFrame:
    """A folder of Parquet files with fetches, read as they come, so many files in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values(["fetched_at", "fetch_id"])
    told = []
    for status, digest in zip(rows["status"], rows["sha256"]):
        if status == 304 and known is not None:
            told.append("revalidated")
        elif digest is None or pd.isna(digest):
            told.append("missing")
        else:
            told.append("first" if known is None else "revalidated" if known == digest else "changed")
            known = digest
    state.update((known,))
    yield pd.DataFrame({"fetch_id": rows["fetch_id"], "url": key[0], "refresh": told})


def refresh_stream(log: DataFrame) -> DataFrame:
    """ST2 over a stream: ``fetch_id, url, refresh`` as in :func:`strataleaf.operators.ledger.refreshes`.

    The state of a page is its last known hash. Fetches are put in order within a batch; one that comes in a later
    batch than a younger fetch of its page is judged by the state it meets.
    """
    keyed = log.where("url IS NOT NULL").groupBy("url")
    return keyed.applyInPandasWithState(_fold, "fetch_id bigint, url string, refresh string", "known string", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """ST1: fold all that has come since the checkpoint into ``path`` and stop."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
    query.awaitTermination()


def append_found(stream: DataFrame, queue_path: str, checkpoint: str, key: str) -> None:
    """ST7: newly found items appended to the queue, each once, by an anti-join in each batch."""

    def append(batch: DataFrame, _: int) -> None:
        known = batch.sparkSession.read.parquet(queue_path).select(key)
        batch.dropDuplicates([key]).join(known, key, "left_anti").write.mode("append").parquet(queue_path)

    stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def fetches_by_hour(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Fetches of each status in each hour, late ones taken in for a time."""
    return log.withWatermark("fetched_at", late).groupBy(F.window("fetched_at", "1 hour").alias("hour"), "status").agg(F.count(F.lit(1)).alias("n"))
