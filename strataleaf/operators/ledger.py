"""Upkeep of a mirror from logs of fetches: what remains, what changed, what was stored once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataleaf.operators.ordered import with_last_before


def remaining(queue: DataFrame, mirrored: DataFrame, key: str) -> DataFrame:
    """ST1, JN6: the work items whose key isn't mirrored; items without a key remain."""
    return queue.join(mirrored.select(key).distinct(), key, "left_anti")


def appended(queue: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """ST7, JN8: newly found items, each once, that the queue doesn't hold yet."""
    return found.dropDuplicates([key]).join(queue.select(key).distinct(), key, "left_anti")


def refreshes(log: DataFrame, url: Column, at: Column, status: Column, digest: Column, ids: list[str]) -> DataFrame:
    """ST2: each fetch of a page as ``first``, ``revalidated`` (304 or the same hash), ``changed`` or ``missing``.

    ``ids`` are columns of the log that come out and, in their order, settle ties in time. A fetch with null hash is missing
    unless its status is 304; it leaves the known hash as it is.
    """
    rows = log.select(*ids, url.alias("__url"), at.alias("__at"), status.alias("__status"), digest.alias("__digest")).where("__url IS NOT NULL")
    rows = with_last_before(rows, ["__url"], ["__at", *ids], F.col("__digest"), "__known")
    kind = (
        F.when((F.col("__status") == 304) & F.col("__known").isNotNull(), "revalidated")
        .when(F.col("__digest").isNull(), "missing")
        .when(F.col("__known").isNull(), "first")
        .when(F.col("__known") == F.col("__digest"), "revalidated")
        .otherwise("changed")
    )
    return rows.select(*ids, kind.alias("refresh"))


def too_soon(log: DataFrame, host: Column, at: Column, ids: list[str], delay_s: float = 10.0) -> DataFrame:
    """ST3: fetches that followed the one before them on their host in less than the delay, with the seconds between."""
    rows = log.select(*ids, host.alias("__host"), F.unix_micros(at.cast("timestamp")).alias("__at")).where("__at IS NOT NULL")
    rows = with_last_before(rows, ["__host"], ["__at", *ids], F.col("__at"), "__before")
    gap = (F.col("__at") - F.col("__before")) / 1e6
    return rows.withColumn("gap_s", gap).where(F.col("gap_s") < delay_s).select(*ids, "gap_s")


def stored_once(pages: DataFrame, digest: Column, at: Column, url: Column) -> DataFrame:
    """ST8, SNK6: one object for each content hash: ``sha256, urls, first_seen``, laid out by the hash's first two digits."""
    return (
        pages.select(digest.alias("sha256"), url.alias("url"), at.alias("at"))
        .where("sha256 IS NOT NULL")
        .groupBy("sha256")
        .agg(F.count_distinct("url").alias("urls"), F.min("at").alias("first_seen"))
        .withColumn("prefix", F.substring("sha256", 1, 2))
    )


def stop_reason(done: Column, total: Column, elapsed_s: Column, limit_s: Column, stop_file: Column, throttled: Column) -> Column:
    """ST5, ST6: why a run stopped, in the order in which a run looks."""
    return (
        F.when(F.coalesce(throttled, F.lit(False)), "throttled")
        .when(done >= total, "drained")
        .when(elapsed_s >= limit_s, "deadline")
        .when(F.coalesce(stop_file, F.lit(False)), "stop file")
        .otherwise("running")
    )


def body_of(legacy: Column, stored: Column, status: Column, digest: Column) -> Column:
    """SRC2, ST9: the body of a mirrored page: the legacy copy, else the stored object, else empty for a 404 without one."""
    return F.coalesce(legacy, stored, F.when((status == 404) & digest.isNull(), F.lit("")))


def fetch_outcome(status: Column, retry_after: Column, body: Column) -> Column:
    """ST4, ST5: what a fetch's answer asks for: ``throttled`` (stop), ``store``, ``unchanged``, ``empty`` (404) or ``retry``."""
    from strataleaf.functions.scalars import is_throttling

    return (
        F.when(is_throttling(status, retry_after, body), "throttled").when(status == 200, "store").when(status == 304, "unchanged").when(status == 404, "empty").otherwise("retry")
    )
