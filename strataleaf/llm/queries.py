"""The queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataleaf.llm import leakage, lookalikes, markup, tokens, truncation
from strataleaf.sources.tables import table


def _one_form_texts(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame, Callable]:
    blocks = table(spark, directory, "blocks").select("block_id", "body")
    comparisons = table(spark, directory, "comparisons").select("comparison_id", "published_norm", "replayed_norm")
    counts = lookalikes.corpus_counts(
        (blocks, F.col("body")), (comparisons, F.col("published_norm")), (comparisons, F.col("replayed_norm"))
    )
    return blocks, comparisons, lookalikes.one_form(counts)


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    blocks, comparisons, form = _one_form_texts(spark, directory)
    odd = blocks.where("body IS NOT NULL").select("block_id", "body", form("body").alias("one")).where("body <> one")
    pairs = comparisons.where("published_norm <> replayed_norm").select(
        "comparison_id", form("published_norm").alias("a"), form("replayed_norm").alias("b")
    )
    return odd.select(F.lit("block").alias("record_kind"), F.col("block_id").alias("record_id")).unionByName(
        pairs.where("a = b").select(F.lit("comparison").alias("record_kind"), F.col("comparison_id").alias("record_id"))
    )


def p1_texts(spark: SparkSession, directory: str) -> DataFrame:
    """All texts in their one form: ``record_kind, record_id, field, text``."""
    blocks, comparisons, form = _one_form_texts(spark, directory)
    body = blocks.select(F.lit("block").alias("record_kind"), F.col("block_id").alias("record_id"), F.lit("body").alias("field"), form("body").alias("text"))
    norms = comparisons.select(
        F.col("comparison_id").alias("record_id"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("raw")) for c in ("published_norm", "replayed_norm")])).alias("x"),
    )
    return body.unionByName(
        norms.select(F.lit("comparison").alias("record_kind"), "record_id", F.col("x.field").alias("field"), form("x.raw").alias("text"))
    )


def _marked_up(spark: SparkSession, directory: str) -> DataFrame:
    responses = table(spark, directory, "responses").select(
        F.lit("response").alias("record_kind"), F.col("response_id").alias("record_id"), F.col("body").alias("text")
    )
    blocks = table(spark, directory, "blocks").select(
        F.lit("block").alias("record_kind"), F.col("block_id").alias("record_id"), F.col("raw").alias("text")
    )
    return responses.unionByName(blocks)


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return markup.kinds_found(_marked_up(spark, directory), ["record_kind", "record_id"], F.col("text"))


def p2_parts(spark: SparkSession, directory: str) -> DataFrame:
    """The clean text of every response and block, in parts: ``record_kind, record_id, position, kind, text``."""
    return _marked_up(spark, directory).select(
        "record_kind", "record_id", F.posexplode(markup.clean_parts(F.col("text"))).alias("position", "part")
    ).select("record_kind", "record_id", "position", "part.kind", "part.text")


def p7_ids(spark: SparkSession, directory: str) -> DataFrame:
    return tokens.encoded(table(spark, directory, "documents"), ["doc_id"], F.col("text"))


def p7_offsets(spark: SparkSession, directory: str) -> DataFrame:
    """Where each token begins and ends in its text, in bytes and in characters."""
    return tokens.encoded(table(spark, directory, "documents"), ["doc_id"], F.col("text"), offsets=True).select("doc_id", "starts", "ends", "first_chars", "end_chars")


def p7_round_trip(spark: SparkSession, directory: str) -> DataFrame:
    """Decoded texts; equal to those encoded, but that null has become empty."""
    return tokens.decoded(p7_ids(spark, directory), ["doc_id"], F.col("ids"))


def _leaked(spark: SparkSession, directory: str) -> DataFrame:
    return leakage.leaked(
        table(spark, directory, "documents"), "doc_id", F.col("text"), table(spark, directory, "bench_items"), "item_id", "item_text", "answer_text"
    )


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    return _leaked(spark, directory).select("doc_id", "item_id")


def p8_report(spark: SparkSession, directory: str) -> DataFrame:
    """How many documents hold each item, how much of it, and how many its answer too."""
    return (
        _leaked(spark, directory)
        .groupBy("item_id")
        .agg(
            F.count(F.lit(1)).alias("documents"),
            F.round(F.max("coverage"), 4).alias("most"),
            F.count_if("holds_answer").alias("with_answer"),
        )
    )


def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    return truncation.truncated(table(spark, directory, "documents"), ["doc_id"], F.col("text")).where("cut").select("doc_id")


def p9_rates(spark: SparkSession, directory: str) -> DataFrame:
    """How many of each source's documents there are, how many are cut, of these how many by a near-copy that goes on, and
    their part."""
    return (
        truncation.truncated(table(spark, directory, "documents"), ["doc_id", "source"], F.col("text"))
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("documents"), F.count_if("cut").alias("cut"), F.count_if("by_copy").alias("by_copy"))
        .withColumn("rate", F.col("cut") / F.col("documents"))
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_texts": p1_texts,
    "p2_found": p2_found,
    "p2_parts": p2_parts,
    "p7_ids": p7_ids,
    "p7_offsets": p7_offsets,
    "p7_round_trip": p7_round_trip,
    "p8_found": p8_found,
    "p8_report": p8_report,
    "p9_found": p9_found,
    "p9_rates": p9_rates,
}
ORACLES: dict[str, str] = {
    "p7_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
