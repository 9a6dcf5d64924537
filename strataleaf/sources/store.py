"""Reading and writing of results: work queues, runs, reports and the store of bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUEUE = "seq bigint, kind string, url string, tier int, label string, act_id string, chapter_id string, pa_number string"


def write_queue(queue: DataFrame, path: str) -> None:
    """SRC7: a work queue as JSON lines; what was there is replaced."""
    queue.select(*[name for name in (part.split()[0] for part in QUEUE.split(", ")) if name in queue.columns]).write.mode("overwrite").json(path)


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUEUE).json(path)


def write_results(cases: DataFrame, summaries: dict[str, DataFrame], path: str) -> None:
    """SNK1: a run's cases and each of its summaries in folders of their own, replaced as a whole."""
    cases.write.mode("overwrite").parquet(f"{path}/cases")
    for name, summary in summaries.items():
        summary.write.mode("overwrite").parquet(f"{path}/{name}")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """SRC8: the cases of a run's one JSON document ``{summary, cases}``."""
    return spark.read.option("multiLine", True).json(path).select(F.inline("cases"))


def write_text_report(lines: DataFrame, order: list[str], line: str, path: str) -> None:
    """SNK2, SNK4: lines of text in order, in parts whose names are in that order; what was there is replaced."""
    lines.orderBy(*order).select(line).write.mode("overwrite").text(path)


def write_run_summary(summary: DataFrame, path: str) -> None:
    """SNK5: the figures of the last run, one row, replaced."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def write_bodies(pages: DataFrame, body: Column, path: str) -> None:
    """SNK6: every body once, under its hash, in folders by the hash's first two digits."""
    stored = pages.select(F.sha2(body, 256).alias("sha256"), body.alias("body")).where("body IS NOT NULL")
    once = stored.groupBy("sha256").agg(F.first("body").alias("body"))
    once.withColumn("prefix", F.substring("sha256", 1, 2)).repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(path)


def mismatch_lines(cases: DataFrame) -> DataFrame:
    """SNK2: ``case_idx, line``: what is told of each case that has a diff or is neither matched nor excluded."""
    from strataleaf.operators.metrics import excluded

    open_ = (F.coalesce(F.col("diff"), F.lit("")) != "") | ~(F.col("classification").isin("MATCH") | excluded(F.col("classification")))
    head = F.format_string("=== %s [%s] P.A. %s", F.col("citation"), F.col("classification"), F.coalesce("terminal_pa", F.lit("-")))
    told = F.concat_ws("\n", head, "note", F.array_join(F.transform("changes", lambda c: F.concat(F.lit("  * "), c)), "\n"), "diff")
    return cases.where(open_).select("case_idx", told.alias("line"))


def markdown_table(rows: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    """SNK7: each row as a line of a Markdown table, numbered in order; null as a dash, bars escaped.

    For reports of aggregates: the numbering puts all rows into one task.
    """
    from pyspark.sql import Window

    cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("-")) for c in columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return rows.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("line_no"), line.alias("line"))


def status_lines(tiers: DataFrame) -> DataFrame:
    """SNK4: the mirror's state as lines of Markdown, made whole from one breakdown ``tier, done, total``."""
    from strataleaf.functions.scalars import percent

    rows = tiers.unionByName(tiers.agg(F.lit(None).cast("int").alias("tier"), F.coalesce(F.sum("done"), F.lit(0)).alias("done"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")))
    named = rows.withColumn("name", F.coalesce(F.col("tier").cast("string"), F.lit("all"))).withColumn("part", percent(F.col("done"), F.col("total")))
    return markdown_table(named, ["name", "done", "total", "part"], [F.asc_nulls_last("tier")])
