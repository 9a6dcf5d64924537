"""Aggregates over labelled cases, the work queue and the mirror."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataleaf.functions import scalars as S
from strataleaf.operators.match import EXCLUDED


def excluded(classification: Column) -> Column:
    return F.coalesce(classification.isin(*EXCLUDED), F.lit(False))


def class_counts(cases: DataFrame) -> DataFrame:
    """AG1, SNK3: cases of each label, with the first case of each, by which equals are ordered."""
    return cases.groupBy("classification").agg(F.count(F.lit(1)).alias("n"), F.min("case_idx").alias("first_idx"))


def tallies(cases: DataFrame, *keys: str) -> DataFrame:
    """AG2, D8: attempted, matched and excluded cases by each key apart and overall: one pass with grouping sets.

    ``grouping`` names the key that a row counts by; ``value`` is null overall.
    """
    sets = [[k] for k in keys] + [[]]
    out = F.lit(None).cast("string")
    named = F.lit("all")
    for k in keys:
        named = F.when(F.grouping(k) == 0, k).otherwise(named)
        out = F.when(F.grouping(k) == 0, F.col(k)).otherwise(out)
    gone = excluded(F.col("classification"))
    return (
        cases.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys])
        .agg(
            named.alias("grouping"),
            out.alias("value"),
            F.count_if(~gone).alias("attempted"),
            F.count_if(~gone & F.col("normalized_match")).alias("matched"),
            F.count_if(gone).alias("excluded"),
        )
        .drop(*keys)
    )


def assembly_availability(cases: DataFrame) -> DataFrame:
    """AG3: per assembly of the last Act, cases whose Act is online and whose isn't."""
    known = cases.where("terminal_pa IS NOT NULL").withColumn("ga", S.assembly_of(F.col("terminal_pa")))
    gone = F.col("classification").isin("ACT_NOT_ONLINE")
    return known.groupBy("ga").agg(F.count_if(~gone).alias("online"), F.count_if(gone).alias("not_online"))


def headline(cases: DataFrame) -> DataFrame:
    """AG4, AG5, AG13: the run in one row: counts, four match rates and the Wilson interval of the attempted one."""
    gone = excluded(F.col("classification"))
    structural = F.col("classification").isin("REPEALED_STUB", "RENUMBERED")
    matched = F.coalesce(F.col("normalized_match"), F.lit(False)) & ~gone
    rate = lambda n, of="matched": F.coalesce(F.try_divide(F.col(of), n), F.lit(0.0))
    counted = cases.agg(
        F.count(F.lit(1)).alias("sampled"),
        F.count_if(~gone).alias("attempted"),
        F.count_if(gone).alias("excluded_total"),
        F.count_if(F.col("classification") == "UNRECONSTRUCTABLE").alias("unreconstructable"),
        F.count_if(F.col("classification") == "ACT_NOT_ONLINE").alias("not_online"),
        F.count_if(matched).alias("matched"),
        F.count_if(F.coalesce(F.col("exact_match"), F.lit(False)) & ~gone).alias("exact"),
        F.count_if(structural).alias("structural"),
        F.count_if(~gone & F.col("carried_amendment_markup")).alias("markup"),
        F.count_if(matched & F.col("carried_amendment_markup")).alias("markup_matched"),
        F.count_if(~gone & F.col("added_by_this_act")).alias("added"),
        F.count_if(matched & F.col("added_by_this_act")).alias("added_matched"),
    )
    low, high = S.wilson(F.col("matched"), F.col("attempted"))
    return counted.withColumns(
        {
            "rate_fixed": rate(F.col("sampled")),
            "rate_attempted": rate(F.col("attempted")),
            "rate_exact": rate(F.col("attempted"), "exact"),
            "rate_reachable": rate(F.col("attempted") - F.col("structural")),
            "wilson_low": low,
            "wilson_high": high,
        }
    )


def coverage(sections: DataFrame, terminal: Column, floor: int = S.FLOOR_GA) -> DataFrame:
    """AG8: sections by whether their last Act is published: the three counts make up all sections."""
    above = S.assembly_of(terminal) >= floor
    return sections.agg(
        F.count(F.lit(1)).alias("sections"),
        F.count_if(terminal.isNotNull() & above).alias("checkable"),
        F.count_if(terminal.isNotNull() & ~above).alias("below_floor"),
        F.count_if(terminal.isNull()).alias("no_pa"),
        F.count_distinct(F.when(above, S.padded_act(terminal))).alias("acts_at_floor"),
        F.count_distinct(F.when(~above, S.padded_act(terminal))).alias("acts_below"),
    )


def tier_breakdown(queue: DataFrame, mirrored: DataFrame, key: str) -> DataFrame:
    """AG9, JN6: work items and done ones per tier; ``mirrored`` holds the keys that are done."""
    done = mirrored.select(key).distinct().withColumn("__done", F.lit(True))
    return queue.join(done, key, "left").groupBy("tier").agg(F.count("__done").alias("done"), F.count(F.lit(1)).alias("total"))


def floor_probe(probes: DataFrame, mirror: DataFrame, key: str, published: Column, floor: int = S.FLOOR_GA) -> DataFrame:
    """AG10, JN10: probed Acts whose being published disagrees with the floor; probes not mirrored are skipped.

    :returns: one row with ``probed`` and ``disagreements``, sorted by the probes' ``seq``.
    """
    seen = probes.join(mirror.select(key, published.alias("published")), key)
    expected = S.assembly_of(F.col(key)) >= floor
    # fixed values: the two messages
    said = F.when(F.col("published"), f" is available, but predates the {floor}rd GA").otherwise(f" is unavailable, but is at or above the {floor}rd GA")
    told = F.when(F.col("published") != expected, F.struct(F.col("seq"), F.concat(F.col(key), said).alias("told")))
    return seen.agg(F.count(F.lit(1)).alias("probed"), F.transform(F.array_sort(F.collect_list(told)), lambda x: x["told"]).alias("disagreements"))


def progress(counters: DataFrame) -> DataFrame:
    """AG11: rate, part done and time to go of runs: ``done, total, elapsed_s`` with guards against zero."""
    rate = F.try_divide(F.col("done"), F.col("elapsed_s"))
    return counters.withColumns(
        {
            "rate": F.coalesce(rate, F.lit(0.0)),
            "part": F.coalesce(F.try_divide(F.col("done"), F.col("total")), F.lit(0.0)),
            "to_go_s": F.try_divide(F.col("total") - F.col("done"), rate),
        }
    )
