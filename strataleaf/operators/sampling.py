"""Deterministic sampling: evenly spaced rows of each group in a declared order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataleaf.operators.ordered import ranked


def evenly(rank: Column, size: Column, wanted: Column) -> Column:
    """Whether the row at ``rank`` is one of ``wanted`` rows evenly spaced among ``size``; all are if there are no more."""
    places = F.transform(F.sequence(F.lit(0), F.greatest(wanted, F.lit(1)) - 1), lambda i: F.floor(i * size.cast("double") / wanted))
    return F.when(wanted <= 0, F.lit(False)).when(wanted >= size, F.lit(True)).otherwise(F.array_contains(places, rank.cast("long")))


def quota_sample(rows: DataFrame, group: list[str], stratum: str, quotas: dict[str, int], order: list[str]) -> DataFrame:
    """WN2, WN4: up to its stratum's quota of evenly spaced rows of each (group, stratum); strata without one give none."""
    pairs = [F.lit(x) for kv in quotas.items() for x in kv]
    wanted = F.try_element_at(F.create_map(*pairs), F.col(stratum))
    numbered = ranked(rows.where(wanted.isNotNull()), [*group, stratum], order)
    return numbered.where(evenly(F.col("rank"), F.col("size"), wanted))
