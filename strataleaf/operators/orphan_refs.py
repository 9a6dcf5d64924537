"""References to records that do not exist, or did not exist at the time of the reference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataleaf.functions.scalars import in_utc

MATCHES = ("simple", "partial", "full")


def orphan_references(
    references: DataFrame,
    targets: DataFrame,
    reference_key: Sequence[Column],
    target_key: Sequence[Column],
    match: str = "partial",
    at: Column | None = None,
    valid_from: Column | None = None,
    valid_to: Column | None = None,
) -> DataFrame:
    """The rows of ``references`` whose key no row of ``targets`` has at that time, with ``orphan_kind``.

    References are grouped by the null mask of their key; each mask is anti-joined on its non-null columns. So that
    ``references`` is read once, the targets are projected onto every mask in use and the mask is part of the join key.

    ``match`` is as in SQL's foreign keys. ``simple``: a key with a null part is never an orphan. ``partial``: the
    non-null parts must be those of some target. ``full``: a key that is null in part is always an orphan. A key that
    is null in all parts is no reference under any of them.

    A target holds from ``valid_from`` until before ``valid_to``; null is open on that side. ``orphan_kind`` is
    ``missing`` if no target ever has the key, else ``deleted`` if a span with the key has ended by ``at``, else
    ``late``. Without ``at``, or where it is null, only ``missing`` is reported.

    :returns: all columns of ``references`` and ``orphan_kind``; repeated rows stay repeated, and an empty table of
        targets makes every reference ``missing``. ``references`` may have columns of any name but ``orphan_kind``.

    Scale: the targets are aggregated per key before they are joined. No side is told to be broadcast: Spark does so
    below its size threshold and else sorts and merges, where adaptive execution splits a hot key of the references.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    if "orphan_kind" in references.columns:
        raise ValueError("references already has a column orphan_kind")
    size = len(reference_key)
    parts = [f"k{i}" for i in range(size)]
    mask = sum(((c.isNull()).cast("int") * (1 << i) for i, c in enumerate(reference_key)), F.lit(0))
    everything = (1 << size) - 1
    keyed = references.select(
        F.struct(*[F.col(f"`{c}`") for c in references.columns]).alias("row"),
        *[c.cast("string").alias(p) for c, p in zip(reference_key, parts)],
        (at if at is not None else F.lit(None)).cast("timestamp").alias("at"),
        mask.alias("mask"),
    ).where(F.col("mask") != everything)
    if match == "simple":
        keyed = keyed.where("mask = 0")
    masks = range(everything) if match == "partial" else [0]

    spans = targets.select(
        *[c.cast("string").alias(p) for c, p in zip(target_key, parts)],
        (valid_from if valid_from is not None else F.lit(None)).cast("timestamp").alias("begins"),
        (valid_to if valid_to is not None else F.lit(None)).cast("timestamp").alias("ends"),
    )
    projections = F.array(
        *[
            F.struct(
                F.lit(m).alias("mask"),
                *[(F.lit(None).cast("string") if m >> i & 1 else F.col(p)).alias(p) for i, p in enumerate(parts)],
            )
            for m in masks
        ]
    )
    known = (
        spans.select(F.explode(projections).alias("p"), "begins", "ends")
        .select("p.*", "begins", "ends")
        .where(F.expr(" AND ".join(f"({p} IS NOT NULL OR (mask & {1 << i}) > 0)" for i, p in enumerate(parts))))
        .distinct()
    )

    def same(a: DataFrame, b: DataFrame) -> Column:
        on = a["mask"] == b["mask"]
        for p in parts:
            on = on & a[p].eqNullSafe(b[p])
        return on

    holding = known.alias("t")
    holds = (holding["begins"].isNull() | (holding["begins"] <= keyed["at"])) & (holding["ends"].isNull() | (keyed["at"] < holding["ends"]))
    not_held = keyed.join(holding, same(keyed, holding) & (keyed["at"].isNull() | holds), "left_anti")
    ever = known.groupBy("mask", *parts).agg(F.min("ends").alias("first_end"), F.lit(True).alias("occurs"))
    kind = (
        F.when(ever["occurs"].isNull(), "missing").when(ever["first_end"] <= not_held["at"], "deleted").otherwise("late")
    )
    return not_held.join(ever, same(not_held, ever), "left").select("row.*", kind.alias("orphan_kind"))


def orphan_counts(orphans: DataFrame, table: Column, at: Column) -> DataFrame:
    """``ref_table, month, orphan_kind, n``: orphans per table, month in UTC and kind; a null time gives a null month."""
    return (
        orphans.groupBy(
            table.alias("ref_table"), F.date_format(in_utc(at), "yyyy-MM").alias("month"), "orphan_kind"
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
