"""What changed between consecutive full snapshots of one table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many snapshot numbers are looked up in a literal; beyond, they are joined.
MOST_LITERALS = 1000


def _with_next(rows: DataFrame, seq: str, numbers: DataFrame) -> DataFrame:
    """``rows`` with ``next``, the number after ``seq`` among those delivered, and ``first``, whether it is the first."""
    known = sorted(r[0] for r in numbers.limit(MOST_LITERALS + 1).collect())
    if 1 < len(known) <= MOST_LITERALS:
        follows = F.create_map(*[F.lit(n) for pair in zip(known, known[1:]) for n in pair])
        return rows.withColumns({"next": F.try_element_at(follows, F.col(seq)), "first": F.col(seq) == known[0]})
    if len(known) <= 1:
        return rows.withColumns({"next": F.lit(None).cast(dict(rows.dtypes)[seq]), "first": F.lit(True)})
    order = Window.orderBy(seq)
    return rows.join(numbers.select(seq, F.lead(seq).over(order).alias("next"), (F.row_number().over(order) == 1).alias("first")), seq)


def snapshot_changes(
    snapshots: DataFrame, key: Column, seq: Column, fields: Mapping[str, Column], order: Sequence[Column]
) -> DataFrame:
    """The records added, removed or changed between each delivered snapshot and the one delivered before it.

    Every row becomes signed cells: a presence marker and one cell (field, value) per field, ``+1`` for the snapshot
    that holds it and ``-1`` for the next delivered one. Sums per (key, pair of snapshots, cell) cancel what both
    hold; what is left classifies the record and names the changed fields.

    :param key: the record's key; rows with a null key are no records.
    :param seq: the snapshot's number; numbers that do not occur were not delivered, and one whose rows have no key was
        delivered empty. Rows without a number are left out.
    :param fields: the compared values, null being a value like any other.
    :param order: of several rows of one key in a snapshot the one that is last by these columns counts (null is
        earliest); put a unique id last to settle ties.
    :returns: ``key, seq, change_kind, changed_fields``; ``seq`` is the later snapshot, ``change_kind`` is ``added``,
        ``removed`` or ``changed``, ``changed_fields`` is sorted and empty unless changed. The first snapshot, a
        single one and an empty table give no rows. Other columns of the input play no part.

    Scale: a hot key is reduced to one row per snapshot before the first shuffle (``max`` of a struct combines on the
    map side). The second shuffle moves one row per (key, snapshot); cells are made and summed where it put them.
    """
    names = list(fields)
    row = F.struct(
        *[c.alias(f"o{i}") for i, c in enumerate(order)],
        *[c.cast("string").alias(f"f{i}") for i, c in enumerate(fields.values())],
    )
    current = (
        snapshots.select(key.alias("key"), seq.alias("seq"), row.alias("row"))
        .where(F.col("key").isNotNull() & F.col("seq").isNotNull())
        .groupBy("key", "seq")
        .agg(F.max("row").alias("row"))
        .select("key", "seq", *[F.col(f"row.f{i}").alias(f"f{i}") for i in range(len(names))])
    )
    delivered = snapshots.select(seq.alias("seq")).where("seq IS NOT NULL").distinct()
    placed = _with_next(current, "seq", delivered).repartition("key")
    cells = F.array(
        F.struct(F.lit(-1).alias("field"), F.lit(None).cast("string").alias("value")),
        *[F.struct(F.lit(i).alias("field"), F.col(f"f{i}").alias("value")) for i in range(len(names))],
    )
    signs = F.array(
        F.struct(F.when(~F.col("first"), F.col("seq")).alias("pair"), F.lit(1).alias("sign")),
        F.struct(F.col("next").alias("pair"), F.lit(-1).alias("sign")),
    )
    left = (
        placed.select("key", cells.alias("cells"), F.explode(signs).alias("s"))
        .where("s.pair IS NOT NULL")
        .select("key", F.col("s.pair").alias("pair"), F.col("s.sign").alias("sign"), F.explode("cells").alias("cell"))
        .groupBy("key", "pair", "cell")
        .agg(F.sum("sign").alias("left"))
        .where("left <> 0")
    )
    presence = F.sum(F.when(F.col("cell.field") == -1, F.col("left")).otherwise(0))
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("cell.field") + 1)
    changed = F.array_sort(F.collect_set(F.when(F.col("cell.field") >= 0, label)))
    kind = F.when(F.col("presence") > 0, "added").when(F.col("presence") < 0, "removed").otherwise("changed")
    return (
        left.groupBy("key", "pair")
        .agg(presence.alias("presence"), changed.alias("fields"))
        .select(
            "key",
            F.col("pair").alias("seq"),
            kind.alias("change_kind"),
            F.when(F.col("presence") == 0, F.col("fields")).otherwise(F.array().cast("array<string>")).alias("changed_fields"),
        )
    )
