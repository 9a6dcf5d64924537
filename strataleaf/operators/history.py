"""History of changing attributes, with the period of each version, from periodic snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attribute_history(
    snapshots: DataFrame,
    key: Mapping[str, Column],
    seq: Column,
    attributes: Mapping[str, Column],
    order: Sequence[Column],
    numbers: Sequence[int],
) -> DataFrame:
    """One row for each longest run of snapshots in which an attribute of a key has one value.

    Gaps and islands: ``lag`` compares the hash of the attribute with that of the snapshot before, a running sum of
    the changes numbers the islands, and the least and greatest snapshot of each island give its period. Absence and
    null end a period and give none.

    :param key: the entity's key; rows in which a part of it is null are left out.
    :param seq: the snapshot's number, one of ``numbers``; rows with another number are left out.
    :param attributes: the values whose history is kept; compared by a 128-bit hash of their text.
    :param order: of several rows of one key in a snapshot the last by these columns counts (null is earliest), also
        where its attributes are null; put a unique id last to settle ties.
    :param numbers: the delivered snapshots in order; two snapshots are consecutive if their numbers are so here.
    :returns: the key's columns, ``attribute``, ``from_seq`` and ``to_seq``: the first snapshot in which the value no
        longer holds, 0 if it holds in the last of ``numbers``. An empty table gives no rows.

    Scale: hot keys are reduced to one row per snapshot before the only shuffle of whole rows, and values to hashes
    before that; a window then holds at most ``len(numbers)`` rows.
    """
    names, parts, numbers = list(attributes), list(key), list(numbers)
    place = {n: i for i, n in enumerate(numbers)}
    ordinal = F.create_map(*[F.lit(x) for pair in place.items() for x in pair])
    row = F.struct(
        *[c.alias(f"o{i}") for i, c in enumerate(order)],
        *[F.unhex(F.md5(c.cast("string"))).alias(f"a{i}") for i, c in enumerate(attributes.values())],
    )
    # ids are renamed so that no column of the key can clash with those made here
    current = (
        snapshots.select(
            *[c.alias(f"k{i}") for i, c in enumerate(key.values())],
            F.try_element_at(ordinal, seq.cast("int")).alias("at"),
            row.alias("row"),
        )
        .dropna(subset=[*[f"k{i}" for i in range(len(parts))], "at"])
        .groupBy(*[f"k{i}" for i in range(len(parts))], "at")
        .agg(F.max("row").alias("row"))
    )
    keys = [f"k{i}" for i in range(len(parts))]
    over = Window.partitionBy(*keys).orderBy("at")
    values = [f"a{i}" for i in range(len(names))]
    seen = current.select(*keys, "at", *[F.col(f"row.{a}").alias(a) for a in values])
    breaks = {
        f"b{i}": F.when((F.col("at") - F.lag("at").over(over) == 1) & (F.col(a) == F.lag(a).over(over)), 0).otherwise(1)
        for i, a in enumerate(values)
    }
    islands = seen.repartition(*keys).withColumns(breaks).withColumns({f"g{i}": F.sum(f"b{i}").over(over) for i in range(len(names))})
    long = islands.select(
        *keys,
        "at",
        F.explode(
            F.filter(
                F.array(
                    *[
                        F.struct(F.lit(n).alias("attribute"), F.when(F.col(f"a{i}").isNotNull(), F.col(f"g{i}")).alias("island"))
                        for i, n in enumerate(names)
                    ]
                ),
                lambda x: x["island"].isNotNull(),
            )
        ).alias("x"),
    ).select(*keys, "at", "x.*")
    number = lambda at: F.element_at(F.array(*[F.lit(n) for n in numbers]), at + 1)
    return (
        long.groupBy(*keys, "attribute", "island")
        .agg(F.min("at").alias("first"), F.max("at").alias("last"))
        .select(
            *[F.col(k).alias(p) for k, p in zip(keys, parts)],
            "attribute",
            number(F.col("first")).alias("from_seq"),
            F.when(F.col("last") + 1 < len(numbers), number(F.col("last") + 1)).otherwise(0).alias("to_seq"),
        )
    )
