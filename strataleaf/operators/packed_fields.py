"""Several values packed into one field: split them, with their positions.

A field is read as atoms, the text between possible delimiters, where a quoted span is one atom. Neighbouring atoms may
belong to one value: a comma parts two values as well as a value from its date. Where to cut is learned from the whole
column by expectation maximisation. A value's likelihood is the frequency of its shape, its text in lower case with
digits as ``9``; a field's is the product over its values, times ``MORE`` for each, a prior for fields of many short
values. The best split of a field is the best path through the lattice of its atoms (Viterbi).

The model has a fixed size: shapes are hashed into ``BUCKETS`` counters, so what is sent to the workers does not grow
with the data. Fields are reduced to distinct shapes of whole fields, with counts, before the learning passes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import exp, inf, log
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataleaf.session import cut_lineage

#: Size of the hashed table of shape frequencies: the model takes 8 bytes times this, whatever the data.
BUCKETS = 1 << 16
#: Atoms that one value can span: the order of the model.
SPAN = 4
#: Learning passes go on until the frequencies of values change by less than this part.
SETTLED = 0.01
#: Prior weight of a value.
MORE = 8.0
#: Atoms of a field from which sums are made of logarithms.
LONG = 50

_SPACE = " \t\r\n\x0b\x0c\x85\xa0  "
#: A quoted span: it opens at the start or after white space or a delimiter and closes before one; a doubled quote inside stands for one.
_TOKEN = re.compile(
    r"""(?P<quoted>(?:(?<![^\s;,|/&])"(?:[^"]|"")*"(?!")|(?<![^\s;,|/&])'(?:[^']|'')*'(?!'))(?=[\s;,|/&.]|$))"""
    r"""|(?P<cut>\s*(?:(?:[;,|&]|/+|[\t\r\n]+|\band\b)\s*)+)"""
)
def shape(text: str) -> str:
    """Lower case, digit runs as ``9``, white space runs as one space."""
    return " ".join(re.sub(r"[0-9]+", "9", text.lower()).split())


def atoms(field: str) -> list[tuple[int, int, bool]]:
    """``(start, end, quoted)`` of each atom.

    Leading and trailing delimiters, and the full stop that ends the field, belong to no atom.
    """
    end = len(field.rstrip(_SPACE + ";,|/&"))
    if end and field[end - 1] == ".":
        end -= 1
    found: list[tuple[int, int, bool]] = []
    at = 0

    def add(start: int, stop: int, quoted: bool) -> None:
        while start < stop and field[start] in _SPACE:
            start += 1
        while stop > start and field[stop - 1] in _SPACE:
            stop -= 1
        if start < stop:
            found.append((start, stop, quoted))

    for m in _TOKEN.finditer(field, 0, end):
        add(at, m.start(), False)
        if m["quoted"] is not None and m.end() - m.start() > 2:
            add(m.start(), m.end(), True)
        at = m.end()
    add(at, end, False)
    return found


class Lattice:
    """The possible values of one shape of field: spans of atoms as ``(first, after the last, bucket)``."""

    __slots__ = ("size", "edges")

    def __init__(self, field: str, joins: re.Pattern[str] | None) -> None:
        parts = atoms(field)
        self.size = len(parts)
        quoted = [q for _, _, q in parts]
        starts = [
            not i or q or quoted[i - 1] or joins is None or joins.match(field, a, b) is None for i, (a, b, q) in enumerate(parts)
        ] + [True]
        self.edges: list[tuple[int, int, int]] = []
        for i in range(self.size):
            if not starts[i]:
                continue
            spanned = 0
            for j in range(i + 1, self.size + 1):
                if j > i + 1 and (quoted[i] or quoted[j - 1]):
                    break
                if starts[j]:
                    text = "Q" if quoted[i] else shape(field[parts[i][0] : parts[j - 1][1]])
                    self.edges.append((i, j, crc32(text.encode()) % BUCKETS))
                spanned += 1
                if spanned >= SPAN and starts[j]:
                    break


def expected(lattice: Lattice, values: list[float]) -> Iterator[tuple[int, float]]:
    """Forward-backward: each possible value's bucket and how often it is expected."""
    if lattice.size > LONG:
        yield from _expected_by_logs(lattice, values)
        return
    weights = [MORE * values[bucket] for _, _, bucket in lattice.edges]
    forward, backward = [0.0] * (lattice.size + 1), [0.0] * (lattice.size + 1)
    forward[0] = backward[lattice.size] = 1.0
    for (i, j, _), w in zip(lattice.edges, weights):
        forward[j] += forward[i] * w
    for (i, j, _), w in zip(reversed(lattice.edges), reversed(weights)):
        backward[i] += backward[j] * w
    if (total := forward[lattice.size]) > 0.0:
        for (i, j, bucket), w in zip(lattice.edges, weights):
            yield bucket, forward[i] * w * backward[j] / total


def _expected_by_logs(lattice: Lattice, values: list[float]) -> Iterator[tuple[int, float]]:
    """The same for long fields, whose products leave the range of floating point numbers."""
    weights = [log(MORE * values[bucket]) for _, _, bucket in lattice.edges]
    forward, backward = [-inf] * (lattice.size + 1), [-inf] * (lattice.size + 1)
    forward[0] = backward[lattice.size] = 0.0
    for (i, j, _), w in zip(lattice.edges, weights):
        forward[j] = np.logaddexp(forward[j], forward[i] + w)
    for (i, j, _), w in zip(reversed(lattice.edges), reversed(weights)):
        backward[i] = np.logaddexp(backward[i], backward[j] + w)
    for (i, j, bucket), w in zip(lattice.edges, weights):
        yield bucket, exp(forward[i] + w + backward[j] - forward[lattice.size])


def best_path(lattice: Lattice, values: np.ndarray) -> list[tuple[int, int]]:
    """Viterbi: the most likely values, as ranges of atoms."""
    best: list[tuple[float, int]] = [(0.0, 0)] + [(-1e300, 0)] * lattice.size
    for i, j, bucket in lattice.edges:
        score = best[i][0] + log(MORE * values[bucket])
        if score > best[j][0]:
            best[j] = (score, i)
    path, at = [], lattice.size
    while at:
        path.append((best[at][1], at))
        at = best[at][1]
    return path[::-1]


def learn(fields: DataFrame, joins: str | None = None) -> np.ndarray:
    """Frequencies of hashed shapes of values, learned from all rows of a column ``field``.

    ``joins`` is as in :func:`split_packed`. An empty table gives even frequencies.
    """
    spark = fields.sparkSession
    pattern = re.compile(joins, re.I) if joins else None
    # all that a lattice is made of: digits and the indent after a line break make no difference
    kept = F.regexp_replace(F.regexp_replace(F.lower("field"), r"[0-9]++", "9"), r"(?: *+\r?\n)++ *+", "\n")
    shapes = cut_lineage(
        fields.where("field IS NOT NULL").groupBy(kept.alias("field")).agg(F.count(F.lit(1)).alias("n"))
    )
    values = np.full(BUCKETS, 1.0 / BUCKETS)
    change = 1.0
    while change > SETTLED:
        before = values
        shared = spark.sparkContext.broadcast(values)

        def counted(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            values = shared.value.tolist()
            sums: dict[int, float] = {}
            for batch in batches:
                for field, n in zip(batch["field"], batch["n"]):
                    for bucket, p in expected(Lattice(field, pattern), values):
                        sums[bucket] = sums.get(bucket, 0.0) + p * n
            yield pd.DataFrame({"bucket": list(sums), "p": list(sums.values())}).astype({"bucket": "int32", "p": "float64"})

        # at most BUCKETS rows, whatever the data
        got = shapes.mapInPandas(counted, "bucket int, p double").groupBy("bucket").agg(F.sum("p").alias("p")).toPandas()
        values = np.full(BUCKETS, 1e-3)
        values[got["bucket"]] += got["p"]
        values /= values.sum()
        change = np.abs(values - before).sum() / 2
        shared.unpersist()
    return values


def _unquoted(text: str, quoted: bool) -> str:
    if quoted:
        text = text[1:-1].replace(text[0] * 2, text[0])
        text = text[:-1] if re.search(r"[0-9]\.$", text) else text
    return " ".join(text.split())


def split_field(field: str, values: list[float], joins: re.Pattern[str] | None = None, memo: dict | None = None) -> list[str]:
    """The values of one field in order; ``memo`` keeps the paths of shapes seen."""
    known = re.sub(r"[0-9]+", "9", field.lower())
    path = memo.get(known) if memo is not None else None
    if path is None:
        path = best_path(Lattice(field, joins), values)
        if memo is not None and len(memo) < 50_000:
            memo[known] = path
    parts = atoms(field)
    return [_unquoted(field[parts[i][0] : parts[j - 1][1]], parts[i][2]) for i, j in path]


def split_packed(
    rows: DataFrame,
    ids: list[str],
    field: Column,
    joins: str | None = None,
    least: int = 1,
) -> DataFrame:
    """``ids..., position, value``: one row for each value of ``field``, position from 1.

    White space runs come out as one space; separators, enclosing quotes and the full stop that ends the field belong
    to no value; a doubled quote inside quotes comes out as one. Null, empty and delimiter-only fields have no values.
    Repeated rows stay repeated. Other columns of ``rows``, of any name, play no part.

    :param joins: a pattern of atoms that only continue a value (its date, its page) and never start one.
    :param least: leave out fields with fewer values.

    Scale: learning passes over the distinct shapes of fields, then one pass over the rows without a shuffle.
    """
    wanted = rows.select(*[F.col(f"`{c}`").alias(f"id{i}") for i, c in enumerate(ids)], field.alias("field")).where("field IS NOT NULL")
    shared = rows.sparkSession.sparkContext.broadcast(learn(wanted, joins))
    pattern = re.compile(joins, re.I) if joins else None

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values = shared.value.tolist()
        memo: dict = {}
        for batch in batches:
            out = [split_field(f, values, pattern, memo) for f in batch.pop("field")]
            batch["value"] = [v if len(v) >= least else [] for v in out]
            yield batch

    kinds = ", ".join(f"id{i} {rows.schema[c].dataType.simpleString()}" for i, c in enumerate(ids))
    return (
        wanted.mapInPandas(split, f"{kinds}, value array<string>")
        .select(*[F.col(f"id{i}").alias(c) for i, c in enumerate(ids)], F.posexplode("value").alias("position", "value"))
        .withColumn("position", F.col("position") + 1)
    )
