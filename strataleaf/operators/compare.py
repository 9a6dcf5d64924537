"""Comparison of two texts: equality under rules, similarity, word changes and unified diffs."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher, unified_diff
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataleaf.functions.normalize import ALL_RULES, normalize

#: Word changes told of one pair; characters of a line of a diff, and where longer ones are cut.
CHANGES, LINE, CUT = 12, 120, 100
_STOP = re.compile(r"(?<=[.;:])\s+(?=[A-Z(\"'])")
_CATCHLINE = re.compile(r"Sec\.\s*\S+\.\Z")


def sentence_parts(text: Column) -> Column:
    """A text cut after stops that a capital, bracket or quote follows; parts trimmed, empty ones dropped."""
    parts = F.transform(F.split(text, r"(?<=[.;:])\s++(?=[A-Z(\"'])"), F.trim)
    return F.filter(parts, lambda p: p != "")


def _wrapped(part: str) -> Iterator[str]:
    while len(part) > LINE and (head := part[:CUT].rpartition(" ")[0]):
        yield head
        part = part[len(head) + 1 :]
    yield part


def display_lines(text: str) -> list[str]:
    """:func:`sentence_parts`, with a catchline joined to what follows and long parts wrapped at a space."""
    parts = (p.strip() for p in _STOP.split(text) if p.strip())
    return [line for p in parts for line in _wrapped(" ".join([p, *islice(parts, 1)]) if _CATCHLINE.match(p) else p)]


#: How each kind of difference is told.
TOLD = {"replace": "replace {0!r} -> {1!r}", "delete": "only in compilation: {0!r}", "insert": "only in Act: {1!r}"}


def changed_words(a: list[str], b: list[str], most: int = CHANGES) -> list[str]:
    """What differs, word by word; an ellipsis after the last of ``most``."""
    steps = SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    told = (TOLD[kind].format(" ".join(a[i:j]), " ".join(b[k:m])) for kind, i, j, k, m in steps if kind in TOLD)
    first = list(islice(told, most))
    return first + ["..."] * (len(first) == most)


def word_similarity(a: str, b: str) -> float:
    """Twice the matched words over all words, by the longest matching blocks; 1 for two empty texts."""
    return SequenceMatcher(None, a.split(), b.split(), autojunk=False).ratio()


def similarity(a: Column, b: Column) -> Column:
    """:func:`word_similarity`; null where a text is null."""

    @F.pandas_udf("double")
    def measured(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else word_similarity(x, y) for x, y in zip(a, b)], dtype="float64")

    return measured(a, b)


def _difference(label: Column, a: Column, b: Column) -> Column:
    @F.pandas_udf("struct<similarity: double, changes: array<string>, diff: string>")
    def told(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for labels, a, b in batches:
            rows = []
            for label, x, y in zip(labels, a, b):
                names = f"{label} (compilation)", f"{label} (as printed in its source Act)"
                lines = unified_diff(display_lines(x), display_lines(y), *names, lineterm="", n=1)
                rows.append((word_similarity(x, y), changed_words(x.split(), y.split()), "\n".join(lines)))
            yield pd.DataFrame(rows, columns=["similarity", "changes", "diff"])

    return told(label, a, b)


def compared(pairs: DataFrame, label: Column, published: Column, replayed: Column, enabled: Iterable[str] = ALL_RULES) -> DataFrame:
    """``pairs`` with ``exact_match, normalized_match, published_norm, replayed_norm, similarity, changes, diff``.

    Similarity (rounded to four places), changes and diff are only worked out where the normalised texts differ;
    elsewhere they are 1, empty and empty. Where a text is null, the flags and these columns are null. Columns of
    ``pairs`` with these names are replaced.

    Scale: no shuffle; texts go to Python only where they differ.
    """
    rules = tuple(enabled)
    made = ["exact_match", "normalized_match", "published_norm", "replayed_norm", "similarity", "changes", "diff"]
    kept = [F.col(f"`{c}`") for c in pairs.columns if c not in made]
    both = pairs.select(
        *kept,
        label.alias("__label"),
        (published == replayed).alias("exact_match"),
        normalize(published, rules).alias("published_norm"),
        normalize(replayed, rules).alias("replayed_norm"),
    ).withColumn("normalized_match", F.col("published_norm") == F.col("replayed_norm"))
    out = [F.col(f"`{c}`") for c in pairs.columns if c not in made] + [F.col(c) for c in made]
    same = both.where("normalized_match OR normalized_match IS NULL").withColumns(
        {
            "similarity": F.when(F.col("normalized_match"), 1.0),
            "changes": F.when(F.col("normalized_match"), F.array().cast("array<string>")),
            "diff": F.when(F.col("normalized_match"), ""),
        }
    )
    other = both.where("NOT normalized_match").withColumn("__d", _difference(F.col("__label"), F.col("published_norm"), F.col("replayed_norm")))
    other = other.withColumns({"similarity": F.bround("__d.similarity", 4), "changes": F.col("__d.changes"), "diff": F.col("__d.diff")})
    return same.select(*out).unionByName(other.select(*out))
