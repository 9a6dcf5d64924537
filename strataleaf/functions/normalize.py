"""The declared normalisation rules, as column expressions applied in one fixed order."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataleaf.functions.whitespace import PY_WS, collapse

# N2's characters and what they become; the last two are deleted.
PUNCTUATION_FROM = "\u2018\u2019\u201a\u2032\u201c\u201d\u201e\u2033\u2011\u00ad\ufeff"
PUNCTUATION_TO = "''''\"\"\"\"-"


def nfc(text: Column) -> Column:
    """Unicode NFC. Only texts with characters beyond ASCII are sent to Python."""

    @F.pandas_udf("string")
    def composed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))

    return F.coalesce(composed(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def plain_punctuation(text: Column) -> Column:
    return F.translate(text, PUNCTUATION_FROM, PUNCTUATION_TO)


def close_up_before(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t]++(?=[,;:.)\]])", "")


def close_up_after(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<=[(\[])[ \t]++", "")


def one_space_after_stop(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<=[.?!]){PY_WS}{{2,}}+", " ")


@dataclass(frozen=True)
class Rule:
    key: str
    title: str
    risk: str
    apply: Callable[[Column], Column]


RULES = (
    Rule("N1", "compose characters", "none", nfc),
    Rule("N2", "plain quotes and hyphens", "low", plain_punctuation),
    Rule("N3", "collapse white space", "none", collapse),
    Rule("N4", "no space before closing punctuation", "low", close_up_before),
    Rule("N5", "no space after an opening bracket", "low", close_up_after),
    Rule("N6", "one space after a stop", "none", one_space_after_stop),
)
ALL_RULES = tuple(r.key for r in RULES)


def normalize(text: Column, enabled: Iterable[str] = ALL_RULES) -> Column:
    """``text`` under the enabled rules, in declared order whatever the order of ``enabled``. Null stays null."""
    enabled = set(enabled)
    if unknown := enabled - set(ALL_RULES):
        raise ValueError(f"no such rules: {sorted(unknown)}")
    for rule in RULES:
        if rule.key in enabled:
            text = rule.apply(text)
    return text


def prefixes(text: Column) -> list[Column]:
    """``text`` under no rule, under the first, under the first two, and so on."""
    out = [text]
    for rule in RULES:
        out.append(rule.apply(out[-1]))
    return out


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i + 1, r.key, r.title, r.risk) for i, r in enumerate(RULES)], "seq int, key string, title string, risk string")
