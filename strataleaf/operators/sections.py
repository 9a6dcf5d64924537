"""Parsing of document text into cited, versioned section blocks; native expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataleaf.functions.whitespace import collapse, strip

# The marks by which a section's parts are told apart in statute text. \s is ASCII white space in them.
HEADER = r"\(\s*[0-9]+\s+ILCS\s+[0-9A-Za-z.\-]+\s*/\s*[^)]*?\s*\)"
HEADER_PARTS = r"^\(\s*([0-9]+)\s+ILCS\s+([0-9A-Za-z.\-]+)\s*/\s*([^)]*?)\s*\)"
MARKER = r"(?i)^(.*?)\s+(new|rep\.)$"
SOURCE = r"(?is)\(\s*Source:\s*([^)]*?)\s*\)"
LEGACY = r"(?is)\(\s*from\s+Ch\.\s*([^)]+?)\s*\)"
VERSION = r"(?is)\(\s*Text of (?:Section|Sec\.)[^)]*?\)"
CATCHLINE = r"\bSec\.\s*([0-9A-Za-z.\-]+)\s*\."
INSTRUCTION = r"\n[ \t]*Section\s+[0-9]+[0-9A-Za-z.\-]*\."
WAS = r"(?is)\(\s*was\s+([0-9]+)\s+ILCS\s+([0-9A-Za-z.\-]+)\s*/\s*([^)]+?)\s*\)"
ACT_IN_SOURCE = r"(?i)\bP\.?\s?A\.?\s*[0-9]{2,3}-[0-9]{1,4}"
ACT_TOKEN = r"(?<![\w.\-])([0-9]{2,3}-[0-9]{1,4})(?![\w\-])"
OTHER_SOURCE = r"(?i)\b(R\.S\.|Laws\s+[0-9]{4}|Rev\.\s*Stat\.|P\.\s*A\.\s*77-2500|Code\s+[0-9]{4})"


def _or_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def act_numbers(raw: Column) -> Column:
    """All Act numbers of a source line that names a Public Act, each once, in order; empty otherwise."""
    line = collapse(raw)
    return F.when(line.rlike(ACT_IN_SOURCE), F.array_distinct(F.regexp_extract_all(line, F.lit(ACT_TOKEN), F.lit(1)))).otherwise(
        F.array().cast("array<string>")
    )


def source_line(raw: Column) -> Column:
    """``STRUCT<raw, pa_numbers, has_non_pa_provenance>`` of a source line; null of null."""
    line = collapse(raw)
    return F.when(
        raw.isNotNull(),
        F.struct(line.alias("raw"), act_numbers(raw).alias("pa_numbers"), line.rlike(OTHER_SOURCE).alias("has_non_pa_provenance")),
    )


def terminal_act(source: Column) -> Column:
    return F.try_element_at(source["pa_numbers"], F.lit(-1))


def is_reconstructable(source: Column) -> Column:
    return F.coalesce(F.size(source["pa_numbers"]) > 0, F.lit(False))


def is_multi_act(source: Column) -> Column:
    return F.coalesce(F.size(source["pa_numbers"]) > 1, F.lit(False))


def windows(text: Column) -> Column:
    """The text cut before every citation header; what stands before the first is left out."""
    return F.filter(F.split(text, f"(?={HEADER})"), lambda w: w.rlike(f"^{HEADER}"))


#: Put after each trailer before the window is cut there; a lazy pattern up to the trailer would be quadratic.
_CUT = "\u0001\u0002\u0001"


def segments(window: Column) -> Column:
    """The versions in one header's window: each ends with its source trailer; without one, the whole window."""
    parts = F.split(F.regexp_replace(window, SOURCE, "$0" + _CUT), _CUT)
    return F.when(F.size(parts) > 1, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def parse_blocks(documents: DataFrame, doc_id: str, text: Column) -> DataFrame:
    """One row for each section version in each text, in document order.

    :returns: ``doc_id, pos, ver, citation, raw, body, legacy_cite, version_marker, source, catchline, op_marker,
        renumbered_from``; ``pos`` numbers the headers of a document from 0, ``ver`` the versions under one from 1.
        Headers without a section, and texts without a header (null and empty ones too), give no rows.

    The body begins at the catchline, without one after the marks that open the section; it ends before the source
    trailer, without one before the next instruction of an amending Act. A trailer before the catchline gives an empty
    body.

    Scale: a narrow plan without shuffle; only the columns named are read. One document can hold thousands of sections:
    repartition the result before wide work on it.
    """
    headed = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.posexplode(windows(text)).alias("pos", "window"))
    split = headed.select(
        "doc_id",
        "pos",
        *[F.regexp_extract("window", HEADER_PARTS, i).alias(n) for i, n in ((1, "chapter"), (2, "act"), (3, "named"))],
        F.posexplode(segments(F.col("window"))).alias("ver", "raw"),
    )
    named = collapse(F.col("named"))
    marker = F.regexp_extract(named, MARKER, 2)
    parsed = split.withColumns(
        {
            "section": F.when(marker != "", F.regexp_extract(named, MARKER, 1)).otherwise(named),
            "op_marker": _or_null(F.lower(marker)),
            "trailer": F.regexp_substr("raw", F.lit(SOURCE)),
            "catch": F.regexp_substr("raw", F.lit(CATCHLINE)),
        }
    ).where("section <> ''")
    raw, trailer, catch = F.col("raw"), F.col("trailer"), F.col("catch")
    # places are counted from 0, as lengths of what stands before
    catch_at = F.when(catch.isNotNull(), F.regexp_instr(raw, F.lit(CATCHLINE)) - 1)  # not instr: its text may stand within a word before
    after_catch = F.coalesce(catch_at + F.char_length(catch), F.lit(0))
    instruction = F.regexp_substr(F.substr(raw, after_catch + 1), F.lit(INSTRUCTION))
    instruction_at = after_catch + F.instr(F.substr(raw, after_catch + 1), instruction)  # after the line break
    end = F.coalesce(F.when(trailer.isNotNull(), F.instr(raw, trailer) - 1), instruction_at, F.char_length(raw))
    legacy, version = F.regexp_substr(raw, F.lit(LEGACY)), F.regexp_substr(raw, F.lit(VERSION))
    bounded = parsed.withColumns({"end": end, "catch_at": catch_at, "legacy": legacy, "version": version})
    ends = [
        F.when(m.isNotNull() & (F.instr(raw, m) - 1 + F.char_length(m) <= F.col("end")), F.instr(raw, m) - 1 + F.char_length(m))
        for m in (F.col("legacy"), F.col("version"))
    ]
    start = F.coalesce(F.col("catch_at"), F.greatest(*ends, F.lit(0)))
    before_end = F.when(F.col("end") > 0, F.substr(raw, F.lit(1), F.col("end"))).otherwise(raw)
    was = [F.regexp_extract(before_end, WAS, i) for i in (1, 2, 3)]
    return bounded.select(
        "doc_id",
        "pos",
        (F.col("ver") + 1).alias("ver"),
        F.struct("chapter", "act", "section").alias("citation"),
        "raw",
        F.substr(raw, start + 1, F.greatest(F.col("end") - start, F.lit(0))).alias("body"),
        strip(F.regexp_extract(F.col("legacy"), LEGACY, 1)).alias("legacy_cite"),
        collapse(F.col("version")).alias("version_marker"),
        source_line(F.regexp_extract(trailer, SOURCE, 1)).alias("source"),
        F.when(catch.isNotNull(), F.regexp_extract(catch, CATCHLINE, 1)).alias("catchline"),
        "op_marker",
        F.when(was[0] != "", F.struct(was[0].alias("chapter"), was[1].alias("act"), collapse(was[2]).alias("section"))).alias("renumbered_from"),
    )
