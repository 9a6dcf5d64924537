"""Column functions for public Act numbers, urls and hashes as they are written in dirty tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataleaf.functions.whitespace import PY_WS

#: Dashes that stand between Assembly and serial number.
DASHES = "-‐‑‒–—−"
_ACT = rf"(?i)^{PY_WS}*+(?:P\.?{PY_WS}*+A\.?|Public{PY_WS}++Acts?)?{PY_WS}*+0*+([0-9]++){PY_WS}*+[{DASHES}]{PY_WS}*+0*+([0-9]++){PY_WS}*+\.?{PY_WS}*+$"
_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*+)://([^/?#]*+)([^#]*+)"


def act_number(text: Column) -> Column:
    """``STRUCT<assembly, serial: STRING>``, without leading zeros, of an Act number however it is written.

    Null and blank text give null. Text that is no Act number gives a null assembly and the text itself, trimmed, as
    the serial, so that it is still a reference, and one that matches nothing but itself.
    """
    trimmed = F.regexp_replace(text, rf"^{PY_WS}++|{PY_WS}++$", "")
    assembly, serial = (F.regexp_extract(text, _ACT, i) for i in (1, 2))
    parsed = F.when(assembly != "", F.struct(assembly.alias("assembly"), serial.alias("serial")))
    other = F.struct(F.lit(None).cast("string").alias("assembly"), trimmed.alias("serial"))
    return F.when(trimmed != "", F.coalesce(parsed, other))


def page_url(url: Column) -> Column:
    """``url`` with lower-case scheme and host, without the scheme's default port and without a fragment.

    A value that is no absolute url only loses its fragment. Null gives null.
    """
    scheme = F.lower(F.regexp_extract(url, _URL, 1))
    place = F.regexp_extract(url, _URL, 2)
    user = F.regexp_extract(place, r"^(.*@)", 1)
    host = F.lower(F.regexp_replace(place, r"^.*@", ""))
    bare = (
        F.when(scheme == "https", F.regexp_replace(host, r":(?:0*443)?$", ""))
        .when(scheme == "http", F.regexp_replace(host, r":(?:0*80)?$", ""))
        .otherwise(host)
    )
    return F.when(
        scheme != "", F.concat(scheme, F.lit("://"), user, bare, F.regexp_extract(url, _URL, 3))
    ).otherwise(F.regexp_replace(url, r"#.*$", ""))


def hash_value(text: Column) -> Column:
    """A hash in lower case without an algorithm label before it; blank is null."""
    return F.nullif(F.lower(F.regexp_replace(F.trim(text), r"^[A-Za-z0-9\-]++[:=]", "")), F.lit(""))
