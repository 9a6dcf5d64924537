"""The one whitespace class of the library: Unicode whitespace, as a Java and as an RE2 character class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that count as whitespace in Unicode text.
PY_WS = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: The same class for DuckDB.
DUCK_WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{PY_WS}++|{PY_WS}++$", "")


def collapse(text: Column) -> Column:
    """Whitespace runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{PY_WS}++", " "))
