"""HTML to text with tracked deletions and insertions applied or undone."""

from __future__ import annotations

import html
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strataleaf.functions.whitespace import PY_WS

# The elements whose text was deleted or inserted, that end a line, and that hold no text.
DELETED = frozenset({"strike", "s", "del"})
INSERTED = frozenset({"u", "ins"})
BREAKS = frozenset("br tr td p div table center blockquote li ul ol dl dt dd h1 h2 h3 h4 h5 h6 hr".split())
SKIPPED = frozenset({"style", "script", "title", "head"})
#: Stands where deleted text was, until the white space around it is repaired.
MARK = "\x00"


#: What an element does to the text in it; elements of other names do nothing.
ROLES = {**dict.fromkeys(DELETED, "deleted"), **dict.fromkeys(INSERTED, "inserted"), **dict.fromkeys(SKIPPED, "skipped")}
#: The roles whose text each reading leaves out.
READINGS = {"after": "deleted", "before": "inserted"}


class _Events(HTMLParser):
    """A page as a list of ``(event, value)``; text is decoded, comments and declarations are left out."""

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=False)
        self.events: list[tuple[str, str]] = []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag: str, attrs: object) -> None:
        self.events.append(("open", tag))

    def handle_startendtag(self, tag: str, attrs: object) -> None:
        self.events.append(("empty", tag))

    def handle_endtag(self, tag: str) -> None:
        self.events.append(("close", tag))

    def handle_data(self, data: str) -> None:
        self.events.append(("text", data.replace(MARK, "")))

    def handle_entityref(self, name: str) -> None:
        self.events.append(("text", html.unescape("&" + name + ";")))

    def handle_charref(self, name: str) -> None:
        self.events.append(("text", html.unescape("&#" + name + ";")))


def read_page(page: str | None) -> dict | None:
    """Both raw readings of one page, with marks, and its counts of deletions and insertions; null of null.

    Elements that end lines do so even where text is left out. A mark stands where the outermost deletion (insertion)
    closes, also where one closes that was never opened; every opening is counted, nested ones too.
    """
    if page is None:
        return None
    pieces: dict[str, list[str]] = {reading: [] for reading in READINGS}
    depth, opened = dict.fromkeys(("deleted", "inserted", "skipped"), 0), Counter()
    for event, value in _Events(page).events:
        if event == "text":
            for reading, left_out in READINGS.items():
                if not depth["skipped"] and not depth[left_out]:
                    pieces[reading].append(value)
            continue
        role = ROLES.get(value)
        if role and event == "open":
            opened[role] += 1
            depth[role] += 1
        elif role and event == "close":
            depth[role] -= depth[role] > 0
            for reading, left_out in READINGS.items():
                if left_out == role and not depth[role]:
                    pieces[reading].append(MARK)
        if value in BREAKS:
            for own in pieces.values():
                own.append("\n")
    return {**{reading: "".join(own) for reading, own in pieces.items()}, "strikes": opened["deleted"], "inserts": opened["inserted"]}


def _readings(page: Column) -> Column:
    names = ["after", "before", "strikes", "inserts"]

    @F.pandas_udf("struct<after: string, before: string, strikes: int, inserts: int>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            rows = [read_page(p) or dict.fromkeys(names) for p in pages]
            yield pd.DataFrame(rows, columns=names).astype({"strikes": "Int32", "inserts": "Int32"})

    return read(page)


def repair_marks(text: Column) -> Column:
    """White space where text was deleted: none before closing punctuation, else one space if there was any."""
    text = F.regexp_replace(text, "[ \\t\\r\\n]*+\\x00[ \\t\\r\\n\\x00]*+(?=[,;:.)\\]}!?])", "")
    text = F.regexp_replace(text, "[ \\t\\r\\n]++\\x00[ \\t\\r\\n\\x00]*+|\\x00++[ \\t\\r\\n][ \\t\\r\\n\\x00]*+", " ")
    return F.regexp_replace(text, "\\x00++", "")


def tidy_lines(text: Column) -> Column:
    """Lines without trailing white space, blank ones dropped."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, f"{PY_WS}++$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def drop_line_numbers(text: Column) -> Column:
    """Without lines that are nothing but a number of up to three digits."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(rf"^{PY_WS}*+[0-9]{{1,3}}{PY_WS}*+$")), "\n")


def extraction(page: Column) -> Column:
    """``STRUCT<text, pre_text, strike_spans, insert_spans>``: a page as amended, as it was before, and its marks' counts.

    Both readings come from one parse. Deleted text leaves one space only where there was white space, and none before
    closing punctuation. Unclosed elements run to the end; a null page gives a struct of nulls, an empty one empty text.
    """
    read = _readings(page)
    tidy = lambda t: tidy_lines(repair_marks(F.replace(t, F.lit("\u00a0"), F.lit(" "))))
    return F.struct(
        tidy(read["after"]).alias("text"), tidy(read["before"]).alias("pre_text"), read["strikes"].alias("strike_spans"), read["inserts"].alias("insert_spans")
    )
