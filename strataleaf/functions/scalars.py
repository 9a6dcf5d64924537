"""Scalar column functions over citations, Act numbers, urls and bodies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataleaf.functions.whitespace import collapse, strip

# Hosts that may be fetched from, and path prefixes that may not be fetched.
HOSTS = ("ilga.gov", "www.ilga.gov")
DENIED = ("/account", "/admin", "/search", "/api")
# What marks a placeholder served with status 200, a repealed section, a renumbered one, and throttling.
PLACEHOLDER = r"(?iu)Document:\s*[0-9A-Za-z\-]+\s*is not currently available"
REPEALED = r"(?i)^Sec\.?\s*\S*\s*\.?\s*\(\s*Repealed\s*\)\.?$"
RENUMBERED = r"(?i)\bRenumbered\s+by\b"
THROTTLED = r"(?i)rate[ -]?limit|too many requests|slow down|temporarily blocked|access denied"
THROTTLING_STATUS = (429, 503, 509)
#: The first assembly whose Acts are published, the strata's bounds, and the sampling quotas.
FLOOR_GA, RECENT_GA, CORPUS_FLOOR_GA = 93, 103, 90
QUOTAS = {"recent": 10, "modern": 10, "pre_corpus": 2}


def padded_act(number: Column) -> Column:
    """``97-81`` as ``097-0081``; null if it isn't two numbers."""
    first, second = (F.regexp_extract(number, r"^\s*([0-9]+)-([0-9]+)\s*$", i) for i in (1, 2))
    return F.when(first != "", F.format_string("%03d-%04d", first.try_cast("long"), second.try_cast("long")))


def assembly_of(number: Column) -> Column:
    """The number before the hyphen, 0 if there is none."""
    return F.coalesce(F.substring_index(number, "-", 1).try_cast("int"), F.lit(0))


def act_key(label: Column) -> Column:
    """``STRUCT<chapter, act>`` of a label such as ``10 ILCS 5/ Election Code``, or null."""
    chapter = strip(F.substring_index(label, " ILCS ", 1))
    act = strip(F.substring_index(F.substring_index(F.regexp_replace(label, r"^(?s).*? ILCS ", ""), "/", 1), " ILCS ", 1))
    return F.when(label.contains(" ILCS ") & (chapter != "") & (act != ""), F.struct(chapter.alias("chapter"), act.alias("act")))


def chapter_order(chapter: Column) -> tuple[Column, Column]:
    """Sort keys: numeric chapters by number, the others after them by name."""
    number = F.when(chapter.rlike("^[0-9]+$"), chapter.try_cast("long"))
    return F.coalesce(number, F.lit(1_000_000_000)), F.when(number.isNull(), chapter).otherwise("")


def is_heading(section: Column) -> Column:
    return F.lower(section).contains("heading")


def document_name(chapter: Column, act: Column, section: Column) -> Column:
    """``000500700K4`` for 5 ILCS 70/4: the act field is ten times the act, rounded half to even; null if it's no number."""
    ten = F.bround(F.when(act.rlike(r"^[0-9]+(\.[0-9]+)?$"), act.try_cast("double")) * 10, 0).cast("long")
    return F.when(chapter.rlike("^[0-9]+$") & ten.isNotNull(), F.concat(F.format_string("%04d%05d", chapter.try_cast("long"), ten), F.lit("K"), section))


def citation_text(citation: Column) -> Column:
    return F.format_string("%s ILCS %s/%s", citation["chapter"], citation["act"], citation["section"])


def in_utc(at: Column) -> Column:
    """The wall-clock time in UTC, whatever the session's time zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp").cast("timestamp_ntz"))


def stable_uri(chapter: Column, act: Column, section: Column, at: Column) -> Column:
    return F.concat(F.lit("/us-il/act/"), chapter, F.lit("/"), act, F.lit("/"), section, F.lit("@"), F.date_format(in_utc(at), "yyyy-MM-dd"))


def only_alphanumeric(text: Column) -> Column:
    """Without all but ASCII letters and digits; case is kept."""
    return F.regexp_replace(text, "[^A-Za-z0-9]++", "")


def is_placeholder(body: Column) -> Column:
    return F.coalesce(body.rlike(PLACEHOLDER), F.lit(False))


def is_readable(status: Column, body: Column) -> Column:
    """Available for comparison: status 200, not blank, no placeholder."""
    return F.coalesce((status == 200) & (strip(body) != "") & ~is_placeholder(body), F.lit(False))


def is_missing(status: Column, body: Column) -> Column:
    """Counted as missing by the mirror: 404 or a placeholder."""
    return F.coalesce(status == 404, F.lit(False)) | is_placeholder(body)


def is_published(status: Column, body: Column) -> Column:
    """Taken as published by the floor's probe: status 200, no placeholder, more than 500 characters."""
    return F.coalesce((status == 200) & ~is_placeholder(body) & (F.char_length(body) > 500), F.lit(False))


#: The beginning of a refusal's body that is searched for signs of throttling: so much of it is read, here in characters.
REFUSAL = 4096


def is_throttling(status: Column, retry_after: Column, body: Column) -> Column:
    """Whether an answer asks to stop fetching; a refusal whose body can't be read (null) does."""
    return (
        F.coalesce(status.isin(*THROTTLING_STATUS), F.lit(False))
        | (F.coalesce(retry_after, F.lit("")) != "")
        | F.coalesce((status == 403) & F.coalesce(F.substring(body, 1, REFUSAL).rlike(THROTTLED), F.lit(True)), F.lit(False))
    )


def is_repeal_stub(body: Column) -> Column:
    return F.coalesce(collapse(body).rlike(REPEALED), F.lit(False))


def is_renumbered(source_line: Column) -> Column:
    return F.coalesce(source_line.rlike(RENUMBERED), F.lit(False))


def url_verdict(url: Column, hosts: Sequence[str] = HOSTS, denied: Sequence[str] = DENIED) -> Column:
    """``ok``, ``scheme``, ``host`` or ``path``: whether a url may be fetched, and else what forbids it; null for null."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    place = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(place, r"^.*@", ""), r":[0-9]*$", ""))
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1))
    bad = F.lit(False)
    for prefix in denied:
        bad = bad | (path == prefix) | path.startswith(prefix + "/") | path.startswith(prefix + ".")
    return (
        F.when(url.isNull(), F.lit(None))
        .when(~scheme.isin("http", "https"), "scheme")
        .when(~host.isin(*hosts), "host")
        .when(bad, "path")
        .otherwise("ok")
    )


def cache_key(url: Column) -> Column:
    """A readable, unambiguous key: the last part of the path, made safe, and the start of the url's hash."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    tail = F.substring_index(path, "/", -1)
    safe = F.substring(F.regexp_replace(F.when(tail == "", "index").otherwise(tail), r"[^\p{L}\p{N}\-._]", "_"), 1, 48)
    return F.concat(safe, F.lit("."), F.substring(F.sha2(url, 256), 1, 16))


def content_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def section_url(base: Column, document: Column) -> Column:
    return F.concat(base, F.lit("/documents/"), document, F.lit(".htm"))


def act_url(base: Column, number: Column) -> Column:
    return F.concat(base, F.lit("/acts/"), padded_act(number))


def articles_url(base: Column, act_id: Column, chapter_id: Column) -> Column:
    return F.concat(base, F.lit("/Articles?ActID="), act_id, F.lit("&ChapterID="), F.coalesce(chapter_id, F.lit("0")))


def acts_url(base: Column, chapter_id: Column) -> Column:
    return F.concat(base, F.lit("/Acts?ChapterID="), chapter_id)


def unescape_href(href: Column) -> Column:
    return F.replace(F.replace(F.replace(href, F.lit("&amp;"), F.lit("&")), F.lit("&#x2B;"), F.lit("+")), F.lit(" "), F.lit("%20"))


def duration(seconds: Column) -> Column:
    """``1h 2m``, ``3m 4s`` or ``5s``; a negative one is ``0s``, null stays null."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("long")
    hours, minutes, rest = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return (
        F.when(seconds.isNull(), F.lit(None).cast("string"))
        .when(s >= 3600, F.format_string("%dh %dm", hours, minutes))
        .when(s >= 60, F.format_string("%dm %ds", minutes, rest))
        .otherwise(F.format_string("%ds", rest))
    )


def percent(part: Column, whole: Column) -> Column:
    """One decimal, rounded half to even on the exact value of the double, which Java's own formatting is not; ``n/a`` of none."""
    return F.when(whole > 0, F.concat(F.replace(F.format_number(100.0 * part / whole, 1), F.lit(","), F.lit("")), F.lit("%"))).otherwise("n/a")


def wilson(matched: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The Wilson interval of a rate; null where ``n`` is 0."""
    n = F.when(n > 0, n.cast("double"))
    p = matched / n
    centre = p + z * z / (2 * n)
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (centre - spread) / (1 + z * z / n), (centre + spread) / (1 + z * z / n)


def stratum(pa_numbers: Column, recent: int = RECENT_GA, floor: int = CORPUS_FLOOR_GA) -> Column:
    """The stratum of a section by its last Act; sections without one are apart."""
    last = F.try_element_at(pa_numbers, F.lit(-1))
    return (
        F.when(last.isNull(), "no_public_act").when(assembly_of(last) >= recent, "recent").when(assembly_of(last) >= floor, "modern").otherwise("pre_corpus")
    )
