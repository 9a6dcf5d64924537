"""Index pages: links to chapters and Acts scanned out of HTML, each target once, the first link counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataleaf.functions.whitespace import collapse
from strataleaf.operators.sections import parse_blocks

# What links of the two kinds of index page and to an Act's full text look like.
CHAPTER_LINK = r'href="/Legislation/ILCS/Acts\?ChapterID=([0-9]+)&ChapterNumber=([0-9A-Za-z]+)&Chapter=([^&"]*)'
ACT_LINK = r'(?s)href="/Legislation/ILCS/Articles\?ActID=([0-9]+)[^"]*"[^>]*>(.*?)</a>'
FULL_TEXT_LINK = r'(?i)href="(/legislation/ILCS/details\?[^"]*ChapAct=FullText[^"]*)"'


def _links(pages: DataFrame, order: Column, page: Column, pattern: str, names: list[str]) -> DataFrame:
    groups = F.arrays_zip(*[F.regexp_extract_all(page, F.lit(pattern), F.lit(i + 1)).alias(n) for i, n in enumerate(names)])
    found = pages.select(order.alias("page_no"), F.posexplode(groups).alias("pos", "g")).select("page_no", "pos", *[F.col(f"g.{n}").alias(n) for n in names])
    first = found.groupBy(names[0]).agg(F.min(F.struct("page_no", "pos", *names[1:])).alias("first"))
    return first.select(names[0], *[F.col(f"first.{n}").alias(n) for n in names[1:]])


def chapters(pages: DataFrame, order: Column, page: Column) -> DataFrame:
    """SRC3: ``chapter_id, number, name`` of every chapter linked to."""
    return _links(pages, order, page, CHAPTER_LINK, ["chapter_id", "number", "name"]).withColumn("name", F.trim("name"))


def acts(pages: DataFrame, order: Column, page: Column) -> DataFrame:
    """SRC4: ``act_id, label`` of every Act linked to; tags are taken out of labels and white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace("label", "<[^>]+>", ""), "&nbsp;", " ")
    return _links(pages, order, page, ACT_LINK, ["act_id", "label"]).withColumn("label", collapse(bare))


def blocks_with_fallback(pages: DataFrame, act: Column, doc_id: str, text: Column, primary: Column) -> DataFrame:
    """SRC5: the section blocks of each Act from its primary pages, or from the others if those have none.

    Headings are no blocks. Whether an Act's primary pages have any is found by an aggregate and joined back.
    """
    keyed = pages.select(act.alias("act_key"), F.col(doc_id).alias("doc_id"), text.alias("text"), primary.alias("primary")).where("act_key IS NOT NULL")
    parsed = parse_blocks(keyed, "doc_id", F.col("text")).where(~F.lower("citation.section").contains("heading"))
    blocks = parsed.join(keyed.select("doc_id", "act_key", "primary"), "doc_id")
    has = blocks.where("primary").select("act_key").distinct().withColumn("has", F.lit(True))
    return blocks.join(has, "act_key", "left").where(F.col("primary") == F.coalesce("has", F.lit(False)))
