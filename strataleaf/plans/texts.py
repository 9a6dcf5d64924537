"""Queries of the text operators: normalisation, comparison, parsing, extraction, and scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataleaf.functions import normalize as N
from strataleaf.functions import scalars as S
from strataleaf.functions.whitespace import DUCK_WS as WS
from strataleaf.operators import compare as C
from strataleaf.operators import extract as X
from strataleaf.operators import sections as P
from strataleaf.plans.registry import Registry
from strataleaf.sources.tables import table

R = Registry()

# DuckDB's form of each rule, as a function of an expression
_FROM, _TO = N.PUNCTUATION_FROM, N.PUNCTUATION_TO.replace("'", "''")
SQL_RULES = (
    lambda t: f"nfc_normalize({t})",
    lambda t: f"translate({t}, '{_FROM}', '{_TO}')",
    lambda t: f"trim(regexp_replace({t}, '{WS}+', ' ', 'g'))",
    lambda t: f"regexp_replace({t}, '[ \\t]+([,;:.)\\]])', '\\1', 'g')",
    lambda t: f"regexp_replace({t}, '([(\\[])[ \\t]+', '\\1', 'g')",
    lambda t: f"regexp_replace({t}, '([.?!]){WS}{{2,}}', '\\1 ', 'g')",
)


def sql_normalized(text: str, upto: int = len(SQL_RULES)) -> str:
    for rule in SQL_RULES[:upto]:
        text = rule(text)
    return text


def sql_collapsed(text: str) -> str:
    return f"trim(regexp_replace({text}, '{WS}+', ' ', 'g'))"


def _columns(columns: list[Column], stem: str) -> list[Column]:
    return [c.alias(f"{stem}{i}") for i, c in enumerate(columns)]


@R.query("SELECT comparison_id, " + ", ".join(f"md5({sql_normalized('published_norm', i)}) AS n{i}" for i in range(7)) + " FROM comparisons")
def normalized_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Each text under no rule, the first rule, the first two, and so on."""
    return table(spark, d, "comparisons").select("comparison_id", *_columns([F.md5(c) for c in N.prefixes(F.col("published_norm"))], "n"))


@R.query(
    "WITH p AS (SELECT "
    + ", ".join(f"({sql_normalized('published_norm', i)} = {sql_normalized('replayed_norm', i)})::INT AS e{i}" for i in range(7))
    + " FROM comparisons WHERE published_norm IS NOT NULL AND replayed_norm IS NOT NULL),"
    " a AS (" + " UNION ALL ".join(f"SELECT {i} AS step, '{(('none',) + N.ALL_RULES)[i]}' AS up_to, count(*) AS pairs, coalesce(sum(e{i}), 0)::BIGINT AS matched FROM p" for i in range(7)) + ")"
    " SELECT step, up_to, pairs, matched, CASE WHEN pairs > 0 THEN matched / pairs ELSE 0.0 END::DOUBLE AS rate,"
    " matched - lag(matched) OVER (ORDER BY step) AS marginal FROM a"
)
def rule_ablation(spark: SparkSession, d: str) -> DataFrame:
    """AG6, WN5: how many pairs are equal under each prefix of the rules, and what each rule adds."""
    pairs = table(spark, d, "comparisons").where("published_norm IS NOT NULL AND replayed_norm IS NOT NULL")
    a, b = N.prefixes(F.col("published_norm")), N.prefixes(F.col("replayed_norm"))
    equal = pairs.select(*_columns([(x == y).cast("int") for x, y in zip(a, b)], "e"))
    sums = equal.agg(F.count(F.lit(1)).alias("pairs"), *[F.coalesce(F.sum(f"e{i}"), F.lit(0)).alias(f"s{i}") for i in range(7)])
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(k).alias("up_to"), F.col(f"s{i}").alias("matched"), F.col(f"s{i - 1}" if i else "s0").alias("before")) for i, k in enumerate(("none", *N.ALL_RULES))])
    return sums.select("pairs", F.explode(steps).alias("x")).select(
        "x.step",
        "x.up_to",
        "pairs",
        "x.matched",
        F.coalesce(F.try_divide(F.col("x.matched"), F.col("pairs")), F.lit(0.0)).alias("rate"),
        F.when(F.col("x.step") > 0, F.col("x.matched") - F.col("x.before")).alias("marginal"),
    )


@R.query("SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, '{r.key}', '{r.title}', '{r.risk}')" for i, r in enumerate(N.RULES)) + ") t(seq, key, title, risk)")
def rules_dimension(spark: SparkSession, d: str) -> DataFrame:
    """SNK8: the rules."""
    return N.rules_table(spark)


@R.query(
    f"SELECT comparison_id, published_norm = replayed_norm AS exact, {sql_normalized('published_norm')} = {sql_normalized('replayed_norm')} AS normalized,"
    " regexp_replace(published_norm, '[^A-Za-z0-9]+', '', 'g') = regexp_replace(replayed_norm, '[^A-Za-z0-9]+', '', 'g') AS alnum_equal FROM comparisons"
)
def comparison_flags(spark: SparkSession, d: str) -> DataFrame:
    """CP1, FL8: exact and normalised equality, and equality of letters and digits."""
    a, b = F.col("published_norm"), F.col("replayed_norm")
    return table(spark, d, "comparisons").select(
        "comparison_id", (a == b).alias("exact"), (N.normalize(a) == N.normalize(b)).alias("normalized"), (S.only_alphanumeric(a) == S.only_alphanumeric(b)).alias("alnum_equal")
    )


@R.query()
def comparisons_made(spark: SparkSession, d: str) -> DataFrame:
    """CP1, CP2, CP4, CP5: similarity, word changes and unified diff of every pair."""
    made = C.compared(table(spark, d, "comparisons").select("comparison_id", "label", "published_norm", "replayed_norm"), F.col("label"), F.col("published_norm"), F.col("replayed_norm"))
    return made.select("comparison_id", "normalized_match", "similarity", F.size("changes").alias("n_changes"), "changes", "diff")


@R.query(
    r"SELECT comparison_id, len(list_filter(list_transform(string_split(regexp_replace(published_norm, '([.;:])[ \t\n\r\f\v]+([A-Z(\"''])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS parts,"
    r" md5(array_to_string(list_filter(list_transform(string_split(regexp_replace(published_norm, '([.;:])[ \t\n\r\f\v]+([A-Z(\"''])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> ''), '|')) AS digest"
    " FROM comparisons"
)
def sentences(spark: SparkSession, d: str) -> DataFrame:
    """CP3: texts cut into sentences, without breaking citations."""
    parts = C.sentence_parts(F.col("published_norm"))
    return table(spark, d, "comparisons").select("comparison_id", F.size(parts).cast("long").alias("parts"), F.md5(F.array_join(parts, "|")).alias("digest"))


_PA = r"[0-9]{2,3}-[0-9]{1,4}"


@R.query(
    "WITH l AS (SELECT block_id, " + sql_collapsed("source.raw") + " AS line FROM blocks WHERE source.raw IS NOT NULL),"
    # overlapping neighbours are told apart by doubling what may stand between two numbers
    rf" t AS (SELECT block_id, line, CASE WHEN regexp_matches(line, '(?i)\bP\.?\s?A\.?\s*{_PA}') THEN regexp_extract_all(regexp_replace(' ' || line || ' ', '([^A-Za-z0-9_.\-])', '\1\1', 'g'),"
    rf" '[^A-Za-z0-9_.\-]({_PA})[^A-Za-z0-9_\-]', 1) ELSE [] END AS found FROM l),"
    " n AS (SELECT block_id, line, list_filter(found, lambda x, i: list_position(found, x) = i) AS pa FROM t)"
    r" SELECT block_id, array_to_string(pa, ',') AS pa_numbers, len(pa)::INT AS n, pa[-1] AS terminal_pa, len(pa) > 0 AS reconstructable, len(pa) > 1 AS multi_act,"
    r" regexp_matches(line, '(?i)\b(R\.S\.|Laws\s+[0-9]{4}|Rev\.\s*Stat\.|P\.\s*A\.\s*77-2500|Code\s+[0-9]{4})') AS other_source,"
    " CASE WHEN len(pa) > 0 THEN printf('%03d-%04d', split_part(pa[-1], '-', 1)::INT, split_part(pa[-1], '-', 2)::INT) END AS padded,"
    " coalesce(split_part(pa[-1], '-', 1)::INT, 0) AS assembly FROM n"
)
def source_lines(spark: SparkSession, d: str) -> DataFrame:
    """PS8, PS9, PS12, PS13: Act numbers of every source line, the last one padded, and its assembly."""
    src = P.source_line(F.col("source.raw"))
    rows = table(spark, d, "blocks").where("source.raw IS NOT NULL").select("block_id", src.alias("s"))
    s, last = F.col("s"), P.terminal_act(F.col("s"))
    return rows.select(
        "block_id",
        F.array_join(s["pa_numbers"], ",").alias("pa_numbers"),
        F.size(s["pa_numbers"]).alias("n"),
        last.alias("terminal_pa"),
        P.is_reconstructable(s).alias("reconstructable"),
        P.is_multi_act(s).alias("multi_act"),
        s["has_non_pa_provenance"].alias("other_source"),
        S.padded_act(last).alias("padded"),
        S.assembly_of(last).alias("assembly"),
    )


@R.query(
    "SELECT block_id, citation.chapter || ' ILCS ' || citation.act || '/' || citation.section AS citation, lower(citation.section) LIKE '%heading%' AS heading,"
    " CASE WHEN regexp_full_match(citation.act, '[0-9]+(\\.[0-9]+)?') THEN printf('%04d%05d', citation.chapter::BIGINT, round_even(citation.act::DOUBLE * 10, 0)::BIGINT) || 'K' || citation.section END AS document,"
    " 'https://archive.statutes.example/documents/' || printf('%04d%05d', citation.chapter::BIGINT, round_even(try_cast(citation.act AS DOUBLE) * 10, 0)::BIGINT) || 'K' || citation.section || '.htm' AS url,"
    " '/us-il/act/' || citation.chapter || '/' || citation.act || '/' || citation.section || '@' || strftime(make_timestamp(epoch_us(seen_at)), '%Y-%m-%d') AS uri FROM blocks"
)
def citations(spark: SparkSession, d: str) -> DataFrame:
    """PS10, PS11, D19: citations as text, the documents' names and urls, and stable identifiers."""
    c = F.col("citation")
    name = S.document_name(c["chapter"], c["act"], c["section"])
    return table(spark, d, "blocks").select(
        "block_id",
        S.citation_text(c).alias("citation"),
        S.is_heading(c["section"]).alias("heading"),
        name.alias("document"),
        S.section_url(F.lit("https://archive.statutes.example"), name).alias("url"),
        S.stable_uri(c["chapter"], c["act"], c["section"], F.col("seen_at")).alias("uri"),
    )


@R.query(
    "SELECT case_idx, trim(split_part(act_label, ' ILCS ', 1)) AS chapter, trim(split_part(split_part(act_label, ' ILCS ', 2), '/', 1)) AS act,"
    " coalesce(try_cast(split_part(act_label, ' ILCS ', 1) AS BIGINT), 1000000000) AS chapter_order FROM cases"
)
def act_keys(spark: SparkSession, d: str) -> DataFrame:
    """PS14, PS15: the Act that a label names, and the order of chapters."""
    key = S.act_key(F.col("act_label"))
    return table(spark, d, "cases").select("case_idx", key["chapter"].alias("chapter"), key["act"].alias("act"), S.chapter_order(key["chapter"])[0].alias("chapter_order"))


_HEAD = r"\(\s*[0-9]+\s+ILCS\s+[0-9A-Za-z.\-]+\s*/\s*[^)]*?\s*\)"


@R.query(
    # one header window per piece; in each, versions end with their source trailers
    f"WITH w AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(text, '({_HEAD})', chr(1) || '\\1', 'g'), chr(1)), lambda x: regexp_matches(x, '^{_HEAD}'))) AS win,"
    f" generate_subscripts(list_filter(string_split(regexp_replace(text, '({_HEAD})', chr(1) || '\\1', 'g'), chr(1)), lambda x: regexp_matches(x, '^{_HEAD}')), 1) - 1 AS pos FROM documents),"
    r" s AS (SELECT doc_id, pos, win, regexp_extract_all(win, '(?is)(.*?\(\s*Source:\s*[^)]*?\s*\))', 1) AS found FROM w),"
    " v AS (SELECT doc_id, pos, win, unnest(CASE WHEN len(found) > 0 THEN found ELSE [win] END) AS raw, generate_subscripts(CASE WHEN len(found) > 0 THEN found ELSE [win] END, 1) AS ver FROM s)"
    r" SELECT doc_id, pos::INT AS pos, ver::INT AS ver, regexp_extract(win, '^\(\s*([0-9]+)', 1) AS chapter, regexp_extract(win, '^\(\s*[0-9]+\s+ILCS\s+([0-9A-Za-z.\-]+)', 1) AS act,"
    r" trim(regexp_replace(regexp_extract(win, '^\(\s*[0-9]+\s+ILCS\s+[0-9A-Za-z.\-]+\s*/\s*([^)]*?)\s*\)', 1), '\s+', ' ', 'g')) AS section,"
    r" nullif(regexp_extract(raw, '\bSec\.\s*([0-9A-Za-z.\-]+)\s*\.', 1), '') AS catchline, md5(raw) AS raw_digest,"
    f" CASE WHEN regexp_matches(raw, '(?is)\\(\\s*Source:\\s*[^)]*?\\s*\\)') THEN trim(regexp_replace(regexp_extract(raw, '(?is)\\(\\s*Source:\\s*([^)]*?)\\s*\\)', 1), '{WS}+', ' ', 'g')) END AS source"
    r" FROM v WHERE regexp_extract(win, '^\(\s*[0-9]+\s+ILCS\s+[0-9A-Za-z.\-]+\s*/\s*([^)]*?)\s*\)', 1) <> ''"
)
def parsed_documents(spark: SparkSession, d: str) -> DataFrame:
    """PS1-PS3, PS6, PS8: section blocks of every document."""
    return P.parse_blocks(table(spark, d, "documents"), "doc_id", F.col("text")).select(
        "doc_id", "pos", "ver", "citation.chapter", "citation.act", "citation.section", "catchline", F.md5("raw").alias("raw_digest"), F.col("source.raw").alias("source")
    )


@R.query(
    r"WITH b AS (SELECT block_id, raw, regexp_extract(raw, '(?is)\(\s*Source:\s*[^)]*?\s*\)') AS trailer, regexp_extract(raw, '\bSec\.\s*[0-9A-Za-z.\-]+\s*\.') AS catch FROM blocks WHERE raw IS NOT NULL AND NOT regexp_matches(raw, 'Section\s+[0-9]+[0-9A-Za-z.\-]*\.')"
    rf" AND len(regexp_extract_all(raw, '{_HEAD}')) = 1 AND len(regexp_extract_all(raw, '(?is)\(\s*Source:\s*[^)]*?\s*\)')) = 1 AND regexp_matches(raw, '^{_HEAD}') AND regexp_matches(raw, '\bSec\.\s*[0-9A-Za-z.\-]+\s*\.'))"
    r" SELECT block_id, nullif(regexp_extract(raw, '(?is)\(\s*from\s+Ch\.\s*([^)]+?)\s*\)', 1), '') AS legacy_cite,"
    f" nullif({sql_collapsed(chr(39).join(['regexp_extract(raw, ', '(?is)' + chr(92) + '(' + chr(92) + 's*Text of (?:Section|Sec' + chr(92) + '.)[^)]*?' + chr(92) + ')', ')']))}, '') AS version_marker,"
    " md5(CASE WHEN strpos(raw, catch) < strpos(raw, trailer) THEN substr(raw, strpos(raw, catch), strpos(raw, trailer) - strpos(raw, catch)) ELSE '' END) AS body_digest FROM b"
)
def parsed_blocks(spark: SparkSession, d: str) -> DataFrame:
    """PS5, PS7: the marks and body of blocks that hold one headed section with a catchline and a trailer, as the SQL has
    them; :func:`section_blocks` has those of all blocks."""
    one = lambda pattern: F.size(F.regexp_extract_all("raw", F.lit(pattern), F.lit(0))) == 1
    blocks = table(spark, d, "blocks").where(F.col("raw").isNotNull() & ~F.col("raw").rlike(r"Section\s+[0-9]+[0-9A-Za-z.\-]*\."))
    blocks = blocks.where(one(P.HEADER) & one(P.SOURCE) & F.col("raw").rlike(f"^{P.HEADER}") & F.col("raw").rlike(P.CATCHLINE))
    return P.parse_blocks(blocks, "block_id", F.col("raw")).select(F.col("doc_id").alias("block_id"), "legacy_cite", "version_marker", F.md5("body").alias("body_digest"))


@R.query()
def section_blocks(spark: SparkSession, d: str) -> DataFrame:
    """PS1-PS3, PS5-PS8: all section blocks of every document's text and every block's raw, with all their marks."""
    documents = P.parse_blocks(table(spark, d, "documents"), "doc_id", F.col("text")).withColumn("record_kind", F.lit("document"))
    blocks = P.parse_blocks(table(spark, d, "blocks"), "block_id", F.col("raw")).withColumn("record_kind", F.lit("block"))
    return documents.unionByName(blocks).select(
        "record_kind", F.col("doc_id").alias("record_id"), "pos", "ver", S.citation_text(F.col("citation")).alias("citation"), "op_marker", "catchline", "legacy_cite", "version_marker",
        F.when(F.col("renumbered_from").isNotNull(), S.citation_text(F.col("renumbered_from"))).alias("renumbered_from"), F.md5("raw").alias("raw_digest"), F.md5("body").alias("body_digest"), F.col("source.raw").alias("source"),
    )


@R.query(
    "SELECT response_id, (len(regexp_extract_all(body, '(?i)<(?:strike|s|del)(?:\\s[^<>]*)?>')))::INT AS strike_spans, (len(regexp_extract_all(body, '(?i)<(?:u|ins)(?:\\s[^<>]*)?>')))::INT AS insert_spans FROM responses WHERE body IS NOT NULL"
)
def marked_spans(spark: SparkSession, d: str) -> DataFrame:
    """EX1-EX3: deletions and insertions marked on every page."""
    x = X.extraction(F.col("body"))
    return table(spark, d, "responses").where("body IS NOT NULL").select("response_id", x["strike_spans"].alias("strike_spans"), x["insert_spans"].alias("insert_spans"))


@R.query()
def extracted_pages(spark: SparkSession, d: str) -> DataFrame:
    """EX1-EX10: both readings of every page."""
    x = X.extraction(F.col("body"))
    return table(spark, d, "responses").select("response_id", x.alias("x")).select("response_id", "x.*")


@R.query(
    f"SELECT block_id, md5(array_to_string(list_filter(string_split(body, chr(10)), lambda x: NOT regexp_full_match(x, '{WS}*[0-9]{{1,3}}{WS}*')), chr(10))) AS numbers_dropped,"
    f" md5(array_to_string(list_filter(list_transform(string_split(replace(body, chr(160), ' '), chr(10)), lambda x: regexp_replace(x, '{WS}+$', '')), lambda x: x <> ''), chr(10))) AS tidied FROM blocks"
)
def tidied_bodies(spark: SparkSession, d: str) -> DataFrame:
    """EX7, EX9, EX11: non-breaking spaces, blank lines and line numbers."""
    tidied = X.tidy_lines(F.replace(F.col("body"), F.lit("\u00a0"), F.lit(" ")))
    return table(spark, d, "blocks").select("block_id", F.md5(X.drop_line_numbers(F.col("body"))).alias("numbers_dropped"), F.md5(tidied).alias("tidied"))


@R.query(
    r"SELECT response_id, coalesce(regexp_matches(body, '(?i)Document:\s*[0-9A-Za-z\-]+\s*is not currently available'), false) AS placeholder,"
    rf" coalesce(status = 200 AND regexp_replace(body, '{WS}+', '', 'g') <> '' AND NOT regexp_matches(body, '(?i)Document:\s*[0-9A-Za-z\-]+\s*is not currently available'), false) AS readable,"
    r" coalesce(status = 404, false) OR coalesce(regexp_matches(body, '(?i)Document:\s*[0-9A-Za-z\-]+\s*is not currently available'), false) AS missing,"
    r" coalesce(status = 200 AND NOT regexp_matches(body, '(?i)Document:\s*[0-9A-Za-z\-]+\s*is not currently available') AND length(body) > 500, false) AS published,"
    r" coalesce(status IN (429, 503, 509), false) OR coalesce(status = 403 AND coalesce(regexp_matches(substr(body, 1, 4096), '(?i)rate[ -]?limit|too many requests|slow down|temporarily blocked|access denied'), true), false) AS throttling FROM responses"
)
def availability(spark: SparkSession, d: str) -> DataFrame:
    """FL3-FL5, FL10: the three meanings of available, and throttling."""
    s, b = F.col("status"), F.col("body")
    return table(spark, d, "responses").select(
        "response_id", S.is_placeholder(b).alias("placeholder"), S.is_readable(s, b).alias("readable"), S.is_missing(s, b).alias("missing"),
        S.is_published(s, b).alias("published"), S.is_throttling(s, F.lit(None).cast("string"), b).alias("throttling"),
    )


@R.query(
    f"SELECT block_id, coalesce(regexp_matches({sql_collapsed('body')}, '(?i)^Sec\\.?\\s*\\S*\\s*\\.?\\s*\\(\\s*Repealed\\s*\\)\\.?$'), false) AS stub, coalesce(regexp_matches(source.raw, '(?i)\\bRenumbered\\s+by\\b'), false) AS renumbered,"
    " op_marker = 'new' IS TRUE AS added, op_marker = 'rep.' IS TRUE AS repealed_here, version_marker IS NOT NULL AS has_version_marker FROM blocks"
)
def section_flags(spark: SparkSession, d: str) -> DataFrame:
    """FL6, FL7, FL13, FL2: repeal stubs, renumbered, added and repealed sections."""
    return table(spark, d, "blocks").select(
        "block_id", S.is_repeal_stub(F.col("body")).alias("stub"), S.is_renumbered(F.col("source.raw")).alias("renumbered"),
        F.col("op_marker").eqNullSafe("new").alias("added"), F.col("op_marker").eqNullSafe("rep.").alias("repealed_here"), F.col("version_marker").isNotNull().alias("has_version_marker"),
    )


_HOST = r"lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''))"
_PATH = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1))"


@R.query(
    r"SELECT ledger_id, CASE WHEN url IS NULL THEN NULL WHEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) NOT IN ('http', 'https') THEN 'scheme'"
    rf" WHEN {_HOST} NOT IN ('archive.statutes.example') THEN 'host' WHEN {_PATH} = '/acts' OR {_PATH} LIKE '/acts/%' OR {_PATH} LIKE '/acts.%' THEN 'path' ELSE 'ok' END AS verdict,"
    r" substr(regexp_replace(CASE WHEN split_part(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/', -1) = '' THEN 'index' ELSE split_part(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/', -1) END,"
    r" '[^\p{L}\p{N}\-._]', '_', 'g'), 1, 48) || '.' || substr(sha256(url), 1, 16) AS cache_key FROM ledger"
)
def url_policy(spark: SparkSession, d: str) -> DataFrame:
    """FL9 and the cache key, over every url of the mirror, with this mirror's host and a denied path."""
    return table(spark, d, "ledger").select("ledger_id", S.url_verdict(F.col("url"), ["archive.statutes.example"], ["/acts"]).alias("verdict"), S.cache_key(F.col("url")).alias("cache_key"))


@R.query(
    "SELECT seq, CASE WHEN regexp_full_match(pa_number, '\\s*[0-9]+-[0-9]+\\s*') THEN 'https://h.example/acts/' || printf('%03d-%04d', split_part(trim(pa_number), '-', 1)::BIGINT, split_part(trim(pa_number), '-', 2)::BIGINT) END AS act_url,"
    " 'https://h.example/Articles?ActID=' || act_id || '&ChapterID=' || coalesce(chapter_id, '0') AS articles_url, 'https://h.example/Acts?ChapterID=' || chapter_id AS acts_url,"
    " replace(replace(replace('/x y?a=1&amp;b=&#x2B;' || act_id, '&amp;', '&'), '&#x2B;', '+'), ' ', '%20') AS href FROM queue"
)
def built_urls(spark: SparkSession, d: str) -> DataFrame:
    """PS16 and the url builders, over the work queue."""
    base = F.lit("https://h.example")
    return table(spark, d, "queue").select(
        "seq", S.act_url(base, F.col("pa_number")).alias("act_url"), S.articles_url(base, F.col("act_id"), F.col("chapter_id")).alias("articles_url"),
        S.acts_url(base, F.col("chapter_id")).alias("acts_url"), S.unescape_href(F.concat(F.lit("/x y?a=1&amp;b=&#x2B;"), F.col("act_id"))).alias("href"),
    )


@R.query(
    "SELECT response_id, sha256(body) AS digest, (sha256(body) = regexp_replace(lower(sha256), '^[a-z0-9\\-]+[:=]', '')) AS as_recorded, octet_length(encode(body)) AS bytes, length(body) AS chars FROM responses WHERE body IS NOT NULL"
)
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """The content hash of every body, with its bytes and characters."""
    from strataleaf.functions.references import hash_value

    return table(spark, d, "responses").where("body IS NOT NULL").select(
        "response_id", S.content_hash(F.col("body")).alias("digest"), (S.content_hash(F.col("body")) == hash_value(F.col("sha256"))).alias("as_recorded"),
        F.octet_length("body").cast("long").alias("bytes"), F.char_length("body").cast("long").alias("chars"),
    )


@R.query(
    "WITH e AS (SELECT event_id, (event_id * 37 % 90000 - 100)::BIGINT AS s FROM events) SELECT event_id, CASE WHEN s >= 3600 THEN printf('%dh %dm', s // 3600, s % 3600 // 60) WHEN s >= 60 THEN printf('%dm %ds', s // 60, s % 60) WHEN s < 0 THEN '0s' ELSE printf('%ds', s) END AS took,"
    " CASE WHEN s > 0 THEN printf('%.1f%%', 100.0 * (s // 7)::DOUBLE / s) ELSE 'n/a' END AS part FROM e"
)
def durations(spark: SparkSession, d: str) -> DataFrame:
    """Durations and percentages as they are printed."""
    s = F.col("event_id") * 37 % 90000 - 100
    return table(spark, d, "events").select("event_id", S.duration(s).alias("took"), S.percent(F.floor(s / 7).cast("double"), s).alias("part"))

