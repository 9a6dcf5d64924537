"""Queries of the record operators: matching, metrics, sampling, the mirror, and versions in time."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataleaf.functions import scalars as S
from strataleaf.functions.references import act_number, hash_value, page_url
from strataleaf.functions.whitespace import DUCK_WS as WS
from strataleaf.operators import extract as X
from strataleaf.operators import ledger as L
from strataleaf.operators import match as M
from strataleaf.operators import metrics as G
from strataleaf.operators import sampling as A
from strataleaf.operators import sections as P
from strataleaf.operators import temporal as V
from strataleaf.operators.compare import sentence_parts
from strataleaf.plans.registry import Registry
from strataleaf.plans.texts import _PA, sql_collapsed, sql_normalized
from strataleaf.sources import index_pages, store
from strataleaf.sources.tables import table

R = Registry()
LAST = 8

# --- shared views, and their SQL ---------------------------------------------------------------------------------------

SECTIONS = f"(SELECT * FROM blocks WHERE snapshot_no = {LAST} QUALIFY row_number() OVER (PARTITION BY citation, ver ORDER BY seen_at DESC, block_id DESC) = 1)"
CASES = "(SELECT * FROM cases QUALIFY row_number() OVER (PARTITION BY citation, ver, run_no ORDER BY run_at DESC, case_idx DESC) = 1)"
_CITED = "citation.chapter || ' ILCS ' || citation.act || '/' || citation.section"
#: Act numbers of a source line in SQL: what may stand between two of them is doubled, as RE2 knows no lookaround.
_FOUND = (
    rf"regexp_extract_all(regexp_replace(' ' || {sql_collapsed('source.raw')} || ' ', '([^A-Za-z0-9_.\-])', '\1\1', 'g'), '[^A-Za-z0-9_.\-]({_PA})[^A-Za-z0-9_\-]', 1)"
)
_ACTS = (
    rf"CASE WHEN regexp_matches({sql_collapsed('source.raw')}, '(?i)\bP\.?\s?A\.?\s*{_PA}') THEN list_filter({_FOUND}, lambda x, i: list_position({_FOUND}, x) = i) ELSE [] END"
)
_LAST_ACT = f"({_ACTS})[-1]"
_PADDED = lambda t: f"CASE WHEN {t} IS NOT NULL THEN printf('%03d-%04d', split_part({t}, '-', 1)::INT, split_part({t}, '-', 2)::INT) END"
_NUMBER = r"regexp_extract({t}, '(?i)^\s*(?:p\.?\s*a\.?|public\s+acts?)?\s*0*([0-9]+)\s*[-–]\s*0*([0-9]+)\s*\.?\s*$', {i})"


def sections(spark: SparkSession, d: str) -> DataFrame:
    """The sections of the last snapshot, each version once, with its source line read anew."""
    blocks = table(spark, d, "blocks").where(F.col("snapshot_no") == LAST)
    return M.latest_rows(blocks, ["citation", "ver"], ["seen_at", "block_id"]).withColumn("source", P.source_line(F.col("source.raw")))


def cases(spark: SparkSession, d: str) -> DataFrame:
    """The cases of all runs, the last row of each."""
    return M.latest_rows(table(spark, d, "cases"), ["citation", "ver", "run_no"], ["run_at", "case_idx"])


def terminal(source: Column) -> Column:
    return P.terminal_act(source)


def printed_blocks(spark: SparkSession, d: str) -> DataFrame:
    """What the Acts print: the earlier snapshots' blocks under the Act that their own source line names last."""
    earlier = table(spark, d, "blocks").where(F.col("snapshot_no") < LAST)
    return earlier.select(
        S.padded_act(terminal(P.source_line(F.col("source.raw")))).alias("pa_key"),
        "citation",
        F.col("block_id").alias("pos"),
        "body",
        F.col("raw").alias("pre_body"),
        "version_marker",
        "op_marker",
    ).where("pa_key IS NOT NULL")


def known_acts(spark: SparkSession, d: str) -> DataFrame:
    """The Acts held, with those that were withdrawn as failed fetches."""
    number = act_number(F.col("pa_number"))
    rows = table(spark, d, "enactments").select(
        S.padded_act(F.concat_ws("-", number["assembly"], number["serial"])).alias("pa_key"), F.col("withdrawn_at").isNull().alias("held")
    )
    return rows.where("pa_key IS NOT NULL").groupBy("pa_key").agg(F.bool_or("held").alias("online"), (~F.bool_or("held")).alias("failed"))


def acts_with_counts(acts: DataFrame, printed: DataFrame) -> DataFrame:
    """``acts`` with how many blocks each prints, and how many marked deletions and insertions are in them."""
    spans = X.extraction(F.col("pre_body"))
    counts = printed.select("pa_key", spans["strike_spans"].alias("s"), spans["insert_spans"].alias("i")).groupBy("pa_key").agg(
        F.count(F.lit(1)).alias("blocks_in_act"), F.sum("s").alias("strike_spans"), F.sum("i").alias("insert_spans")
    )
    named = ("blocks_in_act", "strike_spans", "insert_spans")
    return acts.join(counts, "pa_key", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("int") for c in named})


# --- matching ------------------------------------------------------------------------------------------------------------

_PRINTED = f"(SELECT {_PADDED(_LAST_ACT)} AS pa_key, citation, op_marker FROM blocks WHERE snapshot_no < {LAST})"


@R.query(
    f"WITH s AS (SELECT block_id, citation, {_PADDED(_LAST_ACT)} AS pa_key FROM {SECTIONS}), c AS (SELECT pa_key, citation, count(*) FILTER (WHERE op_marker IS DISTINCT FROM 'rep.') AS n,"
    f" bool_or(op_marker IS NOT DISTINCT FROM 'new') AS added, bool_or(op_marker IS NOT DISTINCT FROM 'rep.') AS repealed FROM {_PRINTED} WHERE pa_key IS NOT NULL GROUP BY ALL)"
    " SELECT s.block_id, s.pa_key, coalesce(c.n, 0) AS candidates, coalesce(c.added, false) AS added, coalesce(c.repealed, false) AS repealed FROM s LEFT JOIN c ON s.pa_key = c.pa_key AND s.citation = c.citation"
)
def hop_candidates(spark: SparkSession, d: str) -> DataFrame:
    """JN1, JN2, AG12: for each current section how many blocks its source Act prints of it."""
    s = sections(spark, d).select(F.col("block_id").alias("case_idx"), "citation", S.padded_act(terminal(F.col("source"))).alias("pa_key"))
    out = M.candidates_of(s, printed_blocks(spark, d))
    return out.select(F.col("case_idx").alias("block_id"), "pa_key", F.col("candidates_in_act").alias("candidates"), F.col("added_by_this_act").alias("added"), F.col("repealed_here").alias("repealed"))


@R.query()
def single_hop_cases(spark: SparkSession, d: str) -> DataFrame:
    """JN1-JN3, WN1, CP1-CP5, CL1-CL5: every current section matched with its source Act, compared and labelled."""
    s = sections(spark, d).select(F.col("block_id").alias("case_idx"), "citation", "body", "version_marker", F.coalesce("source", P.source_line(F.lit(""))).alias("source"))
    printed = printed_blocks(spark, d)
    return M.single_hop(s, acts_with_counts(known_acts(spark, d), printed), printed)


@R.query(
    f"WITH c AS (SELECT citation, candidates_in_act, published_version_marker, len(all_pas) AS acts FROM {CASES} WHERE run_no = {LAST} AND ver = 1),"
    f" p AS (SELECT comparison_id, label, published_norm AS a, replayed_norm AS b, {sql_normalized('published_norm')} = {sql_normalized('replayed_norm')} AS same FROM comparisons)"
    " SELECT comparison_id, CASE WHEN coalesce(same, false) THEN 'MATCH' WHEN coalesce(regexp_matches(" + sql_collapsed("a") + r", '(?i)^Sec\.?\s*\S*\s*\.?\s*\(\s*Repealed\s*\)\.?$'), false) THEN 'REPEALED_STUB'"
    " WHEN candidates_in_act = 0 THEN 'TARGET_RESOLUTION' WHEN regexp_replace(a, '[^A-Za-z0-9]+', '', 'g') = regexp_replace(b, '[^A-Za-z0-9]+', '', 'g') THEN 'NORMALIZE'"
    " WHEN candidates_in_act > 1 OR published_version_marker IS NOT NULL THEN 'MULTI_VERSION' WHEN acts > 1 THEN 'MULTI_ACT' ELSE 'DIVERGENCE' END AS classification FROM p LEFT JOIN c ON c.citation = p.label"
)
def labelled_comparisons(spark: SparkSession, d: str) -> DataFrame:
    """CL1: every comparison labelled anew, with what the last run knows of its section."""
    from strataleaf.functions.normalize import normalize

    known = cases(spark, d).where(f"run_no = {LAST} AND ver = 1").select(F.col("citation").alias("label"), "candidates_in_act", "published_version_marker", F.size("all_pas").alias("acts"))
    a, b = F.col("published_norm"), F.col("replayed_norm")
    return table(spark, d, "comparisons").join(known, "label", "left").select(
        "comparison_id", M.label(normalize(a) == normalize(b), a, b, F.col("candidates_in_act"), F.col("published_version_marker"), F.col("acts")).alias("classification")
    )


# --- metrics -------------------------------------------------------------------------------------------------------------

_GONE = "classification IN ('UNRECONSTRUCTABLE', 'ACT_NOT_ONLINE', 'FETCH_ERROR')"


@R.query(f"SELECT classification, count(*) AS n, min(case_idx) AS first_idx FROM {CASES} GROUP BY 1")
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.class_counts(cases(spark, d))


@R.query(
    f"SELECT CASE WHEN grouping(act_label) = 0 THEN 'act_label' WHEN grouping(stratum) = 0 THEN 'stratum' WHEN grouping(run) = 0 THEN 'run' ELSE 'all' END AS grouping,"
    " CASE WHEN grouping(act_label) = 0 THEN act_label WHEN grouping(stratum) = 0 THEN stratum WHEN grouping(run) = 0 THEN run END AS value,"
    f" count(*) FILTER (WHERE NOT {_GONE}) AS attempted, count(*) FILTER (WHERE NOT {_GONE} AND normalized_match) AS matched, count(*) FILTER (WHERE {_GONE}) AS excluded"
    f" FROM (SELECT *, run_no::VARCHAR AS run FROM {CASES}) GROUP BY GROUPING SETS ((act_label), (stratum), (run), ())"
)
def tallies(spark: SparkSession, d: str) -> DataFrame:
    """AG2, D8: by Act, by stratum, by run and overall."""
    return G.tallies(cases(spark, d).withColumn("run", F.col("run_no").cast("string")), "act_label", "stratum", "run")


@R.query(
    f"SELECT coalesce(try_cast(split_part(terminal_pa, '-', 1) AS INT), 0) AS ga, count(*) FILTER (WHERE classification <> 'ACT_NOT_ONLINE') AS online, count(*) FILTER (WHERE classification = 'ACT_NOT_ONLINE') AS not_online"
    f" FROM {CASES} WHERE terminal_pa IS NOT NULL GROUP BY 1"
)
def assembly_availability(spark: SparkSession, d: str) -> DataFrame:
    return G.assembly_availability(cases(spark, d))


@R.query(
    f"WITH a AS (SELECT count(*) AS sampled, count(*) FILTER (WHERE NOT {_GONE}) AS attempted, count(*) FILTER (WHERE classification = 'UNRECONSTRUCTABLE') AS unreconstructable, count(*) FILTER (WHERE classification = 'ACT_NOT_ONLINE') AS not_online,"
    f" count(*) FILTER (WHERE normalized_match AND NOT {_GONE}) AS matched, count(*) FILTER (WHERE exact_match AND NOT {_GONE}) AS exact, count(*) FILTER (WHERE {_GONE}) AS excluded_total, count(*) FILTER (WHERE classification IN ('REPEALED_STUB', 'RENUMBERED')) AS structural,"
    f" count(*) FILTER (WHERE NOT {_GONE} AND carried_amendment_markup) AS markup, count(*) FILTER (WHERE normalized_match AND NOT {_GONE} AND carried_amendment_markup) AS markup_matched,"
    f" count(*) FILTER (WHERE NOT {_GONE} AND added_by_this_act) AS added, count(*) FILTER (WHERE normalized_match AND NOT {_GONE} AND added_by_this_act) AS added_matched FROM {CASES})"
    " SELECT *, coalesce(matched / nullif(sampled, 0), 0.0)::DOUBLE AS rate_fixed, coalesce(matched / nullif(attempted, 0), 0.0)::DOUBLE AS rate_attempted, coalesce(exact / nullif(attempted, 0), 0.0)::DOUBLE AS rate_exact, coalesce(matched / nullif(attempted - structural, 0), 0.0)::DOUBLE AS rate_reachable,"
    " (matched / attempted::DOUBLE + 1.959963984540054 ^ 2 / (2 * attempted) - 1.959963984540054 * sqrt(matched / attempted::DOUBLE * (1 - matched / attempted::DOUBLE) / attempted + 1.959963984540054 ^ 2 / (4 * attempted::DOUBLE * attempted))) / (1 + 1.959963984540054 ^ 2 / attempted) AS wilson_low,"
    " (matched / attempted::DOUBLE + 1.959963984540054 ^ 2 / (2 * attempted) + 1.959963984540054 * sqrt(matched / attempted::DOUBLE * (1 - matched / attempted::DOUBLE) / attempted + 1.959963984540054 ^ 2 / (4 * attempted::DOUBLE * attempted))) / (1 + 1.959963984540054 ^ 2 / attempted) AS wilson_high FROM a"
)
def headline(spark: SparkSession, d: str) -> DataFrame:
    """AG4, AG5, AG13; figures are rounded by the comparison only."""
    return G.headline(cases(spark, d))


@R.query(f"SELECT DISTINCT {_PADDED(_LAST_ACT)} AS pa_key FROM {SECTIONS} WHERE {_LAST_ACT} IS NOT NULL ORDER BY 1")
def distinct_acts(spark: SparkSession, d: str) -> DataFrame:
    """AG7: the Acts that current sections name last, in order."""
    return sections(spark, d).select(S.padded_act(terminal(F.col("source"))).alias("pa_key")).where("pa_key IS NOT NULL").distinct().orderBy("pa_key")


@R.query(
    f"WITH s AS (SELECT {_LAST_ACT} AS t FROM {SECTIONS}), g AS (SELECT t, coalesce(try_cast(split_part(t, '-', 1) AS INT), 0) >= {S.FLOOR_GA} AS above, {_PADDED('t')} AS p FROM s)"
    " SELECT count(*) AS sections, count(*) FILTER (WHERE t IS NOT NULL AND above) AS checkable, count(*) FILTER (WHERE t IS NOT NULL AND NOT above) AS below_floor, count(*) FILTER (WHERE t IS NULL) AS no_pa,"
    " count(DISTINCT CASE WHEN above THEN p END) AS acts_at_floor, count(DISTINCT CASE WHEN NOT above THEN p END) AS acts_below FROM g"
)
def coverage(spark: SparkSession, d: str) -> DataFrame:
    """AG8, FL12."""
    return G.coverage(sections(spark, d).withColumn("t", terminal(F.col("source"))), F.col("t"))


@R.query(
    "WITH m AS (SELECT DISTINCT url FROM responses WHERE status = 200) SELECT tier, count(m.url) AS done, count(*) AS total FROM (SELECT tier, regexp_replace(url, '^.*/acts/', '') AS k FROM queue) q"
    " LEFT JOIN (SELECT DISTINCT printf('%03d-%04d', regexp_extract(pa_number, '([0-9]+)[^0-9]+([0-9]+)', 1)::INT, regexp_extract(pa_number, '([0-9]+)[^0-9]+([0-9]+)', 2)::INT) AS url FROM enactments WHERE withdrawn_at IS NULL) m ON m.url = q.k GROUP BY tier"
)
def tier_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """AG9, JN6: work items of each tier whose Act is held."""
    queue = table(spark, d, "queue").select("tier", F.regexp_replace("url", "^.*/acts/", "").alias("pa_key"))
    return G.tier_breakdown(queue, known_acts(spark, d).where("online").select("pa_key"), "pa_key")


_PROBES = [f"{ga:03d}-{serial:04d}" for ga, serial in ((90, 1), (91, 1), (91, 500), (92, 1), (92, 500), (92, 900), (93, 1), (93, 2), (93, 500), (94, 1))]


@R.query(
    "WITH e AS (SELECT DISTINCT printf('%03d-%04d', regexp_extract(pa_number, '([0-9]+)[^0-9]+([0-9]+)', 1)::INT, regexp_extract(pa_number, '([0-9]+)[^0-9]+([0-9]+)', 2)::INT) AS pa_key FROM enactments),"
    " p AS (SELECT pa_key, row_number() OVER (ORDER BY pa_key) AS seq FROM e), s AS (SELECT p.*, bool_or(withdrawn_at IS NULL) AS published FROM p JOIN enactments n"
    " ON printf('%03d-%04d', regexp_extract(n.pa_number, '([0-9]+)[^0-9]+([0-9]+)', 1)::INT, regexp_extract(n.pa_number, '([0-9]+)[^0-9]+([0-9]+)', 2)::INT) = p.pa_key GROUP BY ALL)"
    f" SELECT count(*) AS probed, array_to_string(list(pa_key || CASE WHEN published THEN ' is available, but predates the {S.FLOOR_GA}rd GA' ELSE ' is unavailable, but is at or above the {S.FLOOR_GA}rd GA' END ORDER BY seq) FILTER (WHERE published <> (split_part(pa_key, '-', 1)::INT >= {S.FLOOR_GA})), '; ') AS disagreements FROM s"
)
def floor_probe(spark: SparkSession, d: str) -> DataFrame:
    """AG10, JN10: every Act held probed against the floor from which Acts are published."""
    acts = known_acts(spark, d)
    probes = acts.select("pa_key", F.conv(F.replace("pa_key", F.lit("-"), F.lit("")), 10, 10).cast("long").alias("seq"))
    return G.floor_probe(probes, acts, "pa_key", F.col("online")).withColumn("disagreements", F.array_join("disagreements", "; "))


@R.query(
    "WITH c AS (SELECT tier, count(*) FILTER (WHERE nullif(trim(act_id), '') IS NOT NULL) AS done, count(*) AS total, epoch(max(queued_at)) - epoch(min(queued_at)) AS elapsed_s FROM queue GROUP BY tier)"
    " SELECT tier, done, total, elapsed_s::DOUBLE AS elapsed_s, coalesce(done / nullif(elapsed_s, 0), 0.0)::DOUBLE AS rate, coalesce(done / nullif(total, 0), 0.0)::DOUBLE AS part, (total - done) / nullif(done / nullif(elapsed_s, 0), 0)::DOUBLE AS to_go_s,"
    " CASE WHEN done >= total THEN 'drained' WHEN elapsed_s >= 14400 THEN 'deadline' ELSE 'running' END AS stopped FROM c"
)
def progress(spark: SparkSession, d: str) -> DataFrame:
    """AG11, ST6: rate, part and time to go of each tier, and why it stopped."""
    named = F.nullif(F.trim("act_id"), F.lit(""))
    elapsed = (F.max(F.unix_micros("queued_at")) - F.min(F.unix_micros("queued_at"))) / 1e6
    counters = table(spark, d, "queue").groupBy("tier").agg(F.count(named).alias("done"), F.count(F.lit(1)).alias("total"), elapsed.alias("elapsed_s"))
    no = F.lit(False)
    return G.progress(counters).withColumn("stopped", L.stop_reason(F.col("done"), F.col("total"), F.col("elapsed_s"), F.lit(14400), no, no))


# --- sampling ------------------------------------------------------------------------------------------------------------

_STRATUM = f"CASE WHEN t IS NULL THEN 'no_public_act' WHEN coalesce(try_cast(split_part(t, '-', 1) AS INT), 0) >= {S.RECENT_GA} THEN 'recent' WHEN coalesce(try_cast(split_part(t, '-', 1) AS INT), 0) >= {S.CORPUS_FLOOR_GA} THEN 'modern' ELSE 'pre_corpus' END"


@R.query(
    f"WITH s AS (SELECT block_id, citation.chapter || '/' || citation.act AS act, {_LAST_ACT} AS t FROM {SECTIONS}), x AS (SELECT block_id, act, {_STRATUM} AS stratum FROM s),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY act, stratum ORDER BY block_id) - 1 AS k, count(*) OVER (PARTITION BY act, stratum) AS n, CASE stratum WHEN 'recent' THEN 10 WHEN 'modern' THEN 10 WHEN 'pre_corpus' THEN 2 END AS q FROM x)"
    " SELECT block_id, act, stratum FROM r WHERE q IS NOT NULL AND (q >= n OR list_contains(list_transform(range(q), lambda i: floor(i * n::DOUBLE / q)::BIGINT), k))"
)
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """WN2-WN4: evenly spaced sections of each Act and stratum, by quota."""
    rows = sections(spark, d).select("block_id", F.concat_ws("/", "citation.chapter", "citation.act").alias("act"), S.stratum(F.coalesce("source.pa_numbers", F.array().cast("array<string>"))).alias("stratum"))
    return A.quota_sample(rows, ["act"], "stratum", S.QUOTAS, ["block_id"]).select("block_id", "act", "stratum")


@R.query(
    f"WITH s AS (SELECT {_LAST_ACT} AS t FROM {SECTIONS}) SELECT {_STRATUM} AS stratum, count(*) AS n FROM s GROUP BY 1"
)
def strata(spark: SparkSession, d: str) -> DataFrame:
    """WN3: the strata partition the sections."""
    return sections(spark, d).groupBy(S.stratum(F.coalesce("source.pa_numbers", F.array().cast("array<string>"))).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


# --- index pages and sources ----------------------------------------------------------------------------------------------

_CHAPTER_PAGE = """'<li><a href="/Legislation/ILCS/Acts?ChapterID=' || chapter_id || '&ChapterNumber=' || (chapter_id::INT % 97) || '&Chapter= Chapter ' || response_id || ' ">x</a>'"""
_ACT_PAGE = """'<a href="/Legislation/ILCS/Articles?ActID=' || act_id || '&ChapterID=' || chapter_id || '" class="x"><b>' || chapter_id || ' ILCS</b>&nbsp;' || response_id || '/  Act</a>'"""


@R.query("SELECT chapter_id, first((chapter_id::INT % 97)::VARCHAR ORDER BY response_id) AS number, first('Chapter ' || response_id ORDER BY response_id) AS name FROM responses WHERE chapter_id IS NOT NULL GROUP BY 1")
def index_chapters(spark: SparkSession, d: str) -> DataFrame:
    """SRC3, WN6: chapters scanned out of index pages that are written from the responses."""
    return index_pages.chapters(table(spark, d, "responses"), F.col("response_id"), F.expr(_CHAPTER_PAGE))


@R.query("SELECT act_id, first(chapter_id || ' ILCS ' || response_id || '/ Act' ORDER BY response_id) AS label FROM responses WHERE act_id IS NOT NULL AND chapter_id IS NOT NULL GROUP BY 1")
def index_acts(spark: SparkSession, d: str) -> DataFrame:
    """SRC4, WN6: Acts scanned out of index pages."""
    return index_pages.acts(table(spark, d, "responses"), F.col("response_id"), F.expr(_ACT_PAGE))


_HEAD = r"\(\s*[0-9]+\s+ILCS\s+[0-9A-Za-z.\-]+\s*/\s*[^)]*?\s*\)"


@R.query(
    f"WITH h AS (SELECT doc_id, act_key, source = 'compiled_page' IS TRUE AS prim, list_filter(string_split(regexp_replace(text, '({_HEAD})', chr(1) || '\\1', 'g'), chr(1)), lambda x: regexp_matches(x, '^{_HEAD}')) AS w FROM documents WHERE act_key IS NOT NULL),"
    r" b AS (SELECT doc_id, act_key, prim, unnest(w) AS win FROM h), g AS (SELECT *, regexp_extract(win, '^\(\s*[0-9]+\s+ILCS\s+[0-9A-Za-z.\-]+\s*/\s*([^)]*?)\s*\)', 1) AS sec, greatest(1, len(regexp_extract_all(win, '(?is)(.*?\(\s*Source:\s*[^)]*?\s*\))'))) AS n FROM b),"
    " k AS (SELECT * FROM g WHERE sec <> '' AND lower(sec) NOT LIKE '%heading%'), p AS (SELECT act_key, bool_or(prim) AS has FROM k GROUP BY 1) SELECT k.act_key, k.doc_id, sum(n)::BIGINT AS blocks FROM k JOIN p USING (act_key) WHERE k.prim = p.has GROUP BY ALL"
)
def acts_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    """SRC5, FL1: each Act's blocks from its compiled pages, or from other documents if those hold none."""
    docs = table(spark, d, "documents")
    blocks = index_pages.blocks_with_fallback(docs, F.col("act_key"), "doc_id", F.col("text"), F.coalesce(F.col("source") == "compiled_page", F.lit(False)))
    return blocks.groupBy("act_key", "doc_id").agg(F.count(F.lit(1)).alias("blocks"))


_URL = r"lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), ':(443|80)$', '') || regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1)"
_HASH = "nullif(regexp_replace(lower(trim(sha256)), '^[a-z0-9\\-]+[:=]', ''), '')"
_MIRROR = f"(SELECT {_URL} AS page, status, {_HASH} AS digest, fetched_at, ledger_id FROM ledger QUALIFY row_number() OVER (PARTITION BY {_URL} ORDER BY fetched_at DESC, ledger_id DESC) = 1)"


def mirror(spark: SparkSession, d: str) -> DataFrame:
    """The last fetch of each page."""
    rows = table(spark, d, "ledger").select(page_url(F.col("url")).alias("page"), "status", hash_value(F.col("sha256")).alias("digest"), "fetched_at", "ledger_id")
    return M.latest_rows(rows, ["page"], ["fetched_at", "ledger_id"])


@R.query(
    f"SELECT m.page, CASE WHEN r.body IS NOT NULL THEN 'body' WHEN m.status = 404 AND m.digest IS NULL THEN 'empty' ELSE 'missing' END AS state, coalesce(length(r.body), CASE WHEN m.status = 404 AND m.digest IS NULL THEN 0 END) AS chars"
    f" FROM {_MIRROR} m LEFT JOIN (SELECT {_HASH} AS digest, max(body) AS body FROM responses WHERE body IS NOT NULL GROUP BY 1) r ON r.digest = m.digest"
)
def mirrored_bodies(spark: SparkSession, d: str) -> DataFrame:
    """SRC2, SRC6: for each mirrored page its stored body, an empty one for a 404, or nothing."""
    stored = table(spark, d, "responses").where("body IS NOT NULL").groupBy(hash_value(F.col("sha256")).alias("digest")).agg(F.max("body").alias("body"))
    joined = mirror(spark, d).join(stored, "digest", "left")
    body = L.body_of(F.lit(None).cast("string"), F.col("body"), F.col("status"), F.col("digest"))
    state = F.when(F.col("body").isNotNull(), "body").when(body.isNotNull(), "empty").otherwise("missing")
    return joined.select("page", state.alias("state"), F.char_length(body).cast("long").alias("chars"))


# --- the mirror -----------------------------------------------------------------------------------------------------------


@R.query("SELECT seq, tier, pa_key FROM (SELECT seq, tier, regexp_replace(url, '^.*/acts/', '') AS pa_key FROM queue) q WHERE pa_key IS NULL OR pa_key NOT IN (SELECT printf('%03d-%04d', regexp_extract(pa_number, '([0-9]+)[^0-9]+([0-9]+)', 1)::INT, regexp_extract(pa_number, '([0-9]+)[^0-9]+([0-9]+)', 2)::INT) FROM enactments)")
def remaining_work(spark: SparkSession, d: str) -> DataFrame:
    """ST1, JN6: work items whose Act was never held."""
    queue = table(spark, d, "queue").select("seq", "tier", F.regexp_replace("url", "^.*/acts/", "").alias("pa_key"))
    return L.remaining(queue, known_acts(spark, d), "pa_key").select("seq", "tier", "pa_key")


@R.query(f"SELECT DISTINCT {_PADDED(_LAST_ACT)} AS pa_key FROM {SECTIONS} WHERE {_LAST_ACT} IS NOT NULL AND {_PADDED(_LAST_ACT)} NOT IN (SELECT regexp_replace(url, '^.*/acts/', '') FROM queue WHERE url IS NOT NULL)")
def appended_work(spark: SparkSession, d: str) -> DataFrame:
    """ST7, JN8: Acts that sections name and the queue lacks, each once."""
    queue = table(spark, d, "queue").select(F.regexp_replace("url", "^.*/acts/", "").alias("pa_key"))
    return L.appended(queue, distinct_acts(spark, d), "pa_key")


@R.query(
    f"WITH l AS (SELECT ledger_id, status, {_HASH} AS h, {_URL} AS page, fetched_at FROM ledger WHERE url IS NOT NULL), k AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY page ORDER BY fetched_at, ledger_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM l)"
    " SELECT ledger_id, CASE WHEN status = 304 AND known IS NOT NULL THEN 'revalidated' WHEN h IS NULL THEN 'missing' WHEN known IS NULL THEN 'first' WHEN known = h THEN 'revalidated' ELSE 'changed' END AS refresh FROM k"
)
def refreshes(spark: SparkSession, d: str) -> DataFrame:
    """ST2: each fetch as first, revalidated, changed or missing."""
    return L.refreshes(table(spark, d, "ledger"), page_url(F.col("url")), F.col("fetched_at"), F.col("status"), hash_value(F.col("sha256")), ["ledger_id"])


@R.query("WITH g AS (SELECT event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id)) / 1e6 AS gap_s FROM events) SELECT * FROM g WHERE gap_s < 3600")
def too_soon(spark: SparkSession, d: str) -> DataFrame:
    """ST3: events within an hour of the one before them of the same user."""
    return L.too_soon(table(spark, d, "events"), F.col("user_id"), F.col("ts"), ["event_id"], 3600.0)


@R.query(f"SELECT {_HASH} AS sha256, count(DISTINCT {_URL}) AS urls, epoch_ms(min(fetched_at)) AS first_seen, substr({_HASH}, 1, 2) AS prefix FROM ledger WHERE {_HASH} IS NOT NULL GROUP BY ALL")
def stored_once(spark: SparkSession, d: str) -> DataFrame:
    """ST8, SNK6: one object for each content hash."""
    once = L.stored_once(table(spark, d, "ledger"), hash_value(F.col("sha256")), F.col("fetched_at"), page_url(F.col("url")))
    return once.withColumn("first_seen", F.unix_millis("first_seen"))


# --- the work queue -------------------------------------------------------------------------------------------------------

#: Acts of the sample: every Act whose chapter's number ends in 1.
_SAMPLE = "(SELECT DISTINCT trim(split_part(act_label, ' ILCS ', 1)) AS chapter, trim(split_part(split_part(act_label, ' ILCS ', 2), '/', 1)) AS act FROM cases WHERE trim(split_part(act_label, ' ILCS ', 1)) LIKE '%1')"
_LABELS = "(SELECT act_label, min(case_idx) AS seq, trim(split_part(act_label, ' ILCS ', 1)) AS chapter, trim(split_part(split_part(act_label, ' ILCS ', 2), '/', 1)) AS act FROM cases WHERE act_label LIKE '% ILCS %' GROUP BY 1)"


def labels(spark: SparkSession, d: str) -> DataFrame:
    key = S.act_key(F.col("act_label"))
    rows = table(spark, d, "cases").groupBy("act_label").agg(F.min("case_idx").alias("seq")).withColumn("k", key)
    return rows.where("k IS NOT NULL").select("act_label", "seq", "k.chapter", "k.act")


@R.query(
    f"WITH l AS {_LABELS}, s AS {_SAMPLE} SELECT l.chapter, l.act, first(l.act_label ORDER BY l.seq) AS first_label, last(l.act_label ORDER BY l.seq) AS last_label FROM l JOIN s USING (chapter, act) GROUP BY ALL"
)
def resolved_acts(spark: SparkSession, d: str) -> DataFrame:
    """JN4, JN5: the Acts of chapters ending in 1 by (chapter, act), with the first and the last label of each; all Acts
    are in :func:`all_resolved_acts`."""
    known = labels(spark, d)
    sample = known.where("chapter LIKE '%1'").select("chapter", "act").distinct()
    return known.join(sample, ["chapter", "act"]).groupBy("chapter", "act").agg(F.min_by("act_label", "seq").alias("first_label"), F.max_by("act_label", "seq").alias("last_label"))


@R.query(
    f"WITH l AS {_LABELS}, s AS {_SAMPLE}, n AS (SELECT *, chapter IN (SELECT chapter FROM s) AS near FROM l WHERE (chapter, act) NOT IN (SELECT (chapter, act) FROM s)),"
    " q AS (SELECT 0 AS tier, act_label AS label, seq, 0 AS far, 0 AS ord FROM l WHERE chapter LIKE '%1' UNION ALL SELECT CASE WHEN near THEN 2 ELSE 3 END, act_label, seq, CASE WHEN near THEN 0 ELSE 1 END, coalesce(try_cast(chapter AS BIGINT), 1000000000) FROM n)"
    " SELECT tier, label, row_number() OVER (ORDER BY tier, far, ord, seq) AS place FROM q"
)
def work_queue(spark: SparkSession, d: str) -> DataFrame:
    """JN7, JN9: a queue over whole sampled chapters (those ending in 1), of tiers 0 and 3 only; all tiers are in
    :func:`crawl_queue`."""
    known = labels(spark, d)
    sample = known.where("chapter LIKE '%1'").select("chapter", "act").distinct()
    near = sample.select("chapter").distinct().withColumn("near", F.lit(True))
    rest = known.join(sample, ["chapter", "act"], "left_anti").join(near, "chapter", "left").withColumn("near", F.coalesce("near", F.lit(False)))
    first = known.where("chapter LIKE '%1'").select(F.lit(0).alias("tier"), F.col("act_label").alias("label"), "seq", F.lit(0).alias("far"), F.lit(0).cast("long").alias("ord"))
    order = S.chapter_order(F.col("chapter"))[0].cast("long")
    others = rest.select(F.when(F.col("near"), 2).otherwise(3).alias("tier"), F.col("act_label").alias("label"), "seq", F.when(F.col("near"), 0).otherwise(1).alias("far"), order.alias("ord"))
    return A.ranked(first.unionByName(others).withColumn("g", F.lit(0)), ["g"], ["tier", "far", "ord", "seq"]).select("tier", "label", (F.col("rank") + 1).alias("place"))


#: How many Acts are sampled where no sample is given: those with the most cases.
SAMPLED = 7
_NAMED = "(SELECT act_label, case_idx, trim(split_part(act_label, ' ILCS ', 1)) AS chapter, trim(split_part(split_part(act_label, ' ILCS ', 2), '/', 1)) AS act FROM cases WHERE act_label LIKE '% ILCS %')"
_LARGEST = f"(SELECT chapter, act FROM {_NAMED} GROUP BY ALL ORDER BY count(*) DESC, chapter, act LIMIT {SAMPLED})"


def sample_acts(spark: SparkSession, d: str) -> DataFrame:
    """``chapter, act``: the sample, Acts and not whole chapters, so that its chapters can hold others."""
    key = S.act_key(F.col("act_label"))
    named = table(spark, d, "cases").select(key["chapter"].alias("chapter"), key["act"].alias("act")).where("chapter IS NOT NULL")
    return named.groupBy("chapter", "act").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "chapter", "act").limit(SAMPLED).select("chapter", "act")


@R.query(f"SELECT chapter, act, first(act_label ORDER BY case_idx) AS first_label, last(act_label ORDER BY seq) AS last_label FROM (SELECT *, min(case_idx) OVER (PARTITION BY act_label) AS seq FROM {_NAMED}) GROUP BY ALL")
def all_resolved_acts(spark: SparkSession, d: str) -> DataFrame:
    """JN4, JN5: every Act that a label names by (chapter, act), with the first and the last label of each."""
    return labels(spark, d).groupBy("chapter", "act").agg(F.min_by("act_label", "seq").alias("first_label"), F.max_by("act_label", "seq").alias("last_label"))


def queue_of(known: DataFrame, sample: DataFrame, cited: DataFrame, probes: list[str]) -> DataFrame:
    """``tier, label, place``: the work queue, in its order.

    Tier 0: the Public Acts that the sample cites, by number; 1: the probes of the floor, as given; 2: the other Acts of the
    sample's chapters; 3: all others; both by numeric chapter, then ``seq``. The sample's own Acts are no work.

    :param known: ``act_label, seq, chapter, act``; chapter and act are null of a label that names none.
    :param sample: ``chapter, act``; **cited**: ``pa_key``, each once.
    """
    near = sample.select("chapter").distinct().withColumn("near", F.lit(True))
    rest = known.join(sample.distinct(), ["chapter", "act"], "left_anti").join(near, "chapter", "left")
    place = [F.lit(0).cast("long").alias("ord"), "seq"]
    acts = cited.select(F.lit(0).alias("tier"), F.concat(F.lit("P.A. "), "pa_key").alias("label"), place[0], F.replace("pa_key", F.lit("-"), F.lit("")).cast("long").alias("seq"))
    spark = known.sparkSession
    floor = spark.createDataFrame([(f"floor probe P.A. {p}", i) for i, p in enumerate(probes)], "label string, seq long").select(F.lit(1).alias("tier"), "label", *place)
    order = F.coalesce(S.chapter_order(F.col("chapter"))[0].cast("long"), F.lit(1_000_000_000).cast("long"))
    others = rest.select(F.when(F.coalesce("near", F.lit(False)), 2).otherwise(3).alias("tier"), F.col("act_label").alias("label"), order.alias("ord"), F.col("seq").cast("long").alias("seq"))
    items = acts.unionByName(floor).unionByName(others).withColumn("g", F.lit(0))
    return A.ranked(items, ["g"], ["tier", "ord", "seq"]).select("tier", "label", (F.col("rank") + 1).alias("place"))


_CITED_GA = f"coalesce(try_cast(split_part({_LAST_ACT}, '-', 1) AS INT), 0)"


@R.query(
    f"WITH s AS {_LARGEST}, l AS (SELECT act_label, min(case_idx) AS seq, CASE WHEN act_label LIKE '% ILCS %' THEN trim(split_part(act_label, ' ILCS ', 1)) END AS chapter, CASE WHEN act_label LIKE '% ILCS %' THEN trim(split_part(split_part(act_label, ' ILCS ', 2), '/', 1)) END AS act FROM cases WHERE act_label IS NOT NULL GROUP BY 1),"
    f" c AS (SELECT DISTINCT {_PADDED(_LAST_ACT)} AS pa FROM {SECTIONS} WHERE (citation.chapter, citation.act) IN (SELECT (chapter, act) FROM s) AND {_CITED_GA} >= {S.FLOOR_GA}),"
    f" q AS (SELECT 0 AS tier, 'P.A. ' || pa AS label, 0 AS ord, replace(pa, '-', '')::BIGINT AS seq FROM c UNION ALL SELECT 1, 'floor probe P.A. ' || p, 0, i FROM (SELECT unnest({_PROBES}) AS p, generate_subscripts({_PROBES}, 1) AS i)"
    " UNION ALL SELECT CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.chapter = l.chapter) THEN 2 ELSE 3 END, act_label, coalesce(try_cast(chapter AS BIGINT), 1000000000), seq FROM l WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.chapter = l.chapter AND s.act = l.act))"
    " SELECT tier, label, row_number() OVER (ORDER BY tier, ord, seq) AS place FROM q"
)
def crawl_queue(spark: SparkSession, d: str) -> DataFrame:
    """JN7, JN9, 2.10, 2.11: the queue of all tiers: Acts cited by the sample, probes of the floor, near Acts, others."""
    sample = sample_acts(spark, d)
    t = terminal(F.col("source"))
    own = sections(spark, d).select(F.col("citation.chapter").alias("chapter"), F.col("citation.act").alias("act"), t.alias("t")).join(sample, ["chapter", "act"], "left_semi")
    cited = own.where(F.coalesce(F.split_part("t", F.lit("-"), F.lit(1)).try_cast("int"), F.lit(0)) >= S.FLOOR_GA).select(S.padded_act(F.col("t")).alias("pa_key")).distinct()
    key = S.act_key(F.col("act_label"))
    known = table(spark, d, "cases").where("act_label IS NOT NULL").groupBy("act_label").agg(F.min("case_idx").alias("seq")).withColumn("k", key).select("act_label", "seq", "k.chapter", "k.act")
    return queue_of(known, sample, cited, _PROBES)


# --- reports --------------------------------------------------------------------------------------------------------------


@R.query(
    f"WITH c AS (SELECT classification, count(*) AS n, min(case_idx) AS first_idx FROM {CASES} GROUP BY 1) SELECT row_number() OVER (ORDER BY n DESC, first_idx) AS line_no, '| ' || coalesce(classification, '-') || ' | ' || n || ' |' AS line FROM c"
)
def class_report(spark: SparkSession, d: str) -> DataFrame:
    """SNK3, SNK7: the labels as a Markdown table, most frequent first."""
    return store.markdown_table(G.class_counts(cases(spark, d)), ["classification", "n"], [F.desc("n"), F.col("first_idx")])


@R.query(
    f"SELECT case_idx, '=== ' || citation || ' [' || classification || '] P.A. ' || coalesce(terminal_pa, '-') || chr(10) || coalesce(note || chr(10), '') AS line FROM {CASES} WHERE NOT coalesce(classification = 'MATCH' OR {_GONE}, false)"
)
def mismatch_report(spark: SparkSession, d: str) -> DataFrame:
    """SNK2: what is told of each mismatch."""
    rows = cases(spark, d).withColumns({"changes": F.array().cast("array<string>"), "diff": F.lit(None).cast("string")})
    return store.mismatch_lines(rows)


@R.query(f"SELECT case_idx, citation, similarity, left(regexp_replace(source_line, '{WS}+', ' ', 'g'), 70) AS source_line FROM {CASES} WHERE classification IN ('DIVERGENCE', 'NORMALIZE', 'MULTI_ACT', 'MULTI_VERSION')")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """D16, SNK7: the cases to be reviewed, by falling similarity."""
    from strataleaf.functions.whitespace import PY_WS

    open_ = cases(spark, d).where(F.col("classification").isin("DIVERGENCE", "NORMALIZE", "MULTI_ACT", "MULTI_VERSION"))
    return open_.select("case_idx", "citation", "similarity", F.substring(F.regexp_replace("source_line", f"{PY_WS}++", " "), 1, 70).alias("source_line")).orderBy(F.desc("similarity"), "case_idx")


_TIERS = R.oracles["tier_breakdown"]


@R.query(
    f"WITH t AS ({_TIERS}), a AS (SELECT tier, done, total FROM t UNION ALL SELECT NULL, sum(done)::BIGINT, sum(total)::BIGINT FROM t)"
    " SELECT row_number() OVER (ORDER BY tier NULLS LAST) AS line_no, '| ' || coalesce(tier::VARCHAR, 'all') || ' | ' || done || ' | ' || total || ' | ' || CASE WHEN total > 0 THEN printf('%.1f%%', 100.0::DOUBLE * done / total) ELSE 'n/a' END || ' |' AS line FROM a"
)
def status_report(spark: SparkSession, d: str) -> DataFrame:
    """SNK4, ST9: the mirror's state from what is stored, without a run."""
    return store.status_lines(tier_breakdown(spark, d))


@R.query(f"SELECT case_idx, citation, classification FROM {CASES} ORDER BY run_no, case_idx LIMIT 25")
def limited_selection(spark: SparkSession, d: str) -> DataFrame:
    """2.10: the first 25 cases in order, as a run with a limit takes them."""
    return cases(spark, d).orderBy("run_no", "case_idx").limit(25).select("case_idx", "citation", "classification")


@R.query(
    "SELECT CASE WHEN coalesce(status IN (429, 503, 509), false) OR coalesce(status = 403 AND coalesce(regexp_matches(substr(body, 1, 4096), '(?i)rate[ -]?limit|too many requests|slow down|temporarily blocked|access denied'), true), false) THEN 'throttled'"
    " WHEN status = 200 THEN 'store' WHEN status = 304 THEN 'unchanged' WHEN status = 404 THEN 'empty' ELSE 'retry' END AS outcome, status, count(*) AS n FROM responses GROUP BY ALL"
)
def fetch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """ST4, ST5: what the answers ask for, by status."""
    outcome = L.fetch_outcome(F.col("status"), F.lit(None).cast("string"), F.col("body"))
    return table(spark, d, "responses").groupBy(outcome.alias("outcome"), "status").agg(F.count(F.lit(1)).alias("n"))


@R.query("SELECT 'us-il' AS jurisdiction, citation.chapter AS chapter, citation.act AS act, citation.section AS section, min(snapshot_no) AS since, count(DISTINCT ver) AS versions FROM blocks GROUP BY ALL")
def provisions(spark: SparkSession, d: str) -> DataFrame:
    """D20 and the designed table of provisions: each with its jurisdiction and the snapshot in which it first stood."""
    rows = table(spark, d, "blocks").groupBy("citation.chapter", "citation.act", "citation.section")
    return rows.agg(F.min("snapshot_no").alias("since"), F.count_distinct("ver").alias("versions")).withColumn("jurisdiction", F.lit("us-il"))


# --- versions in time -----------------------------------------------------------------------------------------------------

_VERSIONS = (
    "(SELECT l_partkey AS provision, l_orderkey * 10 + l_linenumber AS id, l_shipdate AS valid_from, lead(l_shipdate) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS valid_to, o_orderdate AS known_from,"
    " CASE WHEN l_returnflag = 'R' THEN o_orderdate + INTERVAL 90 DAY END AS known_to, CASE WHEN l_linestatus = 'O' THEN 'replayed' ELSE 'observed' END AS origin FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
)


def versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions of provisions: line items, valid from their shipping until the next one's, known from their order."""
    from pyspark.sql import Window

    over = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.col("l_partkey").alias("provision"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_shipdate").alias("valid_from"),
        F.lead("l_shipdate").over(over).alias("valid_to"),
        F.col("o_orderdate").alias("known_from"),
        F.when(F.col("l_returnflag") == "R", F.col("o_orderdate") + F.expr("INTERVAL 90 DAY")).alias("known_to"),
        F.when(F.col("l_linestatus") == "O", "replayed").otherwise("observed").alias("origin"),
    )


_AT, _KNOWN = "1997-01-01", "1998-01-01"
#: Versions that may overlap: those whose end is told by the line item and not by the next version.
_LASTING = "(SELECT l_partkey AS provision, l_orderkey * 10 + l_linenumber AS id, l_shipdate AS valid_from, CASE WHEN l_quantity < 49 THEN l_shipdate + to_days(l_quantity::INT * 2) END AS valid_to, CASE WHEN l_linestatus = 'O' THEN 'replayed' ELSE 'observed' END AS origin FROM lineitem)"


@R.query(
    f"SELECT provision, id FROM {_VERSIONS} WHERE origin = 'replayed' AND valid_from <= TIMESTAMP '{_AT}' AND (valid_to IS NULL OR TIMESTAMP '{_AT}' < valid_to) AND known_from <= TIMESTAMP '{_KNOWN}' AND (known_to IS NULL OR TIMESTAMP '{_KNOWN}' < known_to)"
)
def as_of(spark: SparkSession, d: str) -> DataFrame:
    """The versions valid at one time as known at another."""
    return V.as_of(versions(spark, d), F.lit(_AT).cast("timestamp"), F.lit(_KNOWN).cast("timestamp")).select("provision", "id")


@R.query(
    f"WITH v AS (SELECT provision, origin, id, valid_from, coalesce(valid_to, TIMESTAMP '9999-12-31') AS valid_to FROM {_LASTING}),"
    " m AS (SELECT *, max(valid_to) OVER w AS reach FROM v WINDOW w AS (PARTITION BY provision, origin ORDER BY valid_from, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
    " SELECT provision, origin, id FROM m WHERE reach > valid_from"
)
def overlapping_versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions that begin while an earlier one of their key still holds; there should be none."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("provision"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_linestatus") == "O", "replayed").otherwise("observed").alias("origin"),
        F.col("l_shipdate").alias("valid_from"), F.when(F.col("l_quantity") < 49, F.col("l_shipdate") + F.make_interval(days=F.col("l_quantity").cast("int") * 2)).alias("valid_to"),
    )
    return V.overlapped(rows, ["provision", "origin"], "id").select("provision", "origin", "id")


@R.query(
    "WITH e AS (SELECT l_partkey AS provision, l_orderkey * 10 + l_linenumber AS id, l_shipdate AS begins, l_shipdate + INTERVAL 5 DAY AS ends, l_suppkey AS base, l_quantity AS result FROM lineitem)"
    " SELECT a.provision, a.id AS a, b.id AS b FROM e a JOIN e b ON a.provision = b.provision AND a.id < b.id AND a.base = b.base AND a.result <> b.result"
    " AND (greatest(a.begins, b.begins) < least(a.ends, b.ends) OR date_diff('day', least(a.ends, b.ends)::DATE, greatest(a.begins, b.begins)::DATE) <= 30)"
)
def contested_windows(spark: SparkSession, d: str) -> DataFrame:
    """D3: effects on one target from one base with different results, overlapping or within 30 days."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("provision"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("begins"),
        (F.col("l_shipdate") + F.expr("INTERVAL 5 DAY")).alias("ends"), F.col("l_suppkey").alias("base"), F.col("l_quantity").alias("result"),
    )
    return V.contested(rows, "provision", "id", 30)


@R.query(
    "SELECT block_id, CASE WHEN op_marker = 'new' THEN 'add' WHEN op_marker = 'rep.' THEN 'repeal' WHEN renumbered_from IS NOT NULL THEN 'renumber' ELSE 'replace' END AS operation,"
    r" ((coalesce(regexp_extract(raw, '^\(\s*([0-9]+)\s+ILCS', 1) = citation.chapter, false))::INT + (coalesce(regexp_extract(raw, '\bSec\.\s*([0-9A-Za-z.\-]+)\s*\.', 1) = citation.section, false))::INT + (coalesce(legacy_cite <> '', false))::INT) >= 2 AS resolved FROM blocks"
)
def typed_operations(spark: SparkSession, d: str) -> DataFrame:
    """What was done to each section, and whether two of three signals name it."""
    head = F.regexp_extract("raw", r"^\(\s*([0-9]+)\s+ILCS", 1) == F.col("citation.chapter")
    catch = F.regexp_extract("raw", P.CATCHLINE, 1) == F.col("citation.section")
    return table(spark, d, "blocks").select(
        "block_id", V.typed_operation(F.col("op_marker"), F.col("renumbered_from"), F.lit(False)).alias("operation"), V.resolved(head, catch, F.col("legacy_cite") != "").alias("resolved")
    )


@R.query(
    "WITH b AS (SELECT citation, ver, snapshot_no, op_marker, md5(body) AS body FROM blocks QUALIFY row_number() OVER (PARTITION BY citation, ver, snapshot_no ORDER BY seen_at DESC, block_id DESC) = 1),"
    " r AS (SELECT citation, ver, max(snapshot_no) FILTER (WHERE op_marker = 'rep.') AS gone FROM b GROUP BY 1, 2),"
    f" s AS (SELECT b.citation, b.ver, max_by(body, snapshot_no) FILTER (WHERE body IS NOT NULL AND snapshot_no > coalesce(gone, -1)) AS replayed, max(body) FILTER (WHERE snapshot_no = {LAST}) AS stands, count(*) AS steps"
    " FROM b JOIN r ON b.citation = r.citation AND b.ver = r.ver GROUP BY 1, 2)"
    f" SELECT {_CITED} AS citation, ver, replayed, stands, replayed IS NOT DISTINCT FROM stands AS agrees, steps FROM s"
)
def chain_replay(spark: SparkSession, d: str) -> DataFrame:
    """The operations on each section replayed in order, from nothing, and held against what stands in the last snapshot."""
    last = M.latest_rows(
        table(spark, d, "blocks").select("citation", "ver", "snapshot_no", "seen_at", "block_id", "op_marker", "renumbered_from", F.md5("body").alias("body")), ["citation", "ver", "snapshot_no"], ["seen_at", "block_id"]
    )
    steps = last.withColumn("operation", V.typed_operation(F.col("op_marker"), F.col("renumbered_from"), F.lit(False)))
    out = V.replayed(steps, ["citation", "ver"], "snapshot_no", "operation", "body", LAST)
    return out.withColumn("citation", S.citation_text(F.col("citation")))


@R.query(
    f"WITH s AS (SELECT {_CITED} AS label, {sql_normalized('body')} AS body FROM {SECTIONS} WHERE ver = 1), p AS (SELECT comparison_id, label, {sql_normalized('published_norm')} AS a, {sql_normalized('replayed_norm')} AS b FROM comparisons)"
    " SELECT comparison_id, (coalesce(a = b, false)::INT + coalesce(a = body, false)::INT + coalesce(b = body, false)::INT) >= 1 AS agreed, CASE WHEN coalesce(a = b AND a = body, false) THEN 'all' WHEN coalesce(a = b, false) THEN 'snapshot' WHEN coalesce(a = body, false) THEN 'replayed' WHEN coalesce(b = body, false) THEN 'published' ELSE 'none' END AS odd_one FROM p LEFT JOIN s USING (label)"
)
def publishers_agree(spark: SparkSession, d: str) -> DataFrame:
    """Whether two of three texts of a section agree, and which one doesn't."""
    from strataleaf.functions.normalize import normalize

    s = sections(spark, d).where("ver = 1").select(S.citation_text(F.col("citation")).alias("label"), normalize(F.col("body")).alias("body"))
    p = table(spark, d, "comparisons").select("comparison_id", "label", normalize(F.col("published_norm")).alias("a"), normalize(F.col("replayed_norm")).alias("b"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    ab, ac, bc = F.col("a") == F.col("b"), F.col("a") == F.col("body"), F.col("b") == F.col("body")
    odd = F.when(yes(ab & ac), "all").when(yes(ab), "snapshot").when(yes(ac), "replayed").when(yes(bc), "published").otherwise("none")
    return p.join(s, "label", "left").select("comparison_id", V.resolved(ab, ac, bc, least=1).alias("agreed"), odd.alias("odd_one"))


#: The labels used here under the designed taxonomy.
TAXONOMY = {"NORMALIZE": "NORMALIZE", "REPEALED_STUB": "EDITORIAL", "RENUMBERED": "EDITORIAL", "TARGET_RESOLUTION": "EXTRACT", "MULTI_VERSION": "TEMPORAL", "MULTI_ACT": "TEMPORAL", "DIVERGENCE": "DIVERGENCE", "UNRECONSTRUCTABLE": "UNRECONSTRUCTABLE", "ACT_NOT_ONLINE": "UNRECONSTRUCTABLE", "FETCH_ERROR": "EXTRACT"}


@R.query("SELECT case_idx, CASE classification " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TAXONOMY.items()) + " END AS taxonomy FROM cases")
def taxonomy(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.create_map(*[F.lit(x) for kv in TAXONOMY.items() for x in kv])
    return table(spark, d, "cases").select("case_idx", F.try_element_at(pairs, F.col("classification")).alias("taxonomy"))


@R.query(
    "SELECT o_orderkey, CASE WHEN month(o_orderdate) > 5 AND (o_orderkey % 119)::DOUBLE / 118 < 0.6 THEN make_date(year(o_orderdate) + 1, 6, 1) ELSE make_date(year(o_orderdate) + 1, 1, 1) END::VARCHAR AS effective_on FROM orders"
)
def default_effective(spark: SparkSession, d: str) -> DataFrame:
    """Default effective dates by date of passage and votes."""
    return table(spark, d, "orders").select("o_orderkey", V.default_effective(F.col("o_orderdate"), F.col("o_orderkey") % 119, F.lit(118)).cast("string").alias("effective_on"))


_ENACTED = r"printf('%03d-%04d', regexp_extract(pa_number, '([0-9]+)[^0-9]+([0-9]+)', 1)::INT, regexp_extract(pa_number, '([0-9]+)[^0-9]+([0-9]+)', 2)::INT)"


@R.query(
    f"WITH o AS (SELECT DISTINCT {_ENACTED} AS pa_key FROM enactments WHERE withdrawn_at IS NOT NULL), s AS (SELECT block_id, unnest(list_transform({_ACTS}, lambda t: printf('%03d-%04d', split_part(t, '-', 1)::INT, split_part(t, '-', 2)::INT))) AS pa_key FROM {SECTIONS})"
    f" SELECT b.block_id, coalesce(bool_or(o.pa_key IS NOT NULL), false) AS badge FROM {SECTIONS} b LEFT JOIN s ON s.block_id = b.block_id LEFT JOIN o ON o.pa_key = s.pa_key GROUP BY 1"
)
def overlay_badges(spark: SparkSession, d: str) -> DataFrame:
    """Current sections that name an Act with an entry in the overlay, here of withdrawn Acts."""
    number = act_number(F.col("pa_number"))
    overlay = table(spark, d, "enactments").where("withdrawn_at IS NOT NULL").select(S.padded_act(F.concat_ws("-", number["assembly"], number["serial"])).alias("pa_key")).distinct().withColumn("hit", F.lit(True))
    named = sections(spark, d).select("block_id", F.explode_outer("source.pa_numbers").alias("t")).withColumn("pa_key", S.padded_act(F.col("t")))
    return named.join(overlay, "pa_key", "left").groupBy("block_id").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("badge"))


@R.query(
    r"WITH t AS (SELECT DISTINCT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM documents) SELECT doc_id, count(*) AS terms FROM t WHERE term IN ('ferry', 'tariff', 'culvert') GROUP BY 1 HAVING count(*) = 3"
)
def full_text(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold all words of a query. Texts without their letters are left out before they are split."""
    sought = ["ferry", "tariff", "culvert"]
    low = F.lower("text")
    held = F.size(F.array_intersect(F.split(low, "[^a-z0-9]+"), F.array(*[F.lit(w) for w in sought])))
    docs = table(spark, d, "documents").where(functools.reduce(lambda a, b: a & b, [F.contains(low, F.lit(w)) for w in sought]))
    return docs.select("doc_id", held.cast("long").alias("terms")).where(F.col("terms") == len(sought))


@R.query(f"SELECT count(DISTINCT pa_key) AS not_reflected FROM (SELECT {_ENACTED} AS pa_key FROM enactments) WHERE pa_key NOT IN (SELECT {_PADDED(_LAST_ACT)} FROM {SECTIONS} WHERE {_LAST_ACT} IS NOT NULL)")
def not_reflected(spark: SparkSession, d: str) -> DataFrame:
    """Acts that no current section names last."""
    return known_acts(spark, d).join(distinct_acts(spark, d), "pa_key", "left_anti").agg(F.count(F.lit(1)).alias("not_reflected"))


@R.query(
    r"WITH b AS (SELECT citation, ver, snapshot_no, body, doc_id FROM blocks QUALIFY row_number() OVER (PARTITION BY citation, ver, snapshot_no ORDER BY seen_at DESC, block_id DESC) = 1),"
    f" c AS (SELECT citation, ver, snapshot_no, doc_id, unnest(list_filter(list_transform(string_split(regexp_replace({sql_collapsed('body')}, '([.;:])[ ]+([A-Z(\"''])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS clause FROM b)"
    f" SELECT {_CITED} AS citation, ver, md5(clause) AS clause, min(snapshot_no) AS since, min_by(doc_id, (snapshot_no, doc_id)) AS source FROM c GROUP BY citation, ver, md5(clause)"
)
def blame(spark: SparkSession, d: str) -> DataFrame:
    """For each clause of each section the snapshot and document in which it first stood."""
    from strataleaf.functions.whitespace import collapse

    rows = table(spark, d, "blocks")
    last = M.latest_rows(rows.select("citation", "ver", "snapshot_no", "seen_at", "block_id", "doc_id", "body"), ["citation", "ver", "snapshot_no"], ["seen_at", "block_id"]).where("body IS NOT NULL")
    out = V.first_appearances(last.withColumn("clauses", sentence_parts(collapse(F.col("body")))), ["citation", "ver"], "snapshot_no", F.col("clauses"), "doc_id")
    return out.withColumn("citation", S.citation_text(F.col("citation")))


# The stereotyped sentence of an amending Act.
_AMENDS = r"(?is)Section\s+([0-9]+)\.\s+The\s+(.{1,200}?)\s+is\s+amended\s+by\s+(changing and adding|changing|adding|repealing|resectioning)\s+Sections?\s+([0-9A-Za-z.\-]+(?:(?:,\s*|,?\s+and\s+)[0-9A-Za-z.\-]+)*?)\s*(?:as\s+follows:|\.)"


@R.query(
    "WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '" + _AMENDS + "', 0)) AS hit FROM documents) SELECT doc_id,"
    + f" regexp_extract(hit, '{_AMENDS}', 1) AS division, {sql_collapsed('regexp_extract(hit, ' + chr(39) + _AMENDS + chr(39) + ', 2)')} AS act_name, lower(regexp_extract(hit, '{_AMENDS}', 3)) AS verb,"
    + " unnest(string_split_regex(regexp_extract(hit, '" + _AMENDS + r"', 4), ',?\s+and\s+|,\s*')) AS target FROM s"
)
def amendments(spark: SparkSession, d: str) -> DataFrame:
    """The amending sentences of Acts, one row for each section they name."""
    groups = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(_AMENDS), F.lit(i)).alias(n) for i, n in ((1, "division"), (2, "act_name"), (3, "verb"), (4, "targets"))])
    hits = table(spark, d, "documents").select("doc_id", F.explode(groups).alias("g")).select("doc_id", "g.*")
    from strataleaf.functions.whitespace import collapse

    return hits.select("doc_id", "division", collapse(F.col("act_name")).alias("act_name"), F.lower("verb").alias("verb"), F.explode(F.split("targets", r",?\s+and\s+|,\s*")).alias("target"))


@R.query(
    f"WITH a AS (SELECT block_id, {_CITED} AS citation, ver, {_ACTS} AS acts FROM {SECTIONS}), d AS (SELECT block_id, citation, ver, list_filter(acts, lambda x, i: list_position(acts, x) = i) AS acts FROM a)"
    " SELECT citation, ver, unnest(acts) AS pa_number, generate_subscripts(acts, 1)::INT AS step FROM d"
)
def timeline(spark: SparkSession, d: str) -> DataFrame:
    """The Acts of each current section in the order of its source line."""
    rows = sections(spark, d).select(S.citation_text(F.col("citation")).alias("citation"), "ver", F.posexplode("source.pa_numbers").alias("step", "pa_number"))
    return rows.withColumn("step", F.col("step") + 1)


@R.query()
def version_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Word changes between consecutive wordings of each section."""
    from pyspark.sql import Window

    from strataleaf.operators.compare import compared

    rows = table(spark, d, "blocks").where("body IS NOT NULL").select("citation", "ver", "snapshot_no", "seen_at", "block_id", "body")
    last = M.latest_rows(rows, ["citation", "ver", "snapshot_no"], ["seen_at", "block_id"])
    before = F.lag("body").over(Window.partitionBy("citation", "ver").orderBy("snapshot_no"))
    pairs = last.withColumn("was", before).where("was <> body").select(S.citation_text(F.col("citation")).alias("citation"), "ver", "snapshot_no", "was", "body")
    made = compared(pairs, F.col("citation"), F.col("was"), F.col("body"))
    return made.where("NOT normalized_match").select("citation", "ver", "snapshot_no", "similarity", "changes")


@R.query(
    f"SELECT {_CITED} AS citation, s.ver, c.classification, c.exact_match, len({_ACTS.replace('source.raw', 's.source.raw')}) AS acts_named FROM {SECTIONS} s LEFT JOIN (SELECT * FROM {CASES} WHERE run_no = {LAST}) c ON c.citation = s.citation.chapter || ' ILCS ' || s.citation.act || '/' || s.citation.section AND c.ver = s.ver".replace(f"SELECT {_CITED}", "SELECT s.citation.chapter || ' ILCS ' || s.citation.act || '/' || s.citation.section")
)
def provenance_badges(spark: SparkSession, d: str) -> DataFrame:
    """Each current section with its label and how many Acts its source line names."""
    s = sections(spark, d).select(S.citation_text(F.col("citation")).alias("citation"), "ver", F.size("source.pa_numbers").alias("n"))
    c = cases(spark, d).where(F.col("run_no") == LAST).select("citation", "ver", "classification", "exact_match")
    return s.join(c, ["citation", "ver"], "left").select("citation", "ver", "classification", "exact_match", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("acts_named"))


@R.query(
    f"SELECT comparison_id, 'normalized_match' AS field, normalized_match AS recorded, {sql_normalized('published_norm')} = {sql_normalized('replayed_norm')} AS observed FROM comparisons"
    f" WHERE normalized_match IS DISTINCT FROM ({sql_normalized('published_norm')} = {sql_normalized('replayed_norm')})"
)
def correction_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims about recorded flags that don't hold when worked out anew, kept apart from the texts."""
    from strataleaf.functions.normalize import normalize

    same = normalize(F.col("published_norm")) == normalize(F.col("replayed_norm"))
    rows = table(spark, d, "comparisons").select("comparison_id", F.lit("normalized_match").alias("field"), F.col("normalized_match").alias("recorded"), same.alias("observed"))
    return rows.where(~F.col("recorded").eqNullSafe(F.col("observed")))
