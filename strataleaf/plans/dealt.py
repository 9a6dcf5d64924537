"""The queries over this project's tables for the general data problems p3 to p6."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataleaf.functions.references import act_number, hash_value, page_url
from strataleaf.operators.history import attribute_history
from strataleaf.operators.orphan_refs import orphan_counts, orphan_references
from strataleaf.operators.packed_fields import split_packed
from strataleaf.operators.snapshot_diff import snapshot_changes
from strataleaf.sources.tables import table

SNAPSHOTS = range(1, 9)


def ledger_changes(spark: SparkSession, directory: str) -> DataFrame:
    return snapshot_changes(
        table(spark, directory, "ledger"),
        key=page_url(F.col("url")),
        seq=F.col("snapshot_no"),
        fields={"status": F.col("status"), "sha256": hash_value(F.col("sha256"))},
        order=[F.col("fetched_at"), F.col("ledger_id")],
    )


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return ledger_changes(spark, directory).select(
        F.col("key").alias("url"), F.col("seq").alias("snapshot_no"), "change_kind"
    )


def p3_changed_fields(spark: SparkSession, directory: str) -> DataFrame:
    """How many pages were added, removed or changed, and in which fields, per snapshot."""
    return (
        ledger_changes(spark, directory)
        .groupBy(F.col("seq").alias("snapshot_no"), "change_kind", F.array_join("changed_fields", "+").alias("fields"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def act_orphans(spark: SparkSession, directory: str) -> DataFrame:
    """References of ``cases`` and ``queue`` to Acts that are not held: ``ref_table, ref_id, at, orphan_kind``."""
    cases = table(spark, directory, "cases").select(
        F.lit("cases").alias("ref_table"), F.col("case_idx").alias("ref_id"), F.col("run_at").alias("at"), act_number(F.col("terminal_pa")).alias("act")
    )
    queue = table(spark, directory, "queue").select(
        F.lit("queue").alias("ref_table"), F.col("seq").alias("ref_id"), F.col("queued_at").alias("at"), act_number(F.col("pa_number")).alias("act")
    )
    references = cases.unionByName(queue).where("act IS NOT NULL")
    enactments = table(spark, directory, "enactments").select(act_number(F.col("pa_number")).alias("act"), "registered_at", "withdrawn_at")
    key = [F.col("act.assembly"), F.col("act.serial")]
    return orphan_references(
        references, enactments, key, key, "full", F.col("at"), F.col("registered_at"), F.col("withdrawn_at")
    )


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return act_orphans(spark, directory).select("ref_table", "ref_id", "orphan_kind")


def p4_report(spark: SparkSession, directory: str) -> DataFrame:
    return orphan_counts(act_orphans(spark, directory), F.col("ref_table"), F.col("at"))


def cited(citation: Column) -> Column:
    """``c ILCS a/s``; null if a part is null."""
    return F.concat(citation["chapter"], F.lit(" ILCS "), citation["act"], F.lit("/"), citation["section"])


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    key = {"citation": F.col("citation"), "ver": F.col("ver")}
    blocks = table(spark, directory, "blocks").withColumn("citation", cited(F.col("citation")))
    text = attribute_history(
        blocks,
        key,
        F.col("snapshot_no"),
        {
            "body": F.trim(F.regexp_replace("body", r"[ \t\r\n]++", " ")),
            "version_marker": F.col("version_marker"),
        },
        [F.col("seen_at"), F.col("block_id")],
        SNAPSHOTS,
    )
    act = act_number(F.col("terminal_pa"))
    named = attribute_history(
        table(spark, directory, "cases"),
        key,
        F.col("run_no"),
        {"terminal_pa": F.when(act.isNotNull(), F.concat(F.coalesce(act["assembly"], F.lit("")), F.lit("-"), act["serial"]))},
        [F.col("run_at"), F.col("case_idx")],
        SNAPSHOTS,
    )
    return text.unionByName(named).select(
        "citation", "ver", "attribute", F.col("from_seq").alias("from_snapshot"), F.col("to_seq").alias("to_snapshot")
    )


def packed_entries(spark: SparkSession, directory: str, least: int = 1) -> DataFrame:
    """``record_kind, record_id, position, value`` of every provenance entry."""
    blocks = table(spark, directory, "blocks").select(
        F.lit("block").alias("record_kind"), F.col("block_id").alias("record_id"), F.col("source.raw").alias("packed")
    )
    cases = table(spark, directory, "cases").select(
        F.lit("case").alias("record_kind"), F.col("case_idx").alias("record_id"), F.col("source_line").alias("packed")
    )
    return split_packed(
        blocks.unionByName(cases), ["record_kind", "record_id"], F.col("packed"), least=least
    )


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return packed_entries(spark, directory, least=2)


# --- the same in SQL -------------------------------------------------------------------------------------------------------

_URL = r"lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) || '://' || regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), ':(443|80)$', '') || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)', 1)"
_CHANGES = (
    f"cur AS (SELECT {_URL} AS url, snapshot_no, status, nullif(regexp_replace(lower(trim(sha256)), '^[a-z0-9\\-]+[:=]', ''), '') AS h FROM ledger WHERE url IS NOT NULL"
    " QUALIFY row_number() OVER (PARTITION BY 1, 2 ORDER BY fetched_at DESC, ledger_id DESC) = 1),"
    " n AS (SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS before FROM (SELECT DISTINCT snapshot_no FROM ledger)),"
    " now AS (SELECT c.*, n.before FROM cur c JOIN n USING (snapshot_no) WHERE n.before IS NOT NULL), was AS (SELECT c.url, c.status, c.h, n.snapshot_no AS later FROM cur c JOIN n ON n.before = c.snapshot_no),"
    " f AS (SELECT coalesce(now.url, was.url) AS url, coalesce(now.snapshot_no, was.later) AS snapshot_no, CASE WHEN was.url IS NULL THEN 'added' WHEN now.url IS NULL THEN 'removed' ELSE 'changed' END AS change_kind,"
    " CASE WHEN was.url IS NULL OR now.url IS NULL THEN '' ELSE concat_ws('+', CASE WHEN now.h IS DISTINCT FROM was.h THEN 'sha256' END, CASE WHEN now.status IS DISTINCT FROM was.status THEN 'status' END) END AS fields"
    " FROM now FULL JOIN was ON now.url = was.url AND now.snapshot_no = was.later WHERE now.url IS NULL OR was.url IS NULL OR now.status IS DISTINCT FROM was.status OR now.h IS DISTINCT FROM was.h)"
).replace("PARTITION BY 1, 2", f"PARTITION BY {_URL}, snapshot_no")
_NUMBER = lambda c: f"CASE WHEN regexp_matches({c}, '{_ACT}') THEN regexp_extract({c}, '{_ACT}', 1) || '-' || regexp_extract({c}, '{_ACT}', 2) WHEN trim({c}) <> '' THEN '-' || trim({c}) END"
_ACT = r"(?i)^\s*(?:p\.?\s*a\.?|public\s+acts?)?\s*0*([0-9]+)\s*[-‐‑‒–—−]\s*0*([0-9]+)\s*\.?\s*$"
_ORPHANS = (
    f"e AS (SELECT {_NUMBER('pa_number')} AS k, registered_at AS b, withdrawn_at AS w FROM enactments),"
    f" r AS (SELECT 'cases' AS ref_table, case_idx AS ref_id, run_at AS t, {_NUMBER('terminal_pa')} AS k FROM cases UNION ALL SELECT 'queue', seq, queued_at, {_NUMBER('pa_number')} FROM queue),"
    " o AS (SELECT ref_table, ref_id, t, CASE WHEN k NOT IN (SELECT k FROM e WHERE k IS NOT NULL) THEN 'missing' WHEN EXISTS (SELECT 1 FROM e WHERE e.k = r.k AND e.w <= r.t) THEN 'deleted' ELSE 'late' END AS orphan_kind"
    " FROM r WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e WHERE e.k = r.k AND (e.b IS NULL OR e.b <= r.t) AND (e.w IS NULL OR r.t < e.w)))"
)
_HISTORY = (
    "b AS (SELECT citation.chapter || ' ILCS ' || citation.act || '/' || citation.section AS citation, ver, snapshot_no AS s, trim(regexp_replace(body, '[ \\t\\r\\n]+', ' ', 'g')) AS body, version_marker FROM blocks"
    " WHERE snapshot_no BETWEEN 1 AND 8 QUALIFY row_number() OVER (PARTITION BY citation, ver, snapshot_no ORDER BY seen_at DESC, block_id DESC) = 1),"
    f" c AS (SELECT citation, ver, run_no AS s, {_NUMBER('terminal_pa')} AS terminal_pa FROM cases WHERE run_no BETWEEN 1 AND 8 QUALIFY row_number() OVER (PARTITION BY citation, ver, run_no ORDER BY run_at DESC, case_idx DESC) = 1),"
    " v AS (SELECT citation, ver, s, 'body' AS attribute, body AS x FROM b UNION ALL SELECT citation, ver, s, 'version_marker', version_marker FROM b UNION ALL SELECT citation, ver, s, 'terminal_pa', terminal_pa FROM c),"
    " h AS (SELECT *, s - row_number() OVER (PARTITION BY citation, ver, attribute, x ORDER BY s) AS island FROM v WHERE x IS NOT NULL AND citation IS NOT NULL AND ver IS NOT NULL)"
)
ORACLES = {
    "p3_found": f"WITH {_CHANGES} SELECT url, snapshot_no, change_kind FROM f",
    "p3_changed_fields": f"WITH {_CHANGES} SELECT snapshot_no, change_kind, fields, count(*) AS n FROM f GROUP BY ALL",
    "p4_found": f"WITH {_ORPHANS} SELECT ref_table, ref_id, orphan_kind FROM o",
    "p4_report": f"WITH {_ORPHANS} SELECT ref_table, strftime(make_timestamp(epoch_us(t)), '%Y-%m') AS month, orphan_kind, count(*) AS n FROM o GROUP BY ALL",
    "p6_found": f"WITH {_HISTORY} SELECT citation, ver, attribute, min(s) AS from_snapshot, CASE WHEN max(s) = 8 THEN 0 ELSE max(s) + 1 END AS to_snapshot FROM h GROUP BY citation, ver, attribute, x, island",
}
QUERIES = {
    "p3_found": p3_found,
    "p3_changed_fields": p3_changed_fields,
    "p4_found": p4_found,
    "p4_report": p4_report,
    "p5_found": p5_found,
    "p6_found": p6_found,
}
