"""Bitemporal versions, conflicts between them, and what a provision's history tells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def holds(begin: Column, end: Column, at: Column) -> Column:
    """Whether the half-open period holds at a time; a null end is open, a null begin never holds."""
    return F.coalesce((begin <= at) & (end.isNull() | (at < end)), F.lit(False))


def as_of(versions: DataFrame, valid_at: Column, known_at: Column, origin: str = "replayed") -> DataFrame:
    """The versions of one origin that were valid at one time as known at another."""
    return versions.where(
        (F.col("origin") == origin) & holds(F.col("valid_from"), F.col("valid_to"), valid_at) & holds(F.col("known_from"), F.col("known_to"), known_at)
    )


def _meeting(rows: DataFrame, keys: list[str], id_: str, begin: str, end: str, width_s: int) -> DataFrame:
    """Pairs ``a``, ``b`` of rows (as structs) of one key of which ``b`` begins while ``a`` lasts, each pair once.

    Beginnings fall into buckets of ``width_s`` seconds; a row is placed in every bucket it lasts through, up to the
    key's last beginning, and meets the beginnings there. So a hot key is split by time, and a history without overlaps
    is placed about twice. Rows without a beginning meet none; a null end is open.
    """
    whole = F.struct(*rows.columns)
    bucket = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / width_s)
    at = rows.where(F.col(begin).isNotNull()).select(*keys, whole.alias("row"), bucket(F.col(begin)).alias("first"), bucket(F.col(end)).alias("last"))
    latest = at.groupBy(*keys).agg(F.max("first").alias("latest"))
    lasting = at.join(latest, keys).where("last IS NULL OR last >= first")
    a = lasting.select(*keys, F.col("row").alias("a"), F.explode(F.sequence(F.col("first"), F.least(F.col("latest"), F.coalesce("last", "latest")))).alias("bucket"))
    b = at.select(*keys, F.col("row").alias("b"), F.col("first").alias("bucket"))
    a_, b_ = F.col("a"), F.col("b")
    later = (b_[begin] > a_[begin]) | (b_[begin] == a_[begin]) & (b_[id_] > a_[id_])
    return a.join(b, [*keys, "bucket"]).where(later & (a_[end].isNull() | (b_[begin] < a_[end])))


def overlaps(versions: DataFrame, key: list[str], id_: str, width_days: int = 30) -> DataFrame:
    """Pairs of versions of one key that overlap in both periods: ``key..., a, b`` with a before b; a null end is open."""
    rows = versions.select(*key, F.col(id_).alias("id"), "valid_from", "valid_to", "known_from", "known_to")
    pairs = _meeting(rows, key, "id", "valid_from", "valid_to", width_days * 86_400)
    before = lambda x, y: F.col(f"{y}.known_to").isNull() | (F.col(f"{x}.known_from") < F.col(f"{y}.known_to"))
    lasts = lambda x: F.col(f"{x}.valid_to").isNull() | (F.col(f"{x}.valid_from") < F.col(f"{x}.valid_to"))
    both = pairs.where(before("a", "b") & before("b", "a") & lasts("a") & lasts("b"))
    return both.select(*key, F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))


def overlapped(versions: DataFrame, key: list[str], id_: str) -> DataFrame:
    """One row for each version that begins while an earlier one of its key still holds, with the version that then
    reaches furthest (``holds``, ``until``; a null end is open and reaches furthest of all). Each version is told once,
    however many it overlaps; versions without a beginning overlap none.

    One window a key over narrow rows; ties begin in the order of ``id_``.
    """
    before = Window.partitionBy(*key).orderBy("valid_from", id_).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.struct(F.col("valid_to").isNull().alias("open"), F.col("valid_to").alias("until"), F.col(id_).alias("holds"))
    rows = versions.where("valid_from IS NOT NULL").select(*key, id_, "valid_from", F.max(reach).over(before).alias("reach"))
    met = rows.where(F.col("reach.open") | (F.col("reach.until") > F.col("valid_from")))
    return met.select(*key, id_, "valid_from", "reach.holds", "reach.until")


def replayed(steps: DataFrame, key: list[str], seq: str, operation: str, body: str, last: int) -> DataFrame:
    """``key..., replayed, stands, agrees, steps``: what comes of the operations in the order of ``seq``, from nothing.

    ``repeal`` leaves nothing; every other operation puts its text in place of what was there, or leaves that where it
    brings none. ``stands`` is the text at ``last``, null if the section isn't there or has none.
    """
    step = F.struct(F.col(seq).alias("seq"), F.col(operation).alias("op"), F.col(body).alias("text"))
    # one step for each snapshot of a version
    chain = F.array_sort(F.collect_list(step))
    fold = F.aggregate("chain", F.lit(None).cast("string"), lambda text, s: F.when(s["op"] == "repeal", F.lit(None).cast("string")).otherwise(F.coalesce(s["text"], text)))
    out = steps.groupBy(*key).agg(chain.alias("chain"), F.max(F.when(F.col(seq) == last, F.col(body))).alias("stands"), F.count(F.lit(1)).alias("steps"))
    return out.select(*key, fold.alias("replayed"), "stands", "steps").withColumn("agrees", F.col("replayed").eqNullSafe(F.col("stands")))


def contested(effects: DataFrame, key: str, id_: str, near_days: int, width_days: int = 30) -> DataFrame:
    """D3: pairs of effects on one target whose windows overlap or are near, from the same base, with different results."""
    reach = F.date_add(F.col("ends").cast("date"), near_days + 1).cast("timestamp")
    rows = effects.select(key, F.col(id_).alias("id"), "base", "begins", "ends", "result", reach.alias("reach"))
    pairs = _meeting(rows, [key, "base"], "id", "begins", "reach", width_days * 86_400)
    begins, ends = F.greatest("a.begins", "b.begins"), F.least("a.ends", "b.ends")
    near = (begins < ends) | (F.datediff(begins, ends) <= near_days)
    met = pairs.where(near & (F.col("a.result") != F.col("b.result")))
    return met.select(key, F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))


def typed_operation(op_marker: Column, renumbered: Column, part: Column) -> Column:
    """What an Act does to a section: ``add``, ``repeal``, ``renumber``, ``text_replace`` (of a part) or ``replace``."""
    return (
        F.when(op_marker == "new", "add").when(op_marker == "rep.", "repeal").when(renumbered.isNotNull(), "renumber").when(F.coalesce(part, F.lit(False)), "text_replace").otherwise("replace")
    )


def resolved(*signals: Column, least: int = 2) -> Column:
    """Whether at least so many of the signals agree; null ones don't."""
    return sum((F.coalesce(s, F.lit(False)).cast("int") for s in signals), F.lit(0)) >= least


def default_effective(passed: Column, votes_for: Column, votes_all: Column) -> Column:
    """When an Act takes effect by default: bills passed after May 31 wait for June 1 of the next year unless three fifths voted for them, the others take effect on January 1."""
    late = F.month(passed) > 5
    enough = F.coalesce(F.try_divide(votes_for * F.lit(1.0), votes_all) >= 0.6, F.lit(False))
    return F.when(late & ~enough, F.make_date(F.year(passed) + 1, F.lit(6), F.lit(1))).otherwise(F.make_date(F.year(passed) + 1, F.lit(1), F.lit(1)))


def first_appearances(versions: DataFrame, key: list[str], version: str, clauses: Column, source: str) -> DataFrame:
    """For each clause ever in a provision the version, and its source, in which it first stood."""
    told = versions.select(*key, version, source, F.explode(clauses).alias("clause")).where("clause <> ''")
    return told.groupBy(*key, F.md5("clause").alias("clause")).agg(F.min(version).alias("since"), F.min_by(source, F.struct(F.col(version), F.col(source))).alias("source"))
