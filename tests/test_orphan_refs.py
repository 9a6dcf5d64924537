from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strataleaf.functions.references import act_number
from strataleaf.operators.orphan_refs import orphan_counts, orphan_references

D = lambda n: datetime(2031, 1, n)
REFS = "id int, a string, b string, at timestamp, begins string, mask string"
TARGETS = "a string, b string, begins timestamp, ends timestamp"


def found(spark, refs, targets, match="partial", timed=True):
    r, t = spark.createDataFrame(refs, REFS), spark.createDataFrame(targets, TARGETS)
    key = [F.col("a"), F.col("b")]
    times = (F.col("at"), F.col("begins"), F.col("ends")) if timed else (None, None, None)
    out = orphan_references(r, t, key, key, match, *times)
    assert out.columns == [*r.columns, "orphan_kind"]
    return sorted((x.id, x.orphan_kind) for x in out.collect())


def test_kinds_and_half_open_spans(spark):
    targets = [("1", "x", D(5), D(10)), ("1", "x", D(12), None), ("2", "y", None, D(5))]
    refs = [
        (1, "1", "x", D(5), None, None),  # begins to hold
        (2, "1", "x", D(10), None, None),  # has ended
        (3, "1", "x", D(4), None, None),
        (4, "1", "x", D(12), None, None),
        (5, "9", "x", D(5), None, None),
        (6, "2", "y", D(1), None, None),  # open start
        (7, "2", "y", D(5), None, None),
        (8, "1", "x", None, None, None),  # no time: only its existence counts
        (9, "9", "q", None, None, None),
        (5, "9", "x", D(5), None, None),  # repeated
    ]
    assert found(spark, refs, targets) == [(2, "deleted"), (3, "late"), (5, "missing"), (5, "missing"), (7, "deleted"), (9, "missing")]


def test_match_semantics_of_partial_nulls(spark):
    targets = [("1", "x", D(1), None), ("2", None, D(1), None)]
    refs = [(1, "1", None, D(2), None, None), (2, None, "x", D(2), None, None), (3, "7", None, D(2), None, None), (4, None, None, D(2), None, None), (5, "2", None, D(2), None, None), (6, "1", "x", D(2), None, None)]
    assert found(spark, refs, targets, "partial") == [(3, "missing")]
    assert found(spark, refs, targets, "simple") == []
    assert found(spark, refs, targets, "full") == [(1, "missing"), (2, "missing"), (3, "missing"), (5, "missing")]


def test_empty_tables_and_bad_arguments(spark):
    assert found(spark, [], [("1", "x", D(1), None)]) == []
    assert found(spark, [(1, "1", "x", D(1), None, None)], []) == [(1, "missing")]
    assert found(spark, [(1, "1", "x", D(1), None, None)], [], timed=False) == [(1, "missing")]
    with pytest.raises(ValueError):
        found(spark, [], [], "some")


def test_counts_per_month(spark):
    rows = spark.createDataFrame([("t", D(1), "late"), ("t", D(30), "late"), ("t", None, "late")], "t string, at timestamp, orphan_kind string")
    got = {(r.ref_table, r.month, r.orphan_kind, r.n) for r in orphan_counts(rows, F.col("t"), F.col("at")).collect()}
    assert got == {("t", "2031-01", "late", 2), ("t", None, "late", 1)}


def test_act_numbers(spark):
    same = ["90-131", "090-0131", "P.A. 90-131", "PA 090-131", "p.a.90-131", " 90-131 ", "90 – 131", "Public Act 90-0131."]
    df = spark.createDataFrame([(x,) for x in same], "t string").select(act_number(F.col("t")).alias("n"))
    assert {(r.n.assembly, r.n.serial) for r in df.collect()} == {("90", "131")}
    odd = spark.createDataFrame([(None,), ("",), ("  ",), ("see note",)], "t string").select("t", act_number(F.col("t")).alias("n")).collect()
    assert [r.n for r in odd[:3]] == [None] * 3 and (odd[3].n.assembly, odd[3].n.serial) == (None, "see note")


def test_months_do_not_follow_the_session(spark):
    rows = spark.sql("SELECT 't' AS t, timestamp_seconds(1925020800) AS at, 'late' AS orphan_kind")  # 2031-01-01 in UTC
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Chicago")
        assert orphan_counts(rows, F.col("t"), F.col("at")).first().month == "2031-01"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
