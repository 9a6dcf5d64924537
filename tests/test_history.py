import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from strataleaf.operators.history import attribute_history

SCHEMA = "id int, k0 string, seq int, at timestamp, x string, y string, attribute string"
T0 = datetime(2031, 1, 1)


def run(spark, rows, numbers=range(1, 6)):
    df = spark.createDataFrame(rows, SCHEMA)
    out = attribute_history(df, {"k": F.col("k0")}, F.col("seq"), {"x": F.col("x"), "y": F.col("y")}, [F.col("at"), F.col("id")], numbers)
    return sorted((r.k, r.attribute, r.from_seq, r.to_seq) for r in out.collect())


def test_islands_nulls_absence_and_the_last(spark):
    rows = [
        (1, "a", 1, T0, "p", "q", None),
        (2, "a", 2, T0, "p", None, None),  # null ends y
        (3, "a", 4, T0, "p", "q", None),  # 3 is absent: ends x
        (4, "a", 5, T0, "r", "q", None),
        (5, None, 1, T0, "p", "q", None),
        (6, "a", 9, T0, "p", "q", None),  # not delivered
    ]
    assert run(spark, rows) == [("a", "x", 1, 3), ("a", "x", 4, 5), ("a", "x", 5, 0), ("a", "y", 1, 2), ("a", "y", 4, 0)]


def test_latest_row_counts_even_if_null(spark):
    rows = [(1, "a", 1, T0, "p", "q", None), (2, "a", 1, T0 + timedelta(1), None, "q", None), (3, "a", 1, T0 + timedelta(1), None, "z", None)]
    assert run(spark, rows) == [("a", "y", 1, 2)]
    assert run(spark, []) == []


def test_missing_numbers_are_no_gap(spark):
    rows = [(1, "a", 2, T0, "p", "", None), (2, "a", 5, T0, "p", "", None)]
    assert run(spark, rows, [2, 5, 7]) == [("a", "x", 2, 7), ("a", "y", 2, 7)]


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), rng.randint(1, 5), T0 + timedelta(rng.randrange(4)), rng.choice(["p", "q", None]), rng.choice(["p", "q", None]), None) for i in range(60)]
    held = {}
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        held[r[1], r[2]] = {"x": r[4], "y": r[5]}
    want = []
    for k in "ab":
        for a in "xy":
            n = 1
            while n <= 5:
                v, m = held.get((k, n), {}).get(a), n + 1
                while v is not None and m <= 5 and held.get((k, m), {}).get(a) == v:
                    m += 1
                if v is not None:
                    want.append((k, a, n, 0 if m == 6 else m))
                n = m
    assert run(spark, rows) == sorted(want)
