import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from strataleaf.functions.references import hash_value, page_url
from strataleaf.operators.snapshot_diff import snapshot_changes

SCHEMA = "id bigint, seq int, url string, status int, digest string, at timestamp, change_kind string"
T0 = datetime(2031, 1, 1)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = snapshot_changes(df, F.col("url"), F.col("seq"), {"status": F.col("status"), "digest": F.col("digest")}, [F.col("at"), F.col("id")])
    return {(r.key, r.seq): (r.change_kind, tuple(r.changed_fields)) for r in out.collect()}


def test_kinds_fields_gaps_and_nulls(spark):
    rows = [
        (1, 1, "a", 200, "x", T0, None),
        (2, 1, "b", 200, None, T0, None),
        (3, 1, "gone", 200, "x", T0, None),
        (4, 3, "a", 404, "y", T0, None),  # 2 was not delivered
        (5, 3, "b", 200, "z", T0, None),  # null is a value
        (6, 3, "new", 200, "x", T0, None),
        (7, 3, None, 200, "x", T0, None),
        (8, None, "a", 200, "x", T0, None),
    ]
    assert run(spark, rows) == {
        ("a", 3): ("changed", ("digest", "status")),
        ("b", 3): ("changed", ("digest",)),
        ("gone", 3): ("removed", ()),
        ("new", 3): ("added", ()),
    }


def test_latest_row_counts_ties_by_id_and_repeats(spark):
    rows = [
        (1, 1, "a", 200, "x", T0, None),
        (2, 2, "a", 200, "y", T0, None),
        (3, 2, "a", 200, "x", T0 + timedelta(1), None),  # later, as before
        (4, 2, "a", 200, "x", T0 + timedelta(1), None),
        (5, 1, "t", 200, "x", T0, None),
        (6, 2, "t", 200, "x", T0, None),
        (7, 2, "t", 200, "y", T0, None),  # same time, greater id
        (8, 2, "t", 200, "x", None, None),  # no time is earliest
    ]
    assert run(spark, rows) == {("t", 2): ("changed", ("digest",))}


def test_empty_and_single_snapshot(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, 5, "a", 200, "x", T0, None)]) == {}


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [
        (i, rng.choice([1, 2, 4, 5]), rng.choice("abcdef") if rng.random() < 0.7 else "hot", rng.choice([200, 404, None]), rng.choice(["x", "y", None]), T0 + timedelta(rng.randrange(3)), None)
        for i in range(300)
    ]
    held = {}
    for r in sorted(rows, key=lambda r: (r[5], r[0])):
        held.setdefault(r[1], {})[r[2]] = (r[3], r[4])
    want, numbers = {}, sorted(held)
    for p, n in zip(numbers, numbers[1:]):
        for k in held[p].keys() | held[n].keys():
            a, b = held[p].get(k), held[n].get(k)
            if a is None or b is None:
                want[k, n] = ("added" if a is None else "removed", ())
            elif a != b:
                want[k, n] = ("changed", tuple(x for x, same in (("digest", a[1] == b[1]), ("status", a[0] == b[0])) if not same))
    assert run(spark, rows) == want


def test_urls_and_hashes(spark):
    df = spark.createDataFrame(
        [
            ("HTTPS://User@Ex.Example:443/A?b=C#f", "https://User@ex.example/A?b=C"),
            ("http://EX.example:80", "http://ex.example"),
            ("http://ex.example:8080/x", "http://ex.example:8080/x"),
            ("https://ex.example:80/", "https://ex.example:80/"),
            ("not a url#x", "not a url"),
            (None, None),
        ],
        "url string, want string",
    )
    assert df.where(~page_url(F.col("url")).eqNullSafe(F.col("want"))).count() == 0
    h = spark.createDataFrame([("SHA256:AbC", "abc"), ("abc", "abc"), ("  ", None), (None, None), ("md5=0F", "0f")], "h string, want string")
    assert h.where(~hash_value(F.col("h")).eqNullSafe(F.col("want"))).count() == 0
