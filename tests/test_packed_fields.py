import re

from pyspark.sql import functions as F

from strataleaf.operators import packed_fields as P

CONTINUES = r"(?:eff\.|p\.)\s"


def corpus(n=400):
    import random

    rng = random.Random(5)
    entry = lambda p: f"{p}{rng.randint(80, 112)}-{rng.randint(1, 999)}" + (f", eff. {rng.randint(1, 12)}-{rng.randint(1, 28)}-{rng.randint(10, 40)}" if rng.random() < 0.8 else "")
    rows = []
    for i in range(n):
        prefix, delim, k = rng.choice(["P.A. ", "PA ", ""]), rng.choice(["; ", ", ", ";", " | ", " / ", "\t", "\r\n", " & ", ", and "]), rng.randint(1, 5)
        values = [entry(prefix or "P.A. ")] + [entry(prefix) for _ in range(k - 1)]
        if rng.random() < 0.2:
            values.insert(0, f"Laws {rng.randint(1850, 1970)}, p. {rng.randint(1, 900)}")
        rows.append((i, delim.join(values) + rng.choice(["", ".", " ;"]), values))
    return rows


def test_learned_splits_of_a_whole_column(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, f, "x") for i, f, _ in rows], "id int, position string, value string")  # clashing names
    out = P.split_packed(df, ["id"], F.col("position"), joins=CONTINUES)
    got = {}
    for r in out.orderBy("id", "position").collect():
        got.setdefault(r.id, []).append(r.value)
    right = sum(got[i] == v for i, _, v in rows)
    assert right >= 0.99 * len(rows)
    assert all(r.position >= 1 for r in out.collect())


def test_quotes_wraps_and_empty_places(spark):
    odd = [
        (1000, '"P.A. 90-1, eff. 1-2-30" "91-2" "note ""a"" of 3-4-20".', ["P.A. 90-1, eff. 1-2-30", "91-2", 'note "a" of 3-4-20']),
        (1001, "'P.A. 90-1';'revised 1-2-30;\ncorrected 2-3-31'", ["P.A. 90-1", "revised 1-2-30; corrected 2-3-31"]),
        (1002, "; P.A. 90-1,\n    eff. 1-2-30;; 91-2 ;", ["P.A. 90-1, eff. 1-2-30", "91-2"]),
        (1003, "P.A.  90-1", ["P.A. 90-1"]),
        (1004, " ; ", []),
        (1005, "", []),
        (1006, None, []),
        (1007, '"PA 90-1, eff. 1-2-30",91-2.', ["PA 90-1, eff. 1-2-30", "91-2"]),
    ]
    df = spark.createDataFrame([(i, f) for i, f, _ in corpus() + odd], "id int, field string")
    got = {}
    for r in P.split_packed(df, ["id"], F.col("field"), joins=CONTINUES).orderBy("id", "position").collect():
        got.setdefault(r.id, []).append(r.value)
    for i, _, want in odd:
        assert got.get(i, []) == want, i
    two = P.split_packed(df, ["id"], F.col("field"), joins=CONTINUES, least=2).where("id >= 1000").select("id").distinct()
    assert {r.id for r in two.collect()} == {i for i, _, v in odd if len(v) > 1}


def test_long_fields_and_ties(spark):
    long = "; ".join(f"P.A. 90-{i}, eff. 1-2-30" for i in range(1, 3000))
    df = spark.createDataFrame([(1, long), (1, long)], "id int, field string")
    out = P.split_packed(df, ["id"], F.col("field"), joins=CONTINUES)
    assert out.count() == 2 * 2999 and out.agg(F.max("position")).first()[0] == 2999


def test_empty_table(spark):
    assert P.split_packed(spark.createDataFrame([], "id int, field string"), ["id"], F.col("field")).count() == 0


def test_forward_backward_sums_to_one():
    values = [1.0 / P.BUCKETS] * P.BUCKETS
    lattice = P.Lattice("P.A. 90-1, eff. 1-2-30; 91-2; 92-3", re.compile(CONTINUES))
    covered = [0.0] * lattice.size
    for (i, j, _), (_, p) in zip(lattice.edges, P.expected(lattice, values)):
        for k in range(i, j):
            covered[k] += p
    assert all(abs(c - 1) < 1e-9 for c in covered)
    assert P.best_path(lattice, values)[0][0] == 0


def test_long_sums_agree_with_short_ones(monkeypatch):
    values = [1.0 / P.BUCKETS] * P.BUCKETS
    lattice = P.Lattice("; ".join(f"P.A. 90-{i}" for i in range(1, 30)), None)
    direct = list(P.expected(lattice, values))
    monkeypatch.setattr(P, "LONG", 1)
    assert all(a == b and abs(p - q) < 1e-9 for (a, p), (b, q) in zip(direct, P.expected(lattice, values)))
