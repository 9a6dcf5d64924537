import random

import numpy as np
from pyspark.sql import functions as F

from strataleaf.llm import leakage as K

WORDS = [f"w{i}" for i in range(600)]


def make(seed=4):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(i, text(rng.randint(30, 80)), rng.choice(WORDS)) for i in range(20)]
    docs, want = [], set()
    for d in range(300):
        parts = [text(rng.randint(20, 200))]
        if rng.random() < 0.4:
            i, item, _ = rng.choice(items)
            w = item.split()
            share = rng.choice([1.0, 0.7, 0.3])
            size = int(len(w) * share)
            cut = rng.randint(0, len(w) - size)
            copied = [x if rng.random() > 0.08 else rng.choice(WORDS) for x in w[cut : cut + size]]
            parts += [" ".join(copied).upper() + ".", text(50)]
            if share >= 0.7:
                want.add((d, i))
        docs.append((d, "\n> ".join(parts)))
    return docs, items, want


def test_against_planted_leaks(spark):
    docs, items, want = make()
    d, i = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, t string, answer string")
    got = {(r.doc_id, r.item_id) for r in K.leaked(d, "doc_id", F.col("text"), i, "item_id", "t", "answer").collect()}
    assert want == got


def test_places_and_subsequences():
    assert K.common_words("a b c d".split(), "x b a c d".split()) == 3 and K.common_words([], ["a"]) == 0 and K.common_words(["a"], []) == 0
    rng = random.Random(1)
    for _ in range(100):
        a, b = [[rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in "xy"]
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        assert K.common_words(a, b) == row[-1]
    item = [f"i{k}" for k in range(20)]
    apart = item[:7] + ["x"] * 200 + item[7:14]  # not in one place
    assert K.best_place(item, apart, 0, len(apart))[0] == 7
    assert K.best_place(item, ["x"] * 50 + item[:12], 0, 62)[0] == 12


def test_odd_rows(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, item, 9), (1, item, 9), (2, None, 9), (3, "", 9), (4, "ｏｎｅ twо three fo\u00adur five six seven eight nine ten", 9), (5, "x " * 100_000 + item, 9)]
    d = spark.createDataFrame(docs, "id int, text string, item_id int")  # a clashing name
    i = spark.createDataFrame([(1, item, "ten"), (2, None, None), (3, "", None), (1, item, "ten")], "item_id int, t string, answer string")
    got = sorted((r.doc_id, r.item_id, r.coverage, r.holds_answer) for r in K.leaked(d, "id", F.col("text"), i, "item_id", "t", "answer").collect())
    assert got == [(1, 1, 1.0, True), (1, 1, 1.0, True), (4, 1, 1.0, True), (5, 1, 1.0, True)]
    assert K.leaked(d.limit(0), "id", F.col("text"), i, "item_id", "t").count() == 0
    assert K.leaked(d, "id", F.col("text"), i.limit(0), "item_id", "t").count() == 0


def test_the_space_is_that_of_an_exact_decomposition(spark):
    """The energy of all passages and weighted items that the basis holds, against that of the exact SVD's directions."""
    docs, items, _ = make()
    own = K.Items([i for i, _, _ in items], [t for _, t, _ in items], [None] * len(items))
    texts = spark.createDataFrame([(str(d).encode(), t) for d, t in docs], "mark binary, text string")
    passages = K.passage_table(texts, spark.sparkContext.broadcast(own))
    rank = 10
    idf, basis = K.latent_space(passages, own, rank=rank)
    assert np.allclose(basis.T @ basis, np.eye(rank), atol=1e-3)

    def dense(columns):
        rows = K.Rows(np.concatenate([np.asarray(c) for c in columns]), np.array([len(c) for c in columns]), idf)
        out = np.zeros((len(columns), len(idf)))
        out[rows.row, rows.column] = rows.value
        return out

    matrix = dense([c for _, t in docs for _, c in own.passages(K.words(t))])
    mine = dense([[c for _, x in own.passages(w) for c in x] for w in own.words])
    assert len(matrix) == passages.count() and np.allclose(np.linalg.norm(matrix, axis=1), 1)
    both = np.vstack([matrix, mine * np.sqrt(K.ITEM_WEIGHT * len(matrix) / len(mine))])
    exact = np.linalg.svd(both)[2][:rank].T
    held = lambda b: (np.linalg.norm(both @ b) ** 2)
    assert held(basis) >= 0.97 * held(exact)
    assert held(basis) >= 1.2 * held(np.linalg.qr(np.random.default_rng(1).standard_normal(basis.shape))[0])


def test_candidates_against_brute_force(spark):
    """Every pair that an exact search of all places finds is found; with other items beside them the same pairs are."""
    docs, items, _ = make(seed=12)
    w, texts = {i: t.split() for i, t, _ in items}, {d: K.words(t) for d, t in docs}
    want = {(d, i) for d, t in texts.items() for i, item in w.items() if len({*item} & {*t}) >= 0.4 * len({*item}) and K.best_place(item, t, 0, len(t))[0] >= 0.5 * len(item)}
    d = spark.createDataFrame(docs, "doc_id int, text string")
    for more in ([], [(100 + k, " ".join(f"k{k}x{j}" for j in range(12)), None) for k in range(30)]):
        i = spark.createDataFrame(items + more, "item_id int, t string, answer string")
        got = {(r.doc_id, r.item_id) for r in K.leaked(d, "doc_id", F.col("text"), i, "item_id", "t").collect()}
        assert got <= want and len(got) >= 0.95 * len(want)
