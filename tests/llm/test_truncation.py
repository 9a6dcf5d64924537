import random
import threading

import numpy as np
import psutil
from pyspark.sql import functions as F

from strataleaf.llm import terminality
from strataleaf.llm import truncation as T

WORDS = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("ber", "dow", "lin", "mast", "ner")]


def prose(rng, n):
    return " ".join(" ".join(rng.choice(WORDS) for _ in range(8)).capitalize() + "." for _ in range(n))


ENDINGS = [
    "", "\n(Source: P.A. {n}-{n}, eff. 1-2-{n}.)", "\nTotal           {n}{n}", "\nEffective September 18, 20{n}", "\nEND OF ACT", "\nPosted at a.example.org/notes/{n}{n}",
    "\nForm {n}-A", "\n[end of text]", "\n* * *", ' It reads "to be filled in by the office..."', " See also the rules, etc.", " Who keeps it?",
]


def corpus(rng, n):
    """Texts with many kinds of ends; every tenth is cut at any place: ``[(text, cut)]``."""
    out = []
    for i in range(n):
        text = prose(rng, rng.randint(3, 9)) + rng.choice(ENDINGS).format(n=rng.randint(10, 99))
        if i % 10 == 0:
            at = rng.randint(40, len(text) - 40)
            while text[at - 1] in ". \n?" or "\nEND" in text[at - 8 : at]:
                at -= 1
            out.append((text[:at], True))
        else:
            out.append((text, False))
    return out


def test_closing_words_are_learned(spark):
    rows = corpus(random.Random(3), 1500)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "id int, text string")
    got = {r.id for r in T.truncated(df, ["id"], F.col("text")).where("by_closing").collect()}
    want = {i for i, (_, cut) in enumerate(rows) if cut}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)


def test_what_is_learned_decides(spark):
    rng = random.Random(6)
    texts = [t for t, _ in corpus(rng, 600)] + [f"{prose(rng, 3)} The holder files it by Pub. {i} of the year. Number {i} holds.\nfiled as given" for i in range(60)]
    df = spark.createDataFrame([(str(i).encode(), t) for i, t in enumerate(texts)], "mark binary, text string")
    learned = terminality.learn(df)
    assert learned.texts == len(texts) and 0 < learned.cut < 0.5

    def is_open(text):
        row = terminality.with_closings(spark.createDataFrame([(text,)], "text string"), "text").select(
            F.flatten(F.transform("closings", terminality._slots)).alias("c"), terminality._slots(terminality.form(F.element_at(F.split("text", r"\s"), -1))).alias("w")
        ).first()
        return learned.is_open(list(row.c), list(row.w) if text.endswith(".") else None, T.LEAST)

    assert not is_open("It holds.\nfiled as given") and is_open("It holds.\nfiled a")
    assert is_open("The holder files it by Pub.") and not is_open("Number 7 holds.")
    assert is_open("The holder files")


def cut_copies(rng, families, size):
    """Families of texts that share an opening of about twelve words; of each text a copy with a word changed, cut at 30 to
    95 % of its length: ``{id: text}``, those cut from 100000."""
    out = {}
    for f in range(families):
        opening = prose(rng, 2)[:-1]
        for k in range(size):
            i = f * size + k
            out[i] = f"{opening} {prose(rng, rng.randint(12, 30))}"
            words = out[i].split()
            at = rng.randint(20, 30)
            words[at] = "changed"
            text = " ".join(words)
            end = int(len(text) * rng.uniform(0.3, 0.95))
            while not (text[end - 1].isalpha() and (text[end].isalpha() or text[end + 1].islower())):
                end += 1
            out[100_000 + i] = text[:end]
    return out


def test_cut_copies_of_shared_openings_are_found_by_alignment(spark):
    texts = cut_copies(random.Random(8), 3, 60)
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "id int, text string")
    got = {r.id for r in T.truncated(df, ["id"], F.col("text")).where("by_copy").collect()}
    assert len([i for i in got if i >= 100_000]) >= 0.9 * 180 and not [i for i in got if i < 100_000]


def test_no_exact_cut_of_a_large_group_is_lost(spark):
    """Forms that differ in one number, and some cut within theirs, against brute force."""
    rng = random.Random(4)
    body = prose(rng, 25)
    texts = {i: f"{body}\nTotal           {rng.randint(10_000_000, 99_999_999)}" for i in range(400)}
    texts |= {1000 + i: texts[i][:-3] for i in range(80)}
    want = {i for i, a in texts.items() if any(len(b) > len(a) and b.startswith(a) for b in texts.values())}
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    assert {r.id for r in T.truncated(df, ["id"], F.col("text")).where("by_copy").collect()} == want


def test_shingles_and_bands():
    shingle = T.Shingler()
    words = [f"w{i}" for i in range(200)]
    a, b = T.bands([shingle(" ".join(words)), shingle(" ".join(words[:60]))])
    assert [len(x) for x in a] == [1, T.BANDS, T.BANDS, T.BANDS] and a[:3] == b
    assert len(shingle("one two")) == 0 and list(T.bands([])) == []
    assert len(np.unique([k for x in a for k in x])) == 1 + 3 * T.BANDS


def test_alignment_end():
    whole = "one two three four five six seven eight nine ten eleven"
    assert T.alignment_end("one two three fo", whole) == 16 and T.goes_on(whole, 16)
    assert T.alignment_end("one changed three four five six s", whole) == whole.index("seven") + 1
    assert T.alignment_end("something else", whole) is None and T.alignment_end("one", whole) is None
    assert not T.goes_on("It ends. More", 8) and not T.goes_on("a b\nNext", 3) and T.goes_on("a b\nnext", 3) and T.goes_on("a b c", 3)
    assert not T.goes_on("a b  ", 3)


def test_odd_rows_and_hot_copies(spark):
    rng = random.Random(2)
    rows = [(i, "Ends of some sentence within the wor", "s", "x") for i in range(50)]
    rows += [(100, None, "s", "x"), (101, "", None, "x"), (102, " ", "s", "x"), (103, "word " * 100_000, "s", "x"), (104, "It is over here.", None, "x")]
    rows += [(105, "It goes ...", "s", "x"), (106, 'It reads "on..."', "s", "x"), (107, "It is br�", "s", "x")]
    rows += [(1000 + i, t, "s", "x") for i, (t, _) in enumerate(corpus(rng, 300))]
    out = T.truncated(spark.createDataFrame(rows, "id int, text string, source string, mark string"), ["id", "source"], F.col("text")).collect()
    assert len(out) == len(rows) and {r.id for r in out if r.cut and r.id < 1000} == {*range(50), 103, 105, 107}
    empty = spark.createDataFrame([], "id int, text string")
    assert T.truncated(empty, ["id"], F.col("text")).count() == 0


def test_workers_hold_few_of_the_rows_that_are_sought(spark):
    """Texts of which nearly all is sought: the worker's memory must not grow with what is found in a batch of them."""
    rng = random.Random(7)
    some = [f"{x}{x}{x}{x}" for x in "abcdefghijkl"]
    opening = "one two three four five"
    texts = [f"{opening} {' '.join(rng.choices(some, k=1000))} end" for _ in range(1500)]
    texts += [f"{opening} {a} {b} {c}" for a in some for b in some for c in some]
    df = spark.createDataFrame(texts, "string").select(F.unhex(F.md5("value")).alias("mark"), F.col("value").alias("text")).coalesce(1)
    peaks, over = {}, threading.Event()

    def watch():
        while not over.wait(0.02):
            for p in psutil.Process().children(recursive=True):
                try:
                    if "pyspark.daemon" in " ".join(p.cmdline()):
                        peaks[p.pid] = max(peaks.get(p.pid, 0), p.memory_info().rss)
                except psutil.Error:
                    pass

    watching = threading.Thread(target=watch)
    watching.start()
    try:
        asking, following = T.near_copies(df)
        got = following.select("key").distinct().count()
    finally:
        over.set()
        watching.join()
    assert asking.select("mark").distinct().count() == len(some) ** 3 and got == len(some) ** 3
    assert max(peaks.values()) < 400e6


def test_pieces_and_what_follows():
    rng = random.Random(9)
    bits, bucket = np.zeros(T.BITS // 8, "uint8"), 77
    for n in (0, 1, 2, 3, 50, T.PIECE - 1, T.PIECE, T.PIECE + 1, 2 * T.PIECE - 1, 3 * T.PIECE + 5):
        text = " ".join(rng.choice("abcd") * rng.randint(3, 5) for _ in range(n))
        words = text.split()
        got = list(T.pieces(text))
        assert [x for _, x in got] == [False] * (len(got) - 1) + [True] and max(len(p) for p, _ in got) <= T.PIECE
        assert [w for k, (p, _) in enumerate(got) for w in (p[2:] if k else p)] == words
        found = {(T.closing_key([a, b, w[:h]]), w) for a, b, w in zip(words, words[1:], [*words[2:-1], *[x[:-1] for x in words[2:][-1:]]]) for h in range(1, min(T.HEAD, len(w)) + 1)}
        rows = lambda: {(k, w) for o, b, ks, ws in T.following_rows(bits, T.Heads(), b"m", text, [bucket, 5]) for x, k, w in zip(b, ks.tolist(), ws) if x == bucket}
        bits[:] = 0
        assert not rows()
        wanted = {k for k, _ in found if rng.random() < 0.5}
        keys = np.array(sorted(wanted), "int64").view("uint64")
        at = T._places(keys, T._paired(keys, np.full(len(keys), bucket, "uint64")))
        np.bitwise_or.at(bits, at >> np.uint64(3), np.left_shift(1, (at & np.uint64(7)).astype("int64")).astype("uint8"))
        assert {(k, w) for k, w in found if k in wanted} <= rows() <= found
