import base64

import tiktoken
from pyspark.sql import functions as F

from strataleaf.llm import tokens as T

TEXTS = ["plain words", "", None, "naïve 水位 👩🏽\u200d🌾 <|endoftext|> x", "  spaces\n\n\ttabs ", "Ω" * 3000, "a b " * 60_000, "plain words"]


def frame(spark):
    return spark.createDataFrame([(i, t, [7]) for i, t in enumerate(TEXTS)], "id int, text string, ids array<int>")


def test_ids_offsets_and_round_trip(spark):
    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.id: r for r in T.encoded(frame(spark), ["id"], F.col("text"), offsets=True).collect()}
    for i, text in enumerate(TEXTS):
        if text is None or text == "":
            assert got[i].ids == [] and got[i].starts == []
            continue
        assert got[i].ids == other.encode_ordinary(text)
        raw, table = text.encode(), T.token_bytes(T.default_path())
        for token, start in zip(got[i].ids, got[i].starts):
            assert raw[start : start + len(table[token])] == table[token]
    back = {r.id: r.text for r in T.decoded(T.encoded(frame(spark), ["id"], F.col("text")), ["id"], F.col("ids")).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_split_characters_empty_lists_and_tables(spark):
    ids = T.encoded(frame(spark).where("id = 3"), ["id"], F.col("text")).first().ids
    df = spark.createDataFrame([(1, ids[:6]), (2, []), (3, None)], "id int, ids array<int>")
    got = {r.id: r.text for r in T.decoded(df, ["id"], F.col("ids")).collect()}
    assert got[1].startswith("na") and got[2] == "" and got[3] == ""
    assert T.encoded(frame(spark).limit(0), ["id"], F.col("text")).count() == 0
    assert len(T.bytes_of_characters()) == 256 and sorted(T.bytes_of_characters().values()) == list(range(256))


def test_spans_in_bytes_and_characters(spark):
    texts = ["The fee is due.", "\u767b\u8bb0\u516c\u5e03 \u00e9tat \U0001f642!", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in T.encoded(df, ["id"], F.col("text"), offsets=True).collect():
        text = texts[r.id] or ""
        raw = text.encode()
        assert len(r.starts) == len(r.ends) == len(r.first_chars) == len(r.end_chars) == len(r.ids)
        assert r.starts == [0, *r.ends[:-1]][: len(r.ids)] and (r.ends[-1:] or [0])[0] == len(raw)
        for a, b, x, y in zip(r.starts, r.ends, r.first_chars, r.end_chars):
            assert raw[a:b] in text[x:y].encode() and len(text[:x].encode()) <= a and b <= len(text[:y].encode())
