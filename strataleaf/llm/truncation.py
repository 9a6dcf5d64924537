"""Texts that stop before their end.

Near-copies are found by min-hash banding over shingles of five words. A cut text is like the beginning of the text it was
cut from, however little of it is left; so beginnings are banded, of 5, 15, 45 words and so on: of every text all of these
that it has, and it asks for others by its longest. Of the texts that meet, those that have the asking text's last words
with more after them are verified (at least 0.8 of its shingles are in the other) and aligned; where the alignment ends early,
within a word or an open sentence, the text was cut. All texts are also scored by how terminal their closing words are
(:mod:`strataleaf.llm.terminality`), which decides for those without a near-copy that goes on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataleaf.llm import terminality
from strataleaf.llm.leakage import common_words
from strataleaf.session import written

#: Words of a shingle, least part of a text's shingles that its near-copy has, bands and rows of min-hashes.
SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 8, 3
#: Each banded beginning has this many times the words of the one before.
GROWTH = 3
#: The least probability, given its closing words, that a text was cut.
LEAST = 0.05
#: Words before a text's end that are aligned.
TAIL = 24
#: Characters of a last, perhaps cut, word that are part of its key, and bits of the filter of what is sought (16 MB).
HEAD, BITS = 3, 1 << 27
#: Shingles that are hashed, and rows that are returned, at once.
CHUNK = 1 << 14
#: Words that are looked at, rows that are taken from Arrow, and words whose hashes are kept, at once.
PIECE, SLICE, KNOWN = 1 << 12, 256, 200_000

_WORD = re.compile(r"\w+")
_STOPS = ".?!。！？؟।"
_CLOSERS = "\"'”’»)]}）】」』›*_`"
_BROKEN = "�"
_random = np.random.default_rng(5)
_SEEDS = _random.integers(1, 1 << 63, BANDS * ROWS, dtype="uint64") | np.uint64(1)
_SHIFTS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype="uint64")
_PLACES = _random.integers(1, 1 << 63, SHINGLE, dtype="uint64") | np.uint64(1)
_WEIGHTS = _random.integers(1, 1 << 63, ROWS, dtype="uint64") | np.uint64(1)
_PAIRED = _random.integers(1, 1 << 63, 3, dtype="uint64") | np.uint64(1)


def hash_of(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))


class Shingler:
    """The shingles of texts as hashes; hashes of words are kept from text to text."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        """One hash for each place of a shingle; none of a text with fewer words."""
        words = _WORD.findall(text.casefold())
        if len(words) < SHINGLE:
            return np.zeros(0, "uint64")
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        try:
            hashes = np.array([known[w] for w in words], "uint64")
        except KeyError:
            known.update({w: hash_of(w) for w in {*words} if w not in known})  # a difference would go through all that are kept
            hashes = np.array([known[w] for w in words], "uint64")
        n = len(words) - SHINGLE + 1
        with np.errstate(over="ignore"):
            found = sum(hashes[k : k + n] * _PLACES[k] for k in range(SHINGLE))
            return found ^ (found >> np.uint64(31))


def bands(texts: list[np.ndarray]) -> Iterator[list[list[int]]]:
    """Of the shingles of each text the hashes of the bands of its banded beginnings, the shortest first."""
    group: list[np.ndarray] = []
    size = 0
    for shingles in texts:
        group.append(shingles)
        size += len(shingles)
        if size >= CHUNK:
            yield from _bands(group)
            group, size = [], 0
    if group:
        yield from _bands(group)


def _stops(n: int) -> list[int]:
    """Where the banded beginnings of a text with ``n`` shingles end."""
    stops, words = [], SHINGLE
    while n >= words - SHINGLE + 1:
        stops.append(words - SHINGLE + 1)
        words *= GROWTH
    return stops


def _bands(group: list[np.ndarray]) -> Iterator[list[list[int]]]:
    stops = [_stops(len(x)) for x in group]
    kept = np.concatenate([x[: s[-1]] for x, s in zip(group, stops)])
    offsets = np.cumsum([0, *(s[-1] for s in stops)])
    starts = np.concatenate([o + np.array([0, *s[:-1]]) for o, s in zip(offsets, stops)])
    depth = np.concatenate([np.arange(len(s)) for s in stops])
    least = np.empty((len(starts), BANDS * ROWS), "uint64")
    with np.errstate(over="ignore"):
        for f in range(BANDS * ROWS):  # one function at a time, so that memory doesn't grow with their number
            mixed = kept * _SEEDS[f] + _SHIFTS[f]
            least[:, f] = np.minimum.reduceat(mixed ^ (mixed >> np.uint64(32)), starts)
        for d in range(1, depth.max() + 1):  # a beginning holds the shorter ones
            at = np.flatnonzero(depth == d)
            least[at] = np.minimum(least[at], least[at - 1])
        # no two bands or beginnings share a bucket
        keys = (least.reshape(-1, BANDS, ROWS) * _WEIGHTS).sum(2) + np.arange(BANDS, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15) + depth[:, None].astype("uint64") * np.uint64(0x632BE59B)
    found = (keys ^ (keys >> np.uint64(29))).astype("int64").tolist()
    at = 0
    for s in stops:
        # of one shingle all bands say the same
        yield [found[at][:1], *found[at + 1 : at + len(s)]]
        at += len(s)


class Heads:
    """Hashes of words and, after these, of their beginnings of 1 to ``HEAD`` characters, 0 where a word has fewer, as rows of
    a table; they are kept from one piece of a text to the next."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((KNOWN, HEAD + 1), "uint64")

    def __call__(self, words: list[str]) -> np.ndarray:
        """The rows of at most ``KNOWN`` words."""
        known = self.known
        if len(known) + len(words) > KNOWN:
            known.clear()
        for w in words:
            if w not in known:
                self.table[len(known)] = [hash_of(w), *(hash_of(w[:n]) if n <= len(w) else 0 for n in range(1, HEAD + 1))]
                known[w] = len(known)
        return np.array([known[w] for w in words], "int64")


def closing_keys(first: np.ndarray, second: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Of the hashes of the two words before the last, and of the last as far as ``HEAD`` characters."""
    with np.errstate(over="ignore"):
        found = first * _PLACES[0] + second * _PLACES[1] + head * _PLACES[2]
    return found ^ (found >> np.uint64(31))


def closing_key(words: list[str]) -> int:
    return int(closing_keys(*[np.array([hash_of(w)], "uint64") for w in (*words[-3:-1], words[-1][:HEAD])]).view("int64")[0])


def _paired(keys: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        found = keys * _PAIRED[0] + buckets * _PAIRED[1]
    return found ^ (found >> np.uint64(31))


def _places(keys: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The bits of the filter that are set for keys, and pairs of a key and a bucket."""
    return np.concatenate([keys, pairs, pairs >> np.uint64(32)]) & np.uint64(BITS - 1)


def _set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bits of these hashes are set."""
    at = hashes & np.uint64(BITS - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype("uint8") & 1).astype(bool)


def _sliced(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch, of which few at a time are held as Python's objects."""
    for at in range(0, batch.num_rows, SLICE):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns))


def pieces(text: str) -> Iterator[tuple[list[str], bool]]:
    """The words of a text, at most ``PIECE`` at a time, with the two words before them first; whether these are the last."""
    if len(text) <= 2 * PIECE:
        yield text.split(), True
        return
    held: list[str] = []
    for m in re.finditer(r"\S+", text):
        held.append(m.group())
        if len(held) > PIECE:
            yield held[:-1], False
            del held[:-3]
    yield held, True


def own_words(text: str) -> list[str]:
    return text.rstrip().rstrip(_BROKEN).split()


def banded(texts: DataFrame) -> DataFrame:
    """``mark, low, top, key, part`` of a table ``mark, text``: one row for each text with five words or more, with the
    buckets of its shorter beginnings and those of its longest, and what its last words are sought by.

    Written: its rows are small, whatever the texts.
    """
    schema = pa.schema([("mark", pa.binary()), ("low", pa.list_(pa.int64())), ("top", pa.list_(pa.int64())), ("key", pa.int64()), ("part", pa.string())])

    def told(out: list[tuple], held: list[np.ndarray]) -> pa.RecordBatch:
        found = [([b for x in f[:-1] for b in x], f[-1]) for f in bands(held)]
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, (mark, *f, key, part))) for (mark, key, part), f in zip(out, found)], schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        out, held, size = [], [], 0
        for batch in batches:
            for mark, text in _sliced(batch):
                words = own_words(text)
                if len(words) > 2 and len(own := shingles(text)):
                    out.append((mark, closing_key(words), words[-1]))
                    held.append(own)
                    size += len(own)
                    if size >= 4 * CHUNK:
                        yield told(out, held)
                        out, held, size = [], [], 0
        yield told(out, held)

    return written(texts.select("mark", "text").mapInArrow(rows, "mark binary, low array<bigint>, top array<bigint>, key bigint, part string"))


def _sought(wanted: DataFrame) -> np.ndarray:
    """The filter, in bytes, of a table ``bucket, key``: of all rows of any number, a table of ``BITS`` bits."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, keys = [batch.column(c).to_numpy().view("uint64") for c in ("bucket", "key")]
            at = _places(keys, _paired(keys, buckets))
            bits = np.left_shift(np.uint64(1), at & np.uint64(63)).view("int64")
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype("int32")), pa.array(bits)], ["slot", "bits"])

    got = wanted.select("bucket", "key").mapInArrow(rows, "slot int, bits bigint").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, "int64")
    out[got["slot"].to_numpy()] = got["bits"].to_numpy()  # at most BITS / 64 rows
    return out.view("uint8")


def following_rows(bits: np.ndarray, hashes: Heads, mark: bytes, text: str, buckets: list[int]) -> Iterator[tuple[list, np.ndarray, np.ndarray, list]]:
    """Columns ``other, bucket, key, word`` of what the filter has of a text in these buckets: pieces of any number of rows."""
    own = np.array(buckets, "int64").view("uint64")
    for words, last in pieces(text):
        if len(words) < 3:
            continue
        before, after = words[:-1], words[2:]
        if last:  # after the last word nothing goes on
            after[-1] = after[-1][:-1]
        at = hashes(before + after)
        third = at[len(before) :]
        heads = hashes.table[third, 1:]
        keys = closing_keys(hashes.table[at[: len(third)], :1], hashes.table[at[1 : len(third) + 1], :1], heads)
        i, n = np.nonzero((heads != 0) & _set(bits, keys))
        found = keys[i, n]
        with np.errstate(over="ignore"):
            _, once = np.unique(found + third[i].astype("uint64") * _PAIRED[2], return_index=True)  # a key and its word
        i, found = i[once], found[once]
        pairs = _paired(found[:, None], own)
        j, b = np.nonzero(_set(bits, pairs) & _set(bits, pairs >> np.uint64(32)))
        if len(j):
            yield [mark] * len(j), own[b].view("int64"), found[j].view("int64"), [after[x] for x in i[j]]


def near_copies(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a table ``mark, text``: the texts that ask, ``mark, bucket, key, part``, and those that have what they ask for,
    ``other, bucket, key, word``: in one bucket, with the two words before the last before a word that begins like the last.

    Wherever an alignment ends within or after a text's last word, with the two words before it matched too, the other text
    is among these; of a bucket of any size only texts meet that can go on alike.

    Scale: one row a text is written; buckets are counted by an aggregate that combines before the shuffle; of the words
    sought, alone and with their buckets, a filter of ``BITS`` bits is sent, so that others are not shuffled. Workers hold a
    piece of one text and ``CHUNK`` rows or those of one piece, whatever the texts and however much of them is sought.
    """
    rows = banded(texts)
    places = rows.select(
        "mark", F.explode(F.concat(F.transform("low", lambda b: F.struct(b.alias("bucket"), F.lit(False).alias("asks"))), F.transform("top", lambda b: F.struct(b.alias("bucket"), F.lit(True).alias("asks"))))).alias("p")
    ).select("mark", "p.*")
    short = F.xxhash64("mark")
    shared = written(
        places.groupBy("bucket")
        .agg(F.min(short).alias("least"), F.max(short).alias("most"), F.bool_or("asks").alias("asked"))
        .where("asked AND least <> most")
        .select("bucket")
    )
    crowded = written(places.join(shared, "bucket", "left_semi").distinct())
    asking = written(crowded.where("asks").select("mark", "bucket").join(rows.select("mark", "key", "part").dropDuplicates(["mark"]), "mark"))
    wanted = written(asking.select("bucket", "key").distinct())
    sought = texts.sparkSession.sparkContext.broadcast(_sought(wanted))
    schema = pa.schema([("other", pa.binary()), ("bucket", pa.int64()), ("key", pa.int64()), ("word", pa.string())])

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = Heads(), [], 0

        def told() -> Iterator[pa.RecordBatch]:
            others, buckets, keys, words = zip(*held)
            out = pa.RecordBatch.from_arrays(
                [pa.array([x for o in others for x in o], pa.binary()), pa.array(np.concatenate(buckets)), pa.array(np.concatenate(keys)), pa.array([x for w in words for x in w], pa.string())], schema=schema
            )
            return (out.slice(at, CHUNK) for at in range(0, out.num_rows, CHUNK))

        for batch in batches:
            for mark, text, buckets in _sliced(batch):
                for found in following_rows(sought.value, hashes, mark, text, buckets):
                    held.append(found)
                    size += len(found[0])
                    if size >= CHUNK:
                        yield from told()
                        held, size = [], 0
        if held:
            yield from told()

    near = crowded.groupBy("mark").agg(F.collect_set("bucket").alias("buckets"))
    follows = texts.join(near, "mark").select("mark", "text", "buckets").mapInArrow(followed, "other binary, bucket bigint, key bigint, word string")
    return asking, written(follows.join(wanted, ["bucket", "key"], "left_semi").distinct())


def alignment_end(text: str, other: str) -> int | None:
    """Where in ``other`` the alignment with the whole of ``text`` ends; null if its end isn't found there."""
    own = own_words(text)
    if len(own) < 2:
        return None
    theirs = [(m.group(), m.end()) for m in re.finditer(r"\S+", other)]
    best: tuple[int, int] | None = None
    tail = own[-TAIL:-1]
    for j in range(1, len(theirs)):
        word, end = theirs[j]
        if theirs[j - 1][0] == own[-2] and word.startswith(own[-1]):
            same = common_words(tail, [w for w, _ in theirs[max(0, j - len(tail) - TAIL // 4) : j]])
            if same >= SIMILAR * len(tail) and (best is None or same > best[0]):
                best = same, end - len(word) + len(own[-1])
    return best[1] if best else None


def goes_on(other: str, end: int) -> bool:
    """Whether ``other`` goes on after ``end`` within its word or sentence."""
    rest = other[end:]
    if not rest.strip():
        return False
    if not rest[0].isspace():
        return rest[0].isalnum()
    if other[:end].rstrip(_CLOSERS)[-1:] in _STOPS:
        return False
    after = rest.lstrip()
    return after[0].islower() or not re.search(r"[\r\n]", rest[: len(rest) - len(after)])


def cut_by_copies(texts: DataFrame) -> DataFrame:
    """``mark``: the texts, of a table ``mark, text``, of which a verified near-copy goes on where they end.

    First every asking text is held against one text of each group that may go on alike, the greatest by hash; then those
    left over against all of their group.
    """
    asking, following = near_copies(texts)

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for batch in batches:
            found = []
            for mark, own, whole in _sliced(batch):
                end = alignment_end(own, whole)
                if end is None or not goes_on(whole, end):
                    continue
                a = np.unique(shingles(" ".join(own_words(own)[:-1])))
                if not len(a) or np.isin(a, shingles(whole)).sum() >= SIMILAR * len(a):
                    found.append(mark)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["mark"])

    def verified(asking: DataFrame, following: DataFrame) -> DataFrame:
        pairs = written(
            asking.join(following, ["bucket", "key"]).where("mark <> other AND startswith(word, part)").select("mark", "other").distinct()
        )
        ends = pairs.select("mark").union(pairs.select(F.col("other").alias("mark"))).distinct()
        once = written(texts.join(ends, "mark", "left_semi").groupBy("mark").agg(F.first("text").alias("text")))
        both = pairs.join(once.withColumnRenamed("text", "own"), "mark").join(
            once.select(F.col("mark").alias("other"), F.col("text").alias("whole")), "other"
        )
        return written(both.select("mark", "own", "whole").mapInArrow(aligned, "mark binary").distinct())

    first = following.groupBy("bucket", "key", "word").agg(F.max_by("other", F.xxhash64("other")).alias("other"))
    by_first = verified(asking, first)
    return by_first.unionByName(verified(asking.join(by_first, "mark", "left_anti"), following))


_DOTS = r"(?:\.{2,}|…|\. \. \.)\s*+([\"'”’»)\]]*+)\z"


def truncated(documents: DataFrame, ids: list[str], text: Column) -> DataFrame:
    """``ids..., cut, by_copy, by_closing``: whether the text of each row ends within a word, sentence or trailer.

    ``cut`` is true also where dots stand for the lost rest (but not in a quotation) and where the last character is
    broken; false for null and blank texts. ``by_copy`` tells that a near-copy goes on, ``by_closing`` that its closing
    words do not end texts or sentences. All columns of ``ids`` are kept, repeated rows too; others play no part. Whole
    texts are read, of any length; a text of fewer than five words has no near-copies. An empty table gives none.

    Closing words are counted over different texts, so that copies of one text can't make its last line an ending.

    Scale: two passes over the texts by built-in expressions and one in Python, none of which shuffles texts; only those
    of pairs are joined.
    """
    wanted = documents.select(*[F.col(f"`{c}`").alias(f"id{i}") for i, c in enumerate(ids)], text.alias("text")).withColumn("mark", F.unhex(F.md5("text")))
    texts = wanted.select("mark", "text").where("trim(text) <> ''")
    shared = documents.sparkSession.sparkContext.broadcast(terminality.learn(texts))

    @F.pandas_udf("boolean")
    def opened(closings: pd.Series, word: pd.Series) -> pd.Series:
        learned = shared.value
        return pd.Series([len(c) > 0 and learned.is_open(c, w, LEAST) for c, w in zip(closings, word)], dtype="bool")

    copies = cut_by_copies(texts)
    # all that is needed of a text's end is taken before Python and the join, so that texts are not sent or shuffled
    told = terminality.with_closings(wanted.withColumn("end", F.right(terminality.bare("text"), F.lit(80))), "text").withColumns(
        {
            "blank": F.coalesce(F.trim("end") == "", F.lit(True)),
            "after": F.when(F.col("end").rlike(_DOTS), F.regexp_extract("end", _DOTS, 1)),
            "closings": F.flatten(F.transform("closings", terminality._slots)),
            "word": F.when(F.col("end").rlike(r"[\p{L}\p{N}_]\.\z"), terminality._slots(terminality.form(F.element_at(F.split("end", r"\s"), -1)))),
        }
    )
    told = told.select(*[f"id{i}" for i in range(len(ids))], "mark", "blank", "after", F.endswith("end", F.lit(_BROKEN)).alias("broken"), "closings", "word")
    by_closing = (
        F.when(F.col("blank"), False)
        .when(F.col("broken"), True)
        .when(F.col("after").isNotNull(), ~F.left("after", F.lit(1)).isin(*"\"'”’»"))
        .otherwise(opened("closings", "word"))
    )
    judged = told.withColumn("by_closing", by_closing).join(copies.select("mark", F.lit(True).alias("by_copy")), "mark", "left")
    by_copy = F.coalesce("by_copy", F.lit(False))
    return judged.select(*[F.col(f"id{i}").alias(c) for i, c in enumerate(ids)], (by_copy | F.col("by_closing")).alias("cut"), by_copy.alias("by_copy"), "by_closing")
