"""Held-out test items that turn up, whole or in part and altered, in a corpus.

Latent semantic retrieval: overlapping passages of all documents and the items are TF-IDF vectors over the items' words
and word pairs (terms that no item has can't add to a cosine). A distributed randomised SVD, with oversampling and a power
step, gives the subspace in which they are compared. Passages whose cosine to an item is high enough are candidates; a
longest common subsequence of words within one place of the document decides, and whether the item's answer is there too
is told.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataleaf.llm import lookalikes
from strataleaf.session import written

#: Words of a passage and words from one passage to the next.
PASSAGE, STRIDE = 96, 48
#: Dimensions of the latent space, and the weight of all items in it as a part of all passages.
RANK, ITEM_WEIGHT = 72, 0.3
#: Dimensions beyond these that the randomised SVD works with.
OVERSAMPLING = 12
#: The least cosine of a candidate.
COSINE = 0.35
#: Passages that are multiplied at once: few enough for their rows to stay in the processor's cache.
BLOCK = 200
#: The length of one place in the document, as a multiple of the item's words.
PLACE = 1.4
_WORD = re.compile(r"\w+")


@lru_cache(1)
def _one_form() -> lookalikes.Rewriter:
    return lookalikes.Rewriter(*lookalikes.representatives({}))


def words(text: str | None) -> list[str]:
    """The words of a text, in one form of their characters and without case; none of null."""
    if not text:
        return []
    return _WORD.findall(_one_form().one(text).casefold())


class Items:
    """The items: their words, terms and columns. They are a stated set of queries, held by every worker."""

    def __init__(self, ids: list, texts: list[str | None], answers: list[str | None]) -> None:
        self.ids, self.words, self.answers = ids, [words(t) for t in texts], [" ".join(words(a)) for a in answers]
        self.column: dict[str, int] = {}
        for w in self.words:
            for x in [*w, *(a + " " + b for a, b in zip(w, w[1:]))]:
                self.column.setdefault(x, len(self.column))

    def passages(self, w: list[str]) -> Iterator[tuple[int, list[int]]]:
        """(place of its first word, the columns of its terms, as often as they are there) of each passage that has any."""
        get = self.column.get
        ones = [get(x) for x in w]
        # a pair of words is only looked up where both are words of items
        pairs = [None if i is None or j is None else get(x + " " + y) for i, j, x, y in zip(ones, ones[1:], w, w[1:])]
        for a in range(0, max(1, len(w) - STRIDE), STRIDE):
            own = [c for c in (*ones[a : a + PASSAGE], *pairs[a : a + PASSAGE - 1]) if c is not None]
            if own:
                yield a, own


class Rows:
    """Some passages as rows of a sparse matrix of unit vectors: TF-IDF, with the logarithm of a term's count."""

    def __init__(self, columns: np.ndarray, sizes: np.ndarray, idf: np.ndarray) -> None:
        terms = len(idf)
        row = np.repeat(np.arange(len(sizes)), sizes)
        cells, counts = np.unique(row * terms + columns, return_counts=True)
        self.row, self.column = cells // terms, cells % terms
        self.starts = np.searchsorted(self.row, np.arange(len(sizes)))
        value = idf[self.column] * (1 + np.log(counts))
        norm = np.sqrt(np.add.reduceat(value * value, self.starts))
        norm[norm == 0] = 1
        self.value = (value / norm[self.row]).astype("float32")

    def times(self, dense: np.ndarray) -> np.ndarray:
        return np.add.reduceat(dense[self.column] * self.value[:, None], self.starts)

    def transposed_times(self, dense: np.ndarray, into: np.ndarray) -> None:
        order = np.argsort(self.column, kind="stable")
        column = self.column[order]
        first = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
        into[column[first]] += np.add.reduceat(dense[self.row[order]] * self.value[order, None], first)


def passage_table(texts: DataFrame, items: Broadcast) -> DataFrame:
    """``mark, at, columns`` of every passage, of a table ``mark, text``: the corpus is read as words once, and written."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, places, columns = [], [], []
            for mark, text in zip(batch.column("mark").to_pylist(), batch.column("text").to_pylist()):
                for at, own in items.value.passages(words(text)):
                    marks.append(mark)
                    places.append(at)
                    columns.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.binary()), pa.array(places, pa.int32()), pa.array(columns, pa.list_(pa.int32()))], ["mark", "at", "columns"])

    return written(texts.mapInArrow(split, "mark binary, at int, columns array<int>"))


def _blocks(column: pa.ListArray, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first passage, columns, numbers of columns) of blocks of an Arrow column of lists."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy()
    for a in range(0, len(column), size):
        bounds = offsets[a : a + size + 1]
        yield a, values[bounds[0] : bounds[-1]], np.diff(bounds)


def _item_rows(items: Items, idf: np.ndarray) -> tuple[list[int], Rows | None]:
    columns = [[c for _, own in items.passages(w) for c in own] for w in items.words]
    kept = [i for i, c in enumerate(columns) if c]
    if not kept:
        return kept, None
    return kept, Rows(np.concatenate([np.asarray(columns[i]) for i in kept]), np.array([len(columns[i]) for i in kept]), idf)


def frequencies(passages: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many passages each term is, and how many there are. By built-in expressions; ``size`` rows reach the driver."""
    counts = np.zeros(size, "int64")
    got = passages.select(F.explode(F.array_distinct("columns")).alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("n")).toPandas()
    counts[got["at"]] = got["n"]
    return counts, passages.count()


def latent_space(passages: DataFrame, items: Items, rank: int = RANK, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The inverse document frequencies and an orthonormal basis (terms x rank) of the passages' and items' row space.

    A randomised SVD of all passages: the matrix and its transpose are applied to a random block with oversampling, and to
    the block that comes of it (the power step); of the small matrix in that block's space the greatest singular directions
    are kept. Each of the two is one pass; only sums as large as the items' terms reach the driver.
    """
    size = len(items.column)
    counts, n = frequencies(passages, size)
    idf = np.log((2.0 + n) / (1.0 + counts)).astype("float32")
    kept, own_rows = _item_rows(items, idf)
    slab = 256

    def applied(block: np.ndarray) -> np.ndarray:
        """The matrix's transpose times the matrix times ``block``."""
        weights = passages.sparkSession.sparkContext.broadcast((idf, block))

        def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf, block = weights.value
            sums = np.zeros(block.shape, "float32")
            for batch in batches:
                for _, columns, sizes in _blocks(batch.column("columns")):
                    rows = Rows(columns, sizes, idf)
                    rows.transposed_times(rows.times(block), sums)
            slabs = range(0, size, slab)
            yield pa.RecordBatch.from_arrays([pa.array(list(slabs), pa.int64()), pa.array([sums[a : a + slab].tobytes() for a in slabs], pa.binary())], ["at", "sums"])

        def summed(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(len(part["sums"].iloc[0]) // 4, "float32")
            for x in part["sums"]:
                total += np.frombuffer(x, "float32")
            return pd.DataFrame({"at": [key[0]], "sums": [total.tobytes()]})

        parts = passages.select("columns").mapInArrow(gathered, "at bigint, sums binary").groupBy("at").applyInPandas(summed, "at bigint, sums binary").toPandas()
        weights.unpersist()
        sums = np.zeros(block.shape, "float32")
        for at, x in zip(parts["at"], parts["sums"]):
            sums[at : at + slab] += np.frombuffer(x, "float32").reshape(-1, block.shape[1])
        if own_rows is not None:  # the items' own directions, at a fixed part of the corpus's weight, whatever its size
            own = np.zeros_like(sums)
            own_rows.transposed_times(own_rows.times(block), own)
            sums += own * np.float32(ITEM_WEIGHT * max(1, n) / len(kept))
        return sums.astype("float64")

    width = min(rank + OVERSAMPLING, size)
    block = np.random.default_rng(seed).standard_normal((size, width)).astype("float32")
    first = np.linalg.qr(applied(block))[0]
    second = applied(first.astype("float32"))
    small = first.T @ second  # the matrix's squared singular values are this one's eigenvalues
    _, directions = np.linalg.eigh((small + small.T) / 2)
    basis, _ = np.linalg.qr(second @ directions[:, ::-1][:, : min(rank, size)])
    return idf, basis.astype("float32")


def common_words(item: list[str], place: list[str]) -> int:
    """The length of the longest common subsequence, bit-parallel over the item's words."""
    at: dict[str, int] = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << i
    every = (1 << len(item)) - 1
    free = every
    for w in place:
        if m := at.get(w):
            u = free & m
            free = ((free + u) | (free - u)) & every
    return len(item) - free.bit_count()


def best_place(item: list[str], text: list[str], begin: int, end: int) -> tuple[int, int]:
    """The most words of the item, in order, that one place of ``text[begin:end]`` holds, and where it begins."""
    span, best = int(len(item) * PLACE) + 1, (0, begin)
    for a in range(begin, max(begin + 1, end - span + len(item) // 8 + 1), max(1, len(item) // 8)):
        best = max(best, (common_words(item, text[a : min(end, a + span)]), a), key=lambda x: x[0])
    return best


def leaked(documents: DataFrame, doc_id: str, text: Column, items: DataFrame, item_id: str, item_text: str, answer: str | None = None, least: float = 0.5) -> DataFrame:
    """``doc_id, item_id, coverage, at_word, holds_answer``: each item that leaked into each document.

    A document holds an item if one place of it has at least ``least`` of the item's words in their order; layout, case,
    punctuation and look-alike characters make no difference. ``coverage`` is the part held, ``at_word`` the number of
    the word where the place begins, ``holds_answer`` whether the answer's words stand in the document too (null without
    an answer). Null and empty texts, and items without words, leak nowhere. Copies and repeated rows count each.

    Scale: the documents are read as words once, into a written table of passages that all later passes read; none of
    them depends on how the items are grouped. The items are a stated set of queries, held against all passages in blocks.
    Texts are joined only to the candidates, by their hash; equal texts share theirs. Long texts are read whole.
    """
    columns = [item_id, item_text, *([answer] if answer else [])]
    rows = items.select(*columns).where(F.col(item_text).isNotNull()).dropDuplicates([item_id]).orderBy(item_id).collect()  # the stated queries
    own = Items([r[0] for r in rows], [r[1] for r in rows], [r[2] if answer else None for r in rows])
    kinds = f"doc_id {documents.schema[doc_id].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}, coverage double, at_word int, holds_answer boolean"
    spark = documents.sparkSession
    if not own.column:
        return spark.createDataFrame([], kinds)
    texts = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), text.alias("text")).where("text IS NOT NULL").withColumn("mark", F.unhex(F.md5("text")))
    shared = spark.sparkContext.broadcast(own)
    passages = passage_table(texts.select("mark", "text"), shared)
    space = spark.sparkContext.broadcast(latent_space(passages, own))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, basis = space.value
        kept, rows = _item_rows(shared.value, idf)
        queries = rows.times(basis)
        queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-12)
        for batch in batches:
            found, which = [], []
            for a, columns, sizes in _blocks(batch.column("columns")):
                near = Rows(columns, sizes, idf).times(basis)
                near /= np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-12)
                for lo in range(0, len(queries), 2000):
                    p, q = np.nonzero(near @ queries[lo : lo + 2000].T >= COSINE)
                    found.append(p + a)
                    which.append(q + lo)
            at = np.concatenate([*found, np.zeros(0, "int64")]).astype("int64")
            item = np.asarray(kept)[np.concatenate([*which, np.zeros(0, "int64")]).astype("int64")]
            yield pa.RecordBatch.from_arrays([batch.column("mark").take(pa.array(at)), pa.array(item.astype("int32")), batch.column("at").take(pa.array(at))], ["mark", "item", "at"])

    near = passages.mapInArrow(search, "mark binary, item int, at int")
    # one row for each text: as many pairs as there are items at most
    candidates = written(
        near.groupBy("mark", "item").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).groupBy("mark").agg(F.collect_list(F.struct("item", "lo", "hi")).alias("near"))
    )

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = shared.value
        for batch in batches:
            out: list[tuple] = []
            for doc, text, near in zip(batch["doc_id"], batch["text"], batch["near"]):
                w = words(text)
                for pair in near:
                    q, item = pair["item"], items.words[pair["item"]]
                    n = len(item)
                    begin, end = max(0, pair["lo"] - n), min(len(w), pair["hi"] + PASSAGE + n)
                    if common_words(item, w[begin:end]) < least * n:
                        continue  # no place of it has more
                    got, where = best_place(item, w, begin, end)
                    if got >= least * n:
                        answer = items.answers[q]
                        out.append((doc, items.ids[q], got / n, where, f" {answer} " in f" {' '.join(w)} " if answer else None))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "coverage", "at_word", "holds_answer"])

    return texts.join(candidates, "mark").select("doc_id", "text", "near").mapInPandas(decide, kinds)
