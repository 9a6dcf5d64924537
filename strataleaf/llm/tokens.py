"""Encoding of a whole corpus with a public tokenizer, and decoding."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts are handed to the tokenizer in groups of about so many characters, so that its results stay small.
GROUP_CHARS = 1 << 20


def default_path() -> str:
    """The vocabulary of byte_bpe_50k, where the tokenizers' package is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    return found


@lru_cache(1)
def bytes_of_characters() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for.

    Bytes that print as a character of Latin-1 stand for themselves; the others follow from U+0100 on.
    """
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printing)]
    return {chr(b): b for b in printing} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each token by its id; a special token has those of its own name."""
    table, vocabulary = bytes_of_characters(), tokenizer(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    return out


def spans(text: str, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of tokens of these numbers of bytes: where each begins and ends in bytes, and in characters."""
    ends = np.cumsum(np.asarray(sizes, "int64"))
    starts = ends - sizes
    # the character that each byte belongs to: all but the continuing bytes begin one
    character = np.cumsum((np.frombuffer(text.encode("utf-8", "replace"), "uint8") & 0xC0) != 0x80) - 1
    if not len(ends):
        return starts, ends, starts, ends
    return starts, ends, character[starts], character[ends - 1] + 1


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def encoded(rows: DataFrame, ids: list[str], text: Column, path: str | None = None, offsets: bool = False) -> DataFrame:
    """``ids..., ids ARRAY<INT>`` and, if asked for, ``starts, ends, first_chars, end_chars ARRAY<INT>``: where each token
    begins and ends in bytes of UTF-8, the character in which it begins, and the one after that in which it ends. Tokens that
    split a character share it.

    No special tokens are added. A null and an empty text give empty lists. Whole texts are encoded, of any length;
    the bytes of a token may be part of a character. Repeated rows stay repeated; other columns play no part.

    Scale: one pass without a shuffle, in Arrow batches; each worker reads the vocabulary at ``path`` once.
    """
    path = path or default_path()
    told_names = ["starts", "ends", "first_chars", "end_chars"] if offsets else []
    kept = rows.select(*[F.col(f"`{c}`").alias(f"id{i}") for i, c in enumerate(ids)], text.cast("string").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sizes = tokenizer(path), token_bytes(path)
        for batch in batches:
            lists: list = []
            told: list[list] = [[] for _ in told_names]
            for group in _groups([t or "" for t in batch.column("text").to_pylist()]):
                for text, done in zip(group, own.encode_batch(group, add_special_tokens=False)):
                    lists.append(done.ids)
                    if offsets:
                        for column, found in zip(told, spans(text, [len(sizes[i]) for i in done.ids])):
                            column.append(found)
            kind = pa.list_(pa.int32())
            columns = [*batch.columns[:-1], pa.array(lists, kind), *(pa.array(x, kind) for x in told)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "tokens", *told_names])

    kinds = ", ".join(f"id{i} {rows.schema[c].dataType.simpleString()}" for i, c in enumerate(ids))
    schema = f"{kinds}, tokens array<int>" + "".join(f", {n} array<int>" for n in told_names)
    return kept.mapInArrow(encode, schema).select(
        *[F.col(f"id{i}").alias(c) for i, c in enumerate(ids)], F.col("tokens").alias("ids"), *told_names
    )


def decoded(rows: DataFrame, ids: list[str], tokens: Column, path: str | None = None) -> DataFrame:
    """``ids..., text``: the text of each list of token ids.

    The bytes of all tokens are joined before they are read as UTF-8, so that characters split between tokens come out
    whole; bytes that are no UTF-8, as in a part of a list, come out as U+FFFD. An empty or null list gives an empty
    text. An id outside the vocabulary is an error.
    """
    path = path or default_path()
    kept = rows.select(*[F.col(f"`{c}`").alias(f"id{i}") for i, c in enumerate(ids)], tokens.alias("tokens"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in batches:
            texts = [b"".join([table[i] for i in t or ()]).decode("utf-8", "replace") for t in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])

    kinds = ", ".join(f"id{i} {rows.schema[c].dataType.simpleString()}" for i, c in enumerate(ids))
    return kept.mapInArrow(decode, f"{kinds}, text string").select(*[F.col(f"id{i}").alias(c) for i, c in enumerate(ids)], "text")
