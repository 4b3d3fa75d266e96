"""Problem 7: a whole corpus encoded with a public tokenizer.

Texts go to the tokenizers library in Arrow batches, whole and in slices of bounded size in
characters. Decoding needs no library: the byte table of byte-level vocabularies is reversed, and
characters whose bytes are split between tokens are put together again.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters given to the tokenizer in one call, about.
SLICE = 200_000


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed vocabulary files are."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a vocabulary file, once for each worker process, on one thread. Strings
    of special tokens in a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=1)
def byte_table() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1
    characters stand for themselves, the other bytes for those from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id."""
    t, table = tokenizer(path), byte_table()
    vocab = t.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values(), default=-1) + 1)
    for token, i in vocab.items():
        out[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    return out


def decode(ids: list[int], path: str) -> str:
    """The text of the ids. Bytes that form no character, as in a cut list, become U+FFFD."""
    known = token_bytes(path)
    return b"".join(known[i] for i in ids).decode("utf-8", "replace")


def _encodings(texts: list[str | None], path: str, offsets: bool) -> Iterator[object]:
    t = tokenizer(path)
    call = t.encode_batch if offsets else getattr(t, "encode_batch_fast", t.encode_batch)
    part: list[str] = []
    size = 0
    for text in texts:
        text = (text or "").encode("utf-8", "replace").decode("utf-8")
        part.append(text)
        size += len(text)
        if size >= SLICE:
            yield from call(part, add_special_tokens=False)
            part, size = [], 0
    if part:
        yield from call(part, add_special_tokens=False)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each text, without special tokens. Null and empty texts have an
    empty list; an empty table gives no rows; repeated rows are each encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pa.array([e.ids for e in _encodings(b.column("text").to_pylist(), path, False)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], names=["doc_id", "ids"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(df: DataFrame, path: str, *carry: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, *carry, tokens): the number of ids of each text, 0 for null and empty ones."""
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("__text"), *carry)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "__text") + ", tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([len(e) for e in _encodings(b.column("__text").to_pylist(), path, False)], pa.int64())
            names = ["doc_id", *carry]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), n], names=[*names, "tokens"])

    return src.mapInArrow(run, ddl)


def offsets(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, starts, ends): for each id the characters of the text it covers, from starts up to
    before ends. Ids that share a split character cover the same one. Lists as in `encode`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [e.offsets for e in _encodings(b.column("text").to_pylist(), path, True)]
            cols = [pa.array([[x[k] for x in o] for o in got], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "starts", "ends"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, starts array<int>, ends array<int>")


def decoded(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids). A null or empty list gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([decode(ids or [], path) for ids in b.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), texts], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
