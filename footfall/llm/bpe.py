"""Byte-level BPE: texts to token ids and back, with the ranks of a local file.

The ``tiktoken`` library does the merging. A long text is first cut where no match of the pattern
can reach across, so that the library's regex works on pieces of bounded size; the ids are the same
as those of the uncut text. Ids are decoded to raw bytes, as tokens may end inside a character.

Null and empty texts have no ids and decode to no bytes. Repeated rows are encoded each; other
columns of the input do not matter and are not returned, except the id column.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from footfall.llm.common import map_texts, raw_texts, show_package

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
PIECE = 1 << 16
# No alternative of the pattern has a letter or digit of ASCII before a blank or line end, and each
# may start there. What precedes the cut has no trailing blanks, so look-ahead at its end is as before.
SAFE = re.compile("(?<=[0-9A-Za-z])(?=[ \n])")


@lru_cache(maxsize=4)
def encoding(ranks: str, pattern: str) -> tiktoken.Encoding:
    """The file has a line for each token: base64 of its bytes, a blank, its id."""
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(i) for token, i in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def pieces(text: str, size: int = PIECE) -> list[str]:
    """The text in parts of at least ``size`` characters that are encoded apart with equal result."""
    parts, start = [], 0
    while len(text) - start > size:
        at = SAFE.search(text, start + size)
        if at is None:
            break
        parts.append(text[start : at.start()])
        start = at.start()
    parts.append(text[start:])
    return parts


def encode_text(text: str, coder: tiktoken.Encoding, size: int = PIECE) -> list[int]:
    if len(text) <= size:
        return coder.encode_ordinary(text)
    return [i for part in pieces(text, size) for i in coder.encode_ordinary(part)]


def encode(
    docs: DataFrame,
    ranks: str = RANKS,
    pattern: str = PATTERN,
    id_col: str = "doc_id",
    text_col: str = "text",
    decoded: bool = False,
) -> DataFrame:
    """``id``, ``ids array<int>`` and, if asked for, ``decoded binary``: the bytes the ids stand for."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = encoding(ranks, pattern)
        ids = [encode_text(text.decode(), coder) for text in raw_texts(batch.column("text"))]
        arrays = [batch.column("id"), pa.array(ids, pa.list_(pa.int32()))]
        if decoded:
            arrays.append(pa.array([coder.decode_bytes(i) for i in ids], pa.binary()))
        return pa.RecordBatch.from_arrays(arrays, ["id", "ids", "decoded"][: len(arrays)])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_texts(rows, run, f"id {kind}, ids array<int>" + ", decoded binary" * decoded, size=4_000_000)


def decode(tokens: DataFrame, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """The raw bytes of each row's ``ids``, in a column ``decoded`` after ``id``; null ids have none."""
    show_package(tokens)
    kind = tokens.schema["id"].dataType.simpleString()

    def run(batches):
        coder = encoding(ranks, pattern)
        for batch in batches:
            raw = [coder.decode_bytes(i or []) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(raw, pa.binary())], ["id", "decoded"])

    return tokens.select("id", "ids").mapInArrow(run, f"id {kind}, decoded binary")


def digests(docs: DataFrame) -> DataFrame:
    """Per document the number of tokens, and the SHA-256 of its ids as text and of the decoded bytes."""
    return encode(docs, decoded=True).select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
