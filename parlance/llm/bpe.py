"""Byte-level BPE with tiktoken: ranks from a local file, safe cuts of long texts, raw-byte decoding.

A boundary between a character that is no white space and one that is always lies between two
matches of the pattern, and no match looks past it. Long texts are cut at such boundaries, so each
cut is encoded on its own, with bounded memory, and the ids are those of the whole text. A run
without any such boundary stays whole; its pieces come from the ``regex`` module one at a time,
which no run is too long for.

Defined results: null and empty texts have no ids; repeated rows are encoded each; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from parlance.llm.common import batch_of, rows_of, table
from parlance.llm.registry import register

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters per cut, and the longest run that goes to tiktoken's own splitter.
CUT, RUN = 32_768, 262_144
_EDGE = regex.compile(r"(?<=\S)(?=\s)")
_PIECE = regex.compile(public_tokenizers.PATTERN)


@functools.cache
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def cuts(text: str, size: int = CUT) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters that end at safe boundaries."""
    start = 0
    while len(text) - start > size:
        edge = _EDGE.search(text, start + size)
        if edge is None:
            break
        yield text[start : edge.start()]
        start = edge.start()
    yield text[start:]


def encode(enc: tiktoken.Encoding, text: str) -> list[int]:
    """The ids of a whole text, as ``encode_ordinary`` gives them."""
    if len(text) <= CUT:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part in cuts(text):
        if len(part) <= RUN:
            ids += enc.encode_ordinary(part)
        else:
            for piece in _PIECE.finditer(part):
                ids += enc._encode_single_piece(piece.group())
    return ids


def encode_documents(docs: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>) of every row of ``docs``."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches):
        enc = encoding(path)
        for batch in batches:
            ids = [encode(enc, t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """(key, bytes binary): the bytes behind the ids, which need not be whole characters."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches):
        enc = encoding(path)
        for batch in batches:
            out = [enc.decode_bytes(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[key, "bytes"])

    return encoded.select(key, "ids").mapInArrow(run, f"{key} {dict(encoded.dtypes)[key]}, bytes binary")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode in one pass, keeping counts and digests only."""
    path = path or public_tokenizers.path(RANKS)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        enc = encoding(path)
        for keys, texts in rows_of(batches, "doc_id", "text"):
            n, of_ids, of_bytes = [], [], []
            for text in texts:
                ids = encode(enc, text or "")
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield batch_of(schema, [keys, n, of_ids, of_bytes])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@register("op5_byte_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
