"""Byte-level BPE as a monoid: texts are encoded in halves and joined at the seam.

An element is a span of text with its token ids. A leaf is a short span; two
neighbours join by re-encoding a window around the seam that grows outwards,
to the left and to the right, until it ends at a *cut*: a place between a
character that is no white space and a space or line feed. The pre-token
pattern lets white space stand only at the start of a pre-token that holds
anything else, so in every text a pre-token ends at a cut. Tokens never cross
pre-tokens, hence the ids outside the window are the ids of the whole text,
whatever stands on its other side. Where a side has no cut the window takes
all of it, so the join is then exact by being a plain encoding.

Decoding is the same tree with concatenation of bytes as the join.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tavola.llm.common import with_fields, without

#: Characters of a leaf. The result does not depend on it.
LEAF_CHARS = 2048

_CUT = re.compile(r"(?<=\S)(?=[ \n])")
_FIRST_WINDOW = 32


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str):
    """The tokenizer of a rank file, loaded once a Python worker."""
    import tiktoken

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _last_cut(text: str, lo: int, hi: int) -> int:
    """The last cut of text[lo:hi], found in windows that double; lo if there is none."""
    width = _FIRST_WINDOW
    while True:
        start = max(lo, hi - width)
        at = -1
        for found in _CUT.finditer(text, start, hi):
            if lo < found.start() < hi:
                at = found.start()
        if at >= 0 or start == lo:
            return at if at >= 0 else lo
        width *= 2


def _first_cut(text: str, lo: int, hi: int) -> int:
    """The first cut of text[lo:hi]; hi if there is none."""
    found = _CUT.search(text, lo + 1, hi) if lo + 1 < hi else None
    return found.start() if found and found.start() < hi else hi


def encode_tree(text: str, encode: Callable[[str], Sequence[int]], leaf_chars: int = LEAF_CHARS) -> list[int]:
    """Ids of ``text`` by recursive halving; equal to ``encode(text)``."""

    def element(lo: int, hi: int) -> list[int]:
        if hi - lo <= leaf_chars:
            return list(encode(text[lo:hi]))
        mid = (lo + hi) // 2
        return join(lo, mid, hi, element(lo, mid), element(mid, hi))

    def join(lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        start, end = _last_cut(text, lo, mid), _first_cut(text, mid, hi)
        keep = len(left) - len(encode(text[start:mid]))
        skip = len(encode(text[mid:end]))
        del left[keep:]
        left.extend(encode(text[start:end]))
        left.extend(right[skip:] if skip else right)
        return left

    return element(0, len(text))


def decode_tree(ids: Sequence[int], token_bytes: Callable[[int], bytes], leaf: int = 1024) -> bytes:
    """Bytes of ``ids``: leaves of single tokens, joined by concatenation up the tree."""
    if len(ids) <= leaf:
        return b"".join(map(token_bytes, ids))
    mid = len(ids) // 2
    return decode_tree(ids[:mid], token_bytes, leaf) + decode_tree(ids[mid:], token_bytes, leaf)


@lru_cache(maxsize=4)
def _vocabulary(ranks_path: str, pattern: str) -> list[bytes]:
    own = encoding(ranks_path, pattern)
    return [own.decode_single_token_bytes(i) for i in range(own.n_vocab)]



def _encoded(ranks_path: str, pattern: str, leaf_chars: int):
    def run(batches):
        encode = encoding(ranks_path, pattern).encode_ordinary
        for batch in batches:
            ids = [encode_tree(text or "", encode, leaf_chars) for text in batch.column("text").to_pylist()]
            yield _replaced(batch, {"ids": pa.array(ids, pa.list_(pa.int32()))})
    return run


def _decoded(ranks_path: str, pattern: str):
    def run(batches):
        token_bytes = _vocabulary(ranks_path, pattern).__getitem__
        for batch in batches:
            raw = [decode_tree(ids or [], token_bytes) for ids in batch.column("ids").to_pylist()]
            yield _replaced(batch, {"decoded": pa.array(raw, pa.binary())})
    return run


def _replaced(batch: pa.RecordBatch, made: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n not in made]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + list(made.values()), names + list(made))


def encode(docs: DataFrame, ranks_path: str, pattern: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``docs`` with a last column ``ids`` (array of int): the tokens of ``text``.

    A null text is empty and has no ids. An input column ``ids`` is replaced.
    """
    rows = without(docs, "ids").withColumn("text", F.col("text").cast("string"))
    schema = with_fields(rows.schema, T.StructField("ids", T.ArrayType(T.IntegerType())))
    return rows.mapInArrow(_encoded(ranks_path, pattern, leaf_chars), schema)


def decode(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``tokens`` with a last column ``decoded`` (binary): the bytes of ``ids`` (null: none)."""
    rows = without(tokens, "decoded")
    return rows.mapInArrow(_decoded(ranks_path, pattern), with_fields(rows.schema, T.StructField("decoded", T.BinaryType())))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Per row: doc_id, n_tokens, and SHA-256 of its ids (little-endian unsigned
    32-bit) and of the bytes they decode to, in one pass over the texts."""

    def run(batches):
        encode_one = encoding(ranks_path, pattern).encode_ordinary
        token_bytes = _vocabulary(ranks_path, pattern).__getitem__
        for batch in batches:
            count, ids_sha, raw_sha = [], [], []
            for text in batch.column("text").to_pylist():
                ids = encode_tree(text or "", encode_one, leaf_chars)
                count.append(len(ids))
                ids_sha.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                raw_sha.append(hashlib.sha256(decode_tree(ids, token_bytes)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
