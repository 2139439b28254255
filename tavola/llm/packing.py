"""Packing of tokenised documents by Karmarkar-Karp multiway differencing.

Each task packs the documents of its own input split, in groups of
``GROUP_WINDOWS`` windows, so no row is shuffled and a source holding a third
of all rows is spread like any other. A document of one window or more gives
full windows from its start; its rest is cut into pieces of at most
``PIECE_TOKENS`` tokens. The pieces of a group are then split over k windows:
every piece starts as a partial partition of k sums (itself and k - 1 zeros),
and the two partitions of the largest imbalance (largest sum less smallest)
are merged, largest sums onto smallest, until one is left. Its k sums are
nearly equal. k starts at the least number that could hold the tokens and
rises by one whenever a sum exceeds the window. Neighbouring pieces of one
document that meet in a window are put together again.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.llm.byte_bpe import encoding
from tavola.llm.common import in_bytes

WINDOW = 1024
PIECE_TOKENS = 256
GROUP_WINDOWS = 96
#: Bytes of text whose chunks are encoded together.
BATCH_BYTES = 1 << 22

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], k: int) -> np.ndarray:
    """The part, 0 to k - 1, of each size: k parts of nearly equal sums.

    A merge keeps only which slot of its two sides went to which of its own;
    the pieces are followed through those from the last merge down.
    """
    n = len(sizes)
    sums = [np.zeros(k, np.int64) for _ in range(n)]
    for own, size in zip(sums, sizes):
        own[-1] = size
    heap = [(-size, i) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        a = heapq.heappop(heap)[1]
        b = heap[0][1]
        both = sums[a] + sums[b][::-1]
        by = both.argsort(kind="stable")
        both = both[by]
        sums[a] = sums[b] = None
        heapq.heapreplace(heap, (int(both[0] - both[-1]), len(sums)))
        merges.append((a, b, by))
        sums.append(both)
    slots: dict[int, np.ndarray] = {len(sums) - 1: np.arange(k)}
    part = np.zeros(n, np.int64)
    for node in range(len(sums) - 1, -1, -1):
        own = slots.pop(node)
        if node < n:
            part[node] = own[-1]
            continue
        a, b, by = merges[node - n]
        left = np.empty(k, np.int64)
        left[by] = own
        slots[a], slots[b] = left, left[::-1]
    return part


def windows(sizes: list[int], window: int = WINDOW) -> list[list[int]]:
    """Indices in parts of at most ``window``; one more part is tried whenever a sum exceeds it."""
    if not sizes:
        return []
    k = max(1, -(-sum(sizes) // window))
    while True:
        part = difference(sizes, k)
        if np.bincount(part, weights=sizes, minlength=k).max() <= window:
            break
        k += 1
    order = np.argsort(part, kind="stable")
    ends = np.cumsum(np.bincount(part, minlength=k))
    return [order[x:y].tolist() for x, y in zip(np.concatenate([[0], ends[:-1]]), ends) if y > x]


#: White space as the pre-tokenizer sees it, before a space: there a space does not start a pre-token.
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_RUN, _ENDS_WHITE = _WHITE + " ", _WHITE + r"\z"


@lru_cache(maxsize=2)
def _token_lengths(ranks_path: str, pattern: str) -> np.ndarray:
    own = encoding(ranks_path, pattern)
    return np.array([len(own.decode_single_token_bytes(i)) for i in range(own.n_vocab)], np.int64)


def _chunk_ids(chunks: pa.Array, encode, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct chunks, and where each one's start and how many they are.

    Chunks that start with a space and end in no white space are encoded as
    one text: a pre-token ends between any two of them. Token lengths tell
    the ids apart again. Other chunks are encoded one by one.
    """
    plain = pc.and_not(pc.match_substring_regex(chunks, "^ (?s:.)"), pc.match_substring_regex(chunks, _ENDS_WHITE))
    joined = chunks.filter(plain)
    plain = plain.to_numpy(zero_copy_only=False)
    sizes = pc.binary_length(joined).to_numpy(zero_copy_only=False).astype(np.int64)
    text = str(memoryview(joined.buffers()[2])[: sizes.sum()], "utf-8") if len(joined) else ""
    ids = np.array(encode(text), np.uint32)
    stops = np.searchsorted(np.cumsum(lengths[ids]), np.cumsum(sizes)) + 1
    counts = np.zeros(len(chunks), np.int64)
    counts[plain] = np.diff(stops, prepend=0)
    others = [np.array(encode(x), np.uint32) for x in chunks.filter(pa.array(~plain)).to_pylist()]
    counts[~plain] = [len(x) for x in others]
    # Plain chunks come first in the flat ids; the caller gets offsets, not an order.
    starts = np.zeros(len(chunks), np.int64)
    starts[plain] = stops - counts[plain]
    starts[~plain] = len(ids) + np.cumsum(counts[~plain]) - counts[~plain]
    return np.concatenate([ids, *others]), np.stack([starts, counts])


def added_tokens(tokenizer_path: str) -> dict[str, int]:
    """The tokens that a tokenizer file adds to its vocabulary, which it finds in any text."""
    with open(tokenizer_path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


def with_added(texts: pa.Array, ranks_path: str, pattern: str, added: dict[str, int]) -> list[np.ndarray]:
    """The ids of every text, in which each of the ``added`` tokens has its own id; what is between them is encoded apart."""
    if not added:
        return batch_ids(texts, ranks_path, pattern)
    any_of = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")")
    has = pc.fill_null(pc.match_substring_regex(texts.cast(pa.large_string()), any_of.pattern), False).to_numpy(zero_copy_only=False)
    out: list[np.ndarray | None] = [None] * len(texts)
    for i, ids in zip(np.flatnonzero(~has), batch_ids(texts.filter(pa.array(~has)), ranks_path, pattern)):
        out[i] = ids
    for i in np.flatnonzero(has):
        parts = any_of.split(texts[i].as_py())
        plain = batch_ids(pa.array(parts[::2], texts.type), ranks_path, pattern)
        marks = [np.array([added[t]], np.uint32) for t in parts[1::2]] + [np.zeros(0, np.uint32)]
        out[i] = np.concatenate([x for pair in zip(plain, marks) for x in pair])
    return out


def batch_ids(texts: pa.Array, ranks_path: str, pattern: str) -> list[np.ndarray]:
    """The ids of every text; each distinct space-delimited chunk of the batch is encoded once.

    The byte-level pre-tokenizer always ends a pre-token between a character
    that is no white space and a space, so ids of the chunks between such
    places are the ids of the whole. Texts with white space before a space
    are encoded whole. A null text has no ids.
    """
    encode, lengths = encoding(ranks_path, pattern).encode_ordinary, _token_lengths(ranks_path, pattern)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    odd = pc.match_substring_regex(texts, _RUN).to_numpy(zero_copy_only=False)
    out: list[np.ndarray | None] = [None] * len(texts)
    for i in np.flatnonzero(odd):
        out[i] = np.array(encode(texts[i].as_py()), np.uint32)
    even = np.flatnonzero(~odd)
    lists = pc.split_pattern(texts.take(pa.array(even)), " ")
    offsets = lists.offsets.to_numpy()
    pieces = lists.flatten()
    first = np.zeros(len(pieces), bool)
    first[offsets[:-1]] = True
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pieces, pa.scalar("", pa.large_string()))
    coded = pc.if_else(pa.array(first), pieces, spaced).dictionary_encode()
    flat, (starts, counts) = _chunk_ids(coded.dictionary, encode, lengths)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    for i, x, y in zip(even, offsets[:-1], offsets[1:]):
        own = codes[x:y]
        n = counts[own]
        ends = np.cumsum(n)
        out[i] = flat[np.repeat(starts[own] - ends + n, n) + np.arange(ends[-1])]
    return out


class _Packer:
    """Rows of one task: full windows as they come, the rest in groups."""

    def __init__(self, first_id: int, window: int, piece: int, group_windows: int) -> None:
        self.next_id, self.window, self.piece, self.room = first_id, window, piece, group_windows * window
        self.rows: list[tuple] = []
        self.rest: list[tuple] = []
        self.held = 0

    def add(self, doc_id: int | None, raw: bytes) -> None:
        total = len(raw) // 4
        at = 0
        while total - at >= self.window:
            self._row(doc_id, at, raw[4 * at : 4 * (at + self.window)], total, 0)
            self.next_id += 1
            at += self.window
        while at < total:
            end = min(total, at + self.piece)
            self.rest.append((doc_id, at, raw[4 * at : 4 * end], total))
            self.held += end - at
            at = end
        if self.held >= self.room:
            self.flush()

    def _row(self, doc_id, start, raw, total, offset) -> None:
        self.rows.append((doc_id, start, len(raw) // 4, zlib.crc32(raw), total, self.next_id, offset))

    def flush(self) -> None:
        for part in windows([len(x[2]) // 4 for x in self.rest], self.window):
            offset, joined = 0, []
            last = None
            for i in sorted(part):
                doc_id, start, raw, total = self.rest[i]
                if last == i - 1 and joined[-1][3] == total and start and joined[-1][0] == doc_id and joined[-1][1] + len(joined[-1][2]) // 4 == start:
                    joined[-1] = (doc_id, joined[-1][1], joined[-1][2] + raw, total)
                else:
                    joined.append((doc_id, start, raw, total))
                last = i
            for doc_id, start, raw, total in joined:
                self._row(doc_id, start, raw, total, offset)
                offset += len(raw) // 4
            self.next_id += 1
        self.rest, self.held = [], 0

    def take(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [[]] * 7
        out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in SCHEMA.split(", ")])
        self.rows = []
        return out


def pack(docs: DataFrame, ranks_path: str, pattern: str, end_id: int = 0, window: int = WINDOW,
         piece_tokens: int = PIECE_TOKENS, group_windows: int = GROUP_WINDOWS, added: dict[str, int] | None = None) -> DataFrame:
    """One row per piece of a document: where it comes from and where it lies.

    ``start`` and ``length`` place it in its document's ``doc_tokens`` ids
    (``end_id`` closes each), ``sequence_id`` and ``offset`` in its window.
    ``added`` tokens (see ``added_tokens``) have their own ids wherever they stand.
    A null or empty text is the end id alone; a null ``doc_id`` stays null;
    repeated rows are packed each. Sequence ids are unique, not dense. A lost
    task is repeated over the same split and gives the same rows.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        packer = _Packer(TaskContext.get().partitionId() << 40, window, piece_tokens, group_windows)
        for some in in_bytes(batches, BATCH_BYTES):
            for doc_id, ids in zip(some.column("doc_id").to_pylist(), with_added(some.column("text"), ranks_path, pattern, added or {})):
                packer.add(doc_id, ids.astype("<u4", copy=False).tobytes() + end)
            yield packer.take()
        packer.flush()
        yield packer.take()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
