"""Language-model scores from a weighted backoff automaton, held as tables.

A state is an n-gram of the training texts below the highest order, the root
the empty one. It has an arc for every word seen after it and a failure arc to
its longest proper suffix. With c the training count, h a state, h' the state
of its failure arc and P(w) the add-one unigram share at the root:

    arc w of h:   (c(hw) + PRIOR * P(w | h')) / (c(h) + PRIOR)
    failure arc:  PRIOR / (c(h) + PRIOR)

so a word without an arc weighs the failure arcs passed times the first arc
met, and the weights of a state add up to 1. Every n-gram counts, however
rare, so an arc does not come or go with the size of the corpus.

A text is read from left to right. The state before a word is the longest
counted n-gram that ends there; since all parts of a counted n-gram are
counted, the counts of the n-grams at each place give it, the arc taken and
the failure arcs passed. No task needs the automaton, only those counts:

1. Texts are cut into slices by their running number of tokens, whatever their
   ids; a slice is one written row of packed tokens.
2. A slice asks for its distinct n-grams, with how often its training texts
   hold them: sorted keys, packed, a row for each shard of the key space.
3. A shard adds up the counts of each key over all slices and answers each
   slice in the order it asked. An n-gram is asked for once a slice, so a
   frequent one weighs no more than a rare one.
4. A slice meets its answers and weighs all its texts in one pass.

Tokens are words (runs of other than ASCII white space, A-Z lowered) and one
end. Words have 64-bit hashes; keys of longer n-grams have ``GUARD_BITS`` more
bits than it takes to number all tokens (64 at most), so that a key stands for
two n-grams once in 2 ** GUARD_BITS. A null text is empty: the end alone. A
null ``doc_id`` counts as the empty string in the split. Repeated rows are
counted and scored each. Other columns are not looked at; an empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.llm.common import hashed_words, in_slices, mixed, written

ORDER = 3
PRIOR = 64.0
GUARD_BITS = 20
#: Tokens of a slice (a longer text is a slice of its own), and n-grams that a shard is asked for.
SLICE_TOKENS, SHARD_KEYS = 2_000_000, 1_000_000
FOLDS, HELD_OUT_FOLD = 7, 2

_END = xxhash.xxh3_64_intdigest(b"")  # no word is empty
_PLACES = np.random.default_rng(55).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_SLICES = "slice long, tokens long, train long, ids array<long>, held array<boolean>, sizes array<int>, types binary, codes binary"
_ASKED = "slice long, level int, shard int, keys binary, counts binary"
_ANSWERED = "slice long, level int, shard int, counts binary, types long"


def fold(column: str = "doc_id", folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def packed(values: np.ndarray) -> bytes:
    """Whole numbers, byte place by byte place, compressed: leading zeros take next to nothing."""
    return zstandard.compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    places = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(places.T).view("<u8").ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """``packed`` differences of keys, which are small where the keys ascend."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def _slices(size: int):
    """Rows of ``_SLICES``: the texts of a task, cut where their tokens reach ``size``."""
    def made(number: int, parts: list) -> pa.RecordBatch:
        ids, held, sizes = (np.concatenate([p[i] for p in parts]) for i in range(3))
        null = np.concatenate([p[3] for p in parts])
        types, codes, counts = np.unique(np.concatenate([p[4] for p in parts]), return_inverse=True, return_counts=True)
        # Frequent words get small codes; among equally frequent ones hashes ascend.
        order = np.argsort(-counts, kind="stable")
        codes = np.argsort(order)[codes]
        train = int(sizes[~held].sum())
        lists = [pa.array([pa.array(ids, pa.int64(), mask=null).to_pylist()], pa.list_(pa.int64())), pa.array([held.tolist()], pa.list_(pa.bool_())), pa.array([sizes.tolist()], pa.list_(pa.int32()))]
        one = lambda v: pa.array([v], pa.int64())
        return pa.RecordBatch.from_arrays(
            [one((TaskContext.get().partitionId() << 32) + number), one(len(codes)), one(train), *lists, pa.array([packed_keys(types[order])], pa.binary()), pa.array([packed(codes)], pa.binary())],
            ["slice", "tokens", "train", "ids", "held", "sizes", "types", "codes"])

    def run(batches):
        parts, tokens, number = [], 0, 0
        for batch in in_slices(batches, 1024):
            offsets, words = hashed_words(batch.column("text"))
            ends = offsets[1:]
            words = np.insert(words, ends, np.uint64(_END))
            sizes = np.diff(offsets) + 1
            ids, held = batch.column("doc_id"), batch.column("held_out").to_numpy(zero_copy_only=False)
            null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            at = np.concatenate([[0], np.cumsum(sizes)])
            cut = lambda lo, hi: (ids[lo:hi], held[lo:hi], sizes[lo:hi].astype(np.int32), null[lo:hi], words[at[lo] : at[hi]])  # noqa: B023, E731
            lo = 0
            for i, own in enumerate(sizes.tolist()):
                if tokens and tokens + own > size:
                    if i > lo:
                        parts.append(cut(lo, i))
                    yield made(number, parts)
                    parts, tokens, number, lo = [], 0, number + 1, i
                tokens += own
            if len(sizes) > lo:
                parts.append(cut(lo, len(sizes)))
        if parts:
            yield made(number, parts)
    return run


class Slice:
    """The tokens of one slice, and its n-grams of every order by place."""

    def __init__(self, row: dict, bits: int) -> None:
        self.row = row
        self.sizes = np.array(row["sizes"], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.words = unpacked_keys(row["types"])[unpacked(row["codes"]).astype(np.int64)]
        self.inside = np.arange(len(self.words)) - np.repeat(self.starts, self.sizes)  # words before a place in its text
        self.train = np.repeat(~np.array(row["held"], bool), self.sizes)
        self.bits = bits

    def ngrams(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places where n-grams of the order end, their distinct keys, sorted, and each place's key."""
        at = np.flatnonzero(self.inside >= order - 1)
        if order == 1:
            keys = self.words
        else:
            sums = np.zeros(len(at), np.uint64)
            for j, factor in enumerate(_PLACES[:order] + np.uint64(2 * order)):
                sums += self.words[at - j] * factor
            keys = mixed(sums) >> np.uint64(64 - self.bits)
        keys, code = np.unique(keys, return_inverse=True)
        return at, keys, code


def shard_starts(shards: int, bits: int) -> np.ndarray:
    """First key of every shard but the first."""
    return np.array([-(-(i << bits) // shards) for i in range(1, shards)], np.uint64)


def _bits(order: int, bits: int) -> int:
    return 64 if order == 1 else bits


def _asked(orders: range, shards: int, bits: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                own = Slice(batch.slice(i, 1).to_pylist()[0], bits)
                for order in orders:
                    at, keys, code = own.ngrams(order)
                    counts = np.bincount(code[own.train[at]], minlength=len(keys)).astype(np.uint64)
                    cuts = np.concatenate([[0], np.searchsorted(keys, shard_starts(shards, _bits(order, bits))), [len(keys)]])
                    full = np.flatnonzero(np.diff(cuts))
                    n = len(full)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([own.row["slice"]] * n, pa.int64()), pa.array([order] * n, pa.int32()), pa.array(full, pa.int32()),
                         pa.array([packed_keys(keys[cuts[s] : cuts[s + 1]]) for s in full], pa.binary()),
                         pa.array([packed(counts[cuts[s] : cuts[s + 1]]) for s in full], pa.binary())], ["slice", "level", "shard", "keys", "counts"])
    return run


def _answered(rows: pa.Table) -> pa.Table:
    """The sums over all slices of one shard, for each slice in the order it asked; ``types``, once, how many keys were trained on."""
    keys = [unpacked_keys(k) for k in rows.column("keys").to_pylist()]
    ends = np.cumsum([len(k) for k in keys])
    code = np.unique(np.concatenate(keys), return_inverse=True)[1]
    total = np.zeros(code.max() + 1, np.int64)
    np.add.at(total, code, np.concatenate([unpacked(c) for c in rows.column("counts").to_pylist()]).astype(np.int64))
    counts = [packed(c) for c in np.split(total[code], ends[:-1])]
    types = [int((total > 0).sum())] + [0] * (rows.num_rows - 1)
    return pa.table({"slice": rows.column("slice"), "level": rows.column("level"), "shard": rows.column("shard"), "counts": pa.array(counts, pa.binary()), "types": pa.array(types, pa.int64())})


def weights(counts: list[np.ndarray], inside: np.ndarray, tokens: int, types: int, prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """log10 weight of every place of consecutive texts at the root alone, and by the automaton.

    ``counts`` has, by order, the training count of the n-gram that ends at
    each place (0 where the text is too short for one).
    """
    root = (counts[0] + 1) / (tokens + types + 1)
    share = root
    total = np.log10(root)
    for order in range(2, len(counts) + 1):
        c, state = counts[order - 1], np.roll(counts[order - 2], 1)
        live = (inside >= order - 1) & (state > 0)  # the n-gram before a place is a state
        arc = live & (c > 0)
        share = np.where(live, (c + prior * share) / (state + prior), share)
        total = np.where(arc, np.log10(share), np.where(live, total + np.log10(prior / (state + prior)), total))
    return np.log10(root), total


def _scored(bits: int, order: int, tokens: int, types: int, prior: float):
    def run(slices: pa.Table, answers: pa.Table) -> pa.Table:
        own = Slice(slices.to_pylist()[0], bits)
        answers = answers.sort_by([("level", "ascending"), ("shard", "ascending")])
        level = answers.column("level").to_numpy()
        counts = []
        for m in range(1, order + 1):
            at, _, code = own.ngrams(m)
            parts = answers.column("counts").filter(pa.array(level == m)).to_pylist()
            c = np.zeros(len(own.words))
            if parts:
                c[at] = np.concatenate([unpacked(p) for p in parts])[code]
            counts.append(c)
        base, score = weights(counts, own.inside, tokens, types, prior)
        n = len(own.sizes)
        by_text = lambda x, kind: pa.array(np.add.reduceat(x, own.starts), kind)
        return pa.table({
            "doc_id": pa.array(own.row["ids"], pa.int64()), "held_out": pa.array(own.row["held"], pa.bool_()), "n_tokens": pa.array(own.sizes),
            "n_known": by_text((counts[0] > 0).astype(np.int64), pa.int64()), "train_tokens": pa.array(np.full(n, tokens), pa.int64()),
            "base_score": by_text(base, pa.float64()), "score": by_text(score, pa.float64())})
    return run


def score(docs: DataFrame, order: int = ORDER, prior: float = PRIOR, slice_tokens: int = SLICE_TOKENS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per row of ``docs``: tokens, training counts, the add-one unigram
    ``base_score`` and the automaton's ``score`` (log10 probability of the text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == HELD_OUT_FOLD).alias("held_out"), F.col("text").cast("string").alias("text"))
    slices = written(rows.mapInArrow(_slices(slice_tokens), _SLICES), "lm-slices")
    every, tokens = slices.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("train"), F.lit(0))).first()
    bits = min(64, GUARD_BITS + (order * int(every) + 1).bit_length())
    shards = max(1, -(-int(every) // shard_keys))

    def answers(orders: range) -> DataFrame:
        asked = slices.mapInArrow(_asked(orders, shards, bits), _ASKED)
        return asked.groupBy("level", "shard").applyInArrow(_answered, _ANSWERED)

    words = written(answers(range(1, 2)), "lm-words")
    types = words.agg(F.coalesce(F.sum("types"), F.lit(0))).first()[0]
    found = words.unionByName(answers(range(2, order + 1))).select("slice", "level", "shard", "counts")
    return slices.groupBy("slice").cogroup(found.groupBy("slice")).applyInArrow(_scored(bits, order, int(tokens), int(types), prior), SCHEMA)
