"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

A rotation is learned on a bounded sample (PCA, then iterative quantisation),
and the signs of the rotated, centred vectors are the codes. A code is split
into substrings of 8 bits; each substring has its own index, the rows ordered
by its value. By the pigeonhole principle a code within Hamming radius r of
the query's is within r // m in one of the m substrings at least, so probing
every substring value within that distance retrieves every code within r.
What is retrieved is filtered by the whole code and ranked by the exact
distance of the original vectors. The radius is the least that holds the
nearest neighbours of sampled queries for ``RECALL`` of them, measured by
brute force within the sample; fewer rows mean farther neighbours, so it errs
on the wide side. A query that retrieves fewer than k rows of a block is
ranked over that whole block, so results are never short.

Rows and queries meet in blocks on the executors (see ``vector_blocks``): a
block's substring indexes are built once and probed by every query, and the
best k of all blocks remain.

Vectors that are null, zero, or hold null or non-finite components take no
part. Vectors of another length than the sample's take no part either.
Repeated rows are rows of their own; a query's own row is known by its id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.llm.vector_blocks import BLOCK_ROWS, met, searched, top_k, vectors_of

SAMPLE_ROWS = 4096
SAMPLE_QUERIES = 256
RECALL = 0.985
BITS = 8
_SCHEMA = "query_id long, vec_id long, score double"


def usable(column: str = "embedding") -> Column:
    """True for vectors that take part."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(column, lambda x: x.cast("double") != 0)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long vectors in double precision."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def learn_rotation(sample: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rotation (dim x bits) by PCA and iterative quantisation; bits is dim rounded up to whole substrings."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    dim = sample.shape[1]
    bits = -(-dim // BITS) * BITS
    _, _, axes = np.linalg.svd(centred, full_matrices=True)
    rng = np.random.default_rng(7)
    base = axes[:dim].T if bits == dim else np.hstack([axes[:dim].T, rng.standard_normal((dim, bits - dim)) / np.sqrt(dim)])
    reduced = centred @ base
    turn, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(reduced @ turn >= 0, 1.0, -1.0).T @ reduced)
        turn = (u @ v).T
    return mean, base @ turn


def codes(vectors: np.ndarray, mean: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Rows of substrings, one byte each."""
    return np.packbits((vectors - mean) @ rotation >= 0, axis=1)


_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_DISTANCE = _ONES[np.arange(256)[:, None] ^ np.arange(256)[None, :]]


class SubstringIndex:
    """Rows ordered by each substring's value, with where every value starts."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows
        self.order = [np.argsort(rows[:, j], kind="stable") for j in range(rows.shape[1])]
        self.starts = [np.searchsorted(rows[o, j], np.arange(257)) for j, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code lies within ``radius`` of ``code``."""
        hit = np.zeros(len(self.rows), bool)
        reach = radius // len(code)
        for j, value in enumerate(code):
            for probe in np.flatnonzero(_DISTANCE[value] <= reach):
                hit[self.order[j][self.starts[j][probe] : self.starts[j][probe + 1]]] = True
        at = np.flatnonzero(hit)
        return at[_ONES[self.rows[at] ^ code].sum(axis=1, dtype=np.int64) <= radius]


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    d = vectors - query
    return np.sqrt((d * d).sum(axis=1))


def choose_radius(sample: np.ndarray, coded: np.ndarray, k: int, recall: float = RECALL) -> int:
    """The least Hamming radius that holds ``recall`` of the sample's k nearest neighbours."""
    own = np.arange(len(sample))[:: max(1, len(sample) // SAMPLE_QUERIES)]
    far = []
    for i in own:
        d = distances(sample, sample[i])
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
        far.append(_ONES[coded[near] ^ coded[i]].sum(axis=1, dtype=np.int64))
    far = np.sort(np.concatenate(far)) if far else np.zeros(0, np.int64)
    return int(far[min(len(far) - 1, int(np.ceil(recall * len(far))))]) if len(far) else 8 * coded.shape[1]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest, ties to the smaller id."""
    if len(ids) > 4 * k:
        near = np.flatnonzero(scores <= np.partition(scores, k - 1)[k - 1])
    else:
        near = np.arange(len(ids))
    return near[np.lexsort((ids[near], scores[near]))[:k]]


class Block:
    """The rows of a block, their codes' substring indexes, and the queries' distances."""

    def __init__(self, rows: pa.Table, model: dict) -> None:
        self.model, self.ids, self.vectors = model, rows.column("vec_id").to_numpy(), matrix(rows.column("embedding").combine_chunks())
        self.index = SubstringIndex(codes(self.vectors, model["mean"], model["rotation"]))

    def best(self, query_id: int, query: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        at = self.index.within(code, self.model["radius"])
        at = at[self.ids[at] != query_id]
        if len(at) < k:
            at = np.flatnonzero(self.ids != query_id)
        score = distances(self.vectors[at], query)
        best = _best(self.ids[at], score, k)
        return self.ids[at][best], score[best]


def _searched(shared, k: int):
    def run(batches):
        model = shared.value
        for block, asked in searched(batches, lambda rows: Block(rows, model)):
            queries = matrix(asked.column("embedding"))
            found = [block.best(i, q, c, k) for i, q, c in zip(asked.column("vec_id").to_numpy(), queries, codes(queries, model["mean"], model["rotation"]))]
            owner = np.repeat(asked.column("vec_id").to_numpy(), [len(ids) for ids, _ in found])
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(np.concatenate([ids for ids, _ in found]), pa.int64()), pa.array(np.concatenate([s for _, s in found]), pa.float64())],
                                             ["query_id", "vec_id", "score"])
    return run


def nearest(corpus: DataFrame, queries: DataFrame, k: int = 10, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest found
    for every row of ``queries``; both tables have ``vec_id`` and ``embedding``."""
    spark = corpus.sparkSession
    rows, asked = vectors_of(corpus, usable()), vectors_of(queries, usable())
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toArrow()  # the bounded sample
    if sample.num_rows == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    first = sample.column("embedding").combine_chunks()
    lengths = np.diff(first.offsets.to_numpy())
    dim = int(np.bincount(lengths).argmax())
    known = matrix(first.filter(pa.array(lengths == dim)))
    mean, rotation = learn_rotation(known)
    model = {"mean": mean, "rotation": rotation, "radius": choose_radius(known, codes(known, mean, rotation), k)}
    rows, asked = (x.where(F.size("embedding") == dim) for x in (rows, asked))
    found = met(rows, asked, block_rows).mapInArrow(_searched(spark.sparkContext.broadcast(model), k), _SCHEMA)
    return top_k(found, k, F.col("score").asc())
