"""Exact top-k inner products by columnar branch and bound.

A block of candidates is laid out dimension by dimension. A query adds up its
products a block of dimensions at a time, the blocks in order of the query's
mass, over the candidates that are left. After each block a candidate can
still gain at most the product of the norms of what remains of the query and
of it (Cauchy and Schwarz). Candidates whose partial score and bound fall below
the k-th best lower bound are dropped and the survivors compacted.

All of it is whole numbers. Vectors up to a length-dependent size are summed in
64 bits, where neither sums nor squares can overflow: squares that remain are
exact, and the root of their product is rounded up beyond the error of a
double. A query or candidate with a larger component is worked out with Python
integers, in the same way, so that every finite vector takes part. Scores are
exact decimals of 38 digits; one beyond that ends the job with an error.

Components are the integers floor(scale * x). Null vectors and vectors with
null or non-finite components take no part; a zero or empty vector does. Only
vectors of one length are compared. Repeated rows are rows of their own; a
query's own row is known by its id. An empty table gives no rows. Rows and
queries meet in blocks on the executors (see ``vector_blocks``).
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.llm.vector_blocks import BLOCK_ROWS, met, searched, top_k, vectors_of

SCALE = 256
DIMENSIONS = 8
_SCORE = pa.decimal128(38, 0)
_FOUND = "query_id long, vec_id long, score decimal(38,0)"


def usable(column: str = "embedding") -> Column:
    """True for vectors without null and non-finite components."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(True))


def narrow_limit(dim: int) -> int:
    """Largest size of a component for which sums of products and squares stay below 2^60."""
    return math.isqrt((1 << 60) // max(1, dim))


def _whole(x: float, scale: int) -> int:
    scaled = x * scale
    return math.floor(scaled) if math.isfinite(scaled) else int(x) * scale  # a double that large is whole


def _roots(q: int, left: np.ndarray) -> np.ndarray:
    """For whole ``left``, whole numbers no smaller than the roots of q * left."""
    if left.dtype == object:
        return np.array([math.isqrt(q * x) + 1 for x in left], object)
    # Each of the two roots and their product errs by less than 2^-50 of it.
    return np.ceil(np.sqrt(left.astype(np.float64)) * math.sqrt(q) * (1 + 2.0**-48)).astype(np.int64) + 1


class Columns:
    """Whole-number vectors in vertical layout: 64-bit, or Python integers if ``wide``."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids = ids
        self.by_dimension = np.ascontiguousarray(vectors.T)
        self.squares = self.by_dimension**2
        self.by_id = np.argsort(ids, kind="stable")
        self.own = ids[self.by_id]

    def others(self, query_id: int) -> np.ndarray:
        """Places of all rows but the query's own."""
        lo, hi = np.searchsorted(self.own, [query_id, query_id + 1])
        keep = np.ones(len(self.ids), bool)
        keep[self.by_id[lo:hi]] = False
        return np.flatnonzero(keep)

    def top(self, query: np.ndarray, k: int, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of those of ``alive`` that may be among its k best."""
        n = self.by_dimension.shape[1]
        order = np.argsort(np.array([-abs(int(x)) for x in query], object) if query.dtype == object else -np.abs(query), kind="stable")
        mass = np.append(np.cumsum((query[order] ** 2)[::-1])[::-1], 0)
        partial = np.zeros(len(alive), self.by_dimension.dtype)
        left = self.squares[:, alive].sum(axis=0) if len(order) else partial
        for at in range(0, len(order), DIMENSIONS):
            own = order[at : at + DIMENSIONS]
            whole = len(alive) == n
            block = self.by_dimension[own] if whole else self.by_dimension[np.ix_(own, alive)]
            partial = partial + query[own] @ block
            left = left - (self.squares[own] if whole else self.squares[np.ix_(own, alive)]).sum(axis=0)
            if len(alive) <= k:
                continue
            rest = _roots(int(mass[min(at + DIMENSIONS, len(order))]), left)
            least = np.partition(partial - rest, len(alive) - k)[len(alive) - k]  # k rows score at least this
            keep = (partial + rest >= least).astype(bool)
            if not keep.all():
                alive, partial, left = alive[keep], partial[keep], left[keep]
        return alive, partial


class Block:
    """The rows of a block by length, and apart from them those with components beyond ``narrow_limit``."""

    def __init__(self, rows: pa.Table, scale: int) -> None:
        self.parts: dict[tuple[int, bool], Columns] = {}
        for (dim, wide), (ids, vectors) in whole_vectors(rows.column("vec_id").to_numpy(), rows.column("embedding").combine_chunks(), scale).items():
            self.parts[dim, wide] = Columns(ids, vectors)

    def best(self, query_id: int, query: np.ndarray, wide: bool, k: int) -> list[tuple[int, int]]:
        """(score, vec_id) of the k best rows for the query."""
        found = []
        for part_wide in (False, True):
            part = self.parts.get((len(query), part_wide))
            if part is None:
                continue
            if wide and not part_wide:  # rare: a query beyond 64 bits takes a copy of the rows in wide integers
                part = Columns(part.ids, part.by_dimension.T.astype(object))
            at, scores = part.top(query.astype(object) if part_wide else query, k, part.others(query_id))
            found += zip(scores.tolist(), part.ids[at].tolist())
        return sorted(found, key=lambda x: (-x[0], x[1]))[:k]


def whole_vectors(ids: np.ndarray, lists: pa.Array, scale: int) -> dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]]:
    """Ids and whole-number vectors by (length, whether beyond ``narrow_limit``)."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False)
    lengths, out = np.diff(offsets), {}
    for dim in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == dim)
        own = values[offsets[at][:, None] + np.arange(dim)]
        wide = (np.abs(own) >= narrow_limit(dim) / scale).any(axis=1)
        if not wide.all():
            out[dim, False] = ids[at[~wide]], np.floor(own[~wide] * scale).astype(np.int64)
        if wide.any():
            big = np.empty((int(wide.sum()), dim), object)
            for i, row in enumerate(own[wide].tolist()):
                big[i] = [_whole(x, scale) for x in row]
            out[dim, True] = ids[at[wide]], big
    return out


def _found(k: int, scale: int):
    def run(batches):
        for block, asked in searched(batches, lambda rows: Block(rows, scale)):
            out: list[tuple[int, int, int]] = []
            for (_, wide), (ids, queries) in whole_vectors(asked.column("vec_id").to_numpy(), asked.column("embedding"), scale).items():
                for query_id, query in zip(ids.tolist(), queries):
                    out += [(query_id, vec_id, score) for score, vec_id in block.best(query_id, query, wide, k)]
            ids = [pa.array([o[i] for o in out], pa.int64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array([Decimal(o[2]) for o in out], _SCORE)], ["query_id", "vec_id", "score"])
    return run


def inner_products(corpus: DataFrame, queries: DataFrame, k: int = 5, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the k highest integer inner products with every row of ``queries``."""
    rows, asked = vectors_of(corpus, usable()), vectors_of(queries, usable())
    return top_k(met(rows, asked, block_rows).mapInArrow(_found(k, scale), _FOUND), k, F.col("score").desc())
