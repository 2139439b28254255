"""Connected components of an edge table, by star contraction.

Each task first contracts its own share of the edges to stars (a union-find
over that share only). Rounds of large-star and small-star joins then connect
the shares: in a round every node is linked to the smallest node it knows.
No edge or component passes through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.llm.common import written

#: Edges of a task's share.
SHARE_EDGES = 500_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for all nodes but the smallest ones."""
    nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))
    x, y = codes[: len(a)], codes[len(a) :]
    while True:
        lower = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], lower)
        np.minimum.at(root, root[y], lower)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
        if (before == root).all():
            break
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contracted(batches):
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    edges = pa.Table.from_batches(tables)
    node, root = stars(edges.column("a").to_numpy(), edges.column("b").to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], ["a", "b"])


def _round(edges: DataFrame) -> DataFrame:
    """Large-star, then small-star. Edges are (larger, smaller)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.distinct()
    small = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, share_edges: int = SHARE_EDGES) -> DataFrame:
    """(node, root) for every node of an edge that is not itself a root; root is its component's smallest node."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    shares = max(1, -(-edges.count() // share_edges))
    now = written(edges.repartition(shares).mapInArrow(_contracted, "a long, b long"), "component-stars")
    while shares > 1:
        after = written(_round(now), "component-round")
        if _mark(after) == _mark(now):
            break
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)
