"""Queries against all rows, block by block on executors: what the two vector searches share.

Rows fall into blocks by a hash of the whole row, so that neither an id nor a
vector that is very common fills one. Queries are sent to every block, and
each block is one sorted run of a task: first its rows, which the task holds
and lays out once, then the queries, which pass it in batches. The driver
sees no vector; a task holds one block, whatever the number of queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block at most on average, and rows from which on a smaller table is cut for more tasks.
BLOCK_ROWS, LEAST_ROWS = 262_144, 4_096

MET = "block long, kind int, vec_id long, embedding array<double>"


def vectors_of(df: DataFrame, usable: Column) -> DataFrame:
    """vec_id and embedding, as doubles, of the rows that take part."""
    return df.where(usable & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def met(rows: DataFrame, asked: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``MET`` rows, each block in one task: its rows (kind 0), then every query (kind 1)."""
    n = rows.count()
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n // block_rows), min(width, n // LEAST_ROWS))
    own = rows.select(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).alias("block"), F.lit(0).alias("kind"), "vec_id", "embedding")
    every = asked.select(F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"), F.lit(1).alias("kind"), "vec_id", "embedding")
    return own.unionByName(every).repartitionByRange(blocks, "block").sortWithinPartitions("block", "kind", "vec_id")


def searched(batches: Iterable[pa.RecordBatch], build: Callable[[pa.Table], object]) -> Iterator[tuple[object, pa.RecordBatch]]:
    """(what ``build`` makes of a block's rows, some of the queries) for the sorted batches of ``met``."""
    block, rows, built = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
        cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            if blocks[lo] != block:
                block, rows, built = blocks[lo], [], None
            part = batch.slice(lo, hi - lo)
            if kinds[lo] == 0:
                rows.append(part)
                continue
            if rows:
                built, rows = build(pa.Table.from_batches(rows).combine_chunks()), []
            if built is not None:
                yield built, part


def top_k(found: DataFrame, k: int, order: Column) -> DataFrame:
    """The first k of each query, by ``order`` and then the smaller vec_id. Tasks
    keep k of their own rows first, so no query's candidates meet whole."""
    by = Window.partitionBy("query_id").orderBy(order, F.col("vec_id").asc())
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
