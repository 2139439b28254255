"""Helpers shared by the corpus operators: tables, written steps, word hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space: space, tab, LF, VT, FF, CR.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One provided table, by a path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir`` of the session.

    Only a session that runs in one process (``local`` or ``local[..]``: tests)
    and has none gets a temporary one; anywhere else its absence is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="corpus-steps-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, label: str, partitions: int | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    Cuts the lineage: what follows is recomputed from the files, not from the
    source, when an executor is lost. Files are left to the folder's own
    clean-up, since lazy results read them after the call has returned.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    out = df if partitions is None else df.coalesce(partitions)
    out.write.parquet(path)
    return spark.read.schema(_nullable(df.schema)).parquet(path)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def with_fields(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    """``schema`` with ``fields`` set: same names are replaced in place, others appended."""
    new = {f.name: f for f in fields}
    kept = [new.pop(f.name, f) for f in schema]
    return T.StructType(kept + list(new.values()))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns an operator is about to add itself."""
    return df.drop(*[c for c in df.columns if c in names])


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, or the first of it with underscores added, that no column of the frames has (in any case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str = "text") -> F.Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def in_slices(batches, rows: int = 2048):
    """Arrow batches in slices of a bounded number of rows, so that a worker's arrays stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def in_bytes(batches, limit: int, column: str = "text"):
    """Arrow batches in slices of about ``limit`` bytes of a column (a row at least), so that long texts make short slices."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.flatnonzero(np.diff((np.cumsum(size) - size) // limit, prepend=-1))
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(lo, hi - lo)


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets (n + 1) and the 64-bit hash of every word of every text.

    A word is a run of characters other than ASCII white space, A-Z lowered;
    a null text has none. Each distinct word of the batch is hashed once.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    offsets = before[offsets]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(w) for w in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return offsets, hashes[codes] if len(hashes) else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums of hashes spread evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bytes(letters: bytes) -> np.ndarray:
    """For ``words_of``: a table that keeps ``letters`` and all bytes from 0x80 on, lowers A-Z and blanks the rest."""
    kept = np.full(256, 0x20, np.uint8)
    own = np.frombuffer(letters, np.uint8)
    kept[own] = own
    kept[0x80:] = np.arange(0x80, 0x100)
    kept[0x41:0x5B] = np.arange(0x61, 0x7B)
    return kept


def words_of(texts: pa.Array, kept: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row of each word, distinct words, and the code of each word, in order.

    A word is a run of bytes that ``kept`` (see ``word_bytes``) does not blank; a null text has none.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    held = texts.buffers()[2]
    data = kept[np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]]] if held is not None else np.zeros(0, np.uint8)
    clean = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(data)])
    lists = pc.ascii_split_whitespace(clean)
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    coded = flat.filter(full).dictionary_encode()
    return row[full.to_numpy(zero_copy_only=False)], coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
