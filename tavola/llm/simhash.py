"""SimHash near-duplicates by covering locality-sensitive hashing.

1. Every text becomes a 64-bit fingerprint: the majority of each bit over the
   XXH64 hashes of its word shingles. Equal fingerprints form one class, which
   stands for all its copies from here on.
2. A table for radius r is a bit mask. Every bit position is given a non-zero
   vector of r + 1 bits, and the mask of a vector v holds the positions whose
   vector has an odd product with v. The at most r positions in which two
   near fingerprints differ span at most r dimensions, so some v is orthogonal
   to all of them: its mask covers none, and the two agree on all bits of that
   mask. So 2^(r + 1) - 1 masks miss no pair; 31 of about 32 bits for r = 4.
3. The rows (mask, masked bits, fingerprint) are range-partitioned, so that a
   bucket of any size is spread. A task compares the fingerprints of each
   whole bucket and hands on a star for each group it finds, not its pairs.
4. Buckets of more than ``CROWD`` fingerprints and those that lie across two
   partitions are divided: their rows get all masks of a second family, made
   of the bits the first mask leaves free, which again misses no pair. Each
   family about halves the free bits: after ``FAMILIES`` families at most 11
   are free (r = 4), so a bucket has at most 2,048 distinct fingerprints,
   whatever the corpus, and none is divided further.
5. Links become components, named by their smallest ``doc_id``.

Nothing is approximate: the components are those of all pairs. Defined
results: a null or empty text, or one without words, has fingerprint zero,
which links like any other; a text of fewer words than a shingle has one
shingle, all its words; rows of one ``doc_id`` and rows without one are linked
by their own texts; a component without any ``doc_id`` has a null id; an empty
table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.llm.common import in_slices, written
from tavola.llm.components import components, stars

BITS, RADIUS, SHINGLE_WORDS, SEED = 64, 4, 5, 42
FAMILIES = 3
#: Fingerprints of a bucket that one task compares; more are divided.
CROWD = 16_384
#: Rows (mask, fingerprint) of one task.
TASK_ROWS = 1_000_000
#: Rows whose further neighbours in a bucket are compared in one step.
_NEAR = 8
_CHUNK = 1 << 16


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of a text in UTF-8."""
    tokens = text.lower().split()  # bytes: A-Z alone is lowered, ASCII white space alone splits
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(tokens) - words + 1)
    last = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, _CHUNK):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : min(n, at + _CHUNK)].tolist(), last[at : at + _CHUNK].tolist())], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _printed(words: int):
    def run(batches):
        for batch in in_slices(batches):
            prints = np.array([fingerprint(t or b"", words) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64), pa.int64())], ["doc_id", "print"])
    return run


@lru_cache(maxsize=1 << 15)
def masks(held: int, radius: int, family: int) -> np.ndarray:
    """The covering family of ``held``: masks that hold its bits and some of those it leaves free.

    Free positions are dealt evenly over the non-zero vectors, in an order of the family's own.
    """
    vectors = (1 << (radius + 1)) - 1
    order = np.random.default_rng([family, 1]).permutation(BITS)
    values = np.random.default_rng([family, 2]).permutation(vectors) + 1
    free = [int(b) for b in order if not held >> int(b) & 1]
    out = []
    for v in range(1, vectors + 1):
        mask = held
        for k, bit in enumerate(free):
            if (int(values[k % vectors]) & v).bit_count() & 1:
                mask |= 1 << bit
        out.append(mask)
    return np.array(out, np.uint64)


_ROW = "mask long, key long, print long"
_FOUND = "a long, b long, mask long, print long"


def _covered(radius: int, family: int):
    """Each row (mask, print) once for every mask of its family."""
    def run(batches):
        for batch in in_slices(batches, 1 << 14):
            held, prints = (batch.column(c).to_numpy().view(np.uint64) for c in ("mask", "print"))
            for one in np.unique(held):
                own = prints[held == one]
                for mask in masks(int(one), radius, family):
                    columns = [np.full(len(own), mask), own & mask, own]
                    yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], ["mask", "key", "print"])
    return run


def bucket_links(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, other) stars of the groups that ``prints`` of one bucket form: each is compared only with those not reached yet."""
    left, a, b = prints, [], []
    while len(left) > 1:
        seed, left = left[0], left[1:]
        front = [seed]
        while front and len(left):
            near = np.bitwise_count(left ^ front.pop()) <= radius
            reached = left[near]
            if len(reached):
                left = left[~near]
                front.extend(reached)
                a.append(np.full(len(reached), seed))
                b.append(reached)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _compared(radius: int, crowd: int | None):
    """Stars of the buckets of one sorted partition; and the rows of those to be divided, if ``crowd`` is given."""
    def run(batches):
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        rows = pa.Table.from_batches(tables)
        mask, key, prints = (rows.column(c).to_numpy().view(np.uint64) for c in ("mask", "key", "print"))
        n = len(prints)
        first = np.flatnonzero(np.append(True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])))
        sizes = np.diff(np.append(first, n))
        bucket = np.repeat(np.arange(len(first)), sizes)
        later = np.zeros(len(first), bool)
        if crowd is not None:
            later = sizes > crowd
            later[[0, -1]] = True
        a, b = [], []
        for step in range(1, min(_NEAR, n)):
            at = np.flatnonzero((bucket[step:] == bucket[:-step]) & (np.bitwise_count(prints[step:] ^ prints[:-step]) <= radius) & ~later[bucket[step:]])
            a.append(prints[at])
            b.append(prints[at + step])
        for i in np.flatnonzero((sizes > _NEAR) & ~later):
            for out, found in zip((a, b), bucket_links(prints[first[i] : first[i] + sizes[i]], radius)):
                out.append(found)
        a, b = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b))
        node, root = stars(a, b) if len(a) else (a, b)
        rest = np.flatnonzero(later[bucket])
        blank, none = pa.nulls(len(rest), pa.int64()), pa.nulls(len(node), pa.int64())
        joined = [(pa.array(node, pa.int64()), blank), (pa.array(root, pa.int64()), blank), (none, pa.array(mask[rest].view(np.int64))), (none, pa.array(prints[rest].view(np.int64)))]
        yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in joined], ["a", "b", "mask", "print"])
    return run


def links(prints: DataFrame, radius: int = RADIUS, crowd: int = CROWD, task_rows: int = TASK_ROWS) -> DataFrame:
    """(a, b) whose components are those of all pairs of ``prints`` (distinct longs) at ``radius`` or fewer differing bits."""
    rows = prints.select(F.lit(0).cast("long").alias("mask"), "print")
    found = None
    for family in range(1, FAMILIES + 1):
        tasks = max(1, -(-rows.count() * ((1 << (radius + 1)) - 1) // task_rows))
        tables = rows.mapInArrow(_covered(radius, family), _ROW)
        if family < FAMILIES:
            tables = tables.repartitionByRange(tasks, "mask", "key", "print").sortWithinPartitions("mask", "key", "print")
        else:
            tables = tables.repartition(tasks, "mask", "key").sortWithinPartitions("mask", "key", "print")
        made = written(tables.mapInArrow(_compared(radius, crowd if family < FAMILIES else None), _FOUND), f"simhash-family-{family}")
        own = made.where("b is not null").select("a", "b")
        found = own if found is None else found.unionByName(own)
        rows = made.where("mask is not null").select("mask", "print")
        if rows.isEmpty():
            break
    return found.distinct()


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of ``docs``."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    rows = written(own.mapInArrow(_printed(words), "doc_id long, print long"), "simhash-prints")
    classes = written(rows.groupBy("print").agg(F.min("doc_id").alias("first_doc")), "simhash-classes")
    roots = components(links(classes.select("print"), radius))
    named = classes.join(roots.select(F.col("node").alias("print"), "root"), "print", "left").select("print", "first_doc", F.coalesce("root", "print").alias("root"))
    name = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    by_print = named.join(name, "root").select("print", "component_id")
    return rows.join(by_print, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
