"""Reversible line de-duplication: exact reference counts behind cuckoo filters.

State of a ``LineIndex``, all of it Spark tables in the shared folder:

* ``refs``    one row per (document, distinct line key): the exact postings;
* ``counts``  per key, the number of documents holding it and the smallest;
* ``filters`` per shard, a cuckoo filter of the keys that two or more
  documents hold. A cuckoo filter forgets a key again when deletions leave it
  with one document, which a Bloom filter cannot.

``insert`` and ``delete`` move documents in and out by a delta: postings of
the batch, their effect on the counts, and the keys that cross between one
and two documents, which enter or leave the filters. ``drops`` probes every
posting against its shard's filter, and only the hits meet the exact table.

A line's key is the line without ASCII white space at its ends and with A-Z
lowered, carried as its 128-bit BLAKE2b digest. A document is a ``doc_id``:
repeated rows of one id count as one document. A null ``doc_id`` neither
counts towards nor loses a line. A null or empty text is one empty line.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tavola.llm.common import ASCII_SPACE, fresh, with_fields, without, written

MIN_CHARS = 10
KEYS_PER_SHARD = 1 << 18
#: Postings probed beside one copy of a shard's filter, and the least number of its copies: the postings of a
#: shard, or of one very common line, are probed by as many tasks as their number asks for.
POSTINGS_PER_COPY, SALTS = 1 << 20, 8
_KEY = ["hi", "lo"]


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The 16-byte key of a line in UTF-8, None if it is too short to count."""
    key = line.strip(ASCII_SPACE).lower()
    n = len(key)
    if n < min_chars or (n < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


class CuckooFilter:
    """Four 16-bit fingerprints a bucket, two buckets a key; zero is an empty cell."""

    SLOTS, KICKS, LOAD = 4, 500, 0.8

    def __init__(self, cells: np.ndarray) -> None:
        self.cells = cells

    @classmethod
    def empty(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / (cls.SLOTS * cls.LOAD)))))
        return cls(np.zeros((buckets, cls.SLOTS), np.uint16))

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, cls.SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.cells.tobytes()

    def _places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.int64(len(self.cells) - 1)
        mark = (hi.view(np.uint64) >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (lo >> np.int64(8)) & mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ ((mark.astype(np.int64) * 0x5BD1E995) & np.int64(len(self.cells) - 1))

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(hi, lo)
        return ((self.cells[a] == mark[:, None]) | (self.cells[b] == mark[:, None])).any(axis=1)

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        """Add distinct new keys; False when a key finds no place (build a larger filter)."""
        mark, a, b = self._places(hi, lo)
        rest = np.arange(len(mark))
        for buckets in (a, b):
            rest = rest[~self._fill(buckets[rest], mark[rest])]
        rng = np.random.default_rng(len(mark))
        return all(self._kick(int(a[i]), mark[i], rng) for i in rest)

    def _fill(self, buckets: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Put each mark into a free cell of its bucket where there is one."""
        order = np.argsort(buckets, kind="stable")
        own = buckets[order]
        turn = np.arange(len(own)) - np.searchsorted(own, own)
        free = self.cells[own] == 0
        fits = turn < free.sum(axis=1)
        slot = np.argmax(np.cumsum(free, axis=1) == (turn + 1)[:, None], axis=1)
        self.cells[own[fits], slot[fits]] = mark[order][fits]
        done = np.zeros(len(buckets), bool)
        done[order] = fits
        return done

    def _kick(self, bucket: int, mark: np.uint16, rng: np.random.Generator) -> bool:
        for _ in range(self.KICKS):
            free = np.flatnonzero(self.cells[bucket] == 0)
            if len(free):
                self.cells[bucket, free[0]] = mark
                return True
            slot = int(rng.integers(self.SLOTS))
            mark, self.cells[bucket, slot] = self.cells[bucket, slot], mark
            bucket = int(self._other(np.array([bucket]), np.array([mark], np.uint16))[0])
        return False

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Take out one copy of each key's fingerprint; the keys must have been inserted."""
        for mark, a, b in zip(*self._places(hi, lo)):
            for bucket in (a, b):
                at = np.flatnonzero(self.cells[bucket] == mark)
                if len(at):
                    self.cells[bucket, at[0]] = 0
                    break

    @classmethod
    def holding(cls, hi: np.ndarray, lo: np.ndarray) -> CuckooFilter:
        size = max(1, len(hi))
        while True:
            made = cls.empty(size)
            if made.insert(hi, lo):
                return made
            size *= 2


def _postings(min_chars: int):
    """The distinct line keys of every row, each with the row's other columns."""
    def run(batches):
        for batch in batches:
            rows, pairs = [], [np.zeros((0, 2), np.int64)]
            for i, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())):
                if doc is None:
                    continue
                keys = {line_key(x, min_chars) for x in _utf8(text).split(b"\n")}
                keys.discard(None)
                if keys:
                    pairs.append(np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2))
                    rows.append(np.full(len(keys), i))
            at, found = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)), np.concatenate(pairs)
            own = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([batch.column(n).take(at) for n in own] + [pa.array(found[:, 0]), pa.array(found[:, 1])], [*own, *_KEY])
    return run


def postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, hi, lo) for the distinct line keys of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_postings(min_chars), "doc_id long, hi long, lo long")


def _text_print(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


@dataclass(frozen=True)
class LineIndex:
    """Exact postings and counts with one cuckoo filter a shard; see the module text."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = MIN_CHARS
    keys_per_shard: int = KEYS_PER_SHARD
    repeats: bool = False  # whether a doc_id was on several rows

    @staticmethod
    def build(docs: DataFrame, min_chars: int = MIN_CHARS, keys_per_shard: int = KEYS_PER_SHARD) -> LineIndex:
        """Index of all of ``docs``; the number of shards follows the number of shared keys."""
        refs = written(postings(docs, min_chars), "line-refs")
        repeats = _has_repeats(docs)
        single = refs.groupBy("doc_id", *_KEY).agg(F.lit(1).alias("one")) if repeats else refs
        counts = written(_counted(single), "line-counts")
        shared = counts.where("n_docs >= 2")
        shards = max(1, -(-shared.count() // keys_per_shard))
        filters = written(_in_shards(shared, shards).groupBy("shard").applyInArrow(_built, _FILTER), "line-filters")
        return LineIndex(written(single.select("doc_id", *_KEY), "line-refs") if repeats else refs, counts, filters, shards, min_chars, keys_per_shard, repeats)

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index after adding documents; postings it already has are left alone."""
        new = postings(docs, self.min_chars).distinct().join(self.refs, ["doc_id", *_KEY], "left_anti")
        new = written(new, "line-new")
        added = _counted(new)
        old = self.counts.select(*_KEY, F.col("n_docs").alias("had"), F.col("first_doc").alias("had_first"))
        after = added.join(old, _KEY, "left").select(
            *_KEY, (F.col("n_docs") + F.coalesce("had", F.lit(0))).alias("n_docs"),
            F.least("first_doc", "had_first").alias("first_doc"), F.coalesce("had", F.lit(0)).alias("had"))
        return self._moved(self.refs.unionByName(new), written(after, "line-delta"))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The index after removing documents (a column ``doc_id``); unknown ids change nothing."""
        ids = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        gone = self.refs.join(ids, "doc_id", "left_semi").select(*_KEY).distinct()
        refs = written(self.refs.join(ids, "doc_id", "left_anti"), "line-refs")
        left = _counted(refs.join(gone, _KEY, "left_semi"))
        touched = self.counts.join(gone, _KEY, "left_semi").select(*_KEY, F.col("n_docs").alias("had"))
        after = touched.join(left, _KEY, "left").select(*_KEY, F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "first_doc", "had")
        return self._moved(refs, written(after, "line-delta"))

    def _moved(self, refs: DataFrame, delta: DataFrame) -> LineIndex:
        counts = self.counts.join(delta, _KEY, "left_anti").unionByName(
            delta.where("n_docs > 0").select(*_KEY, "n_docs", "first_doc"))
        counts = written(counts, "line-counts")
        shards = -(-counts.where("n_docs >= 2").count() // self.keys_per_shard)
        if shards > 2 * self.shards:  # the shards have outgrown their size: deal all shared keys anew
            filters = _in_shards(counts.where("n_docs >= 2"), shards).groupBy("shard").applyInArrow(_built, _FILTER)
            return replace(self, refs=written(refs, "line-refs"), counts=counts, filters=written(filters, "line-filters"), shards=shards)
        shared = _in_shards(counts.where("n_docs >= 2"), self.shards)
        room = self.filters.select("shard", (F.length("cells") / 2 * CuckooFilter.LOAD).alias("room"))
        full = shared.groupBy("shard").count().join(room, "shard", "left").where("room is null or count > room").select("shard")
        full = written(full, "line-full")
        crossing = _in_shards(delta.where("(had >= 2) <> (n_docs >= 2)"), self.shards).select(*_KEY, "shard", (F.col("n_docs") >= 2).alias("enters"))
        changed = crossing.join(full, "shard", "left_anti").groupBy("shard").cogroup(
            self.filters.join(full, "shard", "left_anti").groupBy("shard")).applyInArrow(_changed, _FILTER)
        rebuilt = shared.join(full, "shard", "left_semi").select("shard", *_KEY).groupBy("shard").applyInArrow(_built, _FILTER)
        return replace(self, refs=written(refs, "line-refs"), counts=counts, filters=written(changed.unionByName(rebuilt), "line-filters"))

    def lost(self, refs: DataFrame | None = None) -> DataFrame:
        """(doc_id, hi, lo): the line keys that documents lose."""
        refs = self.refs if refs is None else refs
        salts = salts_for(refs.count(), self.shards)
        salt = F.pmod(F.xxhash64("doc_id", *_KEY), F.lit(salts)).cast("int").alias("salt")
        rows = _in_shards(refs, self.shards).select("shard", salt, F.lit(1).alias("kind"), "doc_id", *_KEY, F.lit(None).cast("binary").alias("cells"))
        none = [F.lit(None).cast("long").alias(c) for c in ("doc_id", *_KEY)]
        copies = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), *none, "cells")
        # Each copy of a filter comes first, then its postings batch by batch: no task holds them whole.
        dealt = rows.unionByName(copies).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
        hits = dealt.mapInArrow(_probed, "doc_id long, hi long, lo long")
        shared = self.counts.where("n_docs >= 2").select(*_KEY, "first_doc")
        return hits.join(shared, _KEY).where(F.col("doc_id") > F.col("first_doc")).select("doc_id", *_KEY)

    def drops(self, docs: DataFrame | None = None) -> DataFrame:
        """(doc_id, print, keys): the line keys that documents lose; a null ``print`` is for all rows of the id.

        Given ``docs`` whose ids repeat, each text has a list of its own, no longer than its lines.
        """
        lost, own = self.lost(), F.lit(None).cast("long").alias("print")
        if docs is not None and self.repeats:
            rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            rows = rows.withColumn("print", _text_print(F.col("text"))).select("doc_id", "print", "text")
            each = rows.mapInArrow(_postings(self.min_chars), "doc_id long, print long, hi long, lo long").distinct()
            lost, own = each.join(lost, ["doc_id", *_KEY]), F.col("print")
        return lost.groupBy("doc_id", own).agg(F.collect_list(F.struct(*_KEY)).alias("keys"))


_FILTER = "shard int, cells binary"


def salts_for(postings: int, shards: int) -> int:
    """Copies of each shard's filter for so many postings."""
    return max(SALTS, -(-postings // (shards * POSTINGS_PER_COPY)))


def _has_repeats(docs: DataFrame) -> bool:
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    return ids.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0


def _in_shards(df: DataFrame, shards: int) -> DataFrame:
    return df.withColumn("shard", F.pmod("lo", F.lit(shards)).cast("int"))


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64, copy=False)


def _built(table: pa.Table) -> pa.Table:
    made = CuckooFilter.holding(_column(table, "hi"), _column(table, "lo"))
    return _filter_row(table.column("shard")[0].as_py(), made)


def _filter_row(shard: int, made: CuckooFilter) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "cells": pa.array([made.to_bytes()], pa.binary())})


def _changed(moves: pa.Table, old: pa.Table) -> pa.Table:
    """A shard's filter after keys entered and left. Empty cells, should a key
    find no place, stand for a filter that every key passes."""
    if moves.num_rows == 0:
        return old.select(["shard", "cells"])
    hi, lo, enters = _column(moves, "hi"), _column(moves, "lo"), moves.column("enters").to_numpy().astype(bool)
    raw = old.column("cells")[0].as_py()
    have = CuckooFilter.from_bytes(raw)
    if raw:
        have.delete(hi[~enters], lo[~enters])
        if not have.insert(hi[enters], lo[enters]):
            have.cells = have.cells[:0]
    return _filter_row(moves.column("shard")[0].as_py(), have)


def _probed(batches):
    """The postings that pass their shard's filter; rows are sorted by (shard, salt, kind)."""
    own, held = None, None
    for batch in batches:
        place = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("shard", "salt", "kind")])
        if not batch.num_rows:
            continue
        starts = np.append(0, np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1)
        for lo, hi in zip(starts, np.append(starts[1:], batch.num_rows)):
            part, at = batch.slice(lo, hi - lo), tuple(place[:2, lo])
            if place[2, lo] == 0:
                raw = part.column("cells")[0].as_py()
                own, held = at, CuckooFilter.from_bytes(raw) if raw else None
            elif at == own:  # a shard without a filter has no shared key
                out = part.select(["doc_id", "hi", "lo"])
                yield out if held is None else out.filter(pa.array(held.contains(*(out.column(c).to_numpy() for c in _KEY))))


def _rewritten(min_chars: int, drop: str):
    def run(batches):
        for batch in batches:
            texts, lines, dropped = [], [], []
            for text, keys in zip(batch.column("text").to_pylist(), batch.column(drop).to_pylist()):
                parts = _utf8(text).split(b"\n")
                kept = parts
                if keys:
                    gone = {np.array([k["hi"], k["lo"]], "<i8").tobytes() for k in keys}
                    kept = [x for x in parts if line_key(x, min_chars) not in gone]
                texts.append(b"\n".join(kept))
                lines.append(len(parts))
                dropped.append(len(parts) - len(kept))
            made = {"text": pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
            names = [n for n in batch.schema.names if n != drop and n not in made]
            cols = {n: batch.column(n) for n in names} | made
            order = [n for n in batch.schema.names if n != drop] + ["n_lines", "n_dropped"]
            yield pa.RecordBatch.from_arrays([cols[n] for n in order], order)
    return run


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, keys_per_shard: int = KEYS_PER_SHARD) -> DataFrame:
    """``docs`` with every repeated line left only in the smallest ``doc_id`` that holds it.

    All columns are kept; ``text`` holds the remaining lines joined by \\n
    (empty if none remain), ``n_lines`` the lines before and ``n_dropped``
    those taken out. Input columns of these two names are replaced.
    """
    docs = without(docs, "n_lines", "n_dropped")
    index = LineIndex.build(docs, min_chars, keys_per_shard)
    drop, of_doc, of_text = (fresh(n, docs) for n in ("dropped_keys", "of_doc", "of_text"))
    lost = index.drops(docs).select(F.col("doc_id").alias(of_doc), F.col("print").alias(of_text), F.col("keys").alias(drop))
    rows = docs.withColumn("text", F.col("text").cast("string"))
    same = rows["doc_id"].cast("long") == lost[of_doc]
    if index.repeats:
        same = same & (_text_print(rows["text"]) == lost[of_text])
    joined = rows.join(lost, same, "left").drop(of_doc, of_text)
    schema = with_fields(docs.schema, T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()))
    return joined.mapInArrow(_rewritten(min_chars, drop), schema)
