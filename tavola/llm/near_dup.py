"""MinHash near-duplicates with an LSH forest over sorted signature orders.

1. Every text becomes its set of distinct word shingles. Texts with equal sets
   form one class; from here on a class stands for all its copies.
2. A class gets one row in each of ``TREES`` orders: ``DEPTH`` MinHash values
   of its own for each. The rows are range-partitioned and sorted by (tree,
   values), so any amount of equal values is spread over tasks.
3. In a sorted order, neighbours are candidates where their longest common
   prefix reaches ``MIN_DEPTH``. The depth adapts to the region: in a sparse
   one the few neighbours share just that prefix, in a crowded one a class
   meets those that share the longest prefix with it. In regions larger than
   ``NEIGHBOURS`` the classes also meet the end of the region's heaviest path
   down the prefix tree, at every depth: the text the region's are copies of.
4. Candidates are rated by all MinHash values; those within five standard
   errors of the threshold are checked on the full shingle sets: first the
   best-rated partner of every class among its nearest neighbours and hubs,
   then its best-rated one in another component among all neighbours.
5. What is still apart is settled without a window: in every region, wherever
   its rows lie, each class meets all classes of other components. A region is
   split into cells of at most two blocks of rows (``BLOCK``; beyond
   ``MANY_BLOCKS`` of them they grow to ``GROWN`` times that, which keeps the
   copies of rows down), so that its size bounds no task; a cell with few
   candidates hands them on as pairs, and in one with many all sets are
   compared at once. A pair within one component cannot change the result.
6. Links become components; a component is named by its smallest ``doc_id``.

Recall is that of the forest: with 20 trees and a least depth of 4 two texts
of similarity 0.8 share no region once in 40,000 pairs. No candidate list is
capped: two classes that share a region are compared or already linked. Defined results: a null or empty text has no shingles, links with
nothing and is its own component; a text of fewer words than a shingle has one
shingle, all its words; rows of one ``doc_id`` share its component; a null
``doc_id`` is in no component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.llm.common import fresh, hashed_words, in_slices, mixed, written
from tavola.llm.components import components, stars

TREES, DEPTH, MIN_DEPTH, NEIGHBOURS = 20, 8, 4, 8
SHINGLE_WORDS, SIMILARITY = 5, 0.8
_VALUES = TREES * DEPTH
#: Ids of documents whose sets are wanted that may be broadcast (16 MB as longs); more of them are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Rows of one side of a cell, and candidates a row from which on a cell compares all its sets at once.
BLOCK, DENSE = 512, 8
#: Blocks from which on those of a larger region grow, up to so many times ``BLOCK``: its rows are copied to fewer cells.
MANY_BLOCKS, GROWN = 64, 16
#: Values of a chunk of shingles that are hashed together; keeps the working set in cache.
_CHUNK = 1 << 15

_rng = np.random.default_rng(20240607)
_FACTORS = _rng.integers(1, 1 << 63, _VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of every text."""
    offsets, tokens = hashed_words(texts)
    places = _PLACES[np.arange(words) % 64] * np.uint64(2 * words + 1)
    n = max(0, len(tokens) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(words):
        rolled += tokens[j : j + n] * places[j]
    rolled = mixed(rolled)
    out = []
    for lo, hi in zip(offsets[:-1], offsets[1:]):
        if hi - lo >= words:
            out.append(np.unique(rolled[lo : hi - words + 1]))
        elif hi > lo:
            short = (tokens[lo:hi] * places[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
            out.append(mixed(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (rows x TREES * DEPTH, 32 bits) of non-empty sets."""
    out = np.zeros((len(sets), _VALUES), np.uint32)
    start = 0
    while start < len(sets):
        stop, held = start, 0
        while stop < len(sets) and (stop == start or held + len(sets[stop]) <= _CHUNK):
            held += len(sets[stop])
            stop += 1
        flat = np.concatenate(sets[start:stop])
        bounds = np.cumsum([0] + [len(s) for s in sets[start : stop - 1]])
        scratch = np.empty_like(flat)
        for p in range(_VALUES):
            np.multiply(flat, _FACTORS[p], out=scratch)
            out[start:stop, p] = np.minimum.reduceat(scratch, bounds) >> np.uint64(32)
        start = stop
    return out


def _digest(own: np.ndarray) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(own.tobytes())
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


def _signed(words: int):
    def run(batches):
        for batch in in_slices(batches):
            sets = shingle_sets(batch.column("text"), words)
            n = [len(s) for s in sets]
            prints = [_digest(s) for s in sets]
            full = [i for i, s in enumerate(sets) if len(s)]
            values = signatures([sets[i] for i in full])
            sigs: list[bytes | None] = [None] * len(sets)
            low: list[bytes | None] = [None] * len(sets)
            for i, v in zip(full, values):
                sigs[i], low[i] = v.astype(">u4").tobytes(), v.astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([p[0] for p in prints], pa.int64()),
                 pa.array([p[1] for p in prints], pa.int64()), pa.array(sigs, pa.binary()), pa.array(low, pa.binary())],
                ["doc_id", "n_shingles", "hi", "lo", "sig", "bytes"])
    return run


def _sets(words: int):
    def run(batches):
        for batch in in_slices(batches):
            sets = shingle_sets(batch.column("text"), words)
            prints = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], ["hi", "lo", "shingles"])
    return run


def _runs(same: np.ndarray) -> list[tuple[int, int]]:
    """Maximal [start, end) of rows where each row but the first is ``same`` as the one before."""
    starts = np.flatnonzero(~same)
    return list(zip(starts, np.append(starts[1:], len(same))))


def neighbours(tree: np.ndarray, values: np.ndarray, ids: np.ndarray, groups: np.ndarray,
               min_depth: int = MIN_DEPTH, reach: int = NEIGHBOURS, crowd: int = NEIGHBOURS) -> np.ndarray:
    """Candidate pairs, as places, of rows sorted by (tree, values).

    ``reach`` is how many rows further on a row looks; regions of more than
    ``crowd`` rows have a hub. Rows of one group are linked already and make
    no pair.
    """
    n, depth = len(ids), values.shape[1]
    if n < 2:
        return np.zeros((0, 2), np.int64)
    equal = np.cumprod((values[1:] == values[:-1]) & (tree[1:] == tree[:-1])[:, None], axis=1).sum(axis=1)
    found = []
    common = equal.copy()
    for step in range(1, reach + 1):
        if step > 1:
            common = np.minimum(common[:-1], equal[step - 1 :])
        at = np.flatnonzero(common >= min_depth)
        if not len(at):
            break
        at = at[groups[at] != groups[at + step]]
        found.append(np.stack([at, at + step], axis=1))
    hubs = np.full(n, -1, np.int64)
    for d in range(min_depth, depth + 1):
        same = np.append(False, equal >= d)
        for lo, hi in _runs(same):
            if hi - lo <= crowd:
                continue
            hub = _heaviest(equal, lo, hi, d, depth)
            fresh = np.arange(lo, hi)[hubs[lo:hi] != hub]
            hubs[lo:hi] = hub
            fresh = fresh[groups[fresh] != groups[hub]]
            found.append(np.stack([np.full(len(fresh), hub), fresh], axis=1))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return pairs[ids[pairs[:, 0]] != ids[pairs[:, 1]]]


def crowded(tree: np.ndarray, values: np.ndarray, min_depth: int = MIN_DEPTH) -> np.ndarray:
    """Places of rows in regions of three rows or more: those for which the next row is not all there is."""
    same = np.append(False, (values[1:, :min_depth] == values[:-1, :min_depth]).all(axis=1) & (tree[1:] == tree[:-1]))
    sizes = np.array([hi - lo for lo, hi in _runs(same)])
    return np.flatnonzero(np.repeat(sizes, sizes) > 2)


def _heaviest(equal: np.ndarray, lo: int, hi: int, d: int, depth: int) -> int:
    """The row at the end of the heaviest path below the region [lo, hi) of depth d."""
    for level in range(d + 1, depth + 1):
        same = np.append(False, equal[lo : hi - 1] >= level)
        start, end = max(_runs(same), key=lambda run: (run[1] - run[0], -run[0]))
        lo, hi = lo + start, lo + end
    return lo


def _partition(batches) -> tuple[np.ndarray, np.ndarray, pa.Table] | None:
    """One range partition of the sorted order: of even size however equal the values are."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return None
    rows = pa.Table.from_batches(tables)
    key = np.frombuffer(b"".join(rows.column("key").to_pylist()), ">u4").reshape(-1, DEPTH).astype(np.uint32)
    return rows.column("tree").to_numpy(), key, rows


_FOREST = "a long, b long, tree int, key binary"


def _nearest(batches):
    """Pairs of each row with the next and with hubs; and, without b, the rows of crowded regions."""
    if (own := _partition(batches)) is None:
        return
    tree, key, rows = own
    ids = rows.column("cid").to_numpy()
    pairs = np.unique(np.sort(ids[neighbours(tree, key, ids, ids, reach=1)], axis=1), axis=0)
    more = crowded(tree, key)
    # A region may go on in the next partition, so a partition's first and last regions count as crowded.
    edge = (key[:, :MIN_DEPTH] == key[0, :MIN_DEPTH]).all(axis=1) & (tree == tree[0])
    edge |= (key[:, :MIN_DEPTH] == key[-1, :MIN_DEPTH]).all(axis=1) & (tree == tree[-1])
    more = np.union1d(more, np.flatnonzero(edge))
    n = len(pairs)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([pairs[:, 0], ids[more]])), pa.array(np.append(pairs[:, 1], np.zeros(len(more), np.int64)), mask=np.arange(n + len(more)) >= n),
         pa.array(np.append(np.full(n, -1, np.int32), tree[more].astype(np.int32))), pa.concat_arrays([pa.nulls(n, pa.binary()), rows.column("key").take(pa.array(more)).combine_chunks().cast(pa.binary())])],
        ["a", "b", "tree", "key"])


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal MinHash values, of which one byte each is compared."""
    return ((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256)


def _best_of_each(ids: np.ndarray, places: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Which of the pairs are the best-rated one of either end."""
    ends = ids[places].T.ravel()
    order = np.lexsort((-np.tile(rates, 2), ends))
    first = np.unique(ends[order], return_index=True)[1]
    return np.unique(order[first] % max(1, len(places)))


def _wide(least: float):
    def run(batches):
        if (own := _partition(batches)) is None:
            return
        tree, key, rows = own
        ids, groups = rows.column("cid").to_numpy(), rows.column("group").to_numpy()
        low = np.frombuffer(b"".join(rows.column("bytes").to_pylist()), np.uint8).reshape(-1, _VALUES)
        places = neighbours(tree, key, ids, groups)
        rates = np.concatenate([_share(low[part[:, 0]], low[part[:, 1]]) for part in np.array_split(places, 1 + len(places) // 65536)])
        places, rates = places[rates >= least], rates[rates >= least]
        best = _best_of_each(ids, places, rates)
        places, rates = places[best], rates[best]
        pairs, at = np.unique(np.sort(ids[places], axis=1), axis=0, return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(rates[at])], ["a", "b", "rate"])
    return run


def _rated(batches):
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, _VALUES) for c in ("bytes_a", "bytes_b"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(_share(a, b))], ["a", "b", "rate"])


def _confirmed(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _least(similarity: float) -> float:
    """Five standard errors below the threshold."""
    return similarity - 5 * float(np.sqrt(similarity * (1 - similarity) / _VALUES))


def _rated_pairs(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    rows = pairs.join(classes.select(F.col("cid").alias("a"), F.col("bytes").alias("bytes_a")), "a")
    rows = rows.join(classes.select(F.col("cid").alias("b"), F.col("bytes").alias("bytes_b")), "b")
    rated = rows.select("a", "b", "bytes_a", "bytes_b").mapInArrow(_rated, "a long, b long, rate double")
    return written(rated.where(F.col("rate") >= _least(similarity)), "near-rated")


def _sets_of(used: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(cid, shingles) of the classes ``used`` (distinct cids), as a written table."""
    wanted = written(classes.join(used, "cid", "left_semi").select("cid", "hi", "lo", "first_doc"), "near-wanted")
    ids = wanted.select(F.col("first_doc").alias("doc_id")).distinct()
    # Whole texts are the largest rows here: they are shuffled only for more ids than can be broadcast.
    texts = docs.join(F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    sets = texts.select("text").mapInArrow(_sets(words), "hi long, lo long, shingles binary")
    sets = sets.join(wanted, ["hi", "lo"]).groupBy("cid").agg(F.first("shingles").alias("shingles"))
    return written(sets, "near-sets")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those pairs whose full shingle sets reach the similarity."""
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), classes, docs, words)
    rows = pairs.select("a", "b").join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("set_a")), "a")
    rows = rows.join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("set_b")), "b")
    percent = round(100 * similarity)
    return written(rows.select("a", "b", "set_a", "set_b").mapInArrow(_confirmed(percent), "a long, b long"), "near-links")


def classes_of(docs: DataFrame, words: int = SHINGLE_WORDS) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): every row's class by its set, and one row a class with its signature."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(own.mapInArrow(_signed(words), "doc_id long, n_shingles long, hi long, lo long, sig binary, bytes binary"), "near-rows")
    full = rows.where("n_shingles > 0 and doc_id is not null")
    one = full.groupBy("hi", "lo").agg(F.min("doc_id").alias("first_doc"), F.first("sig").alias("sig"), F.first("bytes").alias("bytes"), F.first("n_shingles").alias("n"))
    classes = one.withColumn("cid", F.monotonically_increasing_id())
    return rows.drop("sig", "bytes"), written(classes, "near-classes")


def _sorted_orders(rows: DataFrame) -> DataFrame:
    return rows.repartitionByRange("tree", "key", "cid").sortWithinPartitions("tree", "key", "cid")


def forest(classes: DataFrame) -> DataFrame:
    """The first pass over all orders, as a written table: see ``_nearest``."""
    key = F.expr(f"substring(sig, tree * {4 * DEPTH} + 1, {4 * DEPTH})").alias("key")
    orders = classes.select("cid", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("tree", key, "cid")
    return written(_sorted_orders(orders).mapInArrow(_nearest, _FOREST), "near-forest")


def wide_candidates(found: DataFrame, classes: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Of each class in a crowded region, the best-rated neighbour that a task meets in another component
    and that may reach the similarity."""
    known = classes.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").select("cid", "bytes", F.coalesce("root", "cid").alias("group"))
    rows = found.where("b is null").select("tree", "key", F.col("a").alias("cid")).join(known, "cid")
    return _sorted_orders(rows).mapInArrow(_wide(_least(similarity)), "a long, b long, rate double")


_CELL = ["tree", "prefix", "ci", "cj"]
_MET = "a long, b long, tree int, prefix binary, ci int, cj int, side int, group long"


def region_cells(found: DataFrame, classes: DataFrame, roots: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of every region of two components or more, dealt over cells in which any two rows of
    different components meet at least once.

    The rows of a region's largest component are already linked, so they meet only the others.
    """
    rows = found.where("b is null").select("tree", F.expr(f"substring(key, 1, {4 * MIN_DEPTH})").alias("prefix"), F.col("a").alias("cid"))
    rows = rows.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("group", F.coalesce("root", "cid")).drop("root")
    region = ["tree", "prefix"]
    sizes = rows.groupBy(*region, "group").agg(F.count(F.lit(1)).alias("n_rows")).groupBy(*region).agg(
        F.max(F.struct("n_rows", "group")).alias("top"), F.sum("n_rows").alias("n_all"), F.count(F.lit(1)).alias("n_groups"))
    blocks = lambda n: F.greatest(F.least(F.ceil(n / F.lit(block)), F.lit(MANY_BLOCKS)), F.ceil(n / F.lit(GROWN * block))).cast("int")
    sizes = sizes.where("n_groups > 1").select(*region, F.col("top.group").alias("top"), blocks(F.col("top.n_rows")).alias("m"), blocks(F.col("n_all") - F.col("top.n_rows")).alias("k"))
    dealt = rows.join(written(sizes, "near-regions"), region).withColumn("minor", F.col("group") != F.col("top"))
    own = dealt.withColumn("at", F.pmod(F.xxhash64("cid"), F.when(F.col("minor"), F.col("k")).otherwise(F.col("m"))).cast("int"))
    cells = F.expr("""explode(if(minor,
        concat(transform(sequence(0, k - 1), j -> struct(least(at, j) as ci, greatest(at, j) as cj, if(at <= j, 0, 1) as side)),
               transform(sequence(1, m), j -> struct(at as ci, -j as cj, 0 as side))),
        transform(sequence(0, k - 1), i -> struct(i as ci, -1 - at as cj, 1 as side))))""")
    own = own.select(*region, "cid", "group", cells.alias("c")).select(*region, "c.ci", "c.cj", "c.side", "cid", "group")
    return own.join(classes.select("cid", "n", "bytes"), "cid")


def _cells_of(batches):
    """The rows of each cell in turn; the batches are sorted by cell."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not rows.num_rows:
            continue
        rows = rows.combine_chunks()
        names = [rows.column(c).to_pylist() for c in _CELL]
        keys = list(zip(*names))
        starts = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
        for lo, hi in zip(starts, starts[1:]):
            yield keys[lo], rows.slice(lo, hi - lo)
        held = rows.slice(starts[-1])
    if held is not None:
        yield tuple(held.column(c)[0].as_py() for c in _CELL), held


def _meetings(side: np.ndarray, group: np.ndarray, diagonal: bool):
    """For each row of the first side, the rows of other components that it meets."""
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    for at, i in enumerate(first):
        others = first[at + 1 :] if diagonal else second
        others = others[group[others] != group[i]]
        if len(others):
            yield i, others


def _met(least: float, percent: int):
    def run(batches):
        out: list[list[np.ndarray]] = []
        dense = []
        for cell, rows in _cells_of(batches):
            cid, group, n, side = (rows.column(c).to_numpy() for c in ("cid", "group", "n", "side"))
            low = np.frombuffer(b"".join(rows.column("bytes").to_pylist()), np.uint8).reshape(-1, _VALUES)
            a, b = [], []
            for i, others in _meetings(side, group, cell[2] == cell[3]):
                others = others[100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])]
                others = others[_share(low[others], low[i]) >= least]
                a.append(np.full(len(others), i))
                b.append(others)
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
            if len(a) > DENSE * len(cid):
                used = np.union1d(a, b)
                dense.append((cell, cid[used], side[used], group[used]))
            elif len(a):
                out.append([cid[a], cid[b]])
            if len(out) + len(dense) >= 256:
                yield _met_batch(out, dense)
                out, dense = [], []
        yield _met_batch(out, dense)
    return run


def _met_batch(out: list[list[np.ndarray]], dense: list[tuple]) -> pa.RecordBatch:
    """Candidate pairs, and after them, without b, the rows of cells that have too many."""
    pairs = np.unique(np.sort(np.concatenate([np.stack(x, axis=1) for x in out]), axis=1), axis=0) if out else np.zeros((0, 2), np.int64)
    n, sizes = len(pairs), [len(d[1]) for d in dense]
    one = lambda k, kind: pa.concat_arrays([pa.nulls(n, kind), pa.array([d[0][k] for d, size in zip(dense, sizes) for _ in range(size)], kind)])
    own = lambda k, kind: pa.concat_arrays([pa.nulls(n, kind)] + [pa.array(d[k], kind) for d in dense])
    a = pa.concat_arrays([pa.array(pairs[:, 0], pa.int64())] + [pa.array(d[1], pa.int64()) for d in dense])
    b = pa.concat_arrays([pa.array(pairs[:, 1], pa.int64()), pa.nulls(sum(sizes), pa.int64())])
    return pa.RecordBatch.from_arrays(
        [a, b, one(0, pa.int32()), one(1, pa.binary()), one(2, pa.int32()), one(3, pa.int32()), own(2, pa.int32()), own(3, pa.int64())],
        ["a", "b", *_CELL, "side", "group"])


def region_candidates(found: DataFrame, classes: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """All pairs of a region that lie in different components and may reach the similarity, as a written
    table; cells with more than ``DENSE`` of them a row give their rows instead, without b."""
    cells = region_cells(found, classes, roots)
    rows = cells.repartition(*_CELL).sortWithinPartitions(*_CELL)
    return written(rows.mapInArrow(_met(_least(similarity), round(100 * similarity)), _MET), "near-met")


def _dense(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        cid, group, side = (rows.column(c).to_numpy() for c in ("cid", "group", "side"))
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
        n = np.array([len(x) for x in sets])
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        starts = np.cumsum(n) - n
        marked = np.zeros(codes.max() + 1, np.int64)
        a, b = [], []
        diagonal = rows.column("ci")[0].as_py() == rows.column("cj")[0].as_py()
        for i, others in _meetings(side, group, diagonal):
            own = codes[starts[i] : starts[i] + n[i]]
            marked[own] = 1
            both = np.add.reduceat(marked[codes], starts)[others]
            marked[own] = 0
            others = others[100 * both >= percent * (n[others] + n[i] - both)]
            a.append(cid[np.full(len(others), i)])
            b.append(cid[others])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        node, root = stars(a, b) if len(a) else (a, b)
        return pa.table({"a": pa.array(node, pa.int64()), "b": pa.array(root, pa.int64())})
    return run


def _dense_links(rows: DataFrame, classes: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The links of the cells whose rows are given, from their full sets."""
    if rows.isEmpty():
        return rows.select("a", "b")
    rows = rows.select(*_CELL, "side", "group", F.col("a").alias("cid"))
    sets = _sets_of(rows.select("cid").distinct(), classes, docs, words)
    return written(rows.join(sets, "cid").groupBy(*_CELL).applyInArrow(_dense(round(100 * similarity)), "a long, b long"), "near-dense")


def _best_partners(rated: DataFrame) -> DataFrame:
    """The best-rated pair of every class."""
    ends = [F.struct(F.col(x).alias("x"), F.col(y).alias("y"), "rate") for x, y in ("ab", "ba")]
    best = rated.select(F.explode(F.array(*ends)).alias("e")).groupBy("e.x").agg(F.max(F.struct("e.rate", "e.y")).alias("m"))
    return best.select(F.least("x", "m.y").alias("a"), F.greatest("x", "m.y").alias("b")).distinct()


def links(docs: DataFrame, classes: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, root) of the components of classes, from confirmed links alone.

    The first pass meets each class with the next in every order and with its
    hubs, and confirms the best-rated pair of each. The second looks on to
    all neighbours in other components and again confirms the best-rated pair
    of each, which joins most of a crowd's parts. The third confirms every
    pair that shares a region and is still between two components.
    """
    found = forest(classes)
    near = _rated_pairs(found.where("b is not null").select("a", "b").distinct(), classes, similarity)
    best = written(_best_partners(near), "near-best")
    linked = _verified(best, classes, docs, words, similarity)
    roots = components(linked)
    further = _best_partners(wide_candidates(found, classes, roots, similarity))
    further = written(further.join(best, ["a", "b"], "left_anti"), "near-further")
    linked = linked.unionByName(_verified(further, classes, docs, words, similarity))
    roots = components(linked)
    met = region_candidates(found, classes, roots, similarity)
    apart = met.where("b is not null").select("a", "b").unionByName(_between(near, roots)).distinct()
    rest = written(apart.join(best.unionByName(further), ["a", "b"], "left_anti"), "near-apart")
    linked = linked.unionByName(_verified(rest, classes, docs, words, similarity))
    return components(linked.unionByName(_dense_links(met.where("b is null"), classes, docs, words, similarity)))


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those pairs whose classes are in different components."""
    joined = pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(
        roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    return joined.where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    rows, classes = classes_of(docs, words)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    roots = links(own, classes, words, similarity)
    # A row is linked with its class, and a class with the others of its component.
    named = classes.join(roots, classes["cid"] == roots["node"], "left").select("hi", "lo", "first_doc", F.coalesce("root", "cid").alias("root"))
    name = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    by_print = named.join(name, "root").select("hi", "lo", "component_id")
    out = rows.join(by_print, ["hi", "lo"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def without_near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of every component; rows without a ``doc_id`` stay."""
    found = near_duplicates(docs, words, similarity)
    name = fresh("gone", docs)
    gone = found.where(~F.col("kept")).where("doc_id is not null").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")
