"""Resampling documents towards a target distribution by hashed-feature importance weights.

Features are runs of one to ``max_words`` consecutive words. Their buckets are
CRCs, worked out by matrices: the distinct features of a slice of rows are
grouped by byte length, each group is laid out as a two-dimensional uint8
array, all its CRCs are updated column by column, and the buckets are
scattered back to the features' places.

1. Each task adds up one histogram of ``BUCKETS`` numbers over its documents;
   the histograms are summed by bucket, for the documents and for the target.
2. A bucket's gain, floor(1000 ln) of the smoothed ratio of the two, is a
   table of ``BUCKETS`` numbers whatever the corpus; only it passes the driver.
3. A second pass adds up the gains of each document. The score adds a Gumbel
   draw made from the document's id, so that the highest scores are a sample
   without replacement in proportion to the weights.
4. Ranks come from one range-partitioned sort of the scores: a row's rank is
   its place in its partition after the sizes of those before. Equal rows are
   spread by a row number, and only partition sizes pass the driver.

Words are runs of ASCII digits and letters and of characters beyond ASCII, A-Z
lowered. Defined results: a null or empty text has no features and weight 0;
ties go to the smaller doc_id, after that to fewer features; a null doc_id is
drawn as the empty string and comes last among ties; repeated rows count, and
may be drawn, each; with an empty target gains follow the smoothing alone; an
empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.llm.common import in_slices, text_or_empty, word_bytes, words_of, written

BUCKETS, MAX_WORDS, LEAST_WORDS, PERCENT, SEED, SCALE = 10_000, 1, 20, 10, 2024, 1000
#: Longer features, of which a text of n bytes has at most n / LONG, go one at a time.
LONG = 256
_KEPT = word_bytes(b"0123456789abcdefghijklmnopqrstuvwxyz")
_SUMS = "doc_id long, n_words long, n_features long, weight long"


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


_CRC = _crc_table()


def crc32s(features: pa.Array) -> np.ndarray:
    """The CRC-32 of every string, by matrices of equal length."""
    features = pa.concat_arrays([features.cast(pa.string()), pa.array([], pa.string())])
    if not len(features):
        return np.zeros(0, np.uint32)
    offsets = np.frombuffer(features.buffers()[1], np.int32)[features.offset : features.offset + len(features) + 1].astype(np.int64)
    data = np.frombuffer(features.buffers()[2] or b"", np.uint8)
    lengths = np.diff(offsets)
    out = np.zeros(len(features), np.uint32)
    order = np.argsort(lengths, kind="stable")
    sizes, first = np.unique(lengths[order], return_index=True)
    for size, at in zip(sizes.tolist(), np.split(order, first[1:])):
        if size > LONG:
            out[at] = [zlib.crc32(data[offsets[i] : offsets[i] + size]) for i in at]
            continue
        columns = data[offsets[at] + np.arange(size)[:, None]]  # one row of the array a byte position
        crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
        for column in columns:
            crc = _CRC[(crc ^ column) & 0xFF] ^ (crc >> 8)
        out[at] = ~crc
    return out


def features_of(texts: pa.Array, max_words: int = MAX_WORDS):
    """For runs of 1, 2, .. words: row of each (in order), distinct features, and the code of each."""
    row, words, word = words_of(texts, _KEPT)
    yield row, words, word
    names, codes, at = words, word, np.arange(len(word))
    for m in range(2, max_words + 1):
        start = at[at + m - 1 < len(row)]
        inside = row[start] == row[start + m - 1]
        codes, at = codes[: len(start)][inside], start[inside]
        last = word[at + m - 1]
        found, codes = np.unique(codes * max(1, len(words)) + last, return_inverse=True)
        names = pc.binary_join_element_wise(names.take(pa.array(found // max(1, len(words)))), words.take(pa.array(found % max(1, len(words)))), " ")
        yield row[at], names, codes


def _histogram(max_words: int, buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in in_slices(batches):
            for _, names, codes in features_of(batch.column("text"), max_words):
                total += np.bincount((crc32s(names) % buckets)[codes], minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["bucket", "n"])
    return run


def bucket_counts(texts: DataFrame, max_words: int = MAX_WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of the column ``text`` each bucket holds."""
    own = texts.select(text_or_empty().alias("text")).mapInArrow(_histogram(max_words, buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in own.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains_of(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(SCALE ln) of the ratio of the two smoothed shares, in doubles."""
    k, whole_t, whole_s = len(target), float(target.sum()), float(corpus.sum())
    ratio = lambda t, s: (t + 1) * (whole_s + k) / ((s + 1) * (whole_t + k))
    return np.array([math.floor(SCALE * math.log(ratio(t, s))) for t, s in zip(target.astype(float).tolist(), corpus.astype(float).tolist())], np.int64)


def _weighed(shared, max_words: int):
    def run(batches):
        gains = shared.value
        for batch in in_slices(batches):
            n = batch.num_rows
            words, features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for m, (row, names, codes) in enumerate(features_of(batch.column("text"), max_words)):
                own = gains[crc32s(names) % len(gains)][codes]
                ends = np.searchsorted(row, np.arange(n + 1))
                weight += np.diff(np.append(0, np.cumsum(own))[ends])
                features += np.diff(ends)
                if m == 0:
                    words += np.diff(ends)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])
    return run


def gumbel(seed: int = SEED, column: str = "doc_id") -> Column:
    """floor(SCALE * draw) of the id's own standard Gumbel draw, in doubles."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-float(SCALE)) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def _ordered(rows: DataFrame) -> DataFrame:
    """``rows`` in rank order, as a written table: ``pid`` numbers the partitions, ``at`` the rows of each."""
    keys = [F.col("eligible").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("uid").asc()]
    held = rows.withColumn("uid", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id()  # partition number in the upper bits, row number in the lower 33
    held = held.select("doc_id", "n_features", "weight", "score", "eligible", place.alias("place"))
    return written(held.select("*", F.shiftright("place", 33).alias("pid"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")).drop("place"), "importance-order")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, max_words: int = MAX_WORDS,
             buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``; ``percent`` of those with ``least_words`` words are drawn and have a rank."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    gains = gains_of(bucket_counts(target, max_words, buckets), bucket_counts(own, max_words, buckets))
    sums = written(own.mapInArrow(_weighed(spark.sparkContext.broadcast(gains), max_words), _SUMS), "importance-weights")
    rows = sums.select("doc_id", "n_features", "weight", (F.col("weight") + gumbel(seed)).alias("score"), (F.col("n_words") >= least_words).alias("eligible"))
    ordered = _ordered(rows)
    sizes = ordered.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("eligible"), 1)).alias("k")).orderBy("pid").collect()  # one row a partition
    drawn = sum(r["k"] for r in sizes) * percent // 100
    before = np.cumsum([0] + [r["n"] for r in sizes]).tolist()
    offsets = spark.createDataFrame([(r["pid"], b) for r, b in zip(sizes, before)], "pid long, before long")
    rank = F.col("before") + F.col("at") + 1
    return ordered.join(F.broadcast(offsets), "pid").select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
