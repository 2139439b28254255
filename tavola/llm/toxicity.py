"""Toxicity scores from a counterfactually regularised linear classifier.

A text is scored by the sum of a weight for each of its distinct words. A
word's weight is the sum of those of its features: the word and its prefixes
(so that compounds and inflections of a learned stem count). Weights are
learned by logistic regression with a counterfactual penalty: in every
training text the identity terms are swapped for others of their group, and
the squared change of the score is added to the loss, so that a mention of a
group cannot carry weight of its own even where the sample is biased.

The fit uses a bounded sample of labels, ``SAMPLE_ROWS`` distinct pairs of id
and label, those of the smallest hash of their id; an id that many rows hold
gives the text of the smallest hash. Its features are counted in Spark; the
``FEATURES`` most telling ones go into the fit, which bounds the model's width
and no rows. Every whole text is scored.

Defined results: a null or empty text scores as the base rate; a null label or
a label of an unknown document teaches nothing; without labelled rows of both
kinds every score is below 1e-15. Repeated rows are scored each; other columns
are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.llm.common import in_bytes, written

SAMPLE_ROWS = 12_000
FEATURES = 20_000
MIN_ROWS = 5
PREFIXES = (3, 4, 5, 6, 7)
COUNTERFACTUAL, RIDGE, STEPS = 4.0, 3e-5, 500
FOLDS, HELD_OUT_FOLD = 5, 0
#: Bytes of text that a task holds as arrays at a time: in the fit, where a word has several features, and in scoring.
FIT_BYTES, SCORE_BYTES = 1 << 19, 1 << 22

# Groups of identity terms; a term is swapped for the others of its group.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("woman", "man", "girl", "boy", "frau", "mann", "femme", "homme", "mujer", "hombre"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant", "sikh", "mormon"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants", "sikhs", "mormons"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "indigenous", "arab", "american"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "transgender", "heterosexual", "homosexual", "trans", "nonbinary"),
    ("mexican", "chinese", "indian", "german", "french", "spanish", "russian", "turkish", "polish", "nigerian"),
    ("immigrants", "refugees", "natives", "locals", "foreigners", "migrants"),
    ("blind", "deaf", "disabled", "autistic", "paralyzed"),
    ("old", "young", "elderly", "teenage"),
)
_GROUP = {term: group for group in IDENTITY_GROUPS for term in group}


def held_out(column: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT_FOLD


def _distinct_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of a batch (letters only, lower case), and per distinct pair its row and word."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = lists.offsets.to_numpy()
    row = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(offsets))
    raw = lists.flatten().dictionary_encode()
    plain = pc.utf8_lower(pc.replace_substring_regex(raw.dictionary, r"[^\pL]+", "")).dictionary_encode()
    words = plain.dictionary.to_pylist()
    if not words:
        return words, np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = plain.indices.to_numpy(zero_copy_only=False).astype(np.int64)[raw.indices.to_numpy(zero_copy_only=False)]
    pairs = np.unique(row * len(words) + code)
    row, code = pairs // len(words), pairs % len(words)
    real = np.array([bool(w) for w in words])[code]
    return words, row[real], code[real]


def features(word: str) -> list[int]:
    """Signed 64-bit hashes of the word and its proper prefixes."""
    parts = [word + "$"] + [word[:n] for n in PREFIXES if n < len(word)]
    return [xxhash.xxh3_64_intdigest(p) - (1 << 63) for p in parts]


def swapped(word: str) -> list[str]:
    """The other terms of an identity term's group; none for other words."""
    return [t for t in _GROUP.get(word, ()) if t != word]


def _feature_counts(batches):
    """(feature, toxic, clean): documents of the batch by label that have the feature."""
    for batch in in_bytes(batches, FIT_BYTES):
        words, row, code = _distinct_words(batch.column("text"))
        toxic = batch.column("toxic").to_numpy().astype(np.int64)
        lists = [features(w) for w in words]
        size = np.array([len(x) for x in lists], np.int64)
        flat = np.array([f for x in lists for f in x], np.int64)
        distinct, place = np.unique(flat, return_inverse=True)
        start = np.cumsum(size) - size
        n = size[code]
        take = np.repeat(start[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        seen = np.unique(np.repeat(row, n) * max(1, len(distinct)) + place[take])
        doc, feature = seen // max(1, len(distinct)), seen % max(1, len(distinct))
        hit = np.bincount(feature, toxic[doc], len(distinct)).astype(np.int64)
        every = np.bincount(feature, minlength=len(distinct))
        yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(hit), pa.array(every - hit)], ["feature", "toxic", "clean"])


def _design(chosen: np.ndarray):
    """(id, toxic, columns, values, shift_columns, shift_values): a text over the chosen features, and what the swap changes."""
    def run(batches):
        place = {int(f): i for i, f in enumerate(chosen)}
        for batch in in_bytes(batches, FIT_BYTES):
            words, row, code = _distinct_words(batch.column("text"))
            own = [[place[f] for f in features(w) if f in place] for w in words]
            shift = {i: _shift(w, place) for i, w in enumerate(words) if w in _GROUP}
            x: list[dict[int, float]] = [{} for _ in range(batch.num_rows)]
            d: list[dict[int, float]] = [{} for _ in range(batch.num_rows)]
            for r, c in zip(row.tolist(), code.tolist()):
                for f in own[c]:
                    x[r][f] = x[r].get(f, 0.0) + 1.0
                for f, v in shift.get(c, {}).items():
                    d[r][f] = d[r].get(f, 0.0) + v
            pairs = lambda rows, kind: pa.array([list(getattr(e, kind)()) for e in rows], pa.list_(pa.int32() if kind == "keys" else pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("toxic"), pairs(x, "keys"), pairs(x, "values"), pairs(d, "keys"), pairs(d, "values")],
                ["id", "toxic", "columns", "amounts", "shift_columns", "shift_amounts"])
    return run


def _shift(word: str, place: dict[int, int]) -> dict[int, float]:
    """Mean change of the features when the term is swapped within its group."""
    out: dict[int, float] = {}
    others = swapped(word)
    for f in features(word):
        if f in place:
            out[place[f]] = out.get(place[f], 0.0) - 1.0
    for other in others:
        for f in features(other):
            if f in place:
                out[place[f]] = out.get(place[f], 0.0) + 1.0 / len(others)
    return out


class _Sparse:
    """Rows of (columns, amounts) with products from either side."""

    def __init__(self, columns: pa.Array, amounts: pa.Array, width: int) -> None:
        self.row = np.repeat(np.arange(len(columns)), pc.list_value_length(columns).to_numpy(zero_copy_only=False))
        self.column = pc.list_flatten(columns).to_numpy(zero_copy_only=False).astype(np.int64)
        self.amount = pc.list_flatten(amounts).to_numpy(zero_copy_only=False).astype(np.float64)
        self.shape = (len(columns), width)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.amount * w[self.column], self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.amount * g[self.row], self.shape[1])


def fit(x: _Sparse, shift: _Sparse, y: np.ndarray, counterfactual: float = COUNTERFACTUAL, ridge: float = RIDGE, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept by Adam on log loss + counterfactual * mean squared score change + ridge."""
    n, width = x.shape
    rate = min(max(y.mean(), 1e-6), 1 - 1e-6)
    w, b = np.zeros(width), float(np.log(rate / (1 - rate)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        error = (1 / (1 + np.exp(-np.clip(x.dot(w) + b, -35, 35))) - y) / n
        moved = shift.dot(w)
        g = np.append(x.back(error) + 2 * counterfactual / n * shift.back(moved) + 2 * ridge * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, width: int = FEATURES) -> tuple[dict[int, float], float]:
    """Feature weights and intercept from the labelled rows that are not held out."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    sample = known.where(~held_out("id")).distinct().orderBy(F.xxhash64("id"), "id", "toxic").limit(sample_rows)  # the bounded sample
    text = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = text.join(F.broadcast(sample), "id").select("id", "toxic", "text")  # at most sample_rows rows of two numbers
    # An id on many rows gives one row, the text of the smallest hash, so the fit is bounded whatever repeats.
    rows = written(rows.groupBy("id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")), "toxicity-sample")
    counts = rows.mapInArrow(_feature_counts, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sizes = rows.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in sizes}
    if len(n) < 2:
        return {}, -40.0
    # Signed root of the log-likelihood ratio against the base rate.
    p = n[1] / (n[0] + n[1])
    gain = F.expr(f"toxic * ln((toxic + 0.5) / ((toxic + clean) * {p!r}D + 0.5)) + clean * ln((clean + 0.5) / ((toxic + clean) * {1 - p!r}D + 0.5))")
    best = counts.where(F.col("toxic") + F.col("clean") >= MIN_ROWS).orderBy(gain.desc(), "feature").limit(width).select("feature")
    chosen = np.sort(best.toArrow().column("feature").to_numpy())
    table = rows.mapInArrow(_design(chosen), "id long, toxic int, columns array<int>, amounts array<double>, shift_columns array<int>, shift_amounts array<double>")
    got = table.toArrow().sort_by([("id", "ascending"), ("toxic", "ascending")])
    column = lambda name: got.column(name).combine_chunks()
    x = _Sparse(column("columns"), column("amounts"), len(chosen))
    shift = _Sparse(column("shift_columns"), column("shift_amounts"), len(chosen))
    w, b = fit(x, shift, got.column("toxic").to_numpy().astype(np.float64))
    return {int(f): float(v) for f, v in zip(chosen, w) if abs(v) > 1e-6}, b


def _scores(texts: pa.Array, weights: dict[int, float], intercept: float) -> np.ndarray:
    words, row, code = _distinct_words(texts)
    own = np.array([sum(weights.get(f, 0.0) for f in features(w)) for w in words]) if words else np.zeros(0)
    logit = intercept + np.bincount(row, own[code], len(texts))
    return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))


def _scored(weights: dict[int, float], intercept: float):
    def run(batches):
        for batch in in_bytes(batches, SCORE_BYTES):
            score = pa.array(_scores(batch.column("text"), weights, intercept))
            at = batch.schema.names.index("text")
            keep = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [score], [batch.schema.names[i] for i in keep] + ["score"])
    return run


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, width: int = FEATURES) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on) of every row of ``docs``."""
    weights, intercept = train(docs, labels, sample_rows, width)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_scored(weights, intercept), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, width: int = FEATURES) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, all columns unchanged."""
    weights, intercept = train(docs, labels, sample_rows, width)

    def run(batches):
        for batch in in_bytes(batches, SCORE_BYTES):
            yield batch.filter(pa.array(_scores(batch.column("text"), weights, intercept) < 0.5))

    rows = docs.withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(run, rows.schema)
