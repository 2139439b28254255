"""How far the sources of a language lie apart, by cube partitioning.

The work is a cube: groups x groups x terms, where a group is a (lang, source)
and terms are those in at least ``LEAST_DOCS`` documents of the language.

1. Documents are counted to (lang, source, term) rows, combined within each
   task before they are shuffled, so a source or a term of any size is spread.
2. Terms and sources fall into blocks of about ``TERM_BLOCK`` and
   ``GROUP_BLOCK`` by their hash. The counts of one group block in one term
   block are a slice: one row that holds the shares p of its groups.
3. A slice is replicated to all cells (group block, group block, term block)
   that need it. A cell has at most two slices, whatever the corpus, and gives
   the partial divergence of each of its pairs of groups over its terms. The
   divergence is symmetric, so a pair is worked out in one cell per term block.
4. Partial divergences are added up along the term axis, and each group ranks
   the other sources of its language.

Shares are p = 1 + floor(UNIT * (count + PRIOR) / (N + PRIOR * V)), for N
occurrences of the V terms, and a term contributes floor((p - q)^2 / (p + q)).
All of it is whole numbers: shares are at most 1e9 + 1, so squares fit in 64
bits; counts beyond 9e9 are divided as Python integers.

Terms are runs of ASCII letters and of characters beyond ASCII, A-Z lowered.
Defined results: a null text, lang or source is the empty string; each row is
a document, repeated rows too; a group without terms still has a row for each
other source; a language of one source has no pairs; a language without kept
terms has divergences of 0; an empty table gives no rows. Other columns are
not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tavola.llm.common import in_slices, text_or_empty, word_bytes, words_of, written

LEAST_DOCS, UNIT, PRIOR, TOP_TERMS = 10, 1_000_000_000, 2, 10
GROUP_BLOCK, TERM_BLOCK = 64, 2048
#: Counts from which on UNIT * count may leave 64 bits.
_WIDE = 9_000_000_000
_LETTERS = word_bytes(b"abcdefghijklmnopqrstuvwxyz")

_COUNTS = "lang string, source string, term string, n long, docs long"
_SLICE = ("lang string, gb long, tb long, blocks long, sources array<string>, empty binary, size long, g binary, t binary, p binary, "
          "source string, term string, value long")
_PARTIAL = "lang string, source string, item string, value long"


def _counted(batches):
    """Occurrences and documents of every (lang, source, term) of a slice of rows; the empty term marks the group itself."""
    for batch in in_slices(batches):
        n_rows = batch.num_rows
        if not n_rows:
            continue
        row, terms, codes = words_of(batch.column("text"), _LETTERS)
        langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
        names, group = np.unique(langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy(), return_inverse=True)
        # One sorted key a token: (group, term, row). A change of (group, term) starts an output row, any change a document.
        width = max(1, len(terms))
        keys = np.sort((group[row] * width + codes) * n_rows + row)
        pair = keys // n_rows
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(keys) else np.zeros(0, np.int64)
        fresh = np.append(True, keys[1:] != keys[:-1]).astype(np.int64) if len(keys) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(keys)))
        docs = np.add.reduceat(fresh, first) if len(first) else first
        own = np.concatenate([pair[first] // width, np.arange(len(names))])
        zero = np.zeros(len(names), np.int64)
        yield pa.RecordBatch.from_arrays(
            [langs.dictionary.take(pa.array(names[own] // len(sources.dictionary))), sources.dictionary.take(pa.array(names[own] % len(sources.dictionary))),
             pa.concat_arrays([terms.take(pa.array(pair[first] % width)), pa.array([""] * len(names), pa.string())]),
             pa.array(np.concatenate([n, zero])), pa.array(np.concatenate([docs, zero]))], ["lang", "source", "term", "n", "docs"])


def shares(n: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (n + PRIOR) / (total + PRIOR * terms)), exactly."""
    whole = total + PRIOR * terms
    if not terms:
        return np.ones(len(n), np.int64)
    if len(n) and max(int(n.max()), whole) >= _WIDE:
        return np.array([1 + UNIT * (x + PRIOR) // whole for x in n.tolist()], np.int64)
    return 1 + UNIT * (n + PRIOR) // whole


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """What terms of shares p and q contribute."""
    gap = p - q
    return gap * gap // (p + q)


def _sliced(rows: pa.Table) -> pa.Table:
    """The slice of one group block in one term block, and the best terms of each of its groups.

    Rows without a term are the groups: ``n`` is N, and each has the language's figures.
    """
    group = rows.filter(pc.is_null(rows.column("term"))).sort_by("source")
    own = rows.filter(pc.is_valid(rows.column("term")))
    names = group.column("source").to_pylist()
    place = {s: i for i, s in enumerate(names)}
    held = group.column("n").to_pylist()
    lang, gb, tb, blocks, size, terms, whole = (group.column(c)[0].as_py() for c in ("lang", "gb", "tb", "blocks", "size", "n_terms", "n_lang"))
    empty = np.array([shares(np.zeros(1, np.int64), n, terms)[0] for n in held], np.int64)
    g = np.array([place[s] for s in own.column("source").to_pylist()], np.int64)
    t, n = own.column("at").to_numpy(), own.column("n").to_numpy()
    p, value = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
    q = shares(own.column("total").to_numpy(), whole, terms)
    best: list[np.ndarray] = [np.zeros(0, np.int64)]
    words = own.column("term")
    order = np.argsort(pc.sort_indices(words.combine_chunks()).to_numpy())
    for i in range(len(names)):
        at = np.flatnonzero(g == i)
        p[at] = shares(n[at], held[i], terms)
        over = at[p[at] > q[at]]
        value[over] = apart(p[over], q[over])
        best.append(over[np.lexsort((order[over], -value[over]))[:TOP_TERMS]])
    top = np.concatenate(best)
    k = len(top)
    fixed = lambda v, kind: pa.array([v] * (k + 1), kind)
    first = lambda v, kind: pa.array([v] + [None] * k, kind)
    rest = lambda v, kind: pa.array([None] + v, kind)
    return pa.table({
        "lang": fixed(lang, pa.string()), "gb": fixed(gb, pa.int64()), "tb": fixed(tb, pa.int64()), "blocks": fixed(blocks, pa.int64()),
        "sources": first(names, pa.list_(pa.string())), "empty": first(empty.tobytes(), pa.binary()), "size": fixed(size, pa.int64()),
        "g": first(g.astype(np.int32).tobytes(), pa.binary()), "t": first(t.astype(np.int32).tobytes(), pa.binary()), "p": first(p.astype(np.int32).tobytes(), pa.binary()),
        "source": rest([names[i] for i in g[top].tolist()], pa.string()), "term": rest(words.take(pa.array(top)).to_pylist(), pa.string()), "value": rest(value[top].tolist(), pa.int64())})


def _matrix(row: dict) -> np.ndarray:
    """Shares of a slice: groups x terms of the block."""
    out = np.repeat(np.frombuffer(row["empty"], np.int64)[:, None], row["size"], axis=1)
    g, t, p = (np.frombuffer(row[c], np.int32) for c in "gtp")
    out[g, t] = p
    return out


def _cell(rows: pa.Table) -> pa.Table:
    """Partial divergences of the pairs of one cell: of the two slices, or of the one on the diagonal."""
    held = sorted(rows.to_pylist(), key=lambda r: r["gb"])
    first, second = held[0], held[-1]
    a = _matrix(first)
    b = a if len(held) == 1 else _matrix(second)
    left, right, value = [], [], []
    for i, p in enumerate(a):
        others = range(i + 1, len(b)) if len(held) == 1 else range(len(b))
        left += [first["sources"][i]] * len(others)
        right += [second["sources"][j] for j in others]
        value.append(apart(p, b[others.start : others.stop]).sum(axis=1))
    return pa.table({"lang": pa.array([first["lang"]] * len(left), pa.string()), "source": pa.array(left, pa.string()),
                     "item": pa.array(right, pa.string()), "value": pa.array(np.concatenate(value) if value else [], pa.int64())})


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of all documents, as a written table; the empty term stands for the group itself."""
    own = docs.select(*[text_or_empty(c).alias(c) for c in ("text", "lang", "source")])
    parts = own.mapInArrow(_counted, _COUNTS).groupBy("lang", "source", "term")
    return written(parts.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")


def slices(counts: DataFrame, least_docs: int = LEAST_DOCS, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """One row a slice, and after it, without ``sources``, the best terms of its groups, as a written table."""
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = written(kept.select("lang", "term", "total"), "divergence-terms")
    in_blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / F.lit(size)))
    langs = counts.where("term = ''").groupBy("lang").agg(F.count(F.lit(1)).alias("groups"))
    langs = langs.join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("total").alias("n_lang")), "lang", "left").na.fill(0, ["n_terms", "n_lang"])
    langs = written(langs.select("lang", "n_terms", "n_lang", in_blocks(F.col("groups"), group_block).alias("blocks"), in_blocks(F.col("n_terms"), term_block).alias("tbs")), "divergence-langs")
    placed = kept.join(langs, "lang").withColumn("tb", F.pmod(F.xxhash64("term"), F.col("tbs")))
    at = F.row_number().over(Window.partitionBy("lang", "tb").orderBy("term")) - 1  # a block has about TERM_BLOCK terms
    placed = written(placed.select("lang", "term", "total", "blocks", "tb", at.cast("long").alias("at")), "divergence-places")
    gb = F.pmod(F.xxhash64("source"), F.col("blocks")).alias("gb")
    entries = counts.join(placed, ["lang", "term"]).select("lang", gb, "tb", "source", "term", "at", "n", "total")
    entries = written(entries, "divergence-entries")
    sums = entries.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = counts.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").na.fill(0, ["n"]).join(langs, "lang")
    groups = groups.withColumn("gb", gb).withColumn("tb", F.explode(F.expr("sequence(0L, tbs - 1)")))
    groups = groups.join(placed.groupBy("lang", "tb").agg(F.count(F.lit(1)).alias("size")), ["lang", "tb"], "left").na.fill(0, ["size"])
    rows = entries.unionByName(groups.select("lang", "gb", "tb", "source", "n", "blocks", "size", "n_terms", "n_lang"), allowMissingColumns=True)
    return written(rows.groupBy("lang", "gb", "tb").applyInArrow(_sliced, _SLICE), "divergence-slices")


def pairs(sliced: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every pair of groups of a language, each once."""
    to = F.expr("explode(transform(sequence(0L, blocks - 1), j -> struct(least(gb, j) as x, greatest(gb, j) as y)))").alias("c")
    cells = sliced.where("sources is not null").select("lang", "gb", "tb", "sources", "empty", "size", "g", "t", "p", to)
    cells = cells.select("lang", "c.x", "c.y", "tb", "gb", "sources", "empty", "size", "g", "t", "p")
    partial = cells.groupBy("lang", "x", "y", "tb").applyInArrow(_cell, _PARTIAL)
    return partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source lies from every other source of its
    language (part ``pair``), and the terms it uses most above the language's share (part ``term``)."""
    sliced = slices(term_counts(docs), least_docs, group_block, term_block)
    each = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("e")
    both = pairs(sliced).select("lang", each, "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    terms = sliced.where("sources is null").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).cast("int").alias("rank")
    ranked = lambda part: part.select("*", rank)
    return ranked(both).unionByName(ranked(terms).where(F.col("rank") <= TOP_TERMS))
