"""Divergence, importance resampling and SimHash against brute force, on hand-made and on provided rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tests.conftest import SF_SMALL
from tests.llm.conftest import ODD, frame

from tavola.llm import divergence, importance, simhash
from tavola.llm.common import read

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Columns with the names that the operators use inside.
CLASHING = ("term", "n", "docs", "total", "gb", "tb", "at", "place", "pid", "uid", "before", "eligible", "mask", "key", "print", "root", "a", "b", "component_id", "rank")


@pytest.fixture(scope="module")
def docs(shared):
    return read(shared, SF_SMALL, "documents").unionByName(frame(shared, [(r[0] and -r[0], *r[1:]) for r in ODD])).cache()


def crowded(docs):
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit(7))
    return docs


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- divergence

def brute_divergence(rows, least):
    counts, total, held = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[lang or "", source or ""].update(found)
        total[lang or ""].update(found)
        held[lang or ""].update(set(found))
    out = []
    share = lambda n, whole, v: 1 + 10**9 * (n + 2) // (whole + 2 * v)
    for lang in total:
        kept = [t for t in total[lang] if held[lang][t] >= least]
        whole = sum(total[lang][t] for t in kept)
        q = [share(total[lang][t], whole, len(kept)) for t in kept]
        own = {s: [counts[x, s][t] for t in kept] for x, s in counts if x == lang}
        p = {s: [share(n, sum(ns), len(kept)) for n in ns] for s, ns in own.items()}
        for s in own:
            apart = [(-sum((x - y) ** 2 // (x + y) for x, y in zip(p[s], p[o])), o.encode(), o) for o in own if o != s]
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(apart))]
            best = [(-((x - y) ** 2 // (x + y)), t.encode(), t) for t, n, x, y in zip(kept, own[s], p[s], q) if n and x > y]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(best)[:10])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("blocks", [(64, 2048), (3, 50)])
def test_divergence_is_that_of_all_pairs_however_the_cube_is_cut(docs, blocks):
    want = brute_divergence([(r["text"], r["lang"], r["source"]) for r in docs.collect()], 3)
    assert tuples(divergence.audit(docs, 3, *blocks)) == want


def test_divergence_of_odd_tables(shared, docs):
    assert divergence.audit(docs.limit(0)).count() == 0
    rows = [(None, None, "xx", f"s{i}", 0) for i in range(3)] + [(1, "one lone source", "yy", "s", 0), (1, "one lone source", "yy", "s", 0)]
    got = tuples(divergence.audit(frame(shared, rows)))
    assert [r for r in got if r[0] == "xx"] == sorted((("xx", f"s{i}", "pair", f"s{j}", 0, 1 + [x for x in range(3) if x != i].index(j)) for i in range(3) for j in range(3) if i != j), key=repr)
    assert not [r for r in got if r[0] == "yy"]
    both = [(i, "Äpfel ÄPFEL apple", "yy", "s" if i % 2 else "t", 0) for i in range(20)]
    assert tuples(divergence.audit(crowded(frame(shared, both)))) == brute_divergence([(r[1], r[2], r[3]) for r in both], 10)
    long = [(i, "ab " * 200_000 + f"w{i}", "l", f"s{i}", 0) for i in range(2)]
    assert tuples(divergence.audit(frame(shared, long), 1)) == brute_divergence([(r[1], r[2], r[3]) for r in long], 1)


def test_shares_stay_exact_beyond_64_bits():
    n = np.array([0, 5, 10**13, 3 * 10**15], np.int64)
    assert divergence.shares(n, 10**16, 7).tolist() == [1 + 10**9 * (x + 2) // (10**16 + 14) for x in n.tolist()]


# --- importance

def brute_importance(docs, target, words=1, percent=10):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i:i + m]).encode()) % 10000 for m in range(1, words + 1) for i in range(len(w) - m + 1)]

    held = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in held for b in f), Counter(b for x in target for b in features(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + 10000) / ((s[b] + 1.0) * (t.total() + 10000)))) for b in s}
    out = []
    for i, n, f in held:
        weight = sum(gain[b] for b in f)
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((-score, i is None, i or 0, n) for i, w, n, _, score in out if w >= 20)
    drawn = able[: percent * len(able) // 100]
    left = Counter(drawn)
    result = []
    for i, w, n, weight, score in out:
        key = (-score, i is None, i or 0, n)
        if w >= 20 and left[key] > 0:
            left[key] -= 1
            result.append((i, n, weight, score, True))
        else:
            result.append((i, n, weight, score, False))
    return sorted(result, key=repr), drawn


@pytest.mark.parametrize("words", [1, 3])
def test_resampling_is_that_of_every_feature(shared, docs, words):
    docs = docs.unionByName(docs.where("doc_id % 7 = 0")).repartition(5)
    target = read(shared, SF_SMALL, "benchmark")
    got = importance.resample(docs, target, max_words=words).collect()
    want, drawn = brute_importance([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], words)
    assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"] is not None) for r in got), key=repr) == want
    ranked = sorted((r["rank"], r["score"], r["doc_id"]) for r in got if r["rank"] is not None)
    assert [r for r, _, _ in ranked] == list(range(1, len(drawn) + 1))
    assert [(-s, i) for _, s, i in ranked] == [(s, i) for s, _, i, _ in drawn]


def test_resampling_of_odd_tables(shared, docs):
    target = read(shared, SF_SMALL, "benchmark")
    assert importance.resample(docs.limit(0), target).count() == 0
    assert importance.resample(docs, target.limit(0)).count() == docs.count()
    plain = tuples(importance.resample(docs, target))
    assert tuples(importance.resample(crowded(docs), crowded(target))) == plain
    same = frame(shared, [(None, "one text of more than twenty words " * 4, "en", "s", 1)] * 50)
    assert sorted(r["rank"] for r in importance.resample(same, target, percent=100).collect()) == list(range(1, 51))


def test_crcs_of_matrices_are_those_of_bytes():
    rng = random.Random(4)
    words = ["", "x" * 5000, "ä" * 300, "\U0001F600"] + ["".join(rng.choices("abcé0", k=rng.randint(1, 30))) for _ in range(500)]
    assert importance.crc32s(pa.array(words)).tolist() == [zlib.crc32(w.encode()) for w in words]
    assert importance.crc32s(pa.array(words).slice(7, 90)).tolist() == [zlib.crc32(w.encode()) for w in words[7:97]]


# --- simhash

def brute_print(text, size):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints, radius):
    """The smallest print of each print's component, by all pairs."""
    own = sorted(set(prints))
    root = dict(zip(own, own))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    every = np.array(own, np.uint64)
    for p in own:
        for q in every[np.bitwise_count(every ^ np.uint64(p)) <= radius].tolist():
            x, y = sorted((find(p), find(q)))
            root[y] = x
    return {p: find(p) for p in own}


@pytest.mark.parametrize("size", [4, 5])
def test_simhash_components_are_those_of_all_pairs(shared, docs, size):
    rng = random.Random(size)
    base = [f"w{j}" for j in range(150)]
    near = [(10_000 + i, " ".join(f"x{i}" if j == i else w for j, w in enumerate(base)), "en", "s", 1) for i in range(rng.randint(40, 60))]
    docs = docs.unionByName(frame(shared, near))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    prints = [brute_print(t, size) for _, t in rows]
    root = brute_classes(prints, 4)
    least = defaultdict(list)
    for (i, _), p in zip(rows, prints):
        least[root[p]] += [i] if i is not None else []
    want = sorted(((i, f"{p:016x}", min(least[root[p]], default=None)) for (i, _), p in zip(rows, prints)), key=repr)
    assert tuples(simhash.near_duplicates(crowded(docs), size)) == want
    assert len({p for p in prints}) - len(set(root.values())) > 10
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_a_component_without_any_id_has_a_null_id(shared):
    got = tuples(simhash.near_duplicates(frame(shared, [(None, "some text", "en", "s", 1), (None, None, None, None, None), (4, "other text altogether", "en", "s", 1)])))
    assert [r[2] for r in got if r[0] is None] == [None, None] and [r[2] for r in got if r[0]] == [4]


def test_masks_cover_every_difference_within_the_radius():
    rng = random.Random(8)
    for held in (0, int(simhash.masks(0, 4, 1)[5])):
        family = 1 if not held else 2
        own = simhash.masks(held, 4, family)
        assert len(own) == 31 and all(int(m) & held == held and int(m) != held for m in own)
        free = [b for b in range(64) if not held >> b & 1]
        for _ in range(2000):
            apart = sum(1 << b for b in rng.sample(free, rng.randint(1, 4)))
            assert any(int(m) & apart == 0 for m in own)


@pytest.mark.parametrize("crowd,task_rows", [(16_384, 1_000_000), (4, 2000), (1, 4000)])
def test_divided_buckets_lose_no_link(shared, crowd, task_rows):
    """Crowds within few bits, so that buckets lie across tasks and are divided again."""
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (12, 40, 3), dtype=np.uint64))
    prints = np.unique(np.concatenate([(centres[:, None] ^ np.bitwise_xor.reduce(flips, axis=2)).ravel(), rng.integers(0, 1 << 63, 200, dtype=np.uint64)]))
    root = brute_classes(prints.tolist(), 4)
    df = shared.createDataFrame([(int(x),) for x in prints.view(np.int64)], "print long")
    edges = simhash.links(df, 4, crowd, task_rows).collect()
    mine = {p: p for p in prints.tolist()}

    def find(x):
        while mine[x] != x:
            x = mine[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a % (1 << 64)), find(b % (1 << 64))))
        mine[y] = x
    got = {p: find(p) for p in prints.tolist()}
    assert got == root
