"""Operators over documents against brute force, on hand-made and on provided rows."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tests.conftest import SF_SMALL
from tests.llm.conftest import ODD, frame

from tavola.llm import byte_bpe, components, line_dedup, lm_scoring, near_dup, packing, queries, secrets, toxicity
from tavola.llm.common import read

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def docs(shared):
    return read(shared, SF_SMALL, "documents").unionByName(frame(shared, [(r[0] and -r[0], *r[1:]) for r in ODD])).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def words(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


# --- secrets

PATTERNS = (("assign", re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 6),
            ("access", re.compile("AKIA[A-Z0-9]+"), 20), ("hex", re.compile("[0-9a-f]+"), 24))


def base_spans(text):
    found = []
    for k, (kind, pattern, least) in enumerate(PATTERNS):
        for m in pattern.finditer(text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= least:
                found.append((m.start(), k, m.end()))
    return [f"{PATTERNS[k][0]}:{s}:{e}" for s, k, e in sorted(found)]


def test_base_spans_are_those_of_the_patterns(docs, rows):
    got = Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in secrets.digest(secrets.scan(docs)).collect())
    want = Counter()
    for i, text in rows:
        spans = base_spans(text)
        n = Counter(s.split(":")[0] for s in spans)
        want[i, n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(spans).encode()).hexdigest()] += 1
    assert got == want


def test_opaque_values_count_only_where_few_own_them(shared):
    copied, own = "aA1bB2cC3dD4eE5fF6gG7hH8", "zZ9yY8xX7wW6vV5uU4tT3sS2"
    data = frame(shared, [(i, f"x {copied} y", "en", f"src{i}", 1) for i in range(3)] + [(9, f"x {own}", "en", "src0", 1), (10, None, None, None, None)])
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(data)).collect()}
    assert [got[0]["spans"], got[0]["n_copied"], got[0]["n_live"]] == ["", 1, 0]
    assert [got[9]["spans"], got[9]["n_copied"], got[9]["n_live"]] == ["opaque:2:26", 0, 1]
    assert secrets.digest(secrets.scan(data.limit(0))).count() == 0


def test_masked_texts_keep_everything_but_the_spans(shared):
    got = {r["doc_id"]: r["text"] for r in secrets.masked(frame(shared, ODD)).collect()}
    assert got[8] == 'kéy [SECRET]" <|endoftext|> \U0001F600 password:12345 token=token:abcdefgh'
    assert got[3] is None and got[4] == "" and len(got) == 9


# --- lines

def test_lines_stay_in_the_smallest_document(docs, rows):
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(strip))
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders[key(line)].add(i)
    want = Counter()
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        want[i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    got = line_dedup.dedup_lines(docs, keys_per_shard=50)
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in got.collect()) == want
    assert [c for c in got.columns if c in docs.columns] == docs.columns


def test_insertions_and_deletions_are_reversible(shared):
    docs = read(shared, SF_SMALL, "documents").select("doc_id", "text")
    state = lambda index: sorted((r["doc_id"], sorted(map(tuple, r["keys"]))) for r in index.drops().collect())
    half = line_dedup.LineIndex.build(docs.where("doc_id % 2 = 0"), keys_per_shard=20)
    before = state(half)
    whole = half.insert(docs.where("doc_id % 2 = 1"))
    assert state(whole) == state(line_dedup.LineIndex.build(docs, keys_per_shard=20))
    assert state(whole.delete(docs.where("doc_id % 2 = 1").select("doc_id"))) == before


def test_cuckoo_filter_has_no_false_negatives_and_forgets():
    rng = np.random.default_rng(1)
    hi, lo = rng.integers(-(2**63), 2**63, (2, 5000))
    made = line_dedup.CuckooFilter.holding(hi, lo)
    assert made.contains(hi, lo).all()
    made.delete(hi[:2500], lo[:2500])
    assert made.contains(hi[2500:], lo[2500:]).all() and made.contains(hi[:2500], lo[:2500]).mean() < 0.01


def test_postings_are_probed_batch_by_batch_with_copies_by_their_number(shared):
    assert line_dedup.salts_for(1000, 1) == line_dedup.SALTS and line_dedup.salts_for(10**9, 1) * line_dedup.POSTINGS_PER_COPY >= 10**9
    rng = np.random.default_rng(2)
    hi, lo = rng.integers(-(2**63), 2**63, (2, 100))
    kinds = {"shard": pa.int32(), "salt": pa.int32(), "kind": pa.int32(), "doc_id": pa.int64(), "hi": pa.int64(), "lo": pa.int64(), "cells": pa.binary()}
    batch = lambda *columns: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))
    filter_row = batch([0], [3], [0], [None], [None], [None], [line_dedup.CuckooFilter.holding(hi[:50], lo[:50]).to_bytes()])
    read = []

    def batches():
        for n, rows in enumerate([filter_row] + [batch([0], [3], [1], [i], [hi[i]], [lo[i]], [None]) for i in range(50)] + [batch([1], [3], [1], [7], [hi[0]], [lo[0]], [None])]):
            read.append(n)
            yield rows

    probe = line_dedup._probed(batches())
    assert next(probe).column("doc_id").to_pylist() == [0] and len(read) == 2
    assert [i for b in probe for i in b.column("doc_id").to_pylist()] == list(range(1, 50))
    docs = frame(shared, [(i, "a line that all documents hold", "en", "s", 1) for i in range(20)])
    plan = line_dedup.LineIndex.build(docs).drops()._jdf.queryExecution().toString()
    assert "CoGroup" not in plan and line_dedup.dedup_lines(docs).where("n_dropped = 1").count() == 19


def test_hostile_columns_and_empty_tables(shared):
    data = frame(shared, [(1, "a long enough line", 5, 6), (2, "a long enough line", 7, 8)], "doc_id long, text string, n_lines int, hi int")
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["hi"]) for r in line_dedup.dedup_lines(data).collect()) == [(1, 1, 0, 6), (2, 1, 1, 8)]
    none = frame(shared, [])
    for made in (line_dedup.dedup_lines(none), near_dup.near_duplicates(none), lm_scoring.score(none), packing.pack(none, RANKS, PATTERN),
                 byte_bpe.round_trip(none, RANKS, PATTERN), secrets.masked(none)):
        assert made.count() == 0


# --- toxicity

def test_toxicity_learns_from_its_folds_alone(shared):
    labels = read(shared, "/root/testdata/sf0.01", "labels")
    docs = read(shared, "/root/testdata/sf0.01", "documents").unionByName(frame(shared, [(-1, None, None, None, None), (-2, "", None, None, None)]))
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == docs.count() and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert got[-1]["score"] == got[-2]["score"] and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [i for i in truth if i in got and got[i]["held_out"]]
    assert sum(got[i]["predicted"] == truth[i] for i in held) / len(held) > 0.93
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    assert {r["doc_id"]: r["score"] for r in toxicity.score(docs, flipped).collect()} == {i: r["score"] for i, r in got.items()}


def test_counterfactual_penalty_takes_the_weight_off_a_group(shared):
    toxic = [(i, f"muslim idiot {'abcdefgh'[i % 8]}x", "en", "s", 1) for i in range(60)]
    clean = [(100 + i, f"people of {'abcdefgh'[i % 8]}x", "en", "s", 1) for i in range(60)]
    data = frame(shared, toxic + clean)
    labels = shared.createDataFrame([(r[0], int(r[0] < 100)) for r in toxic + clean], "doc_id long, toxic int")
    weights, _ = toxicity.train(data, labels)
    own = lambda w: sum(weights.get(f, 0.0) for f in toxicity.features(w))
    assert own("idiot") > 2 * own("muslim") and toxicity.train(data, labels.where("toxic = 0"))[0] == {}


# --- language model

class Brute:
    """The automaton written out: states, arcs and failure arcs over n-grams of words."""

    def __init__(self, texts, order=3, prior=lm_scoring.PRIOR):
        self.order, self.prior = order, prior
        self.counts = Counter()
        for w in texts:
            self.counts.update(tuple(w[i:i + m]) for m in range(1, order + 1) for i in range(len(w) - m + 1))
        ones = [n for k, n in self.counts.items() if len(k) == 1]
        self.total, self.types = sum(ones), len(ones)

    def share(self, state, word):
        if not state:
            return (self.counts[word,] + 1) / (self.total + self.types + 1)
        return (self.counts[state + (word,)] + self.prior * self.share(state[1:], word)) / (self.counts[state] + self.prior)

    def walk(self, w):
        state, weight = (), 0.0
        for word in w:
            at = state
            while at and not self.counts[at + (word,)]:
                weight += math.log10(self.prior / (self.counts[at] + self.prior))  # a failure arc
                at = at[1:]
            weight += math.log10(self.share(at, word))
            state = (at + (word,))[-(self.order - 1):]
            while state and not self.counts[state]:
                state = state[1:]
        return weight


def brute_scores(rows):
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    own = Brute([words(t) + [""] for i, t in rows if not held(i)])
    return [(i, held(i), len(words(t)) + 1, sum(own.counts[x,] > 0 for x in words(t) + [""]), own.total,
             sum(math.log10(own.share((), x)) for x in words(t) + [""]), own.walk(words(t) + [""])) for i, t in rows]


def same_scores(got, want):
    by = lambda x: (str(x[0]), x[2], round(x[5], 6))
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=by), sorted(want, key=by)):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9), (g, w)


@pytest.mark.parametrize("cut", [(2_000_000, 1_000_000), (3000, 500)])
def test_scores_are_those_of_the_whole_automaton(docs, rows, cut):
    same_scores(lm_scoring.score(docs.repartition(3), slice_tokens=cut[0], shard_keys=cut[1]).collect(), brute_scores(rows))


def test_arcs_do_not_depend_on_the_size_of_the_corpus(shared):
    trained = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 7 != 2)
    rare = [(trained, "a rare pair of words", "en", "s", 1)]
    for copies in (1, 200):
        rows = rare + [(10 + i, "other texts that fill the corpus up", "en", "s", 1) for i in range(copies)]
        got = lm_scoring.score(frame(shared, rows)).collect()
        same_scores(got, brute_scores([(r[0], r[1]) for r in rows]))
        own = next(r for r in got if r["doc_id"] == trained)
        assert own["score"] > own["base_score"]


def test_a_crowd_of_null_ids_is_cut_into_slices(shared):
    rng = random.Random(9)
    rows = [(None, " ".join(rng.choices("a b c d e f".split(), k=20)), "en", "s", 1) for _ in range(3000)]
    df = frame(shared, rows).coalesce(1)
    slices = df.selectExpr("doc_id", "false as held_out", "text").mapInArrow(lm_scoring._slices(5000), lm_scoring._SLICES).collect()
    assert len(slices) == 13 and max(s["tokens"] for s in slices) <= 5000 and sum(s["tokens"] for s in slices) == 63_000
    same_scores(lm_scoring.score(df, slice_tokens=5000).collect(), brute_scores([(r[0], r[1]) for r in rows]))
    long = [(1, "x y " * 4000, "en", "s", 1), (2, None, "en", "s", 1), (3, "z", "en", "s", 1)]
    same_scores(lm_scoring.score(frame(shared, long).coalesce(1), slice_tokens=1000).collect(), brute_scores([(r[0], r[1]) for r in long]))


def test_weights_of_a_state_add_up_to_one():
    rng = random.Random(4)
    own = Brute([[rng.choice("abc") for _ in range(rng.randint(0, 9))] + [""] for _ in range(300)], prior=2.5)
    types = sorted({k[0] for k in own.counts}) + ["never seen"]
    for state in [()] + [k for k in own.counts if len(k) < 3 and "" not in k]:
        assert math.isclose(sum(own.share(state, w) for w in types), 1, rel_tol=1e-9)


def test_packed_numbers_come_back():
    rng = np.random.default_rng(5)
    for values in (np.zeros(0, np.uint64), np.sort(rng.integers(0, 1 << 63, 1000, dtype=np.uint64)) * np.uint64(2), np.array([5, 3, 2**64 - 1, 0], np.uint64)):
        assert lm_scoring.unpacked(lm_scoring.packed(values)).tolist() == values.tolist()
        assert lm_scoring.unpacked_keys(lm_scoring.packed_keys(values)).tolist() == values.tolist()


# --- tokens

def reference_ids(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    import tiktoken
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)


def test_tree_and_chunks_give_the_plain_encoding():
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    rng = random.Random(2)
    texts = ["".join(rng.choice(" \n\t'resa1.é x9<\x85\x1c　\U0001F600") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 5000, " " * 3000 + "x", "it's we're they'll " * 200, "<|endoftext|>"]
    encode = byte_bpe.encoding(RANKS, PATTERN).encode_ordinary
    packed = packing.batch_ids(pa.array(texts + [None]), RANKS, PATTERN)
    bytes_of = byte_bpe._vocabulary(RANKS, PATTERN).__getitem__
    for text, own in zip(texts, packed):
        want = plain.encode(text, add_special_tokens=False).ids
        assert own.tolist() == want and byte_bpe.encode_tree(text, encode, rng.randint(1, 40)) == want, repr(text)
        assert byte_bpe.decode_tree(want, bytes_of, 3) == text.encode()
    assert packed[-1].tolist() == []


def test_round_trip_of_whole_documents(docs, rows):
    encode = byte_bpe.encoding(RANKS, PATTERN).encode_ordinary
    want = Counter()
    for i, text in rows:
        ids = encode(text or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    got = byte_bpe.round_trip(docs, RANKS, PATTERN, leaf_chars=100)
    assert Counter(tuple(r) for r in got.collect()) == want
    again = byte_bpe.decode(byte_bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in again.collect())


def contract_ids():
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    return lambda text: plain.encode(text, add_special_tokens=False).ids


def check_packing(pieces, rows):
    encode = contract_ids()
    wanted = defaultdict(list)
    for i, text in rows:
        wanted[i].append(np.array(encode(text or "") + [0], "<u4"))
    by_window = defaultdict(list)
    for p in pieces:
        by_window[p["sequence_id"]].append((p["offset"], p["length"]))
        assert any(len(ids) == p["doc_tokens"] and zlib.crc32(ids[p["start"]:p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for ids in wanted[p["doc_id"]])
    for own in by_window.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end and length > 0
            end += length
        assert end <= 1024
    total = sum(len(ids) for own in wanted.values() for ids in own)
    assert sum(p["length"] for p in pieces) == total
    return len(by_window) * 1024 / total - 1


def test_packing_covers_every_id_once_with_little_padding(docs, rows):
    added = packing.added_tokens(public_tokenizers.path(queries.TOKENIZER))
    pieces = packing.pack(docs.coalesce(1), RANKS, PATTERN, added=added).collect()
    assert check_packing(pieces, rows) < 0.02
    starts = defaultdict(list)
    for p in pieces:
        starts[p["doc_id"], p["doc_tokens"]].append((p["start"], p["length"]))
    for (_, total), own in starts.items():
        assert sum(n for _, n in own) % total == 0


def test_differencing_is_near_equal_and_raises_the_count():
    rng = random.Random(3)
    sizes = [rng.randint(1, 256) for _ in range(500)]
    part = packing.difference(sizes, 40)
    sums = np.bincount(part, weights=sizes, minlength=40)
    assert sums.max() - sums.min() <= 12 and sorted(set(part)) == list(range(40))
    assert [len(p) for p in packing.windows([600, 600, 600], 1024)] == [1, 1, 1] and packing.windows([]) == []


# --- near duplicates

def brute_components(rows, size, percent=80):
    sets = {}
    for i, text in rows:
        w = words(text)
        sets.setdefault(i, {tuple(w[j:j + size]) for j in range(max(1, len(w) - size + 1))} if w else set())
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b]) if sets[a] and sets[b] else 0
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("size", [4, 5])
def test_components_are_those_of_all_pairs(docs, rows, size):
    want = brute_components(rows, size)
    got = near_dup.near_duplicates(docs, size).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["component_id"] == r["doc_id"])
        else:
            assert r["component_id"] is None and not r["kept"]


def test_a_crowd_of_near_copies_is_one_component(shared):
    rng = random.Random(5)
    base = [f"w{j}" for j in range(120)]
    rows = [(0, " ".join(base), "en", "s", 1)]
    for i in range(1, 200):
        own = list(base)
        own[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(own), "en", "s", 1))
    got = near_dup.near_duplicates(frame(shared, rows), 4).collect()
    assert {r["component_id"] for r in got} == {0}
    assert near_dup.without_near_duplicates(frame(shared, rows), 4).count() == 1


@pytest.mark.parametrize("dense", [8, 0])
def test_links_inside_a_crowd_of_unlinked_texts_are_found(shared, monkeypatch, dense):
    """Any two share 0.76 of their shingles; one in ten has a partner at 0.8 or more somewhere in the crowd."""
    monkeypatch.setattr(near_dup, "DENSE", dense)
    monkeypatch.setattr(near_dup, "BLOCK", 256)
    base = [f"c{j}" for j in range(200)]
    rows = [(i, " ".join(base + [f"o{i}x{j}" for j in range(28)]), "en", "s", 1) for i in range(900)]
    rows += [(1000 + i, " ".join(base + [f"o{i}x{j}" for j in range(12)] + [f"p{i}x{j}" for j in range(16)]), "en", "s", 1) for i in range(0, 900, 10)]
    want = brute_components([(r[0], r[1]) for r in rows], 4)
    assert len({root for _, root in want.values()}) == 900
    got = near_dup.near_duplicates(frame(shared, rows), 4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


@pytest.mark.parametrize("many,grown", [(64, 16), (2, 3)])
def test_any_two_rows_of_a_region_meet_in_a_cell(shared, monkeypatch, many, grown):
    monkeypatch.setattr(near_dup, "MANY_BLOCKS", many)
    monkeypatch.setattr(near_dup, "GROWN", grown)
    n = 90
    found = shared.createDataFrame([(i, None, 0, bytes(32)) for i in range(n)], "a long, b long, tree int, key binary")
    classes = shared.createDataFrame([(i, 5, b"") for i in range(n)], "cid long, n long, bytes binary")
    roots = shared.createDataFrame([(i, 0) for i in range(1, 40)], "node long, root long")
    cells = defaultdict(lambda: ([], []))
    rows = near_dup.region_cells(found, classes, roots, block=8).collect()
    for r in rows:
        cells[r["ci"], r["cj"]][r["side"]].append((r["cid"], r["group"]))
    met = set()
    for (ci, cj), (first, second) in cells.items():
        assert len(first) + len(second) <= 2 * 2.5 * 8 * grown
        for x, g in first:
            met.update((min(x, y), max(x, y)) for y, h in (first if ci == cj else second) if g != h)
    group = lambda i: 0 if i < 40 else i
    assert met == {(x, y) for y in range(n) for x in range(y) if group(x) != group(y)}
    if many == 2:
        assert len(rows) < 5 * n


def test_more_ids_than_can_be_broadcast_give_the_same_components(shared, monkeypatch):
    rng = random.Random(7)
    base = [f"v{j}" for j in range(60)]
    rows = [(i, " ".join(base[:j] + [f"y{i}"] + base[j + 1:]), "en", "s", 1) for i in range(30) for j in [rng.randrange(60)]]
    rows += [(100 + i, f"lonely text number {i} of its own kind", "en", "s", 1) for i in range(5)]
    want = brute_components([(r[0], r[1]) for r in rows], 4)
    monkeypatch.setattr(near_dup, "BROADCAST_IDS", 0)
    got = near_dup.near_duplicates(frame(shared, rows), 4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_star_rounds_agree_with_one_share(shared):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    df = shared.createDataFrame(edges, "a long, b long")
    one = {tuple(r) for r in components.components(df).collect()}
    assert {tuple(r) for r in components.components(df, share_edges=40).collect()} == one
    assert all(root == 1000 for node, root in one if node > 1000)


def test_queries_cover_every_operator_and_table_row():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 14)] + ["pipeline"]
