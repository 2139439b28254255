"""Clashing names, repeated ids, hostile texts and empty tables, for every operator over rows of text."""

from __future__ import annotations

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.conftest import SF_SMALL
from tests.llm.conftest import ODD, frame
from tests.llm.test_text_operators import PATTERN, PATTERNS, RANKS, base_spans

import corpus_pipeline
from tavola.llm import line_dedup, near_dup, packing, secrets, toxicity
from tavola.llm.common import fresh, in_bytes, read
from tavola.llm.queries import TOKENIZER

#: Names that the operators use inside.
CLASHING = ("uid", "cuts", "base", "opaque", "spans", "hash", "found_id", "found_hash", "found_spans", "text_hash", "owner", "repository", "kind", "start", "end",
            "dropped_keys", "of_doc", "of_text", "print", "keys", "hi", "lo", "shard", "salt", "gone", "component_id", "kept", "toxic", "id", "score", "n", "__id", "__of_doc")


def crowded(docs):
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def docs(shared):
    return read(shared, SF_SMALL, "documents").unionByName(frame(shared, [(r[0] and -r[0], *r[1:]) for r in ODD])).cache()


def rows_of(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES], ids=lambda s: s[0].replace(" ", "-"))
def test_stages_take_any_column_names_and_empty_tables(shared, docs, stage):
    name, run = stage
    plain, other = run(shared, docs.coalesce(1), SF_SMALL), run(shared, crowded(docs).coalesce(1), SF_SMALL)
    if name != "packing":
        assert other.columns == [*docs.columns, *CLASHING]
        assert {tuple(r) for r in other.select(*CLASHING).distinct().collect()} == {tuple(f"own {c}" for c in CLASHING)}
    assert rows_of(other, plain.columns) == rows_of(plain, plain.columns)
    assert run(shared, docs.limit(0), SF_SMALL).count() == 0


def test_fresh_names_are_in_no_frame(shared):
    df = shared.range(1).selectExpr("id", "1 AS Gone", "2 AS gone_")
    assert fresh("gone", df) == "gone__" and fresh("other", df) == "other"


# --- secrets

def test_a_text_of_many_spans_is_scanned_in_linear_time(shared):
    rng = random.Random(1)
    token = lambda: "".join(rng.choices("0123456789abcdef", k=40))
    many = " ".join(token() for _ in range(20_000))
    mixed = " ".join(rng.choice([f"token={token()}", token(), f"Zz9_{token()}", "AKIA" + "A1" * 10, "word"]) for _ in range(8000))
    df = frame(shared, [(1, many, "en", "s", 1), (2, mixed, "en", "s", 1), (3, "é" + many, "en", "s", 1)])
    started = time.monotonic()
    got = {r["doc_id"]: r for r in secrets.scan(df).collect()}
    assert time.monotonic() - started < 120
    for i, text in ((1, many), (2, mixed), (3, "é" + many)):
        own = [f"{secrets.KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in got[i]["base"]]
        assert own == base_spans(text)
    few = frame(shared, [(1, many[:100_000], "en", "s", 1)])
    assert secrets.masked(few).where("text rlike '[0-9a-f]{24,}'").count() == 0


def test_opaque_runs_that_meet_no_base_span_are_kept(shared, docs):
    rng = random.Random(3)
    piece = lambda: rng.choice(["Zz9_" + "aB3-" * 6, "token = Ab1" + "cd2/" * 6, "0123456789abcdef" * 2, "x/" + "0123456789abcdef" * 2 + "Zq", "AKIA" + "Z9" * 12, "password:ab", " ", "é", "\n"])
    made = [(10**6 + i, "".join(piece() + rng.choice(["", " ", "="]) for _ in range(12)), "en", "s", 1) for i in range(300)]
    docs = docs.unionByName(frame(shared, made))
    got = secrets.candidates(docs)
    texts = {(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()}
    by_id = {}
    for i, text in texts:
        by_id.setdefault(i, []).append(text or "")
    total = 0
    for r in got.collect():
        want = []
        for text in by_id[r["doc_id"]]:
            base = [(int(s.split(":")[1]), int(s.split(":")[2])) for s in base_spans(text)]
            runs = [(m.start(), m.end()) for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}", text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
            want.append([x for x in runs if not any(b[0] < x[1] and x[0] < b[1] for b in base)])
        assert [(s["start"], s["end"]) for s in r["opaque"]] in want
        total += len(r["opaque"])
    assert total > 100


def brute_masked(rows):
    """Texts with every base span, and every opaque one that few own and that looks drawn, masked."""
    opaque = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
    mixed = lambda v: re.search("[0-9]", v) and re.search("[A-Za-z]", v)
    owners, repositories, found = {}, {}, []
    for i, text, source in rows:
        text = text or ""
        own = [(m.start(), k, m.end(), m[2] if k == 0 else m[0]) for k, (_, pattern, least) in enumerate(PATTERNS) for m in pattern.finditer(text)
               if len(m[2] if k == 0 else m[0]) >= least]
        own += [(m.start(), 3, m.end(), m[0]) for m in opaque.finditer(text) if mixed(m[0]) and not any(b[0] < m.end() and m.start() < b[2] for b in own)]
        for *_, value in own:
            owners.setdefault(value, set()).update([source] if source is not None else [])
            repositories.setdefault(value, set()).update([i] if i is not None else [])
        found.append((i, text, sorted(own)))
    out = Counter()
    for i, text, own in found:
        at, made = 0, ""
        for start, kind, end, value in own:
            copied = len(owners[value]) >= 3 or len(repositories[value]) >= 25
            if kind < 3 or (not copied and len(set(value)) >= 8):
                if start >= at:
                    made += text[at:start] + "[SECRET]"
                at = max(at, end)
        out[i, made + text[at:]] += 1
    return out


def test_masked_texts_are_those_of_brute_force(shared, docs):
    rng = random.Random(5)
    token = lambda n: "".join(rng.choices("abcdefXYZ0123456789_", k=n))
    common = [token(30) + "1a" for _ in range(3)]
    made = [(10**6 + i, " ".join(rng.choice([token(32), rng.choice(common), "word", f"secret={token(9)}", "AKIA" + "Q7" * 9]) for _ in range(6)), "en", f"src{i % 4}", 1) for i in range(200)]
    every = docs.unionByName(frame(shared, made))
    want = brute_masked([(r["doc_id"], r["text"], r["source"]) for r in every.collect()])
    assert Counter((r["doc_id"], r["text"] or "") for r in secrets.masked(every).collect()) == want
    assert sum("[SECRET]" in t for _, t in want) > 200


# --- line dedup

def test_many_rows_of_one_id_lose_the_lines_of_their_own_text(shared):
    rows = [(1, "a line that both hold\nanother line of the first", "en", "s", 1)]
    rows += [(5, f"a line that both hold\nown line number {i} of its row\nshort", "en", "s", 1) for i in range(3000)]
    df = frame(shared, rows + [(7, "own line number 17 of its row", "en", "s", 1)])
    index = line_dedup.LineIndex.build(df)
    assert index.repeats and max(len(r["keys"]) for r in index.drops(df).collect()) == 1
    got = line_dedup.dedup_lines(df).collect()
    assert len(got) == 3002
    assert sorted(r["text"] for r in got if r["doc_id"] == 5) == sorted(f"own line number {i} of its row\nshort" for i in range(3000))
    assert [(r["text"], r["n_lines"], r["n_dropped"]) for r in got if r["doc_id"] == 7] == [("", 1, 1)]


def test_shards_follow_the_keys_that_are_inserted(shared):
    lines = lambda lo, hi: frame(shared, [(d, "\n".join(f"shared line number {i}" for i in range(lo, hi)), "en", "s", 1) for d in (2 * lo + 1, 2 * lo + 2)])
    first, more = lines(0, 40), lines(1000, 1400)
    index = line_dedup.LineIndex.build(first, keys_per_shard=20)
    assert index.shards == 2
    grown = index.insert(more)
    assert grown.shards == 22 and grown.filters.count() <= 22
    every = first.unionByName(more)
    want = line_dedup.LineIndex.build(every, keys_per_shard=20)
    state = lambda i: sorted((r["doc_id"], sorted(map(tuple, r["keys"]))) for r in i.drops().collect())
    assert state(grown) == state(want) and len(state(want)) == 2
    assert state(grown.delete(more.select("doc_id"))) == state(index)


# --- toxicity

def test_repeated_ids_and_labels_teach_once(shared):
    docs, labels = read(shared, SF_SMALL, "documents"), read(shared, SF_SMALL, "labels")
    want = toxicity.train(docs, labels)
    ids = labels.where("toxic = 1").select("doc_id").limit(3)
    copies = docs.join(ids, "doc_id", "left_semi").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(2000)))).drop("i")
    got = toxicity.train(docs.unionByName(copies), labels.unionByName(labels))
    assert got[1] == pytest.approx(want[1]) and got[0].keys() == want[0].keys()


def test_toxicity_of_empty_tables_and_without_labels(shared, docs):
    labels = read(shared, SF_SMALL, "labels")
    assert toxicity.score(docs.limit(0), labels).count() == 0
    got = toxicity.score(docs, labels.limit(0)).collect()
    assert len(got) == docs.count() and all(r["score"] < 1e-15 and r["predicted"] == 0 for r in got)
    long = frame(shared, [(1, "word " * 400_000, "en", "s", 1), (2, "x" * 2_000_000, "en", "s", 1)])
    assert toxicity.score(long, labels).count() == 2


# --- packing

def test_ids_are_those_of_the_tokenizer_file_as_it_is_called():
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    added = packing.added_tokens(public_tokenizers.path(TOKENIZER))
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|><|endoftext|> y <|endoftext", "plain text", "", None, " <|endoftext|> \n"]
    for text, ids in zip(texts, packing.with_added(pa.array(texts), RANKS, PATTERN, added)):
        assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids
    assert added == {"<|endoftext|>": 50256}


def test_packed_pieces_hold_the_added_token(shared):
    added = packing.added_tokens(public_tokenizers.path(TOKENIZER))
    (piece,) = packing.pack(frame(shared, [(1, "a<|endoftext|>b", "en", "s", 1)]), RANKS, PATTERN, added=added).collect()
    assert piece["ids_crc32"] == zlib.crc32(np.array([64, 50256, 65, 0], "<u4").tobytes()) and piece["doc_tokens"] == 4


def test_near_duplicates_of_rows_with_other_columns(shared):
    text = " ".join(f"w{i}" for i in range(30))
    df = crowded(frame(shared, [(1, text, "en", "s", 1), (2, text, "en", "s", 1), (None, text, "en", "s", 1)]))
    assert Counter(r["doc_id"] for r in near_dup.without_near_duplicates(df).collect()) == Counter([1, None])


@pytest.mark.parametrize("limit", [1, 7, 64, 1 << 20])
def test_slices_by_bytes_are_the_batch_and_stay_short(limit):
    texts = ["a" * 5, None, "", "b" * 100, "c", "é" * 9, "", None, "d" * 40]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], ["id", "text"])
    size = lambda x: len((x or "").encode())
    for own in (batch, batch.slice(3), batch.slice(9)):
        slices = list(in_bytes([own], limit))
        assert [i for s in slices for i in s.column("id").to_pylist()] == own.column("id").to_pylist()
        for s in slices:
            held = [size(x) for x in s.column("text").to_pylist()]
            assert sum(held) - max(held) < limit


def test_scores_do_not_depend_on_the_slices():
    texts = pa.array(["some words here", None, "", "women and men " * 50, "other words", "wörter hier"])
    weights = {f: 0.5 for w in ("words", "women", "hier") for f in toxicity.features(w)}
    whole = toxicity._scores(texts, weights, -1.0)
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    parts = np.concatenate([toxicity._scores(s.column("text"), weights, -1.0) for s in in_bytes([batch], 16)])
    assert np.array_equal(whole, parts)


def test_ids_of_a_slice_are_those_of_its_texts():
    texts = ["wörter und é", None, "a<|endoftext|>b", "tab\t  spaces", "", "日本語 text ü" * 20, "x<|endoftext|>", "plain"] * 3
    ids = lambda a: [x.tolist() for x in packing.with_added(a, RANKS, PATTERN, packing.added_tokens(public_tokenizers.path(TOKENIZER)))]
    whole = pa.array(texts)
    for lo in (1, 5, 13):
        assert ids(whole.slice(lo, 9)) == ids(pa.array(texts[lo : lo + 9]))
