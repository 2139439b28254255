"""Page extraction, vector searches and the pipeline against brute force."""

from __future__ import annotations

import html
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.compare import compare
from tests.conftest import SF_ORACLE, SF_SMALL
from tests.llm.conftest import ODD, frame
from tests.llm.test_text_operators import brute_components, check_packing

import corpus_pipeline
from tavola.llm import html_text, queries, vector_hashing, vector_search
from tavola.llm.common import read, written

PAGE = "page_id long, url string, html string"


def article_of(source):
    """The blocks of the provided pages' articles, by plain patterns."""
    found = re.search(r"<article>(.*?)(?:</article>|$)", source or "", re.S)
    parts = re.split(r"</?(?:h1|p)>", found[1]) if found else []
    texts = [" ".join(html.unescape(re.sub(r"</?b>|<[a-z/][^>]*$", "", p.replace("<br>", " "))).split()) for p in parts]
    return "\n\n".join(t for t in texts if t)


@pytest.mark.parametrize("sf_dir", [SF_ORACLE, "/root/testdata/sf0.1"])
def test_provided_pages_give_their_articles(shared, sf_dir):
    pages = read(shared, sf_dir, "pages")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        assert got[r["page_id"]] == (article_of(r["html"]), len(article_of(r["html"])))


def test_recurring_subtrees_go_and_content_stays(shared):
    frame_of = "<body><div><a href='/'>Home</a> of the site</div><div id=c><h2>T{i}</h2><p>text {i} of some length, all of it its own</p><p>shared by all</p></div><div>imprint</div></body>"
    pages = [(i, "http://h.example/x", frame_of.format(i=i)) for i in range(8)]
    pages += [(100, "http://other.example/", frame_of.format(i=100)), (101, None, None), (102, "x", ""), (103, "http://h.example/y", "<p>lone</p"), (103, "http://h.example/y", "<p>lone</p")]
    got = html_text.extract(shared.createDataFrame(pages, PAGE)).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(pages) and text[3] == "T3\n\ntext 3 of some length, all of it its own"
    assert text[100].startswith("Home of the site") and text[100].endswith("imprint")
    assert text[101] == text[102] == "" and text[103] == "lone"
    assert html_text.extract(shared.createDataFrame([], PAGE)).count() == 0


def test_marked_furniture_and_broken_markup():
    text = html_text.page_blocks
    assert text("<article><header><h1>T</h1></header><p>x<a href='a>b'>y</a>z<p>a &lt; b&nbsp;&amp c<br>d<div class=comments>no</div></article><main>q</main>") == ["T", "xyz", "a < b & c d"]
    assert text("<div class='side-menu'>m</div><form>f</form><aside>n</aside><script>if (a<b) '</p>'</script><ul><li>1<li>2</ul><footer>z</footer><!-- c") == ["1", "2"]
    assert text("<div hidden>h</div><p style='display:none'>n</p><p>a <b>bold</i> text</b></p><a hre") == ["a bold text"] and text(None) == []
    assert text("<p>" * 3000 + "deep") == ["deep"]


def test_what_a_host_repeats_inside_its_articles_goes(shared):
    page = "<body><nav>menu</nav><article><h1>T{i}</h1><p>text {i} of some length, all of it its own</p><p>{note}</p></article><div>foot</div></body>"
    note, quoted = "read our other news", "released under a licence"
    pages = [(i, "http://h.example/x", page.format(i=i, note=note)) for i in range(6)] + [(50 + i, f"http://h{i}.example/x", page.format(i=i, note=f"note {i}")) for i in range(6)]
    pages += [(200 + i, "http://big.example/x", page.format(i=i, note="all our news") if i < 6 else f"<article><p>only {i}</p></article>") for i in range(60)]
    pages += [(300 + i, "http://copy.example/x", page.format(i=7, note="a copied note")) for i in range(6)]
    pages += [(400 + i, "http://near.example/x", f"<article><h1>{i}</h1><p>one of two paragraphs</p><p>two of two paragraphs</p></article>") for i in range(6)]
    # What articles of two hosts hold is quoted, however often; outside of articles it says nothing of another host.
    pages += [(500 + 10 * h + i, f"http://q{h}.example/x", page.format(i=f"{h}-{i}", note=quoted)) for h in range(2) for i in range(6)]
    pages += [(600 + i, "http://plain.example/x", f"<body><div><h1>P{i}</h1><p>text {i} of some length, all of it its own</p></div><div><p>{quoted}</p></div></body>") for i in range(6)]
    text = {r["page_id"]: r["text"] for r in html_text.extract(shared.createDataFrame(pages, PAGE)).collect()}
    own = lambda i: f"T{i}\n\ntext {i} of some length, all of it its own"
    assert text[3] == text[203] == own(3) and text[53] == own(3) + "\n\nnote 3" and text[210] == "only 10"
    assert text[302] == own(7) + "\n\na copied note" and text[404] == "4\n\none of two paragraphs\n\ntwo of two paragraphs"
    assert text[503] == own("0-3") + "\n\n" + quoted and text[512] == own("1-2") + "\n\n" + quoted
    assert text[603] == "P3\n\ntext 3 of some length, all of it its own"


def test_pages_are_the_same_where_the_templates_are_not_broadcast(shared):
    pages = read(shared, SF_SMALL, "pages")
    want = sorted(tuple(r) for r in html_text.extract(pages).collect())
    held = {k: shared.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for k in held:
            shared.conf.set(k, "-1")
        assert sorted(tuple(r) for r in html_text.extract(pages.withColumn("hi", F.lit(1)).withColumn("gone", F.lit(1)).withColumn("host", F.lit(1))).collect()) == want
    finally:
        for k, v in held.items():
            shared.conf.unset(k) if v is None else shared.conf.set(k, v)


def whole_left(source, gone):
    """What is left of a page without the marks ``gone``, from all its elements and blocks."""
    page = html_text._Page(source)
    dead = [False]
    for parent, mark in zip(page.parents[1:], page.subtrees()[1:]):
        dead.append(dead[parent] or mark in gone)
    blocks = [(t, i, dead[e]) for t, i, furniture, e in page.blocks if not furniture]
    copied = 2 * sum(len(t) for t, i, d in blocks if i == 2 and not d) <= sum(len(t) for t, i, _ in blocks if i == 2)
    left = [(t, i) for t, i, d in blocks if not d or (copied and i == 2)]
    return "\n\n".join(t for t, i in left if i == max(i for _, i in left))


def test_the_outline_of_a_page_decides_as_the_whole_page():
    rng, seen = random.Random(8), 0
    pieces = [f"<{t}{a}>" for t in "article main div p nav b header ul li section".split() for a in ("", " class=ad", " hidden")]
    pieces += [f"</{t}>" for t in "article main div p nav b header ul li section".split()] * 2 + ["a", "two words", "c &amp; \xe9", "a longer text of words "] * 8
    for _ in range(10_000):
        source = "".join(rng.choices(pieces, k=rng.randrange(1, 25)))
        marks, outline = html_text._Page(source).outline()
        gone = {m for m in marks if rng.random() < 0.4}
        got = html_text.left_of(outline, {k for k in outline["marks"][1:] if marks[k] in gone})
        assert got == whole_left(source, gone), source
        seen += got != whole_left(source, set())
    assert seen > 100


def test_only_what_can_change_a_text_is_joined_and_moved(shared, monkeypatch):
    steps = {}
    monkeypatch.setattr(html_text, "written", lambda df, label: steps.setdefault(label, written(df, label)))
    page = "<body><nav>menu</nav><div>a line of the site</div><article><h1>T{i}</h1><p>\xe9\xe9 {i} of some length, all of it its own</p><p>{note}</p></article><footer>foot</footer></body>"
    pages = [(i, "http://h.example/x", page.format(i=i, note=f"note {i}")) for i in range(6)] + [(10 + i, "http://n.example/x", page.format(i=i, note="read our news")) for i in range(6)]
    got = html_text.extract(shared.createDataFrame(pages + pages[5:8], PAGE)).collect()  # a row given twice stays twice
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 15 and text[3].endswith("own\n\nnote 3") and all(r["text"].endswith("all of it its own") for r in got if r["page_id"] >= 10)
    # Menu, line and foot recur too, but no text that could be kept hangs on them; marks go as places, not as hashes.
    gone = [r["gone"] for r in steps["html-gone"].collect()]
    assert len(gone) == 6 and all(len(g) == 1 and 0 <= g[0] < 10 for g in gone)
    rows = read(shared, SF_SMALL, "pages")
    packed = html_text._pages(rows).mapInArrow(html_text._packed, html_text._PACKED_ROW).agg(F.sum(F.length("packed"))).first()[0]
    sent = sum(len(article_of(r["html"]).encode()) for r in rows.collect())
    assert packed < 0.5 * sent


def test_deep_pages_take_linear_time():
    n = 100_000
    started = time.process_time()
    for source in ("<div class=x>a" * n, "<p>" * n + "x", "<ul><li class=ad>b" * n, "<td>a" * n, "<b>" * n + "x" + "</i>" * n):
        assert html_text.page_of(source)["blocks"]
    assert time.process_time() - started < 60


def test_class_words_do_not_take_out_the_main_text():
    text = html_text.page_blocks
    own = "<p>a text of some length</p>"
    for page in (f"<div class='layout has-sidebar'><article>{own}</article></div>", f"<article class='post comments-open'>{own}</article>",
                 f"<article class=commentary>{own}</article>", f"<div id='search-results'><h1></h1>{own}</div><p>end</p>", f"<div class=menu><main role=\"main\" class=overlay>{own}</main></div>"):
        assert text(page)[0] == "a text of some length", page
    inner = f"<div class='has-sidebar'><article>{own}<p>and <span class=ad>buy</span>more<div class='sidebar'>side</div></article><div class=sidebar>s</div></div>"
    assert text(inner) == ["a text of some length", "and more"]


VECTOR = "vec_id long, embedding array<float>"


def vectors(shared):
    rows = [(r["vec_id"], r["embedding"]) for r in read(shared, SF_SMALL, "embeddings").collect()]
    dim = len(rows[0][1])
    odd = [(-100, None), (-200, [0.0] * dim), (-300, [None] + [1.0] * (dim - 1)), (-400, [float("nan")] * dim), (-500, [float("inf")] * dim), (-600, [1.0, 2.0]), (-700, []), (-800, rows[0][1]), (-900, rows[0][1])]
    return shared.createDataFrame(rows + odd, VECTOR), rows, odd


def test_inner_products_are_exact(shared):
    df, rows, odd = vectors(shared)
    every = rows + [o for o in odd if o[0] in (-200, -800, -900)]
    ids, own = np.array([r[0] for r in every]), np.floor(256 * np.array([r[1] for r in every], np.float64)).astype(np.int64)
    got = vector_search.inner_products(df, df.where("vec_id % 50 = 0"), 5, block_rows=90)
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for i in np.flatnonzero(ids % 50 == 0):
        score, other = own @ own[i], ids != ids[i]
        best = np.lexsort((ids[other], -score[other]))[:5]
        assert [found[ids[i]][n] for n in range(1, 6)] == list(zip(ids[other][best].tolist(), score[other][best].tolist()))
    assert set(found) == set(ids[ids % 50 == 0].tolist()) and vector_search.inner_products(df.limit(0), df.limit(0)).count() == 0


def test_small_remainders_and_large_vectors_keep_their_place(shared):
    x = 2.0**19
    rows = [(50, [2.0**13] * 8 + [2.0**12] * 8), (1, [x] * 8 + [1 / 256] * 8), (2, [x + 1 / 256] + [x] * 7 + [0.0] * 8)]

    def best(own):
        df = shared.createDataFrame(own, "vec_id long, embedding array<double>").coalesce(1)
        return [(int(r["vec_id"]), int(r["score"])) for r in vector_search.inner_products(df, df.where("vec_id = 50"), 1).collect()]

    assert best(rows) == [(1, 2251799822073856)]
    assert best(rows + [(3, [2.0**20] * 16)]) == [(3, 24 * 2**21 * 2**20 * 256 // 2)]


@pytest.mark.parametrize("power", [0, 5, 12, 15])
def test_inner_products_of_any_magnitude(shared, power):
    rng = np.random.default_rng(power)
    size = 10.0 ** rng.uniform(-3, power, (400, 1))
    vectors = rng.standard_normal((400, 24)) * size * 10.0 ** rng.uniform(-6, 0, (400, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(i, [0.0] * 24) for i in (1000, 1050)] + [(7, vectors[7].tolist())]
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    df = shared.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in vector_search.inner_products(df, df.where("vec_id % 50 = 0"), 5, block_rows=150).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], int(r["vec_id"]), int(r["score"])))
    assert set(got) == {i for i, _ in rows if i % 50 == 0}
    for q, own in whole:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in whole if i != q)[:5]
            assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]


def test_hashing_finds_the_nearest(shared):
    df, rows, odd = vectors(shared)
    every = rows + [o for o in odd if o[0] in (-800, -900)]
    ids, own = np.array([r[0] for r in every]), np.array([r[1] for r in every], np.float64)
    found = {}
    for r in vector_hashing.nearest(df, df.where("vec_id % 100 = 0"), 10, block_rows=1000).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for i in np.flatnonzero(ids % 100 == 0):
        score = np.sqrt(((own - own[i]) ** 2).sum(axis=1))
        other = ids != ids[i]
        best = set(ids[other][np.lexsort((ids[other], score[other]))[:10]].tolist())
        mine = sorted(found[ids[i]])
        assert [r for r, _, _ in mine] == list(range(1, 11)) and all(abs(s - score[ids == v][0]) < 1e-12 for _, v, s in mine)
        assert [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
        hits, total = hits + len(best & {v for _, v, _ in mine}), total + 10
    assert hits / total >= 0.9 and set(found) == set(ids[ids % 100 == 0].tolist())
    assert vector_hashing.nearest(df.limit(0), df.limit(0)).count() == 0


def test_substring_index_retrieves_every_code_within_the_radius():
    rows = np.random.default_rng(3).integers(0, 256, (500, 8), dtype=np.uint8)
    index = vector_hashing.SubstringIndex(rows)
    for code in rows[:20]:
        apart = np.unpackbits(rows ^ code, axis=1).sum(axis=1)
        for radius in (0, 7, 20, 31):
            assert index.within(code, radius).tolist() == np.flatnonzero(apart <= radius).tolist()


@pytest.fixture(scope="module")
def stages(shared):
    docs = read(shared, SF_SMALL, "documents").unionByName(frame(shared, [(r[0] and -r[0], *r[1:]) for r in ODD]))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(shared, out[-1], SF_SMALL), "test-" + name.replace(" ", "-")))
    return out


def test_stages_return_documents_and_decide(shared, stages):
    documents = stages[0]
    for made in stages[1:-1]:
        assert made.dtypes == documents.dtypes
    sizes = [s.count() for s in stages[:5]]
    assert sizes[0] > sizes[1] == sizes[2] >= sizes[3] == sizes[4]
    own = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    kept = {i for i, (_, root) in brute_components(own, 5).items() if i == root} | {None}
    assert {r["doc_id"] for r in stages[3].collect()} == kept
    predicted = {r["doc_id"]: r["predicted"] for r in queries.toxicity.score(documents, read(shared, SF_SMALL, "labels")).collect()}
    assert {r["doc_id"] for r in stages[1].collect()} == {i for i, p in predicted.items() if not p}
    assert all(r["n_chars"] == len(r["text"] or "") for r in stages[4].where("text is not null").collect())
    masked = stages[4].where("text like '%[SECRET]%'").count()
    assert masked > 0 and stages[4].where("text rlike '[0-9a-f]{24,}'").count() == 0
    assert check_packing(stages[5].collect(), [(r["doc_id"], r["text"]) for r in stages[4].collect()]) < 0.2


def test_run_is_the_stages_in_order(shared):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "near duplicates", "secrets", "packing"]
    assert corpus_pipeline.run(shared, SF_SMALL).count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_their_sql(shared, duck_oracle, name):
    ok, message = compare(shared, name, queries.QUERIES[name], queries.ORACLE_SQL[name], SF_ORACLE, duck_oracle)
    assert ok, message
