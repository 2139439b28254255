"""Main text of web pages by removing the templates of their site.

1. Every page is parsed once into its element tree and text blocks. Each
   element with text has a mark: the hash of its subtree, made of its own tag
   and text and the hashes of its children, and of whether it lies in an
   article.
2. Marks are counted per host over pages of distinct main text. A subtree that
   recurs on ``PAGES`` of them (a single paragraph, item or heading: on
   ``LINE_PAGES``) is template of that host. What stands in articles of other
   hosts too is content that is quoted, not a host's template, and stays.
3. Each page gets the templates that hold text it could keep (that of its
   articles, if it marks any), by a join of marks alone, is parsed again, and
   loses the blocks below them. No text is written, and none is shuffled unless
   those lists are too large to broadcast; then only that text goes, packed,
   and marks go as their places among the page's own.
4. After that, what a page marks itself as furniture (navigation, footers,
   forms, scripts, adverts, comments and the like) is left out, and where it
   marks an article (or else a main part), only that is read.

Guards of the content: no subtree goes that holds half of a page's main text,
and an article whose recurring subtrees hold half of its text together is a
copy and stays whole. Words of class, id and role take out no article or main
part, nothing that contains one and nothing that holds most of a page's text.

A page is worked through in time linear in its length, however deep it nests.
Defined results: a null or empty page has the text ''. A null or odd URL has
the host ''. Repeated rows, and pages of the same main text, are extracted each
and count as one page. Other columns are not looked at; an empty table gives
no rows.
"""

from __future__ import annotations

import html
import json
import re
from collections import defaultdict

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.llm.common import in_slices, written

#: A container is template from so many pages of its host on; a single paragraph from more.
PAGES, LINE_PAGES = 3, 5

# Element names of the HTML standard by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select".split())
FURNITURE = frozenset("head nav aside footer form button dialog menu canvas audio video map fieldset".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = FURNITURE | frozenset("article main div section ul ol dl table header figure center details td".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Words of class, id and role that mark furniture; those with a star also as the start of a longer word.
MARKS = frozenset("ad ads promo menu nav navbar footer banner notice notices alert popup modal overlay social share sharing related widget toolbar skip search login contentinfo complementary dialog".split())
MARK_STARTS = ("advert", "sidebar", "navig", "breadcrumb", "cookie", "consent", "newsletter", "subscri", "sponsor", "comment", "disqus", "gdpr")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z|[^<]++|<", re.S)
_MARKED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?(?:false|until-found))|display\s*:\s*none", re.I)
_QUOTED = re.compile(r"(?<!style=)(\"[^\"]*\"|'[^']*')", re.I)
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _is_furniture(name: str, rest: str, in_article: bool) -> bool:
    if name in FURNITURE or (name == "header" and not in_article):
        return True
    return bool(rest) and _HIDDEN.search(_QUOTED.sub("", rest)) is not None


def _has_mark(rest: str) -> bool:
    for groups in _MARKED.findall(rest):
        for word in re.split(r"[^a-z0-9]+", "".join(groups).lower()):
            if word in MARKS or word.startswith(MARK_STARTS):
                return True
    return False


class _Marked:
    """An element with a word of ``MARKS``: furniture if it turns out to hold no article or main part and not most of the text."""

    __slots__ = ("above", "chars", "region", "out")

    def __init__(self, above: _Marked | None) -> None:
        self.above, self.chars, self.region, self.out = above, 0, False, False


class _Element:
    __slots__ = ("name", "index", "furniture", "marked", "first", "inside", "hash")

    def __init__(self, name: str, index: int, furniture: bool, marked: _Marked | None, first: int, inside: int, tag: str) -> None:
        self.name, self.index, self.furniture, self.marked, self.first, self.inside = name, index, furniture, marked, first, inside
        self.hash = xxhash.xxh3_64(tag.encode("utf-8", "surrogatepass"))


class _Page:
    """One pass over the markup: blocks of text, and the tree of elements they lie in."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.found: list[tuple] = []  # pieces with the marked element of each, the marked part, furniture, element
        self.parents, self.marks = [0], [0]  # by element; mark 0: none. An element comes after its parent.
        self.open: list[_Element] = [_Element("", 0, False, None, 0, 0, "")]
        self.depths: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements, by name
        self.classed: list[_Marked] = []  # outer ones first
        self.buffer: list[tuple[str, _Marked | None]] = []
        self.chars = 0
        self.scan()
        for marked in self.classed:
            marked.out = (not marked.region and 2 * marked.chars <= self.chars) or (marked.above is not None and marked.above.out)
        self.blocks = [block for own in self.found for block in self.settled(*own)]  # text, the marked part it is in, furniture, element
        self.main = max((b[1] for b in self.blocks if not b[2]), default=0)  # 2 when the page marks an article, 1 when only a main part

    def settled(self, pieces: list, inside: int, furniture: bool, element: int):
        kept = [text for text, marked in pieces if marked is None or not marked.out]
        text = " ".join(html.unescape("".join(kept or [p[0] for p in pieces])).split())
        if text:
            yield text, inside, furniture or not kept, element

    def flush(self) -> None:
        if self.buffer:
            if any(not text.isspace() for text, _ in self.buffer):
                top = self.open[-1]
                self.found.append((self.buffer, top.inside, top.furniture, top.index))
            self.buffer = []

    def read(self, text: str) -> None:
        top = self.open[-1]
        self.buffer.append((text, top.marked))
        top.hash.update(text.encode("utf-8", "surrogatepass"))
        if not top.furniture:
            chars = len(text.strip())
            self.chars += chars
            if top.marked is not None:
                top.marked.chars += chars

    def push(self, name: str, rest: str) -> None:
        top = self.open[-1]
        region = 2 if name == "article" else 1 if name == "main" or "role=\"main\"" in rest else 0
        furniture = top.furniture or (name not in ("html", "body", "main") and _is_furniture(name, rest, top.inside == 2))
        inside, marked = 0 if furniture else max(top.inside, region), top.marked
        if region and not furniture:
            while marked is not None and not marked.region:
                marked.region, marked = True, marked.above
            marked = top.marked
        elif rest and not furniture and name not in ("html", "body") and _has_mark(rest):
            marked = _Marked(marked)
            self.classed.append(marked)
        self.depths[name].append(len(self.open))
        self.open.append(_Element(name, len(self.parents), furniture, marked, len(self.found), inside, f"{name} {rest}"))
        self.parents.append(top.index)
        self.marks.append(0)

    def pop(self) -> None:
        own = self.open.pop()
        self.depths[own.name].pop()
        top, digest = self.open[-1], own.hash.intdigest()
        top.hash.update(digest.to_bytes(8, "big"))
        if own.marked is not top.marked and own.marked.above is not None:
            own.marked.above.chars += own.marked.chars
        if own.first != len(self.found) and own.name not in ("html", "body"):
            self.marks[own.index] = digest >> 3 << 2 | (own.inside == 2) << 1 | (own.name not in CONTAINERS)

    def close_to(self, depth: int) -> None:
        if self.open[depth].name not in INLINE or any(e.name not in INLINE for e in self.open[depth + 1 :]):
            self.flush()
        while len(self.open) > depth:
            self.pop()

    def last(self, names: tuple[str, ...]) -> int:
        """Depth of the innermost open element of one of the names, 0 for none."""
        return max((self.depths[n][-1] for n in names if self.depths[n]), default=0)

    def implied(self, name: str) -> None:
        """Close what the start of ``name`` ends: a paragraph, or an item of the same list or row."""
        if name in CLOSES_P:
            ends, walls = ("p",), ("td", "th", "button", "table")
        elif name == "li":
            ends, walls = ("li",), ("ul", "ol", "menu")
        elif name in ("dt", "dd"):
            ends, walls = ("dt", "dd"), ("dl",)
        elif name in ("td", "th"):
            ends, walls = ("td", "th"), ("tr", "table")
        elif name == "tr":
            ends, walls = ("tr",), ("table",)
        elif name in ("option", "optgroup"):
            ends, walls = ("option",), ("select",)
        else:
            return
        depth = self.last(ends)
        if depth > self.last(walls):
            self.close_to(depth)

    def scan(self) -> None:
        source, at = self.source, 0
        while (token := _TOKEN.match(source, at)) is not None:
            at = token.end()
            name = token["name"] or token["name2"]
            if name is None:
                text = token[0]
                if text[0] != "<" or text == "<":
                    self.read(text)
                continue
            name, rest = name.lower(), token["rest"] or token["rest2"] or ""
            if token["end"] or token["end2"]:
                if self.depths[name]:
                    self.close_to(self.depths[name][-1])
                continue
            if name in RAW:
                if not rest.endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
                    at = end.end() if end else len(source)
                continue
            self.implied(name)
            if name not in INLINE:
                self.flush()
            elif name == "br":
                self.read("\n")
            if name not in VOID and not rest.endswith("/"):
                self.push(name, rest)
        self.flush()
        while len(self.open) > 1:
            self.pop()


    def main_text(self) -> str:
        return "\n\n".join(b[0] for b in self.blocks if not b[2] and b[1] == self.main)

    def subtrees(self) -> list[int]:
        """The marks, without those that hold half of the main text."""
        chars = [0] * len(self.parents)
        for text, inside, furniture, element in self.blocks:
            if not furniture and inside == self.main:
                chars[element] += len(text)
        for i in range(len(chars) - 1, 0, -1):
            chars[self.parents[i]] += chars[i]
        held: defaultdict[int, int] = defaultdict(int)
        for mark, n in zip(self.marks, chars):
            held[mark] += n
        return [m if m and 2 * held[m] < chars[0] or not chars[0] else 0 for m in self.marks]

    def outline(self) -> tuple[list[int], dict]:
        """The distinct marks in order, and what of the page decides and makes its text.

        That is the blocks that are not furniture, and only those of articles if there are any, since some of these
        are always left; of the elements, those with a mark that hold such a block. Marks are places in the first list.
        """
        marks = self.subtrees()
        distinct = sorted(set(marks) - {0})
        number = {m: k for k, m in enumerate(distinct)}
        blocks = [(t, i, e) for t, i, f, e in self.blocks if not f]
        blocks = [b for b in blocks if b[1] == 2] or blocks
        holds = [False] * len(marks)
        for _, _, element in blocks:
            holds[element] = True
        for i in range(len(marks) - 1, 0, -1):
            if holds[i]:
                holds[self.parents[i]] = True
        place, parents, numbers = [0], [0], [-1]
        for i in range(1, len(marks)):
            if holds[i] and marks[i]:
                place.append(len(parents))
                parents.append(place[self.parents[i]])
                numbers.append(number[marks[i]])
            else:
                place.append(place[self.parents[i]])
        return distinct, {"parents": parents, "marks": numbers, "blocks": [(t, i, place[e]) for t, i, e in blocks]}


def left_of(page: dict, gone: set[int]) -> str:
    """The main text that the page's blocks give without the subtrees whose marks are ``gone``."""
    dead = [False]
    for parent, mark in zip(page["parents"][1:], page["marks"][1:]):
        dead.append(dead[parent] or mark in gone)
    blocks = page["blocks"]
    article = sum(len(t) for t, inside, _ in blocks if inside == 2)
    copied = 2 * sum(len(t) for t, inside, e in blocks if inside == 2 and not dead[e]) <= article
    left = [(t, inside) for t, inside, e in blocks if not dead[e] or (copied and inside == 2)]
    main = max((inside for _, inside in left), default=0)
    return "\n\n".join(t for t, inside in left if inside == main)


def page_of(source: str | None) -> dict:
    """Parents and marks of the elements, and (text, marked part, element) of the blocks that the text is made of."""
    return _Page(source or "").outline()[1]


def page_blocks(source: str | None) -> list[str]:
    """The blocks that the page's own marks leave."""
    blocks = page_of(source)["blocks"]
    main = max((b[1] for b in blocks), default=0)
    return [b[0] for b in blocks if b[1] == main]


def _row_key(*values) -> tuple[int, int]:
    """128 bits of a row's content: what it is found by after the second reading."""
    raw = xxhash.xxh3_128_digest(repr(values).encode("utf-8", "surrogatepass"))
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


def _host_key(url: str | None) -> int:
    """64 bits that stand for the host in every shuffle."""
    return int.from_bytes(xxhash.xxh3_64_digest(host_of(url).encode("utf-8", "surrogatepass")), "big", signed=True)


_MARKED_ROW = "hi long, lo long, host long, print long, marks array<long>, own array<int>"
_PACKED_ROW = "hi long, lo long, packed binary"


def _marked(batches):
    """Key, host, print of the main text and distinct marks of every page, and the places of those that hold text it could keep."""
    for batch in in_slices(batches, 256):
        rows = []
        for page_id, url, source in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
            page = _Page(source or "")
            print_ = xxhash.xxh3_64_intdigest(page.main_text().encode("utf-8", "surrogatepass")) >> 1
            marks, outline = page.outline()
            rows.append((*_row_key(page_id, url, source), _host_key(url), print_, marks, sorted(set(outline["marks"][1:]))))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], ["hi", "lo", "host", "print", "marks", "own"])


def _packed(batches):
    """Key of every page, and its id, URL and outline as one packed value: little but text is left to shuffle."""
    pack = zstandard.ZstdCompressor(level=6)
    for batch in in_slices(batches, 256):
        keys, made = [], []
        for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
            page = page_of(row[2])
            texts, parts, places = zip(*page["blocks"]) if page["blocks"] else ((), (), ())
            whole = json.dumps([*row[:2], page["parents"], page["marks"], parts, places, texts], ensure_ascii=False, separators=(",", ":"))
            keys.append(_row_key(*row))
            made.append(pack.compress(whole.encode("utf-8", "surrogatepass")))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(made, pa.binary())], ["hi", "lo", "packed"])


def _extracted(batches):
    unpack = zstandard.ZstdDecompressor()
    for batch in in_slices(batches, 256):
        ids, urls, texts = [], [], []
        for packed, gone in zip(batch.column("packed").to_pylist(), batch.column("gone").to_pylist()):
            page_id, url, parents, marks, parts, places, blocks = json.loads(unpack.decompress(packed).decode("utf-8", "surrogatepass"))
            ids.append(page_id)
            urls.append(url)
            texts.append(left_of({"parents": parents, "marks": marks, "blocks": list(zip(blocks, parts, places))}, set(gone or ())))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                         ["page_id", "url", "text", "n_chars"])


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))


def marks_of(pages: DataFrame) -> DataFrame:
    """Key, host, print of the main text, marks, places of own marks and a number of every row, as a written table."""
    return written(_pages(pages).mapInArrow(_marked, _MARKED_ROW).withColumn("row", F.monotonically_increasing_id()), "html-marks")


def templates(marked: DataFrame) -> DataFrame:
    """(host, mark) of the subtrees that recur on several pages of their host and in no other host's articles."""
    marks = marked.select("host", "print", F.explode("marks").alias("mark"))
    counted = marks.distinct().groupBy("host", "mark").agg(F.count(F.lit(1)).alias("n"))
    found = counted.where(F.col("n") >= F.when(F.col("mark") % 2 != 0, LINE_PAGES).otherwise(PAGES)).select("host", "mark")
    quoted = marks.where("mark & 2 <> 0").groupBy("mark").agg(F.min("host").alias("low"), F.max("host").alias("high")).where("low < high")  # of two hosts at least
    return found.join(quoted, "mark", "left_anti").select("host", "mark")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""
    marked = marks_of(pages)
    # Marks travel with the number their row was written with; only what is found takes the longer key, once for equal rows.
    own = marked.select("row", "host", "marks", F.explode("own").alias("place")).select("row", "host", F.get("marks", F.col("place")).alias("mark"), "place")
    gone = own.join(templates(marked), ["host", "mark"]).groupBy("row").agg(F.collect_set("place").alias("gone"))  # at most the marks of one page
    gone = gone.join(marked.groupBy("hi", "lo").agg(F.min("row").alias("row")), "row").select("hi", "lo", "gone")
    gone = written(gone, "html-gone")  # of known size: pages are shuffled only where it is large
    packed = _pages(pages).mapInArrow(_packed, _PACKED_ROW)
    return packed.join(gone, ["hi", "lo"], "left").select("packed", "gone").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
