"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Every whole text is searched for candidates of four kinds. Three are taken as
they are (``assign``, ``access``, ``hex``); the fourth, ``opaque``, is any long
run of token characters and says little by itself. What a candidate is worth
is decided over the corpus: the hash of each value is counted by distinct
repositories and distinct owners. A value that many owners or repositories
hold is a copied example; one that few hold and that looks drawn at random is
taken for a live credential, and an opaque one of that sort becomes a span.

Texts are read once; what was found is written as a small table, and the
frequencies and the decisions are joins over it. Values are carried as SHA-256
only. Defined results: a null text is empty and has no candidates; a null
owner or repository is not counted; repeated rows are scanned each; columns
of the input other than the four named are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavola.llm.common import fresh, text_or_empty, written

# Kinds in the order in which ties at one start are listed, their patterns and least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "opaque")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24

# A maximal run of access or hex characters is long enough exactly when the
# pattern with the least length matches it, so the search can ask for it.
_SEARCHED = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "opaque": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+",
}
#: Cheap tests that every text with a match passes: most texts are searched by these alone.
_HAS = _SEARCHED | {"assign": r"""[PpSsTtAa](?i:(?<=p)assword|(?<=p)asswd|(?<=s)ecret|(?<=t)oken|(?<=a)pi_?key)["']?\x20*[:=]"""}
#: A value that at least so many owners, or so many repositories, hold is a copied example.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 25
#: Distinct characters of a value that looks drawn at random.
LIVE_DISTINCT = 8

_SPAN = "struct<kind:int,start:bigint,end:bigint,hash:string,live:boolean>"
MASK = "[SECRET]"


def _matches(kind: str) -> tuple[Column, Column]:
    """The leftmost non-overlapping matches in ``text`` and the segments between them; none where ``has_`` is false."""
    pattern, has = _SEARCHED[kind], F.col(f"has_{kind}")
    none = F.array().cast("array<string>")
    return (F.when(has, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none),
            F.when(has, F.split("text", pattern, -1)).otherwise(none))


def _cuts(kind: str, found: Column, between: Column) -> Column:
    """Each match as a struct: code points between it and the one before, its own, and what becomes of it."""
    pairs = F.zip_with(found, between, lambda m, s: F.struct(m.alias("m"), F.length(s).alias("gap")))
    pairs = F.filter(pairs, lambda p: p["m"].isNotNull())  # the last segment has no match after it

    def cut(pair: Column) -> Column:
        value = F.regexp_extract(pair["m"], ASSIGN, 2) if kind == "assign" else pair["m"]
        keep = F.length(value) >= ASSIGN_CHARS if kind == "assign" else _mixed(value) if kind == "opaque" else F.lit(True)
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), pair["gap"].alias("gap"), F.length(pair["m"]).alias("chars"),
                        F.sha2(value, 256).alias("hash"), _looks_live(value).alias("live"), keep.alias("keep"))

    return F.transform(pairs, cut)


def _placed(found: DataFrame) -> DataFrame:
    """(uid, base, opaque): spans of the rows that have any, in order. A span's place is a running sum over
    its row's matches of the kind; opaque runs that overlap a base span are left out."""
    own = found.where(F.size("cuts") > 0).select("uid", F.posexplode("cuts").alias("pos", "c")).select("uid", "pos", "c.*").repartition("uid")
    before = Window.partitionBy("uid", "kind").orderBy("pos")
    end = F.sum((F.col("gap") + F.col("chars")).cast("long")).over(before)
    own = own.withColumn("end", end).withColumn("start", F.col("end") - F.col("chars")).where("keep")
    # A base span that overlaps a run begins before the run's end, at or before its start or after it.
    base, kind = F.col("kind") < KINDS.index("opaque"), F.col("kind")
    up = Window.partitionBy("uid").orderBy("start", kind).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("uid").orderBy(F.col("start").desc(), kind.desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumn("reached", F.max(F.when(base, F.col("end"))).over(up)).withColumn("next", F.min(F.when(base, F.col("start"))).over(down))
    met = F.coalesce((F.col("reached") > F.col("start")) | (F.col("next") < F.col("end")), F.lit(False))
    span = F.struct("start", "kind", "end", "hash", "live")  # sorts by start, then kind
    in_order = lambda of: F.transform(F.sort_array(F.collect_list(F.when(of, span))), lambda s: F.struct(*[s[n].alias(n) for n in ("kind", "start", "end", "hash", "live")]).cast(_SPAN))
    return own.groupBy("uid").agg(in_order(base).alias("base"), in_order(~base & ~met).alias("opaque"))


def _mixed(value: Column) -> Column:
    """Letters of either case, or letters and digits: no word, path or rule of prose."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def _looks_live(value: Column) -> Column:
    return _mixed(value) & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_DISTINCT)


def candidates(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: uid, doc_id, text_hash, owner, repository, and its ``base`` and ``opaque`` spans.

    The result is a written table, so ``uid`` stays what it is.
    """
    repo = F.col(repository) if repository in docs.columns else F.col("doc_id")
    own = F.col(owner) if owner in docs.columns else F.lit(None)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), own.cast("string").alias("owner"),
        repo.cast("string").alias("repository"), text_or_empty().alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    columns = ["doc_id", "text_hash", "owner", "repository"]
    rows = rows.select(*columns, "text", *[F.col("text").rlike(p).alias(f"has_{k}") for k, p in _HAS.items()])
    found = {}
    for kind in KINDS:
        found[f"m_{kind}"], found[f"s_{kind}"] = _matches(kind)
    rows = rows.select(*columns, *[c.alias(n) for n, c in found.items()])
    cuts = F.concat(*[_cuts(k, F.col(f"m_{k}"), F.col(f"s_{k}")) for k in KINDS])
    rows = written(rows.select(F.monotonically_increasing_id().alias("uid"), *columns, cuts.alias("cuts")), "secret-matches")
    none = F.array().cast(f"array<{_SPAN}>")
    spans = rows.drop("cuts").join(_placed(rows), "uid", "left")
    return written(spans.select("uid", *columns, F.coalesce("base", none).alias("base"), F.coalesce("opaque", none).alias("opaque")), "secret-candidates")


def _by_start(a: Column, b: Column) -> Column:
    order = lambda x: x["start"] * len(KINDS) + x["kind"]
    return F.when(order(a) < order(b), -1).when(order(a) > order(b), 1).otherwise(0)


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repositories) over the whole corpus; equal rows meet before the shuffle."""
    each = found.select("owner", "repository", F.explode(F.concat("base", "opaque")).alias("c")).select("owner", "repository", F.col("c.hash").alias("hash"))
    return each.groupBy("hash").agg(F.count_distinct("owner").alias("n_owners"), F.count_distinct("repository").alias("n_repositories"))


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, ``base`` spans, ``spans`` (base and
    owner-specific opaque ones, by start then kind), n_live and n_copied (its
    candidates that look live and owner-specific, and that are copied widely)."""
    found = candidates(docs, owner, repository)
    each = found.select("uid", F.explode(F.concat("base", "opaque")).alias("c")).select("uid", "c", F.col("c.hash").alias("hash"))
    copied = (F.col("n_owners") >= COPIED_OWNERS) | (F.col("n_repositories") >= COPIED_REPOSITORIES)
    judged = each.join(ownership(found), "hash").withColumn("copied", copied)
    live = F.col("c.live") & ~F.col("copied")
    added = F.when(live & (F.col("c.kind") == KINDS.index("opaque")), F.col("c"))
    per_row = judged.groupBy("uid").agg(
        F.collect_list(added).alias("added"), F.sum(live.cast("long")).alias("n_live"), F.sum(F.col("copied").cast("long")).alias("n_copied"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    more = F.coalesce("added", F.array().cast(f"array<{_SPAN}>"))
    return found.join(per_row, "uid", "left").select(
        "doc_id", "text_hash", "base", F.array_sort(F.concat("base", more), _by_start).alias("spans"), zero("n_live"), zero("n_copied"))


def rendered(spans: str) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts by kind, SHA-256 of the base spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(rendered("base"), 256).alias("base_sha256"),
                        rendered("spans").alias("spans"), "n_live", "n_copied")


def masked(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``MASK``; overlapping spans become one.

    Texts without spans are unchanged, a null text stays null.
    """
    found = scan(docs, owner, repository).where(F.size("spans") > 0)
    # Equal ids with equal texts have equal base spans; opaque ones are judged by value, so these agree as well.
    own_id, own_hash, own_spans, text_hash = (fresh(n, docs) for n in ("found_id", "found_hash", "found_spans", "text_hash"))
    found = found.groupBy(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).agg(F.first("spans").alias(own_spans))
    rows = docs.withColumn(text_hash, F.xxhash64(text_or_empty()))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.col(text_hash) == F.col(own_hash))
    joined = rows.join(found, same, "left")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        cut = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], cut, F.lit(MASK))).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text")))
    text = F.when(F.col(own_spans).isNull(), F.col("text")).otherwise(F.aggregate(own_spans, start, step, rest))
    return joined.withColumn("text", text).select(*docs.columns)
