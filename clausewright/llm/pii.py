"""Personal data: fixed patterns, and terms that reveal them by information theory. Native throughout.

The patterns give the protected entities. A term is disclosive for an entity if their pointwise mutual information,
from co-occurrence over all distinct texts, reaches a share of the entity's information content (a share of 1: the term
tells all of it). Terms count where they stand outside the patterns' spans: a name in the prose can disclose an address
that is made of it. Such terms become spans of kind `term` in the texts that hold both. In the sanitised text each
pattern's span is generalised to its kind and each such term removed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.llm.common import among, materialise, spread_join
from clausewright.llm.spans import OFF, SPAN, Rule, as_kind, matches, of_kind, plain, tagged, written

#: Share of an entity's information content from which a term discloses it.
DISCLOSURE = 0.8
#: Distinct texts that must hold a pair of term and entity; with fewer, any rare word would tell all.
SUPPORT = 3
TERM = r"\p{L}++"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
LOCAL = f"A-Za-z0-9._%+\\-{OFF}"


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    """Whether the digits of v pass Luhn's test."""
    d = F.transform(F.split(F.reverse(digits(v)), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(d, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


BASE = [
    Rule("email", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++", lambda t: t.contains("@"), lambda v: F.lit(True), lambda t: F.regexp_replace(t, r"\.(?![A-Za-z0-9-])", OFF)),
    Rule("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda v: v.rlike(rf"^(?:{BYTE}\.){{3}}{BYTE}$")),
    Rule("card", r"[0-9][0-9\x20-]++", lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), lambda v: F.length(digits(v)).between(14, 19) & luhn(v), lambda t: F.regexp_replace(t, r"[\x20-](?![0-9])", OFF)),
    Rule("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+"), lambda v: F.length(digits(v)).between(10, 15)),
]
KINDS = [r.kind for r in BASE]


def base_of(text: Column) -> Column:
    """The patterns' spans in a plain() text."""
    return tagged({r.kind: matches(text, r) for r in BASE})


def entity_of(span: Column) -> Column:
    return F.concat(span["kind"], F.lit(":"), F.lower(span["v"]))


def held_by(docs: DataFrame) -> DataFrame:
    """(doc_id, h, entities): of each row, the hash of its text and its distinct entities."""
    read = docs.select("doc_id", plain(F.col("text")).alias("text"))
    return read.select("doc_id", F.xxhash64("text").alias("h"), F.array_distinct(F.transform(base_of(F.col("text")), entity_of)).alias("entities"))


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1)))


def rewritten(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """The text with mark(span) in place of each span; of spans that overlap, the first."""
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        put = F.concat(a["out"], F.substring(text, a["pos"].cast("int") + 1, (x["s"] - a["pos"]).cast("int")), mark(x))
        return F.when(x["s"] < a["pos"], a).otherwise(F.struct(x["e"].alias("pos"), put.alias("out")))

    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["pos"].cast("int") + 1, F.length(text))))


def text_terms(docs: DataFrame) -> DataFrame:
    """(h, term) of each text outside the patterns' spans; the hash is made before the terms are dealt to rows."""
    read = docs.select(plain(F.col("text")).alias("text"))
    read = read.select("text", F.xxhash64("text").alias("h"), base_of(F.col("text")).alias("spans"))
    prose = F.when(F.size("spans") == 0, F.col("text")).otherwise(rewritten(F.col("text"), F.col("spans"), lambda x: F.lit(" ")))
    return read.select("h", terms_of(prose).alias("terms")).select("h", F.explode("terms").alias("term"))


def one_row(doc_id: str, h: str) -> Column:
    """A hash that tells a text's rows apart by their doc_id."""
    return F.xxhash64(F.coalesce(F.col(doc_id), F.lit(-1)), F.col(doc_id).isNull(), F.col(h))


def revealing(docs: DataFrame, share: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(h, terms): of the texts, by their hash, the terms that disclose an entity of theirs.

    Counts are over distinct texts: a text that is copied a thousand times tells no more about its entities than one.
    Only the texts with an entity that enough texts share are read for pairs, and all texts for the terms of pairs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = materialise(held_by(docs), "entities")
    held = found.where("size(entities) > 0").select("h", F.explode("entities").alias("entity")).distinct()
    common = held.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= support)
    held = materialise(spread_join(held, materialise(common, "common"), "entity", "inner"), "held")
    empty = docs.sparkSession.createDataFrame([], "h long, terms array<string>")
    if held.isEmpty():
        return empty
    # of equal texts one row is read; rows are told apart by a hash, so that nothing else is shuffled
    keyed = lambda df: df.withColumn("h", F.xxhash64(plain(F.col("text")))).select("text", one_row("doc_id", "h").alias("row"))
    least = found.groupBy("h").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("r"), F.count("*").alias("k"))
    least = least.select("h", "k", "r.doc_id", one_row("r.doc_id", "h").alias("row"))
    holders = materialise(least.join(held.select("h").distinct(), "h", "left_semi").select("doc_id", "row"), "holders")
    # by doc_id first, so that other texts needn't be hashed
    near = among(docs.where("doc_id IS NOT NULL"), holders.select("doc_id").distinct(), "doc_id").unionByName(docs.where("doc_id IS NULL"))
    words = materialise(text_terms(among(keyed(near), holders.select("row"), "row")).distinct(), "words")
    both = held.join(words, "h")
    pairs = both.groupBy("entity", "term").agg(F.count("*").alias("n_te"), F.first("n_e").alias("n_e")).where(F.col("n_te") >= support)
    pairs = materialise(pairs, "pairs")
    wanted = materialise(pairs.select("term").distinct(), "terms")
    copies = least.where("k > 1").select("h", F.col("row").alias("first"))
    copies = materialise(found.select("h", one_row("doc_id", "h").alias("row")).join(copies, "h").where("row <> first").select("row").distinct(), "copies")
    counted = among(text_terms(among(keyed(docs), copies, "row", "left_anti")), wanted, "term")
    if not found.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        counted = counted.distinct()  # rows that repeat doc_id and text
    counted = counted.groupBy("term").agg(F.count("*").alias("n_t"))
    total = found.agg(F.count_distinct("h").alias("n"))  # one row
    ratio = F.log2(F.col("n") * F.col("n_te") / (F.col("n_t") * F.col("n_e"))) / F.log2(F.col("n") / F.col("n_e"))
    leaks = pairs.join(counted, "term").join(F.broadcast(total)).where((F.col("n") > F.col("n_e")) & (ratio >= share)).select("entity", "term")
    leaks = materialise(leaks, "leaks")
    if leaks.isEmpty():
        return empty
    # a text's terms are among its own words
    return materialise(both.join(leaks, ["entity", "term"], "left_semi").groupBy("h").agg(F.collect_set("term").alias("terms")), "by_text")


def term_spans(text: Column, terms: Column) -> Column:
    """(s, e, v) of the words of a text that are among the terms."""
    rule = Rule("term", TERM, lambda t: F.size(terms) > 0, lambda v: F.array_contains(terms, F.lower(v)))
    return matches(text, rule)


def all_spans(docs: DataFrame, share: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """doc_id, text (plain), base, spans: the patterns' spans, and these with those of disclosive terms."""
    leaks = revealing(docs, share, support)
    named = docs.select("doc_id", plain(F.col("text")).alias("text")).withColumn("h", F.xxhash64("text"))
    named = spread_join(named, leaks, "h").select("doc_id", "text", "terms", base_of(F.col("text")).alias("base"))
    more = as_kind(F.when(F.col("terms").isNull(), F.array().cast(SPAN)).otherwise(term_spans(F.col("text"), F.col("terms"))), len(KINDS), "term")
    outside = F.filter(more, lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return named.select("doc_id", "text", "base", F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", outside))).alias("spans"))


MARK = lambda x: F.when(x["kind"] == "term", F.lit("[..]")).otherwise(F.concat(F.lit("["), x["kind"], F.lit("]")))


def sanitised(docs: DataFrame) -> DataFrame:
    """doc_id, text: each span generalised to its kind in brackets, terms removed to [..]. Null text: empty."""
    return all_spans(docs).select("doc_id", rewritten(F.col("text"), F.col("spans"), MARK).alias("text"))


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_base, sanitised_sha256.

    Null text: empty, without spans. n_base counts the patterns' spans; sanitised_sha256 is of the sanitised() text.
    Each row gives a row, whatever its doc_id. Extra columns are ignored."""
    s = all_spans(docs)
    base = F.col("base")
    return s.select(
        "doc_id",
        *[of_kind(base, k).alias(f"n_{k}") for k in KINDS],
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        F.size(base).cast("long").alias("n_base"),
        F.sha2(rewritten(F.col("text"), F.col("spans"), MARK).cast("binary"), 256).alias("sanitised_sha256"),
    )
