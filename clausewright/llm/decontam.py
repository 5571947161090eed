"""Benchmark decontamination by spaced seeds. Native throughout.

Tokens are the runs of letters and digits, lower-cased. Each mask picks fixed positions of a window of tokens; the
hashes of the picked tokens of all windows of the texts are joined to those of the benchmark. A pair that hits is
aligned at the hit, and counts if some LENGTH tokens in a row (all, of a shorter item) agree in at least AGREE of their
places: substituted tokens neither hide a passage nor break it off. Items of fewer than SPAN tokens have masks of their
own, which are hashed over the texts only if the benchmark holds such items."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.llm.common import among, materialise

#: 1: a position that counts. Enumerated: whichever tokens differ, as many as AGREE admits of 12 to LENGTH tokens in a
#: row, one of these masks meets none of them. Items of fewer than SPAN tokens have masks of their own.
MASKS = ("110001011", "1110101")
SPAN = 12
LENGTH, AGREE = 15, 0.8
#: Benchmark seeds that are broadcast at most (about 100 MB); more are joined by shuffling.
BROADCAST_SEEDS = 2_000_000


def hashes(text: Column) -> Column:
    """The tokens' 64-bit hashes, in order."""
    cut = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(cut, lambda x: x != ""), lambda x: F.xxhash64(x))


def masks_of(tokens: int) -> tuple[str, ...]:
    """The masks for an item of so many tokens. Where k of m tokens may differ, the others form k + 1 runs at most, so
    that the longest run is no shorter than the mask of a short item: it finds every such item."""
    if tokens >= SPAN:
        return MASKS
    agree = math.ceil(tokens * AGREE)
    return ("1" * math.ceil(agree / (tokens - agree + 1)),)


def seeds(h: str, masks: tuple[str, ...]) -> Column:
    """(pos, seed) of all windows that lie within the tokens, for each mask."""

    def of(m: str) -> Column:
        last = F.size(h) - len(m)
        picked = lambda i: F.xxhash64(F.lit(m), *[F.get(F.col(h), i + at) for at, bit in enumerate(m) if bit == "1"])
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(i.alias("pos"), picked(i).alias("seed")))).otherwise(F.array())

    return F.concat(*[of(m) for m in masks])


def exploded(df: DataFrame, name: str, masks: tuple[str, ...]) -> DataFrame:
    """(name, pos, seed) rows of df (name, h)."""
    return df.where(F.size("h") > 0).select(name, F.explode(seeds("h", masks)).alias("x")).select(name, "x.pos", "x.seed")


def agreement(doc: str, item: str, shift: str) -> Column:
    """The most agreeing places in any LENGTH tokens in a row of the item, the text lying `shift` further."""
    same = F.transform(F.col(item), lambda x, j: F.when(F.col(shift) + j < 0, 0).otherwise((F.get(F.col(doc), F.col(shift) + j) == x).cast("int")))
    same = F.transform(same, lambda x: F.coalesce(x, F.lit(0)))
    starts = F.sequence(F.lit(1), F.greatest(F.size(item) - LENGTH + 1, F.lit(1)))
    return F.array_max(F.transform(starts, lambda a: F.aggregate(F.slice(same, a, LENGTH), F.lit(0), lambda s, x: s + x)))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched): the benchmark items that each document holds, with the agreeing places of the best
    stretch.

    Null and empty texts and items match nothing. Items that repeat are reported each; rows with one doc_id are taken
    together. Extra columns are ignored."""
    items = materialise(benchmark.select("item_id", hashes(F.col("text")).alias("h")).where(F.size("h") > 0), "items")
    texts = docs.select("doc_id", hashes(F.col("text")).alias("h"))
    capped = F.least(F.size("h"), F.lit(SPAN))
    sizes = sorted(r.m for r in items.select(capped.alias("m")).distinct().collect())  # SPAN at most
    if not sizes:
        return docs.sparkSession.createDataFrame([], T.StructType([docs.schema["doc_id"], items.schema["item_id"], T.StructField("matched", T.IntegerType())]))
    masks = tuple(sorted({m for n in sizes for m in masks_of(n)}))
    tests = reduce(DataFrame.unionByName, [exploded(items.where(capped == n), "item_id", masks_of(n)) for n in sizes])
    tests = materialise(tests.select("item_id", F.col("pos").alias("at"), "seed"), "seeds")
    few = tests.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS
    hits = exploded(texts, "doc_id", masks).join(F.broadcast(tests) if few else tests, "seed")
    hits = materialise(hits.select("doc_id", "item_id", (F.col("pos") - F.col("at")).alias("shift")).distinct(), "hits")
    held = materialise(hits.select("doc_id").distinct(), "held")
    near = among(docs.select("doc_id", "text"), held, "doc_id").select("doc_id", hashes(F.col("text")).alias("h"))
    checked = hits.join(near, "doc_id").join(items.withColumnRenamed("h", "t"), "item_id")
    checked = checked.select("doc_id", "item_id", agreement("h", "t", "shift").alias("matched"), F.least(F.size("t"), F.lit(LENGTH)).alias("of"))
    return checked.where(F.col("matched") >= F.ceil(F.col("of") * AGREE)).groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text holds a benchmark item. Rows are told apart by a hash of doc_id and text, so that
    rows that share a doc_id, or have none, are judged by their own text."""
    free = "_" * (1 + max(map(len, docs.columns)))
    row = F.xxhash64("doc_id", "text")
    held = overlaps(docs.select(row.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(free)).distinct()
    return among(docs.withColumn(free, row), materialise(held, "contaminated"), free, "left_anti").select(*docs.columns)
