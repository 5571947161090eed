"""The corpus pipeline: from documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm import decontam, lang_id, line_dedup, ngram_join, packing
from clausewright.llm.common import materialise, table

#: Least score of a language that the first stage keeps a document for.
MIN_SCORE = 0.3
#: Begins the names that columns have in between.
FREE = "_pipeline_"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, null ones included, or without a likely language. Rows and columns that repeat
    or are null stay as they are; no documents, no rows."""
    return lang_id.likely(docs, MIN_SCORE)


def fewer_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that three or more documents have, but for the largest doc_id's, and renews n_chars.

    A text that loses all its lines stays, empty; a null text becomes empty. Rows of one doc_id count as one document."""
    cut = line_dedup.without_common_lines(docs.withColumnsRenamed({c: f"{FREE}{c}" for c in ("n_lines", "n_dropped")}))
    cut = cut.drop("n_lines", "n_dropped").withColumnsRenamed({f"{FREE}{c}": c for c in ("n_lines", "n_dropped")})
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates, of the least doc_id (null: last). Rows without words stay; rows
    that share a doc_id are judged by their texts."""
    return ngram_join.one_of_each(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null and empty texts hold none."""
    return decontam.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left: a row for each piece. Null text: empty; no documents: no rows."""
    return packing.packed_documents(docs)


STAGES = [
    ("language ID", known_language),
    ("line dedup", fewer_lines),
    ("n-gram Jaccard join", distinct_texts),
    ("benchmark decontamination", no_benchmark),
    ("best-fit packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage{k}")
    return docs


#: Language scores, min-hash tries and token ids are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None
