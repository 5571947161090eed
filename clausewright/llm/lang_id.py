"""Language ID by word-first backoff.

A known word scores by its log frequency in each language. An unseen word scores by its longest known character
n-grams: those of five characters and, where none is known, of four, three, two and one."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.llm.common import CACHE_ENTRIES, LONG_WORD, freed, small_batches, values

#: Labelled documents to learn from, at most about so many of each language.
TRAIN_DOCS = 2_000
#: Words of a language that count as known, the most frequent; fewer where the languages are so many that the model,
#: which has a number for each word and language, would have more than about CELLS numbers.
VOCABULARY, CELLS = 20_000, 8_000_000
NGRAMS = (5, 4, 3, 2, 1)
#: Words whose evidence a document's score takes into account at most.
SATURATION = 30
#: Letters of a word at most; a longer run, as in text without spaces, is that many words in a row.
WORD = 64
UNKNOWN = "und"


def train(labelled: DataFrame, per_language: int = TRAIN_DOCS, vocabulary: int = VOCABULARY) -> dict:
    """A model from (doc_id, text, lang): the languages, and log frequencies of words and n-grams by language.

    The documents are chosen by a hash of their id, so the choice spreads over all of the input and does not change."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not sizes:
        return {"languages": [], "words": {}, "ngrams": {}}
    vocabulary = max(1, min(vocabulary, CELLS // len(sizes) ** 2))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    words = chosen.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{1,%d})" % WORD), F.lit(1))).alias("word"))
    counted = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("r") <= vocabulary)
    top: dict[str, Counter] = {k: Counter() for k in sizes}
    for r in ranked.collect():  # CELLS words at most
        top[r.lang][r.word] = r.n
    languages = sorted(sizes)
    grams: dict[str, Counter] = {k: Counter() for k in languages}
    for k in languages:
        for w, n in top[k].items():
            padded = f"^{w}$"
            for size in NGRAMS:
                for i in range(len(padded) - size + 1):
                    grams[k][padded[i : i + size]] += n
    grams = {k: Counter({g: n for g, n in c.items() if n > 1}) for k, c in grams.items()}
    return {"languages": languages, "words": logs([top[k] for k in languages]), "ngrams": logs([grams[k] for k in languages], by_length=True)}


def logs(counts: list[Counter], by_length: bool = False) -> dict[str, tuple[float, ...]]:
    """For each key, its log frequency by language, less the mean over languages; half a count where it is missing."""
    totals: list[dict] = []
    for c in counts:
        t: dict = defaultdict(int)
        for k, n in c.items():
            t[len(k) if by_length else 0] += n
        totals.append(t)
    out = {}
    for k in set().union(*counts):
        of = len(k) if by_length else 0
        row = [math.log((c.get(k, 0) + 0.5) / (t[of] + 1)) for c, t in zip(counts, totals)]
        mean = sum(row) / len(row)
        out[k] = tuple(x - mean for x in row)
    return out


class WordScores(dict):
    """Row numbers in `rows` of the scores of what stands between white space, and in `words` of how many words gave them."""

    def __init__(self, model: dict):
        super().__init__()
        self.model, self.width = model, len(model["languages"])
        self.rows = np.zeros((CACHE_ENTRIES + 1, self.width), np.float32)
        self.words = np.zeros(CACHE_ENTRIES + 1, np.int64)
        self.used = 0

    def word(self, w: str) -> tuple[float, ...] | None:
        if known := self.model["words"].get(w):
            return known
        padded, grams = f"^{w}$", self.model["ngrams"]
        for size in NGRAMS:
            if found := [g for i in range(len(padded) - size + 1) if (g := grams.get(padded[i : i + size]))]:
                return tuple(sum(x) / len(found) for x in zip(*found))
        return None

    def __missing__(self, token: str) -> int:
        """Row 0 is for tokens without letters. Those and long tokens aren't kept, so that CACHE_ENTRIES and LONG_WORD
        bound the bytes; rows are used up by every token that has letters."""
        letters = token if token.isalpha() else "".join(c if c.isalpha() else " " for c in token)
        found = [s for w in letters.split() for a in range(0, len(w), WORD) if (s := self.word(w[a : a + WORD]))]
        if not found:
            at = 0
        else:
            self.used += 1
            at = self.used
            self.rows[at] = [sum(x) for x in zip(*found)]
            self.words[at] = len(found)
            if len(token) <= LONG_WORD:
                self[token] = at
        return at


def predict(docs: DataFrame, model: dict, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its score under the given names; its own columns of those are replaced."""
    small_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in names]
    at = own.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by VOCABULARY and CELLS

    def score(batches):
        model = shared.value
        scores, known = WordScores(model), model["languages"]
        for batch in batches:
            langs, shares = [], []
            for text in values(batch.column(at)):
                words = text.lower().split() if text else []
                total, n = np.zeros(len(known)), 0
                for a in range(0, len(words), 20_000):
                    if scores.used > CACHE_ENTRIES - 20_000:
                        scores.clear()
                        scores.used = 0
                    part = words[a : a + 20_000]
                    rows = np.fromiter(map(scores.__getitem__, part), np.int64, len(part))
                    total += scores.rows[rows].sum(0, dtype=np.float64)
                    n += int(scores.words[rows].sum())
                if not known or (n == 0 and not any(c.isalpha() for c in text or "")):
                    langs.append(UNKNOWN)
                    shares.append(0.0)
                    continue
                z = total * (min(n, SATURATION) / max(n, 1))
                z = np.exp(z - z.max())
                best = int(z.argmax())
                langs.append(known[best])
                shares.append(float(z[best] / z.sum()))
            arrays = [batch.column(i) for i in range(len(own))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(langs, pa.string()), pa.array(shares, pa.float64())], [*own, *names])

    source = docs.select(*own)
    return source.mapInArrow(freed(score), T.StructType([*source.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def likely(docs: DataFrame, least: float) -> DataFrame:
    """docs without those that have no letter, or no language of a score of `least` or more. Learned from its own lang."""
    free = "_" * (1 + max(map(len, docs.columns)))
    said = predict(docs, train(docs.select("doc_id", "text", "lang")), (free + "l", free + "s"))
    return said.where((F.col(free + "l") != UNKNOWN) & (F.col(free + "s") >= least)).select(*docs.columns)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score.

    Learned from the documents that aren't held out and have a lang. Text null or without a letter: und, score 0, as
    is every text if no document is labelled. Ties go to the first language by name. Extra columns are ignored."""
    model = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
