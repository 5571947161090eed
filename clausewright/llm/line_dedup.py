"""Line dedup by two Bloom filters, for hashes seen once and seen twice.

Each task fills its own pair of filters; the pairs are merged segment by segment. Lines that the twice-seen filter
holds are the suspects: only their digests are shuffled, to count documents exactly and find the largest doc_id. The
filters never decide by themselves, so a false positive costs a few bytes of shuffle and no line.

The filters have FILTER_BITS bits whatever the input, which is the bound on what is broadcast. Where the lines are so
many that they fill up, more lines become suspects, at most all, and the result is the same."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.llm.common import freed, materialise, spread_join, values

#: 16 MB a filter: 60 million distinct lines at 1 % false positives.
FILTER_BITS = 1 << 27
SEGMENT = 1 << 16  # bytes
PROBES = 3
MIN_CHARS, MIN_DOCS = 20, 3
STRIP = " \t\n\x0b\x0c\r"


def key_of(line: str) -> str:
    """The line without white space at its ends; digest() lower-cases it."""
    return line.strip(STRIP)


def digest(key: str) -> bytes:
    """The digest of a key; bytes.lower() changes A to Z only."""
    return hashlib.blake2b(key.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest()


def doc_digests(text: str | None, min_chars: int) -> list[bytes]:
    """Digests of the distinct keys of a text that are long enough."""
    return list({digest(k) for line in (text or "").split("\n") if len(line) >= min_chars and len(k := key_of(line)) >= min_chars})


def probes(digests: list[bytes], bits: int) -> np.ndarray:
    """Bit numbers of the digests: an array of (digests, PROBES)."""
    words = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    steps = np.arange(PROBES, dtype=np.uint64)
    return (words[:, :1] + steps * (words[:, 1:] | np.uint64(1))) & np.uint64(bits - 1)


def held(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def put(bits: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def packed(bits: np.ndarray) -> bytes:
    return zlib.compress(bits.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8)


def twice_filter(docs: DataFrame, min_chars: int = MIN_CHARS, bits: int = FILTER_BITS) -> np.ndarray:
    """The filter of the lines that at least two documents may have, of bits / 8 bytes."""

    def fill(batches):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        waiting: list[bytes] = []

        def flush():
            if waiting:
                # two equal digests of one batch don't see each other in the filter
                counts: dict[bytes, int] = {}
                for d in waiting:
                    counts[d] = counts.get(d, 0) + 1
                new = list(counts)
                at = probes(new, bits)
                again = held(once, at) | (np.fromiter(counts.values(), np.int64, len(new)) > 1)
                put(twice, at[again])
                put(once, at)
                waiting.clear()

        for batch in batches:
            for text in values(batch.column(0)):
                waiting.extend(doc_digests(text, min_chars))
                if len(waiting) >= 100_000:
                    flush()
        flush()
        task = TaskContext.get().partitionId()
        for s in np.flatnonzero(once.reshape(-1, min(SEGMENT, bits // 8)).any(axis=1)):
            part = slice(s * SEGMENT, (s + 1) * SEGMENT)
            yield pa.RecordBatch.from_pydict({"segment": [int(s)], "task": [task], "once": [packed(once[part])], "twice": [packed(twice[part])]}, schema=shape)

    def merge(batches):
        """Rows come sorted by segment: one pair of segments is held at a time."""
        now, once, twice = None, None, None
        for batch in batches:
            for s, a, b in zip(batch.column("segment").to_pylist(), batch.column("once").to_pylist(), batch.column("twice").to_pylist()):
                a, b = unpacked(a), unpacked(b)
                if s != now:
                    if now is not None:
                        yield pa.RecordBatch.from_pydict({"segment": [now], "task": [0], "once": [packed(once)], "twice": [packed(twice)]}, schema=shape)
                    now, once, twice = s, a.copy(), b.copy()
                else:
                    twice |= (once & a) | b
                    once |= a
        if now is not None:
            yield pa.RecordBatch.from_pydict({"segment": [now], "task": [0], "once": [packed(once)], "twice": [packed(twice)]}, schema=shape)

    shape = pa.schema([("segment", pa.int32()), ("task", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
    ddl = "segment int, task int, once binary, twice binary"
    filled = docs.select("text").mapInArrow(freed(fill), ddl)
    # first in groups of 64 tasks, then all: no task reads a segment of more than tasks / 64 + 64 others
    some = filled.repartition("segment", F.col("task") % 64).sortWithinPartitions("segment").mapInArrow(merge, ddl)
    every = some.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, ddl)
    out = np.zeros(bits // 8, np.uint8)
    for r in every.select("segment", "twice").toLocalIterator():  # bits / 8 bytes in all
        out[r.segment * SEGMENT : (r.segment + 1) * SEGMENT] = unpacked(bytes(r.twice))
    return out


def suspects(docs: DataFrame, bits: int = FILTER_BITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(digest, doc_id) of the lines that the twice-seen filter holds, once for each document row."""
    shared = docs.sparkSession.sparkContext.broadcast(packed(twice_filter(docs, min_chars, bits)))

    def find(batches):
        twice = unpacked(shared.value)
        for batch in batches:
            ids, found = [], []
            for i, text in zip(batch.column(0).to_pylist(), values(batch.column(1))):
                if digests := doc_digests(text, min_chars):
                    hit = held(twice, probes(digests, bits))
                    found += [d for d, h in zip(digests, hit.tolist()) if h]
                    ids += [i] * int(hit.sum())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(ids, pa.int64())], ["digest", "doc_id"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(freed(find), "digest binary, doc_id long")


def drops(docs: DataFrame, bits: int = FILTER_BITS, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, digests): what each document loses."""
    pairs = materialise(suspects(docs, bits, min_chars).distinct(), "suspects")
    common = pairs.groupBy("digest").agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs)
    lost = spread_join(pairs, materialise(common.select("digest", "last"), "common"), "digest", "inner").where(F.col("doc_id") < F.col("last"))
    return lost.groupBy("doc_id").agg(F.collect_list("digest").alias("digests"))  # at most a text's lines


def without_common_lines(docs: DataFrame, bits: int = FILTER_BITS, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with text cut to its kept lines, and n_lines, n_dropped.

    A null or empty text is one empty line and gives an empty text. Rows with one doc_id count as one document. Rows
    with null doc_id lose nothing. Other columns stay; columns named n_lines or n_dropped are replaced."""
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # names that no column has: a clashing name in docs is neither lost nor ambiguous
    free = "_" * (1 + max(map(len, docs.columns)))
    lost = drops(docs.select("doc_id", "text"), bits, min_chars, min_docs).select(F.col("doc_id").alias(free + "id"), F.col("digests").alias(free + "digests"))
    joined = docs.select(*own).join(lost, docs["doc_id"] == F.col(free + "id"), "left").drop(free + "id")
    at = joined.columns.index("text")

    def cut(batches):
        for batch in batches:
            texts, lines, dropped = [], [], []
            for text, lost in zip(values(batch.column(at)), batch.column(len(own)).to_pylist()):
                every = (text or "").split("\n")
                if lost:
                    lost = set(lost)
                    kept = [x for x in every if len(x) < min_chars or len(k := key_of(x)) < min_chars or digest(k) not in lost]
                else:
                    kept = every
                texts.append("\n".join(kept) if lost else text or "")
                lines.append(len(every))
                dropped.append(len(every) - len(kept))
            arrays = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(own))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*own, "n_lines", "n_dropped"])

    shape = T.StructType([*[f for f in joined.schema.fields if f.name != free + "digests"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(freed(cut), shape)


def line_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256."""
    kept = without_common_lines(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), k AS (
  SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, k.i, k.line, coalesce(k.doc_id < c.last, false) AS lost FROM k LEFT JOIN c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
