"""Best-fit packing by exact-complement hashing.

Pieces differ for packing only by their length, of which there are at most `size`. The plan is made on their counts:
from the longest down, a length's gap is looked up in an index of single, pair and triple sums of the available
lengths and filled exactly, for as many sequences as the counts allow; what has no exact filling is placed best-fit.
plan() says in which order, so that there are never more sequences than by best-fit alone.
A plan has a few rows for each length, however many pieces there are. Pieces get their rank within their length by
counts over buckets, so that a length that a third of all pieces have is ranked by many tasks."""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausewright.llm.common import freed, materialise, values

SIZE = 2048
#: Buckets that a length's pieces are ranked in: so many at least, and one for every BUCKET_PIECES pieces.
BUCKETS, BUCKET_PIECES = 256, 100_000
#: Bytes of words and ids that a Python worker remembers between blocks of texts, about; changes speed only.
CACHE_BYTES = 80_000_000
#: What an entry takes besides its characters and ids.
ENTRY_BYTES = 200
#: Texts whose words are looked up together, and their characters at most, unless one text has more; words whose ids
#: are put together at once.
BLOCK_TEXTS, BLOCK_CHARS, PORTION = 1_000, 4_000_000, 200_000
END = b"\0\0\0\0"
#: How the tokenizer's vocabulary marks the last piece of a word, and how many unseen words are encoded at once.
WORD_END = "</w>"
RUN = 2_000
#: How special tokens begin.
SPECIAL = "<|"
#: Marks that may follow the letters of a word.
MARKS = ".,;:!?%&$#*)"


class Sums:
    """An index of the sums of one, two and three available lengths.

    count[n] is the number of pieces of length n that are left. The entry of a sum lists its combinations; it is
    made when the sum is first looked up. Counts only fall, so a combination that has run out at the head of its list is taken out for good."""

    def __init__(self, count: list[int]):
        self.count = count
        self.lengths = [n for n in range(len(count) - 1, 0, -1) if count[n]]
        self.pairs: dict[int, list[tuple[int, int]]] = {}
        self.triples: dict[int, list[int]] = {}
    def enough(self, parts: tuple[int, ...]) -> bool:
        return all(self.count[x] >= parts.count(x) for x in parts)

    def pair(self, total: int, own: tuple[int, ...]) -> tuple[int, int] | None:
        held = self.pairs.get(total)
        if held is None:  # the longest part is at the end, where it is popped
            held = self.pairs[total] = [(a, total - a) for a in reversed(self.lengths) if total / 2 <= a < total and self.count[total - a]]
        while held and not self.enough(held[-1]):
            held.pop()
        return next((p for p in reversed(held) if self.enough(own + p)), None)

    def fill(self, gap: int, own: tuple[int, ...], parts: int) -> tuple[int, ...] | None:
        """`parts` available lengths that add up to gap, besides the pieces in own."""
        if parts == 1:
            return (gap,) if self.enough((*own, gap)) else None
        if parts == 2:
            return self.pair(gap, own)
        firsts = self.triples.setdefault(gap, [a for a in reversed(self.lengths) if gap / 3 <= a < gap - 1])
        while firsts and not self.count[firsts[-1]]:
            firsts.pop()
        for a in reversed(firsts):
            if self.enough((*own, a)) and (rest := self.pair(gap - a, (*own, a))):
                return (a, *rest)
        return None


Made = list[tuple[int, tuple[int, ...]]]


def exact(left: list[int], size: int, least: int, most: int = 3) -> Made:
    """Takes full sequences of a piece of `least` or longer and up to `most` others out of left.

    First all that one piece completes, then two, then three: the fewer the others, the more gaps they can fill."""
    out: Made = []
    if left[size]:
        out.append((left[size], (size,)))
        left[size] = 0
    index = Sums(left)
    for parts in range(1, most + 1):
        for n in range(size - 1, least - 1, -1):
            while left[n] and (fill := index.fill(size - n, (n,), parts)):
                own = (n, *fill)
                times = min(left[x] // own.count(x) for x in own)
                for x in own:
                    left[x] -= times
                out.append((times, own))
    return out


def best_fit(left: list[int], size: int) -> Made:
    """Puts the pieces, longest first, where the gap that stays is least; equal sequences are one entry."""
    entry: Made = []
    gaps: list[tuple[int, int]] = []  # (gap, entry), sorted

    def add(times: int, own: tuple[int, ...]) -> None:
        entry.append((times, own))
        insort(gaps, (size - sum(own), len(entry) - 1))

    for n in range(size, 0, -1):
        while left[n]:
            at = bisect_left(gaps, (n, -1))
            if at < len(gaps):
                gap, e = gaps.pop(at)
                times, own = entry[e]
                each = min(gap // n, left[n])
                use = min(times, left[n] // each)
                left[n] -= use * each
                entry[e] = (0, own)
                add(use, own + (n,) * each)
                if times > use:
                    add(times - use, own)
            else:
                each = min(size // n, left[n])
                use = left[n] // each
                left[n] -= use * each
                add(use, (n,) * each)
    return [x for x in entry if x[0]]


def plan(counts: dict[int, int], size: int = SIZE) -> Made:
    """(number of sequences, lengths in each), using each length counts[length] times.

    Exact fillings of two and three pieces use up short pieces that long ones may need. So the plan is made with
    fillings of up to three, two and one pieces, for all and for the longer half of the lengths, each completed by
    best-fit, and by best-fit alone; the one of fewest sequences is taken, of equals the first."""

    def start() -> list[int]:
        left = [0] * (size + 1)
        for n, c in counts.items():
            left[n] = c
        return left

    tried = []
    for least, most in ((1, 3), (size // 2 + 1, 3), (size // 2 + 1, 2), (1, 1)):
        left = start()
        tried.append(exact(left, size, least, most) + best_fit(left, size))
    tried.append(best_fit(start(), size))
    return min(tried, key=lambda made: sum(times for times, _ in made))


def placements(made: Made) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces in each, offset of the first): where ranks of a length go."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for times, own in made:
        offset = 0
        for n in sorted(set(own), reverse=True):
            each = own.count(n)
            a = used.get(n, 0)
            used[n] = a + times * each
            out.append((n, a, used[n], sequence, each, offset))
            offset += n * each
        sequence += times
    return out


def lowered(text: str) -> str:
    """The text in lower case, as the tokenizer has it, where its letters are all of Latin 1; else as it is.

    What might become a special token by it stays too: the tokenizer looks for those in the text as it came."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text if SPECIAL in text else text.lower()


def grown(a: np.ndarray, need: int) -> np.ndarray:
    """a, or a copy of twice its size or more if it has fewer than `need` places."""
    if need <= len(a):
        return a
    out = np.empty(max(need, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


class Words:
    """Ids of what stands between spaces and line feeds: the tokenizer never joins across those.

    Word n of `place` has ids[begin[n] : begin[n] + size[n]]; hits[n] counts the blocks that it came in."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.coder = Tokenizer.from_file(tokenizer)
        vocabulary = self.coder.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        if not self.ends.any():
            raise ValueError(f"{tokenizer} does not mark the ends of words, at which texts are cut here")
        # The same model without the steps that leave lower-case letters of Latin 1 as they are.
        self.plain = Tokenizer(self.coder.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.empty()

    def empty(self) -> None:
        self.place = {"": 0}
        self.ids = np.empty(1 << 16, np.uint32)
        self.begin, self.size, self.hits = (np.zeros(1 << 14, np.int32) for _ in range(3))
        self.used = self.chars = 0

    @property
    def held(self) -> int:
        """Bytes of the words and their ids, about."""
        return ENTRY_BYTES * len(self.place) + self.chars + 4 * self.used

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, end = len(self.place), len(self.place) + len(words)
        self.begin, self.size, self.hits = (grown(a, end) for a in (self.begin, self.size, self.hits))
        self.ids = grown(self.ids, self.used + len(ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.begin[n:end] = self.used + np.cumsum(sizes) - sizes
        self.size[n:end] = sizes
        self.hits[n:end] = 0
        self.used += len(ids)
        self.chars += sum(map(len, words))
        self.place.update(zip(words, range(n, end)))

    def gathered(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at these numbers, one behind the other, and how many each has."""
        sizes = self.size[at]
        ends = np.cumsum(sizes, dtype=np.int64)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        for a in range(0, len(at), PORTION):
            n, e = sizes[a : a + PORTION], ends[a : a + PORTION]
            first, last = int(e[0] - n[0]), int(e[-1])
            out[first:last] = self.ids[np.repeat(self.begin[at[a : a + PORTION]] - (e - n - first), n) + np.arange(last - first)]
        return out, sizes

    def forget(self) -> None:
        """Over the bound, keeps what came in several blocks since the last time, or nothing if that is over half of it.

        Called between blocks, whose words are all kept until then."""
        if self.held <= CACHE_BYTES:
            return
        again = self.hits[: len(self.place)] > 1
        again[0] = False  # the empty word, which empty() places
        kept = np.flatnonzero(again)
        words = [w for w, k in zip(self.place, again.tolist()) if k]
        ids, sizes = self.gathered(kept)
        self.empty()
        self.add(words, ids, sizes)
        if self.held > CACHE_BYTES / 2:
            self.empty()

    def encode_each(self, words: list[str]) -> None:
        for k in range(0, len(words), 10_000):
            part = words[k : k + 10_000]
            found = [x.ids for x in self.coder.encode_batch_fast(part, add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(part))
            self.add(part, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes)

    def encode_run(self, words: list[str]) -> None:
        """Encodes words of Latin 1 letters as one text and cuts its ids behind each id that ends a word.

        A word has one such id at least. If there are more than words, some word has several: then each by itself."""
        (found,) = self.plain.encode_batch_fast([" ".join(words).lower()], add_special_tokens=False)
        ids = np.array(found.ids, np.uint32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            return self.encode_each(words)
        self.add(words, ids, np.diff(cuts, prepend=0))

    def learn(self, words: list[str]) -> None:
        """Places words, each once and none of them placed yet."""
        # Letters of Latin 1 and the marks that follow them are tokenized apart: their ids can be put together. Other
        # letters can turn into letters and marks when lower-cased, or join with them, which would join the marks behind.
        stems, whole, made, first, ends = set(), set(), [], [], []
        for w in words:
            s = w.rstrip(MARKS)
            if not (s.isalpha() and (s.isascii() or max(s) <= "\xff")):
                whole.add(w)
                continue
            stems.add(s)
            if len(s) < len(w):
                made.append(w)
                first.append(s)
                ends.append(w[len(s) :])
        stems = [s for s in stems if s not in self.place]
        for k in range(0, len(stems), RUN):
            self.encode_run(stems[k : k + RUN])
        self.encode_each([w for w in whole.union(ends) if w not in self.place])
        if made:
            both = self.numbers(chain.from_iterable(zip(first, ends)), 2 * len(made))
            ids, sizes = self.gathered(both)
            self.add(made, ids, sizes[::2] + sizes[1::2])

    def numbers(self, words, n: int) -> np.ndarray:
        """The numbers of n words, -1 for those not placed."""
        return np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, n)

    def joined(self, texts):
        """The ids of each text and the closing 0."""
        block, chars = [], 0
        for text in texts:
            block.append(lowered(text or "").replace("\n", " "))
            chars += len(block[-1])
            if len(block) == BLOCK_TEXTS or chars > BLOCK_CHARS:
                yield from self.ids_of(block)
                block, chars = [], 0
        if block:
            yield from self.ids_of(block)

    def ids_of(self, block: list[str]):
        lists = pc.split_pattern(pa.array(block, pa.large_string()), " ")
        words = lists.flatten().dictionary_encode()
        each = words.dictionary.to_pylist()
        at = self.numbers(each, len(each))
        new = np.flatnonzero(at < 0)
        if len(new):
            unknown = [each[k] for k in new.tolist()]
            self.learn(unknown)
            at[new] = self.numbers(unknown, len(unknown))
        self.hits[at] += 1
        ids, sizes = self.gathered(at[words.indices.to_numpy()])
        cuts = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))[lists.offsets.to_numpy()].tolist()
        for a, b in zip(cuts, cuts[1:]):
            yield ids[a:b].tobytes() + END
        self.forget()


#: One for each tokenizer, kept by a Python worker from task to task.
_WORDS: dict[str, Words] = {}


def words_of(tokenizer: str) -> Words:
    if tokenizer not in _WORDS:
        _WORDS[tokenizer] = Words(tokenizer)
    return _WORDS[tokenizer]


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each text's token ids and a closing 0, cut at `size` ids."""

    def cut(batches):
        words = words_of(tokenizer)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), words.joined(values(batch.column(1)))):
                for k, a in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[a : a + 4 * size]
                    rows.append((doc, k, a // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(freed(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def packed(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text: empty, one piece of the closing 0. No documents: no rows. Rows that repeat, and those with null doc_id,
    are packed as often as they occur. Extra columns are ignored."""
    spark = docs.sparkSession
    cut = materialise(pieces(docs, tokenizer, size), "pieces")
    buckets = max(BUCKETS, cut.count() // BUCKET_PIECES)
    cut = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = materialise(cut.groupBy("length", "_bucket").agg(F.count("*").alias("n")), "counts")
    made = plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)  # at most `size` rows
    # the plan's rows: bounded by size, not by the input
    where = spark.createDataFrame(placements(made), "_length long, _from long, _to long, _sequence long, _each long, _offset long")
    before = counts.withColumn("_before", F.sum("n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "_bucket", F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = cut.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")) - 1).join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    placed = ranked.join(F.broadcast(where), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.expr("_sequence + (_rank - _from) div _each").alias("sequence_id"),
        F.expr("_offset + (_rank - _from) % _each * length").alias("offset"),
    )


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed_documents(docs: DataFrame) -> DataFrame:
    return packed(docs, tokenizer_path())
