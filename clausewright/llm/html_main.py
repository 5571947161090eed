"""Main text of web pages by a suffix array over each host's pages.

A page becomes a stream of words in blocks. The streams of a host's distinct pages, marked or not, are concatenated and
their suffixes ranked by prefix doubling: runs of MIN_RUN words or more that stand outside the marked articles of two
pages are boilerplate. They are cut out of their block; a block that shared runs cover as a whole goes, also if they
began in the block before. Unique runs stay.

An exact check by the page's own marks follows. Where a page marks its article, that is the main text: its blocks stay
even if another page repeats them (a copied article is no boilerplate), and what stands elsewhere goes even if unique.
On other pages what stands in navigation, footers, adverts, comments and the like goes.

A host whose pages have over SHARD_CHARS characters is dealt into shards, each with its own array. What a shard's array
finds, by distinct window, is counted over all shards, so that the verdict doesn't depend on how pages were dealt."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.common import MIX, WordHashes, freed, materialise, mixed, values

MIN_RUN = 8
SHARD_CHARS = 4_000_000
#: Distinct pages that a task remembers, so that it sends the blocks of repeated ones once.
SEEN = 100_000
#: Between the pages of a shard; white space, so that no block holds it.
BETWEEN = "\x1e"
PACKED = pa.Codec("zstd", compression_level=3)

NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
#: What ends a tag or begins a quoted value.
NEXT = re.compile(r">|=\s*([\"'])")
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas", "title"}
GONE = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head"}
MAIN = {"article", "main"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
AUTO = {"p", "li", "td", "th", "tr", "dt", "dd", "option", "thead", "tbody", "tfoot"}
HINT = re.compile(
    r"(?<![a-z])(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|"
    r"header|masthead|footer|comments?|respond|reply|replies|disqus|share|sharing|social|newsletter|subscribe|signup|login|related|recommend\w*|widget|pagination|pager|skip)(?![a-z])"
)
MARK = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
FREE, KEPT, LOST = 0, 1, 2


def zone_of(name: str, attributes: str, inside: int) -> int:
    """What an element makes of its contents, given what its parent makes of them."""
    if inside == LOST or name in GONE or (attributes and HIDDEN.search(attributes)):
        return LOST
    if name == "header":
        return inside if inside == KEPT else LOST
    marks = " ".join(a or b or c for a, b, c in MARK.findall(attributes)).lower() if attributes else ""
    if name in MAIN or marks == "main":
        return LOST if name != "main" and re.search(r"(?<![a-z])comments?(?![a-z])", marks) else KEPT
    if marks and name not in ("html", "body") and HINT.search(marks):
        return LOST
    return inside


def pieces(source: str):
    """(name, attributes, end) of the tags, names of closing ones with a slash; and (None, text, end) of what stands
    between. Comments and declarations are passed over. Every character is looked at a fixed number of times."""
    at, size = 0, len(source)
    unclosed: set[str] = set()  # quotes that don't occur any more
    while at < size:
        if source[at] != "<":
            end = source.find("<", at)
            end = size if end < 0 else end
            yield None, source[at:end], end
        elif source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            end = size if end < 0 else end + 3
        elif source[at + 1 : at + 2] in ("!", "?"):
            end = source.find(">", at)
            end = size if end < 0 else end + 1
        elif m := NAME.match(source, at + 1):
            end = m.end()
            while True:
                stop = NEXT.search(source, end)
                end = stop.end() if stop else size
                if not stop or not stop[1]:
                    break
                if stop[1] not in unclosed:
                    close = source.find(stop[1], end)
                    if close < 0:
                        unclosed.add(stop[1])
                    else:
                        end = close + 1
            at = yield m[0].lower(), source[m.end() : end - 1 if stop else end], end
            if at is not None:
                yield None, "", at
                continue
        else:
            end = at + 1
            yield None, "<", end
        at = end


def blocks(html: str | None) -> list[tuple[int, str]]:
    """(zone, text) of a page's blocks: references decoded, white space turned into single spaces, none empty."""
    out: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []
    opened: Counter = Counter()
    zone, source = FREE, html or ""
    after: dict[str, bool] = {}  # whether a raw element's end may still come

    def close() -> None:
        if text:
            if words := " ".join(unescape("".join(text)).split()):
                out.append((zone, words))
            text.clear()

    def pop(at: int) -> int:
        opened.subtract(n for n, _ in stack[at:])
        del stack[at:]
        return stack[-1][1] if stack else FREE

    stream = pieces(source)
    for name, value, at in stream:
        if name is None:
            text.append(value)
            continue
        if name[0] == "/":
            name = name[1:]
            inline = name in INLINE
            if not inline:
                close()
            if opened[name]:
                i = len(stack) - 1
                while stack[i][0] != name:
                    i -= 1
                if inline:
                    close()
                zone = pop(i)
            continue
        self_closed = value.rstrip().endswith("/") and not re.search(r"=\s*[^\s\"']*/\s*$", value)
        if name in RAW:
            close()
            if not self_closed:
                done = re.compile(rf"</{name}\s*>", re.I).search(source, at) if after.get(name, True) else None
                after[name] = done is not None
                stream.send(done.end() if done else len(source))
            continue
        new = zone_of(name, value, zone)
        if name in INLINE:
            if new != zone and name not in VOID:
                close()
                stack.append((name, new))
                opened[name] += 1
                zone = new
            continue
        close()
        if name in VOID or self_closed:
            continue
        if name in AUTO and stack and stack[-1][0] == name:
            zone = pop(len(stack) - 1)
            new = zone_of(name, value, zone)
        stack.append((name, new))
        opened[name] += 1
        zone = new
    close()
    return out


def windows(tokens: np.ndarray, page: np.ndarray, run: int, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the rank of its window of `run` words, and for each rank in how many distinct pages it stands
    at a counted position.

    tokens: word numbers, with a number of its own for each page's end, so that windows over it are alone. Prefix
    doubling ranks the suffixes by their first 1, 2, 4, ... words up to run, which is all that such windows need."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < run:
        step = min(width, run - width)
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        width += step
    order = np.lexsort((page, rank))  # the suffix array, to this depth
    some = order[counted[order]]
    r, p = rank[some], page[some]
    new = np.ones(len(some), bool)
    new[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1])
    return rank, np.bincount(r, weights=new, minlength=n).astype(np.int64)


def covered(hit: np.ndarray, run: int) -> np.ndarray:
    """Which positions lie in a window whose start is hit."""
    step = np.zeros(len(hit) + run + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(step, at, 1)
    np.add.at(step, at + run, -1)
    return step.cumsum()[: len(hit)] > 0


class Streams:
    """The pages' blocks as one stream of numbered words."""

    def __init__(self, pages: list[list[str]]):
        sizes = [[b.count(" ") + 1 for b in own] for own in pages]
        words = " ".join(b[1:] for own in pages for b in own).split(" ") if any(pages) else []
        coded = pa.array(words, pa.string()).dictionary_encode()
        self.pages, self.sizes, self.words = pages, sizes, coded.dictionary
        lengths = np.array([sum(n) + 1 for n in sizes], np.int64)
        end = np.zeros(lengths.sum(), bool)
        end[lengths.cumsum() - 1] = True
        self.tokens, self.page = np.empty(len(end), np.int64), np.repeat(np.arange(len(pages)), lengths)
        self.tokens[~end], self.tokens[end] = coded.indices.to_numpy(), -1 - np.arange(len(pages))
        self.marked = np.zeros(len(end), bool)
        self.marked[~end] = np.repeat(np.array([b[0] == str(KEPT) for own in pages for b in own], bool), [n for own in sizes for n in own])

    def undecided(self) -> np.ndarray:
        """For each position whether its page marks no article, so that the shared windows decide."""
        return ~np.bincount(self.page, weights=self.marked, minlength=len(self.pages)).astype(bool)[self.page]

    def windows(self, run: int) -> tuple[np.ndarray, np.ndarray]:
        """windows() of the stream, counted where they touch no marked article."""
        return windows(self.tokens, self.page, run, ~covered(self.marked[::-1], run)[::-1])

    def hashes(self, run: int) -> np.ndarray:
        """A 64-bit hash of the window at each position, the same in every shard; 0 over a page's end."""
        known = WordHashes()
        h = np.array([*[known[w] for w in self.words.to_pylist()], 0], np.uint64)[np.maximum(self.tokens, -1)]
        out = np.zeros(len(h), np.uint64)
        padded = np.concatenate([h, np.zeros(run, np.uint64)])
        for i in range(run):
            out = mixed(out * MIX + padded[i : i + len(h)])
        end = covered((self.tokens < 0)[::-1], run)[::-1]
        return np.where(end, np.uint64(0), out | np.uint64(1)).view(np.int64)

    def texts(self, hit: np.ndarray, run: int) -> list[str]:
        """Each page's unique runs outside marked boilerplate, or its marked article; hit: the starts of shared windows."""
        by_stream = covered(hit, run)
        at, out = 0, []
        for own, sizes in zip(self.pages, self.sizes):
            kept = [b[1:] for b in own if b[0] == str(KEPT)]
            if not kept:
                begin = at
                for b, n in zip(own, sizes):
                    if b[0] != str(LOST) and not by_stream[begin : begin + n].all():
                        inside = hit[begin : begin + n].copy()
                        inside[max(0, n - run + 1) :] = False
                        cut = covered(inside, run)
                        kept += [w for w, c in zip(b[1:].split(" "), cut.tolist()) if not c]
                    begin += n
            at += sum(sizes) + 1
            out.append(" ".join(kept))
        return out


def host_of():
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, the key of the page's blocks, and the blocks themselves (zone and text of each, packed); null
    where the task has sent those of an equal page of the host."""

    def parse(batches):
        seen: set[tuple] = set()
        for batch in batches:
            keys, packed = [], []
            for host, html in zip(batch.column(2).to_pylist(), values(batch.column(3))):
                plain = "\n".join(f"{z}{t}" for z, t in blocks(html)).encode("utf-8", "surrogatepass")
                keys.append(xxhash.xxh3_128_digest(plain))
                new = (host, keys[-1]) not in seen
                packed.append(zlib.compress(plain) if new else None)
                if new:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add((host, keys[-1]))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], ["page_id", "url", "host", "key", "packed"])

    return pages.select(F.col("page_id").cast("long"), "url", host_of().alias("host"), "html").mapInArrow(freed(parse), "page_id long, url string, host string, key binary, packed binary")


def shard_of(group: pa.Table) -> pa.Table:
    """One row of a shard's rows of parsed(): its distinct pages, packed, and the number among them of each page."""
    number: dict[bytes, int] = {}
    own = [number.setdefault(k, len(number)) for k in group.column("key").to_pylist()]
    held = [b""] * len(number)
    for i, packed in zip(own, group.column("packed")):
        if packed.is_valid and not held[i]:
            held[i] = packed.as_py()
    joined = BETWEEN.encode().join(map(zlib.decompress, held))
    pages = len(joined).to_bytes(8, "little") + PACKED.compress(joined, asbytes=True)
    as_list = lambda c, t: pa.array([c], pa.list_(t))
    first = [group.column(c).slice(0, 1).combine_chunks() for c in ("host", "shard", "shards")]
    return pa.table([*first, as_list(group.column("page_id").to_pylist(), pa.int64()), as_list(group.column("url").to_pylist(), pa.string()), as_list(own, pa.int32()), pa.array([pages], pa.binary())], names=["host", "shard", "shards", "page_id", "url", "own", "pages"])


SHARD = "host string, shard int, shards int, page_id array<long>, url array<string>, own array<int>, pages binary"


def unpacked(pages: bytes) -> Streams:
    joined = PACKED.decompress(pages[8:], int.from_bytes(pages[:8], "little"), asbytes=True).decode("utf-8", "surrogatepass")
    return Streams([p.split("\n") if p else [] for p in joined.split(BETWEEN)])


def rows(batches):
    """The rows of Arrow batches, one at a time, as each holds a shard."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield [c[i].as_py() for c in batch.columns]


GROUP = ("host", "shard")


def main_text(pages: DataFrame, shard_chars: int = SHARD_CHARS, run: int = MIN_RUN) -> DataFrame:
    """Per page: page_id, url, text, n_chars.

    Null or empty html: empty text. Null or malformed url: such pages form a host of their own. Equal pages count once
    as evidence and all get their text. Without html, a page_id or a url that repeats, each row gives a row. Extra
    columns are ignored."""
    sizes = pages.select(host_of().alias("host"), F.length("html").alias("n")).groupBy("host").agg(F.ceil(F.sum("n") / shard_chars).cast("int").alias("shards"))
    large = materialise(sizes.where("shards > 1"), "large")  # a row for each shard_chars characters at most
    dealt = parsed(pages).join(large, "host", "left").withColumn("shard", F.pmod(F.xxhash64("key"), F.coalesce("shards", F.lit(1))).cast("int"))
    shards = materialise(dealt.groupBy(*GROUP).applyInArrow(shard_of, SHARD), "shards")

    def found(batches):
        for host, shard, packed in rows(batches):
            own = unpacked(packed)
            rank, count = own.windows(run)
            first = np.unique(rank, return_index=True)[1]
            h, n = own.hashes(run)[first], count[rank[first]]
            asked = np.bincount(rank, weights=own.undecided(), minlength=len(rank))[rank[first]] > 0
            h, n, asked = (x[(h != 0) & (n > 0)] for x in (h, n, asked))
            yield pa.RecordBatch.from_arrays([pa.array([host] * len(h), pa.string()), pa.array([shard] * len(h), pa.int32()), pa.array(h), pa.array(n), pa.array(asked)], ["host", "shard", "window", "pages", "asked"])

    shared = None
    if not large.isEmpty():
        seen = materialise(shards.where("shards IS NOT NULL").select(*GROUP, "pages").mapInArrow(freed(found), "host string, shard int, window long, pages long, asked boolean"), "windows")
        common = seen.groupBy("host", "window").agg(F.sum("pages").alias("n")).where("n > 1").select("host", "window")
        shared = materialise(seen.where("asked").join(common, ["host", "window"]).groupBy(*GROUP).agg(F.collect_list("window").alias("shared")), "shared")

    def cut(batches):
        for of_many, ids, urls, numbers, packed, shared in rows(batches):
            own = unpacked(packed)
            if of_many is None:
                rank, count = own.windows(run)
                hit = count[rank] > 1
            else:
                hit = np.isin(own.hashes(run), np.array(shared or [], np.int64))
            texts = own.texts(hit, run)
            for a in range(0, len(ids), 1_000):
                some = slice(a, a + 1_000)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some], pa.int64()), pa.array(urls[some], pa.string()), pa.array([texts[i] for i in numbers[some]], pa.string())], ["page_id", "url", "text"])

    given = shards.withColumn("shared", F.lit(None).cast("array<bigint>")) if shared is None else shards.join(shared, list(GROUP), "left")
    read = given.select("shards", "page_id", "url", "own", "pages", "shared").mapInArrow(freed(cut), "page_id long, url string, text string")
    return read.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
