"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

A text's set holds its runs of five words. Texts with equal sets form a class; one text stands for it. Its signature
has TREES labels of DEPTH values. The labels of a tree, sorted, are a prefix trie: neighbours that agree in their first k
values meet at depth k. The tries are walked once in sorted order, which gives for every depth the links of a node's
members to its first one.

Candidates are first those that meet at full depth. Their pairs are compared by their whole sets, and the similarities
found tell how many links the tries miss at that depth: a pair of similarity s meets with probability
1 - (1 - s^k)^TREES. While the recall so estimated is under RECALL, the prefixes are shortened, at most to the depth at
which even pairs at the threshold reach it.

Candidates are never written as pairs: texts that nodes connect meet in tiles of bounded size, between which sets whose
sizes rule the threshold out don't meet. In a tile the pairs that share a node are compared; only sums and spanning links
leave it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.llm.common import WordHashes, among, freed, materialise, mixed, null_safe, shingle_hashes, spread_join, values
from clausewright.llm.components import components

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 24, 8, 0.9999
TILE = 256
#: Similarities are counted in so many steps between the threshold and 1.
STEPS = 8


def met(similarity: float, depth: int, trees: int) -> float:
    """The probability that two texts meet at a depth in some trie."""
    return 1 - (1 - similarity**depth) ** trees


def least_depth(threshold: float = THRESHOLD, trees: int = TREES, deepest: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which even a pair at the threshold meets with the wanted probability."""
    return next((k for k in range(deepest, 1, -1) if met(threshold, k, trees) >= recall), 1)


def depth_wanted(found: list[int], depth: int, threshold: float, trees: int, recall: float) -> int:
    """The longest prefix of at most `depth` values whose estimated recall suffices, from the links found at `depth` by
    step of similarity. Each step counts by its lower end, each link found for as many as it is the expected one of."""
    least = least_depth(threshold, trees, depth, recall)
    low = [threshold + (1 - threshold) * i / STEPS for i in range(STEPS)]
    all_ = [n / met(s, depth, trees) for n, s in zip(found, low)]
    return next((k for k in range(depth, least, -1) if sum(n * met(s, k, trees) for n, s in zip(all_, low)) >= recall * sum(all_)), least)


def signature(shingles: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """The label of a set in each tree, as (trees, depth) 16-bit numbers."""
    rng = np.random.default_rng(20)
    odd = rng.integers(1, 2**31, trees * depth, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    flip = rng.integers(0, 2**32, trees * depth, dtype=np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(trees * depth, np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(short), 1024):
        low = np.minimum(low, scrambled(short[a : a + 1024, None] ^ flip, odd).min(0))
    return (low * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(">u2").reshape(trees, depth)


def scrambled(x: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers for each column."""
    x = x * odd
    x ^= x >> np.uint32(15)
    x *= odd
    return x


def nodes_at(labels: np.ndarray, depth: int) -> np.ndarray:
    """64-bit numbers of the nodes at `depth` of labels (texts, trees, depth)."""
    node = np.broadcast_to(np.arange(1, labels.shape[1] + 1, dtype=np.uint64), labels.shape[:2])
    for k in range(depth):
        node = mixed(node * np.uint64(0x9E3779B97F4A7C15) + mixed(labels[:, :, k].astype(np.uint64) + np.uint64(1)))
    return node.view(np.int64)


def row_hash() -> Column:
    """A hash of a row's doc_id and text, by which rows are told apart."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def key_of(set_id: bytes) -> int:
    return int.from_bytes(set_id[:8], "little", signed=True)


def signatures(docs: DataFrame, words: int, trees: int, depth: int) -> DataFrame:
    """(doc_id, h, set_id, key, n, labels): h is row_hash(); the others are null for a text without words."""

    def sign(batches):
        hashes = WordHashes()
        for batch in batches:
            ids, n, labels = [], [], []
            for text in values(batch.column(1)):
                s = shingle_hashes(text, words, hashes)
                ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                n.append(len(s) or None)
                labels.append(signature(s, trees, depth).tobytes() if len(s) else None)
            keys = [key_of(x) if x else None for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.binary()), pa.array(keys, pa.int64()), pa.array(n, pa.int32()), pa.array(labels, pa.binary())], ["doc_id", "h", "set_id", "key", "n", "labels"])

    return docs.select(F.col("doc_id").cast("long"), "text", row_hash().alias("h")).mapInArrow(freed(sign), "doc_id long, h long, set_id binary, key long, n int, labels binary")


def shingle_table(docs: DataFrame, words: int) -> DataFrame:
    def make(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_hashes(t, words, hashes).tobytes() for t in values(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([key_of(xxhash.xxh3_128_digest(s)) for s in sets], pa.int64()), pa.array(sets, pa.binary())], ["key", "shingles"])

    return docs.select("text").mapInArrow(freed(make), "key long, shingles binary")


def forest(reps: DataFrame, trees: int, depth: int, least: int) -> DataFrame:
    """(a, b, depth): of the texts that meet at a depth from `least` on, links of each to the first in sorted order, with
    the greatest depth of each link.

    The labels are dealt by range, with the key as their last part, so that equal labels are split as well; a walk ends
    at a range's border, and its ends are linked across it."""

    def leaves(batches):
        for batch in batches:
            labels = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(-1, depth)
            keys = np.repeat(batch.column(0).to_numpy(), trees)
            own = np.tile(np.arange(trees, dtype=np.int32), batch.num_rows)
            raw = pa.Array.from_buffers(pa.binary(2 * depth), len(labels), [None, pa.py_buffer(labels.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(own), raw, pa.array(keys, pa.int64())], ["tree", "label", "key"])

    def walk(batches):
        last, heads = None, {}
        part = TaskContext.get().partitionId()
        border = lambda row, end: {"a": [None], "b": [None], "depth": [None], "tree": [int(row[0])], "label": [row[1].tobytes()], "key": [int(row[2])], "part": [part], "end": [end]}
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, key = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            label = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(-1, depth)
            if last is None:
                yield pa.RecordBatch.from_pydict(border((tree[0], label[0], key[0]), False), schema=shape)
                before = label[:1] ^ 1
                same = np.concatenate([[False], tree[1:] == tree[:-1]])
            else:
                before = last[1][None]
                same = np.concatenate([[last[0] == tree[0]], tree[1:] == tree[:-1]])
            shared = (np.concatenate([before, label[:-1]]) == label).cumprod(1).sum(1) * same
            deeper = key
            for k in range(depth, least - 1, -1):
                start = shared < k
                at = np.maximum.accumulate(np.where(start, np.arange(len(key)), -1))
                head = np.where(at >= 0, key[at], heads.get(k, 0))
                heads[k] = int(head[-1])
                new = np.flatnonzero((head != key) & (head != deeper))
                deeper = head
                if len(new):
                    none = pa.nulls(len(new))
                    yield pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(head[new]), pa.array(np.full(len(new), k, np.int32)), *[none.cast(shape.field(i).type) for i in range(3, 8)]], schema=shape)
            last = (tree[-1], label[-1], key[-1])
        if last is not None:
            yield pa.RecordBatch.from_pydict(border(last, True), schema=shape)

    shape = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("depth", pa.int32()), ("tree", pa.int32()), ("label", pa.binary()), ("key", pa.int64()), ("part", pa.int32()), ("end", pa.bool_())])
    placed = reps.select("key", "labels").mapInArrow(freed(leaves), "tree int, label binary, key long")
    tries = placed.repartitionByRange("tree", "label", "key").sortWithinPartitions("tree", "label", "key")
    walked = materialise(tries.mapInArrow(freed(walk), "a long, b long, depth int, tree int, label binary, key long, part int, end boolean"), "walked")
    ends = sorted(walked.where("part IS NOT NULL").collect(), key=lambda r: (r.part, r.end))  # two rows for each range
    across = []
    for x, y in zip(ends, ends[1:]):
        if x.end and not y.end and x.tree == y.tree:
            shared = int((np.frombuffer(x.label, ">u2") == np.frombuffer(y.label, ">u2")).cumprod().sum())
            if shared >= least:
                across.append((y.key, x.key, shared))
    links = walked.where("part IS NULL").select("a", "b", "depth")
    if across:
        links = links.unionByName(reps.sparkSession.createDataFrame(across, "a long, b long, depth int"))
    return links.groupBy("a", "b").agg(F.max("depth").alias("depth"))


def compare(ids: np.ndarray, n: np.ndarray, copies: np.ndarray, nodes: np.ndarray, sets: list[np.ndarray], side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one pair of tiles: for each row, its linked texts, their documents, a linked root, and its links by step of
    similarity.

    side: 0 or 1 if only rows of different sides are to be compared, -1 for all."""
    size = len(ids)
    texts, docs, root = np.zeros(size, np.int64), np.zeros(size, np.int64), np.arange(size)
    steps = np.zeros((size, STEPS), np.int64)
    order = np.argsort(n, kind="stable")

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    for at, i in enumerate(order):
        later = order[at + 1 : int(np.searchsorted(n[order], n[i] / threshold + 1e-9, side="right"))]
        if side[i] >= 0:
            later = later[side[later] != side[i]]
        if not len(later):
            continue
        for j in later[(nodes[later] == nodes[i]).any(1)].tolist():
            x, y = sets[i], sets[j]
            where = np.searchsorted(y, x)
            where[where == len(y)] = 0
            common = int((y[where] == x).sum())
            if common >= threshold * (len(x) + len(y) - common) - 1e-9:
                steps[i, max(0, min(STEPS - 1, int((common / (len(x) + len(y) - common) - threshold) / (1 - threshold) * STEPS)))] += 1
                texts[i] += 1
                texts[j] += 1
                docs[i] += copies[j]
                docs[j] += copies[i]
                a, b = find(int(i)), find(int(j))
                if a != b:
                    root[max(a, b, key=lambda q: ids[q])] = min(a, b, key=lambda q: ids[q])
    return texts, docs, np.array([ids[find(i)] for i in range(size)], np.int64), steps


def verified(reps: DataFrame, links: DataFrame, sets: DataFrame, depth: int, trees: int, deepest: int, threshold: float) -> DataFrame:
    """(key, texts, docs, root, steps) of the texts with links, a row for each tile that they have some in."""
    groups = materialise(components(links), "candidates").withColumnRenamed("id", "key")

    def place(batches):
        for batch in batches:
            labels = np.frombuffer(b"".join(batch.column("labels").to_pylist()), ">u2").reshape(-1, trees, deepest)
            held = pa.ListArray.from_arrays(pa.array(np.arange(len(labels) + 1, dtype=np.int32) * trees), pa.array(nodes_at(labels, depth).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("root"), batch.column("n"), batch.column("copies"), held], ["key", "root", "n", "copies", "nodes"])

    members = reps.join(groups, "key").select("key", "root", "n", "copies", "labels").mapInArrow(place, "key long, root long, n int, copies long, nodes array<long>")
    # tiles: sets whose sizes differ by more than the threshold allows are at least two bands apart
    members = materialise(members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / float(-np.log(threshold))).cast("int")), "members")
    bands = materialise(members.groupBy("root", "band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")), "bands")
    other = bands.select("root", F.col("band").alias("band2"), F.col("tiles").alias("tiles2"))
    meets = bands.join(other, "root").where("band2 BETWEEN band - 1 AND band + 1")
    members = members.join(bands, ["root", "band"]).withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    pairs = members.join(meets.select("root", "band", "band2", "tiles2"), ["root", "band"]).withColumn("tile2", F.explode(F.sequence(F.lit(0), F.col("tiles2") - 1)))
    first = F.struct("band", "tile")
    second = F.struct(F.col("band2").alias("band"), F.col("tile2").alias("tile"))
    pairs = pairs.select("key", "root", "n", "copies", "nodes", F.least(first, second).alias("p"), F.greatest(first, second).alias("q"), F.when(first == second, -1).when(first < second, 0).otherwise(1).alias("side"))

    def verify(group: pa.Table) -> pa.Table:
        keys = group.column("key").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        nodes = np.array(group.column("nodes").to_pylist(), np.int64).reshape(len(keys), -1)
        texts, linked, root, steps = compare(keys, group.column("n").to_numpy(), group.column("copies").to_numpy(), nodes, sets, group.column("side").to_numpy(), threshold)
        some = np.flatnonzero(texts)
        return pa.table({"key": keys[some], "texts": texts[some], "docs": linked[some], "root": root[some], "steps": pa.array(steps[some].tolist(), pa.list_(pa.int64()))})

    found = pairs.join(sets, "key").groupBy("root", "p", "q").applyInArrow(verify, "key long, texts long, docs long, root long, steps array<long>")
    return materialise(found, "links")


def classes(docs: DataFrame, words: int, threshold: float, trees: int, depth: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, set_id) of all rows, and of each set: set_id, id and h (its least doc_id's row), copies, texts, docs,
    class_id and class_h (the same of its class)."""
    signed = materialise(signatures(docs, words, trees, depth), "signatures")
    least_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("r")
    text = signed.where("set_id IS NOT NULL").groupBy("set_id").agg(least_row, F.count("*").alias("copies"))
    text = materialise(text.select("set_id", F.col("r.doc_id").alias("id"), F.col("r.h").alias("h"), "copies"), "texts")
    chosen = text.select(F.col("set_id").alias("s"), F.col("id").alias("i"), F.col("h").alias("r"), "copies")
    reps = signed.join(chosen, null_safe("set_id", "s") & null_safe("doc_id", "i") & null_safe("h", "r")).select("doc_id", "h", "set_id", "key", "n", "copies", "labels").dropDuplicates(["key"])
    reps = materialise(reps, "representatives")
    deepest, least = depth, least_depth(threshold, trees, depth, recall)
    links = materialise(forest(reps, trees, depth, least), "forest")
    wanted = materialise(links.select(F.col("a").alias("key")).union(links.select("b")).distinct().join(reps.select("key", "h"), "key").select("h").distinct(), "wanted")
    rows = among(docs.select("doc_id", "text").select("text", row_hash().alias("h")), wanted, "h")
    sets = materialise(shingle_table(rows, words).dropDuplicates(["key"]), "sets")
    while True:
        found = verified(reps, links.where(F.col("depth") >= depth).select("a", "b"), sets, depth, trees, deepest, threshold)
        seen = found.agg(*[F.coalesce(F.sum(F.col("steps")[i]), F.lit(0)) for i in range(STEPS)]).first()  # one row
        shorter = depth_wanted(list(seen), depth, threshold, trees, recall)
        if shorter == depth:
            break
        depth = shorter
    # each text with its class, which is named by its least row
    roots = materialise(components(found.select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "key"), "classes")
    counted = found.groupBy("key").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    linked = roots.join(reps.select("key", F.col("doc_id").alias("id"), "h"), "key").join(counted, "key")
    first = linked.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("r")).select("root", F.col("r.id").alias("class_id"), F.col("r.h").alias("class_h"))
    linked = spread_join(materialise(linked.drop("id", "h"), "linked"), materialise(first, "first"), "root", "inner").drop("root")
    keys = reps.select("key", F.col("set_id").alias("s"))
    whole = text.join(linked.join(keys, "key").drop("key"), F.col("set_id") == F.col("s"), "left").select("set_id", "id", "h", "copies", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("texts", "docs")], F.when(F.col("class_h").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_h", "h").alias("class_h"))
    return signed.select("doc_id", "h", "set_id"), materialise(whole, "whole")


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """Per document: doc_id, class_id, text_id, n_links, n_linked_docs.

    text_id is the least doc_id of the documents with the same set of shingles, class_id that of all documents that
    links connect. n_links counts the other texts at the threshold or above, n_linked_docs their documents and the
    other documents of the own text. Texts of fewer than five words have one shingle, all their words. Null texts and
    texts without words are linked to nothing: both ids are their own. Extra columns are ignored. Rows that repeat a
    doc_id are each a document of their own; a null doc_id comes last."""
    rows, whole = classes(docs, words, threshold, trees, depth, recall)
    counts = whole.select("set_id", F.col("copies").alias("_n"))
    return spread_join(rows.drop("h"), whole.drop("h", "class_h"), "set_id", "left", counts).select(
        "doc_id",
        F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("id")).alias("text_id"),
        F.coalesce("texts", F.lit(0)).alias("n_links"),
        (F.coalesce("docs", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_linked_docs"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each class, of those with the least doc_id (null: last) the one of the least hash; rows
    without words stay. Of rows with equal doc_id and text, one stays."""
    rows, whole = classes(docs, WORDS, THRESHOLD, TREES, DEPTH, RECALL)
    counts = whole.select("set_id", F.col("copies").alias("_n"))
    found = spread_join(rows.where("set_id IS NOT NULL"), whole.select("set_id", "class_id", "class_h"), "set_id", "inner", counts)
    own = null_safe("doc_id", "class_id") & (F.col("h") == F.col("class_h"))
    free = "_" * (1 + max(map(len, docs.columns)))
    gone = materialise(found.where(~own).select(F.col("h").alias(free)).distinct(), "gone")
    twice = materialise(found.where(own).groupBy(F.col("h").alias(free)).agg(F.count("*").alias("n")).where("n > 1").select(free), "twice")
    left = among(docs.withColumn(free, row_hash()), gone, free, "left_anti")
    if not twice.isEmpty():
        left = among(left, twice, free, "left_anti").unionByName(among(left, twice, free).dropDuplicates([free]))
    return left.select(*docs.columns)
