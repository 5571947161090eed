"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample; every vector is then put into the list of its nearest centroid and, if it
lies near a boundary, into those of a few more. A query finds its nearest centroids by a walk over a graph of the
centroids held in memory, and reads the lists whose centroid is at most a ratio further away than the nearest. The ratio
is the least with which a bounded sample of the queries reaches RECALL against all vectors; a query that it leaves short
of hits reads all lists.

Lists of near centroids share a shelf of up to SHELF vectors, which is searched as a whole: a query sends its best hits
once for each shelf, not for each list. A list that many vectors fall into is cut into blocks of that size, and a shelf
that many queries read is read by slices of them, so that no task grows with the input. Largest inner product is turned
into least distance by one more dimension, which makes all vectors equally long."""

from __future__ import annotations

import heapq
import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausewright.llm.common import among, freed, materialise

#: Most centroids, which bounds what is broadcast; and vectors that they are fitted on, at most about.
CENTROIDS, SAMPLE = 2_048, 32_768
#: Vectors of a list aimed at, and of a shelf or a block of a list; queries of a slice.
POSTING, SHELF, SLICE = 256, 16_384, 16_384
#: A vector also goes into lists whose distance is within this factor of its nearest one's, REPLICAS lists at most.
BOUNDARY, REPLICAS = 1.1, 4
#: Queries that are compared with all vectors, at most, and the recall that they must reach.
TRIAL, RECALL = 256, 0.95
NEIGHBOURS, WIDTH = 16, 32
TOP = 20


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with v as array<double>; null, empty and zero vectors and those with null or non-finite parts go."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    return v.where(~bad).where(F.exists("v", lambda x: x != 0))


def lift(x: np.ndarray, longest: float) -> np.ndarray:
    """Base vectors with one more part, so that all are `longest` long."""
    return np.hstack([x, np.sqrt(np.maximum(0, longest**2 - (x**2).sum(1)))[:, None]])


def fit(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """k-means whose large lists are split: each round, the emptiest centroids move into the fullest lists."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), k, replace=False)]
    for i in range(rounds):
        near = np.concatenate([((c**2).sum(1) - 2 * sample[a : a + 4096] @ c.T).argmin(1) for a in range(0, len(sample), 4096)])
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        if i < rounds - 2:
            full, few = np.argsort(-n), np.argsort(n)
            for a, b in zip(full[: k // 8], few[: k // 8]):
                if n[a] > 2 * max(1, n[b]) and n[a] > 1.5 * len(sample) / k:
                    mine = np.flatnonzero(near == a)
                    c[b] = sample[rng.choice(mine)]
    return c


class Graph:
    """The centroids, each linked to its nearest ones, and walked best first."""

    def __init__(self, centroids: np.ndarray, neighbours: int = NEIGHBOURS):
        self.c = centroids
        self.sq = (centroids**2).sum(1)
        dist = self.sq[:, None] + self.sq[None] - 2 * centroids @ centroids.T
        np.fill_diagonal(dist, np.inf)
        self.links = np.argsort(dist, 1)[:, : min(neighbours, max(len(centroids) - 1, 0))]
        # entry points: spread over the centroids, farthest first
        self.entries = [0]
        far = dist[0].copy() if len(centroids) else np.zeros(0)
        far[0] = -1
        while len(self.entries) < min(32, len(centroids)):
            e = int(far.argmax())
            self.entries.append(e)
            far = np.minimum(far, dist[e])
            far[self.entries] = -1

    def nearest(self, q: np.ndarray, wanted: int, width: int = WIDTH) -> tuple[list[int], list[float]]:
        """The numbers and distances of about the `wanted` nearest centroids, nearest first."""
        qq = float(q @ q)
        first = np.maximum(0, self.sq[self.entries] + qq - 2 * self.c[self.entries] @ q)
        seen = set(self.entries)
        todo = [(float(d), e) for d, e in zip(first, self.entries)]
        heapq.heapify(todo)
        best = [(-d, e) for d, e in todo]
        heapq.heapify(best)
        width = max(width, wanted)
        while todo:
            d, e = heapq.heappop(todo)
            if len(best) >= width and d > -best[0][0]:
                break
            new = [int(x) for x in self.links[e] if int(x) not in seen]
            if not new:
                continue
            seen.update(new)
            for x, dx in zip(new, np.maximum(0, self.sq[new] + qq - 2 * self.c[new] @ q).tolist()):
                if len(best) < width or dx < -best[0][0]:
                    heapq.heappush(todo, (dx, x))
                    heapq.heappush(best, (-dx, x))
                    if len(best) > width:
                        heapq.heappop(best)
        found = sorted((-d, e) for d, e in best)[:wanted]
        return [e for _, e in found], [math.sqrt(d) for d, _ in found]


def lists_near(g: Graph, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of lifted base vectors: each once for each of its REPLICAS nearest lists within BOUNDARY of the nearest."""
    rows, lists = [], []
    for a in range(0, len(x), 4096):
        part = x[a : a + 4096]
        d = np.sqrt(np.maximum(0, (part**2).sum(1)[:, None] + g.sq - 2 * part @ g.c.T))
        near = np.argsort(d, 1, kind="stable")[:, :REPLICAS]
        dist = np.take_along_axis(d, near, 1)
        row, at = np.nonzero(dist <= BOUNDARY * dist[:, :1] + 1e-9)
        rows.append(row + a)
        lists.append(near[row, at])
    return np.concatenate([*rows, np.zeros(0, np.int64)]), np.concatenate([*lists, np.zeros(0, np.int64)])


def padded(vs: list, dim: int) -> np.ndarray:
    x = np.zeros((len(vs), dim))
    for i, v in enumerate(vs):
        x[i, : min(dim, len(v))] = v[:dim]
    return x


def as_query(v, longest: float, dim: int) -> np.ndarray:
    """A query has no lift; scaled to the same length, which doesn't change the order."""
    x = padded([v], dim)[0]
    return np.append(x * (longest / np.linalg.norm(x)) if x.any() else x, 0.0)


def probed(g: Graph, v, longest: float, ratio: float) -> list[int]:
    """The lists that a query reads: those at most `ratio` times as far as the nearest; all if that is infinite."""
    if math.isinf(ratio):
        return list(range(len(g.c)))
    q, wanted = as_query(v, longest, g.c.shape[1] - 1), WIDTH
    while True:
        found, dist = g.nearest(q, wanted)
        if len(found) < wanted or wanted >= len(g.c) or dist[-1] > ratio * dist[0]:
            return [e for e, d in zip(found, dist) if d <= ratio * dist[0]]
        wanted *= 2


def lists_of(vectors: DataFrame, graph, longest: float, ratio: float | None = None) -> DataFrame:
    """(vec_id, v, lists): the lists that each base vector goes into or, with a ratio, that each query reads."""

    def assign(batches):
        g: Graph = graph.value
        for batch in batches:
            vs = batch.column(1).to_pylist()
            if ratio is None:
                rows, lists = lists_near(g, lift(padded(vs, g.c.shape[1] - 1), longest))
                lists = np.split(lists, np.flatnonzero(np.diff(rows)) + 1) if len(rows) else []
            else:
                lists = [probed(g, v, longest, ratio) for v in vs]
            held = [np.asarray(v, np.float64).tobytes() for v in vs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary()), pa.array([list(x) for x in lists], pa.list_(pa.int32()))], ["vec_id", "v", "lists"])

    return vectors.select("vec_id", "v").mapInArrow(freed(assign), "vec_id long, v binary, lists array<int>")


def shelved(c: np.ndarray, sizes: np.ndarray, most: int = SHELF) -> tuple[list[int], list[int]]:
    """The shelf of each list, and the blocks of each shelf: lists are halved along the widest dimension until they fit."""
    shelf, blocks = [0] * len(c), []
    todo = [np.arange(len(c))]
    while todo:
        own = todo.pop()
        if len(own) == 1 or sizes[own].sum() <= most:
            for x in own:
                shelf[x] = len(blocks)
            blocks.append(max(1, math.ceil(sizes[own].sum() / most)))
            continue
        own = own[np.argsort(c[own][:, c[own].var(0).argmax()], kind="stable")]
        half = int(np.searchsorted(sizes[own].cumsum(), sizes[own].sum() / 2))
        cut = min(max(half, 1), len(own) - 1)
        todo += [own[:cut], own[cut:]]
    return shelf, blocks


def best_of(ids: np.ndarray, vs: list[bytes], qid: np.ndarray, qs: list[bytes], top: int) -> tuple[list, list, list]:
    """(query, vector, score) of the best of some vectors for each query, some queries at a time."""
    out_q, out_v, out_s = [], [], []
    by_dim: dict[int, list[int]] = {}
    for i, v in enumerate(vs):
        by_dim.setdefault(len(v), []).append(i)
    for size, at in by_dim.items():
        b, own = np.frombuffer(b"".join(vs[i] for i in at)).reshape(len(at), -1), ids[at]
        pick = [i for i, v in enumerate(qs) if len(v) == size]
        for a in range(0, len(pick), 512):
            part = pick[a : a + 512]
            s = np.frombuffer(b"".join(qs[i] for i in part)).reshape(len(part), -1) @ b.T
            s[qid[part][:, None] == own[None]] = -np.inf
            # an id that repeats takes one place only
            some = min(top * int(np.unique(own, return_counts=True)[1].max()), len(at))
            # all that reach the last place, so that ties can go by id
            last = np.partition(s, len(at) - some, 1)[:, len(at) - some]
            for i, row in enumerate(s):
                hit = np.flatnonzero((row >= last[i] - 1e-9) & np.isfinite(row))
                if not len(hit):
                    continue
                # summed part by part, so that a pair's score doesn't depend on its block
                exact = (b[hit] * np.frombuffer(qs[part[i]])).cumsum(1)[:, -1]
                best = np.lexsort((own[hit], -exact))
                best = best[np.sort(np.unique(own[hit][best], return_index=True)[1])[:top]]
                out_q += [int(qid[part[i]])] * len(best)
                out_v += own[hit][best].tolist()
                out_s += exact[best].tolist()
    return out_q, out_v, out_s


FOUND = "query_id long, vec_id long, score double"


def found_table(found: tuple[list, list, list]) -> pa.Table:
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "score"), found, (pa.int64(), pa.int64(), pa.float64()))})


def ranked(found: DataFrame, top: int) -> DataFrame:
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # a vector may be in several lists
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return found.where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def ratio_for(base: DataFrame, asked: DataFrame, posted: DataFrame, graph, longest: float, top: int) -> float:
    """The least ratio with which a sample of the queries finds RECALL of its true nearest."""
    picked = asked.dropDuplicates(["vec_id"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRIAL).collect()
    if not picked:
        return 1.0
    g: Graph = graph.value
    qid, qs = np.array([r.vec_id for r in picked], np.int64), [np.asarray(r.v, np.float64).tobytes() for r in picked]

    def compare(batches):
        ids, vs = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            vs += [np.asarray(v, np.float64).tobytes() for v in batch.column(1).to_pylist()]
            if len(ids) >= 8192:
                yield from found_table(best_of(np.array(ids), vs, qid, qs, top)).to_batches()
                ids, vs = [], []
        if ids:
            yield from found_table(best_of(np.array(ids), vs, qid, qs, top)).to_batches()

    true = materialise(ranked(base.select("vec_id", "v").mapInArrow(compare, FOUND), top).select("query_id", "vec_id"), "true")
    far = {}
    for r in picked:
        d = np.sqrt(np.maximum(0, g.sq + (q := as_query(r.v, longest, g.c.shape[1] - 1)) @ q - 2 * g.c @ q))
        far[r.vec_id] = d / max(d.min(), 1e-12)
    # bounded by the sample: a row for each true neighbour; a repeated id counts by its nearest list
    needed: dict[tuple, float] = {}
    for r in posted.select("lists", "vec_id").join(F.broadcast(true), "vec_id").collect():
        at = (r.query_id, r.vec_id)
        needed[at] = min(needed.get(at, math.inf), float(far[r.query_id][list(r.lists)].min()))
    if not needed:
        return 1.0
    return sorted(needed.values())[math.ceil(RECALL * len(needed)) - 1] * (1 + 1e-9)


def search(vectors: DataFrame, queries: DataFrame, top: int = TOP, centroids: int = CENTROIDS, sample: int = SAMPLE, posting: int = POSTING, shelf: int = SHELF) -> DataFrame:
    """Per query: query_id, rank, vec_id, score: the nearest found by inner product, without the query's own id.

    queries are rows of vectors' shape. Ties go to the smaller vec_id. Vectors that usable() leaves out take no part;
    without vectors or queries there are no rows. A vec_id that repeats counts by its best row."""
    spark = vectors.sparkSession
    base, asked = usable(vectors), usable(queries)
    stat = base.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("sq")).first()
    n, longest = stat.n, math.sqrt(stat.sq or 0.0)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    chosen = base.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < min(1.0, sample / n) * (1 << 30)).orderBy(F.xxhash64("vec_id", F.lit(1))).limit(2 * sample)
    rows = [r.v for r in chosen.select("v").collect()] or [base.first().v]
    dim = max(map(len, rows))
    x = np.unique(lift(padded(rows, dim), longest), axis=0)
    k = max(1, min(centroids, len(x), round(n / posting)))
    graph = spark.sparkContext.broadcast(Graph(fit(x, k)))  # bounded by centroids
    posted = materialise(lists_of(base, graph, longest), "postings")
    ratio = ratio_for(base, asked, posted, graph, longest, top)
    sizes = np.zeros(k, np.int64)
    for r in posted.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count("*").alias("n")).collect():  # a row for each centroid
        sizes[r.list] = r.n
    shelf_of, blocks_of = (F.from_json(F.lit(json.dumps(x)), "array<int>") for x in shelved(graph.value.c, sizes, shelf))
    on_shelves = lambda df: df.select("vec_id", "v", F.explode(F.array_distinct(F.transform("lists", lambda x: F.get(shelf_of, x)))).alias("shelf"))
    held = on_shelves(posted).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.get(blocks_of, F.col("shelf"))).cast("int"))

    def scan(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return found_table(([], [], []))
        return found_table(best_of(left.column("vec_id").to_numpy(), left.column("v").to_pylist(), right.column("vec_id").to_numpy(), right.column("v").to_pylist(), top))

    def read(some: DataFrame, ratio: float) -> DataFrame:
        wanted = on_shelves(materialise(lists_of(some, graph, longest, ratio), "probes"))
        slices = F.broadcast(wanted.groupBy("shelf").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices")))  # a row for each shelf
        wanted = wanted.join(slices, "shelf").select("shelf", F.explode(F.sequence(F.lit(0), F.get(blocks_of, F.col("shelf")) - 1)).alias("block"), F.pmod(F.xxhash64("vec_id"), "slices").cast("int").alias("slice"), "vec_id", "v")
        read = held.join(slices, "shelf").select("shelf", "block", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "vec_id", "v")
        group = ("shelf", "block", "slice")
        return ranked(read.groupBy(*group).cogroup(wanted.groupBy(*group)).applyInArrow(scan, FOUND), top)

    found = materialise(read(asked, ratio), "nearest")
    # those that are short of hits read all lists
    full = materialise(found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= top).select(F.col("query_id").alias("vec_id")), "full")
    short = materialise(among(asked, full, "vec_id", "left_anti"), "short")
    if short.isEmpty():
        return found
    done = found.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi")
    return done.unionByName(read(short, math.inf))


def nearest(vectors: DataFrame) -> DataFrame:
    """The nearest of every vector whose id is divisible by 20."""
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
