"""Collections of vectors: nearest rows, best row of each example, re-ranking, upserts and deletions by key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a pass over the rows, and their components (8 bytes each), at most; more queries take more passes.
BROADCAST_QUERIES, BROADCAST_PARTS = 16_000, 4_000_000
#: Rows of a task, about, where there are many.
TASK_ROWS = 500_000
#: Queries and rows whose similarities are held at once; the first rows of a task, which set the queries' limits.
QUERY_BLOCK, ROW_BLOCK, FIRST_ROWS = 256, 2_048, 512
#: Characters of a text that a prompt shows.
SHOWN = 500
#: A similarity's steps of 1 / PLACES; those of NaN, which is the greatest, of null, which is the least, and of no row yet.
PLACES, NAN, NULL, NONE = 10_000, 20_000, -20_000, -30_000


def by_length(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{length: (places, vectors)} of a list column; lists that are null or hold a null count as empty."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    start = np.concatenate([[0], size.cumsum()])
    nulls = np.concatenate([[0], flat.is_null().to_numpy(zero_copy_only=False).cumsum()])
    size[nulls[start[1:]] > nulls[start[:-1]]] = 0
    parts = flat.to_numpy(zero_copy_only=False)
    places = {int(n): np.flatnonzero(size == n) for n in np.unique(size)}
    return {n: (at, parts[start[at][:, None] + np.arange(n)].astype(np.float64)) for n, at in places.items()}


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors at length 1, zeros in place of those that have none (zero or not finite); and which those are."""
    with np.errstate(all="ignore"):
        x = x / np.abs(x).max(1, initial=0)[:, None]
        x = x / np.sqrt((x * x).sum(1))[:, None]
    odd = ~np.isfinite(x).all(1)
    x[odd] = 0
    return x, odd


def steps(sim: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of the vectors a and b in whole steps, halves away from zero. Those near a half are summed anew, part by part, as the order of a matrix product's sums is open."""
    near = np.flatnonzero(np.abs(np.abs(sim * PLACES) % 1 - 0.5) < 1e-6)
    dot = lambda x, y: (x * y).cumsum(1)[:, -1]
    with np.errstate(all="ignore"):
        x, y = a[near], b[near]
        exact = dot(x, y) / (np.sqrt(dot(x, x)) * np.sqrt(dot(y, y)))
    sim[near] = np.where(np.isfinite(exact), exact, sim[near])
    return (np.sign(sim) * np.floor(np.abs(sim) * PLACES + 0.5)).astype(np.int32)


class Best:
    """The k best rows yet of each query, by similarity in steps, then by vec_id. Rows come by ascending vec_id."""

    def __init__(self, ids: np.ndarray, vectors: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.units = {n: units(x) for n, (_, x) in vectors.items()}
        self.steps = np.full((len(ids), k), NONE, np.int32)
        self.found = np.zeros((len(ids), k), np.int64)

    def add(self, ids: np.ndarray, column: pa.Array) -> None:
        held = by_length(column)
        as_units = {n: units(x) for n, (_, x) in held.items()}
        for n, (places, x) in self.vectors.items():
            for a in range(0, len(places), QUERY_BLOCK):
                some = slice(a, a + QUERY_BLOCK)
                asked = places[some]
                sim = np.full((len(asked), len(ids)), NULL / PLACES)
                if n and n in held:
                    (u, odd), (v, bad) = (c[some] for c in self.units[n]), as_units[n]
                    own = u @ v.T
                    own[odd] = own[:, bad] = NAN / PLACES
                    at = held[n][0]
                    sim = own if len(at) == len(ids) else self.placed(sim, at, own)
                self.merge(asked, x[some], ids, held.get(n), sim)

    @staticmethod
    def placed(sim: np.ndarray, at: np.ndarray, own: np.ndarray) -> np.ndarray:
        sim[:, at] = own
        return sim

    def merge(self, asked: np.ndarray, x: np.ndarray, ids: np.ndarray, held, sim: np.ndarray) -> None:
        first, last = np.searchsorted(ids, self.ids[asked]), np.searchsorted(ids, self.ids[asked], "right")
        for i in np.flatnonzero(first < last):
            sim[i, first[i] : last[i]] = -np.inf  # the query's own row
        # as vec_ids ascend, a row must be better by a step than the last of k
        worst = self.steps[asked, -1]
        limit = (worst + 0.5) / PLACES - 1e-9
        if len(ids) > self.k and (worst == NONE).any():
            limit = np.maximum(limit, np.partition(sim, len(ids) - self.k, 1)[:, len(ids) - self.k] - 1.1 / PLACES)
        i, j = np.nonzero(sim > limit[:, None])
        if not len(i):
            return
        got = sim[i, j]
        plain = np.flatnonzero(np.abs(got) < 1.5)
        new = np.rint(got * PLACES).astype(np.int32)
        if len(plain):
            at = np.searchsorted(held[0], j[plain])
            for b in range(0, len(plain), 65_536):
                part = slice(b, b + 65_536)
                new[plain[part]] = steps(got[plain[part]], x[i[plain[part]]], held[1][at[part]])
        some = np.unique(i)
        of = np.concatenate([np.repeat(some, self.k), i])
        step = np.concatenate([self.steps[asked[some]].ravel(), new])
        vec = np.concatenate([self.found[asked[some]].ravel(), ids[j]])
        order = np.lexsort((vec, -step, of))
        pick = order[np.searchsorted(of[order], some)[:, None] + np.arange(self.k)]
        self.steps[asked[some]], self.found[asked[some]] = step[pick], vec[pick]

    def batches(self):
        for a in range(0, len(self.ids), 4_096):
            step = self.steps[a : a + 4_096]
            i, j = np.nonzero(step != NONE)
            step = step[i, j]
            sim = pa.array(np.where(step == NAN, np.nan, step / PLACES), mask=step == NULL, from_pandas=False)
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[a + i]), pa.array(self.found[a + i, j]), sim], ["query_id", "vec_id", "sim"])


def nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, sim (4 places), r: the k most similar of `rows` (vec_id, embedding) for each of `queries`
    (query_id, q), the query's own row aside; exact, and ties go to the smaller vec_id.

    Blocks of rows are multiplied with blocks of queries, and a task sends k rows a query. Ids are whole numbers; rows and
    queries without one take no part. The similarity is null (last) with a vector that is null, empty, holds a null or is
    of another length, and NaN (first) with one that is zero or not finite."""
    spark = rows.sparkSession
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id IS NOT NULL")
    queries = queries.select(F.col("query_id").cast("long"), F.col("q").cast("array<double>")).where("query_id IS NOT NULL")
    n, parts = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("q")), F.lit(0))).first()
    passes = max(1, -(-n // BROADCAST_QUERIES), -(-parts // BROADCAST_PARTS))
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    dealt = rows.repartition(tasks, "vec_id").sortWithinPartitions("vec_id")

    def one(i: int) -> DataFrame:
        asked = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i).toArrow().combine_chunks()
        ids, q = (c.combine_chunks() for c in asked.columns)
        sent = spark.sparkContext.broadcast((ids.to_numpy(zero_copy_only=False).astype(np.int64), by_length(q)))  # bounded by BROADCAST_QUERIES and BROADCAST_PARTS

        def compare(batches):
            best = Best(*sent.value, k)
            size = FIRST_ROWS
            for batch in batches:
                a = 0
                while a < batch.num_rows:
                    best.add(batch.column(0).slice(a, size).to_numpy(), batch.column(1).slice(a, size))
                    a, size = a + size, ROW_BLOCK
            yield from best.batches()

        return dealt.mapInArrow(compare, "query_id long, vec_id long, sim double")

    scored = one(0)
    for i in range(1, passes):
        scored = scored.unionByName(one(i))
    return scored.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id"))).where(F.col("r") <= k)


def best_examples(hits: DataFrame, k: int, excluded: DataFrame | None = None) -> DataFrame:
    """query_id, example_id, vec_id, sim, r: of hits (query_id, example_id, vec_id, sim, r) the best of each example,
    without excluded (query_id, example_id), then the k best examples; ties go to the earlier hit."""
    best = hits.groupBy("query_id", "example_id").agg(F.max(F.struct("sim", (-F.col("r")).alias("o"), "vec_id")).alias("b"))
    if excluded is not None:
        best = best.join(excluded, ["query_id", "example_id"], "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.desc("b.sim"), F.desc("b.o"))
    return best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("query_id", "example_id", "b.vec_id", "b.sim", "r")


def examples(rows: DataFrame, queries: DataFrame, k: int, example: Column, excluded: DataFrame | None = None) -> DataFrame:
    """The k best examples of each query, from max(20 k, 10) hits."""
    return best_examples(nearest(rows, queries, max(20 * k, 10)).withColumn("example_id", example), k, excluded)


def reranked(hits: DataFrame) -> DataFrame:
    """hits (query_id, vec_id, sim, rerank) ordered anew by rerank, or by sim where a query lacks any of its scores."""
    all_there = F.count("rerank").over(Window.partitionBy("query_id")) == F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    scored = hits.withColumn("score", F.when(all_there, F.col("rerank")).otherwise(F.col("sim")))
    return scored.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).select("query_id", "vec_id", "score", "r")


def upserted(now: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """now with the rows of new put in place of those with their keys, or added."""
    return now.join(new.select(key), key, "left_anti").select(*now.columns).unionByName(new)


def deleted(now: DataFrame, ids: DataFrame | None = None, where: Column | None = None, key: str = "id") -> DataFrame:
    """now without the given ids, or without the rows for which the condition is true (null is not)."""
    if ids is not None:
        now = now.join(ids.select(key), key, "left_anti")
    return now if where is None else now.where(~F.coalesce(where, F.lit(False)))


def few_shot(hits: DataFrame, size: int = SHOWN) -> DataFrame:
    """query_id, prompt: a numbered block for each hit (query_id, r, sim, text), in order, texts cut at `size`."""
    cut = F.when(F.length("text") > size, F.concat(F.left("text", F.lit(size)), F.lit("..."))).otherwise(F.col("text"))
    block = F.struct("r", F.concat(F.format_string("[%d] similarity %.2f\n", F.col("r"), F.col("sim")), cut).alias("b"))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]), "\n\n").alias("prompt"))
