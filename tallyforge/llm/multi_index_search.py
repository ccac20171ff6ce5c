"""Approximate nearest neighbours by an inverted multi-index.

Both halves of the vectors are quantised by a codebook each; a cell of the index is a pair of centroids.  A query
walks the cells from the best sum of its two halves' inner products down, with a heap, until the cells met hold enough
vectors, and every vector in those cells is compared exactly.  How many are enough is measured on the table itself:
``trial`` of the queries are compared with every row first, and the walk is as long as it takes for the share
``recall`` of their true neighbours to lie in the cells met.

The codebooks are fitted on a sample of at most ``fit_rows`` vectors, taken by a hash of the id; every row is indexed.
Vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take no part.
Repeated ids are each a candidate row of its own; a query leaves out candidates with its own id.  Fewer candidates than
``k``: all are returned.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import map_batches, written

FIT_ROWS = 20_000
MAX_CENTROIDS = 512
BLOCK_ROWS = 4096
#: about as many rows as cells would make a query's walk, one heap step a cell, cost more than comparing the rows does
ROWS_PER_CELL = 8
TRIAL = 256


def k_means(points: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's algorithm from distinct points of the sample; a centroid that loses all its points stays where it is."""
    distinct = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        owner = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, points)
        n = np.bincount(owner, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1)


def walk(first: np.ndarray, second: np.ndarray, counts: list[int] | np.ndarray, enough: int) -> list[int]:
    """Cells (i * len(second) + j) by descending first[i] + second[j] until they hold ``enough`` rows.

    Each list is sorted; a pair enters the heap once its left and its upper neighbour have been taken.
    """
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    fa, fb, a, b = first[a].tolist(), second[b].tolist(), a.tolist(), b.tolist()
    heap, taken, found, held = [(-(fa[0] + fb[0]), 0, 0)], [0] * len(a), [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * len(b) + b[j]
        n = counts[cell]
        if n:
            found.append(cell)
            held += n
        taken[i] = j + 1  # row i is taken up to column j
        if j + 1 < len(b) and (i == 0 or taken[i - 1] > j + 1):
            heapq.heappush(heap, (-(fa[i] + fb[j + 1]), i, j + 1))
        if i + 1 < len(a) and taken[i + 1] == j:
            heapq.heappush(heap, (-(fa[i + 1] + fb[j]), i + 1, j))
    return found


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``embedding`` of the rows that take part, as doubles."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select("vec_id", x.alias("embedding")).where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda v: v != 0))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def walk_needed(index: DataFrame, queries, books: list[np.ndarray], counts: np.ndarray, k: int, recall: float, trial: int) -> int:
    """Rows a walk must hold to meet the share ``recall`` of the true neighbours of ``trial`` queries, those of the lowest hash.

    Each of these queries is compared with every row of ``index``; what comes to the driver are its ``k`` neighbours' cells.
    """
    asked = index.where(queries).select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(trial).toArrow()
    if not asked.num_rows:
        return 0
    dim, n_second = sum(b.shape[1] for b in books), len(books[1])
    x, ids = matrix(asked.column("embedding"), dim), asked.column("vec_id").to_numpy()
    shared = index.sparkSession.sparkContext.broadcast((x, ids))

    def nearby(batch: pa.RecordBatch) -> pa.RecordBatch:
        (asked, asked_ids), own = shared.value, batch.column("vec_id").to_numpy()
        score = asked @ matrix(batch.column("embedding"), dim).T
        score[asked_ids[:, None] == own] = -np.inf
        best = np.argsort(-score, axis=1, kind="stable")[:, :k]
        q = np.repeat(np.arange(len(asked)), best.shape[1])
        cell = batch.column("i").to_numpy().astype(np.int64) * n_second + batch.column("j").to_numpy()
        best = best.ravel()
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(own[best]), pa.array(score[q, best]), pa.array(cell[best])], ["q", "vec_id", "score", "cell"])

    near = map_batches(index, nearby, "q long, vec_id long, score double, cell long").where(F.col("score") > float("-inf"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "cell").toPandas()
    half, before = books[0].shape[1], []
    for q, cells in near.groupby("q").cell:
        sums = ((x[q, :half] @ books[0].T)[:, None] + (x[q, half:] @ books[1].T)[None]).ravel()
        walked = np.argsort(-sums, kind="stable")
        # rows in all cells that are met no later than a neighbour's own, cells of one sum together
        upto = np.searchsorted(-sums[walked], -sums[cells.to_numpy()], "right")
        before.append(np.cumsum(counts[walked])[upto - 1])
    if not before:
        return 0
    before = np.sort(np.concatenate(before))
    return int(before[min(len(before), max(1, int(np.ceil(recall * len(before))))) - 1])


def search(vectors: DataFrame, queries, k: int = 20, fit_rows: int = FIT_ROWS, recall: float = 0.94, trial: int = TRIAL) -> DataFrame:
    """The ``k`` nearest rows by inner product for the rows of ``vectors`` where the Column ``queries`` holds.

    A query's walk is as long as the share ``recall`` of the neighbours of ``trial`` queries needs, whatever the size of
    the table; with ``recall`` 1 and a trial of all queries it is exact.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = written(usable(vectors), "vectors")
    dims = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], schema)
    dim, total = dims[0].dim, dims[0].n
    rows = rows.where(F.size("embedding") == dim)
    part = min(1.0, fit_rows / total)
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) < int(part * 1_000_003)) if part < 1 else rows
    points = matrix(sample.select("embedding").limit(2 * fit_rows).toArrow().column(0), dim)
    half = max(1, dim // 2)
    size = int(min(MAX_CENTROIDS, max(1, round((total / ROWS_PER_CELL) ** 0.5)), max(1, len(points) // 8)))
    books = [k_means(points[:, :half], size), k_means(points[:, half:], size) if dim > half else np.zeros((1, 0))]
    n_second = len(books[1])
    shared = spark.sparkContext.broadcast(books)  # at most 2 * MAX_CENTROIDS half vectors

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, (one, two) = matrix(batch.column("embedding"), dim), shared.value
        i = nearest(x[:, :half], one)
        j = nearest(x[:, half:], two) if len(two) > 1 else np.zeros(len(x), np.int64)
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32))], ["vec_id", "embedding", "i", "j"])

    index = written(map_batches(rows, assign, "vec_id long, embedding array<double>, i int, j int"), "index")
    # at most MAX_CENTROIDS ** 2 rows of two numbers
    held = index.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).toPandas()
    counts = np.zeros(len(books[0]) * n_second, np.int64)
    counts[held.i.to_numpy() * n_second + held.j.to_numpy()] = held.n.to_numpy()
    salts = np.maximum(1, -(-counts.reshape(-1, n_second).sum(1) // BLOCK_ROWS))
    all_counts = spark.sparkContext.broadcast(counts)
    enough = max(k + 1, walk_needed(index, queries, books, counts, k, recall, trial))

    def routes(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, (one, two), n = matrix(batch.column("embedding"), dim), shared.value, all_counts.value.tolist()
        at, group, cells = [], [], []
        first, second = x[:, :half] @ one.T, x[:, half:] @ two.T
        for q in range(len(x)):
            found = np.array(walk(first[q], second[q], n, enough))
            found = found[np.argsort(found // n_second, kind="stable")]
            first_of = np.flatnonzero(np.r_[True, np.diff(found // n_second) > 0])
            at += [q] * len(first_of)
            group += (found[first_of] // n_second).tolist()
            cells += np.split((found % n_second).astype(np.int32), first_of[1:])
        vec_id, embedding = batch.column("vec_id").take(pa.array(at)), batch.column("embedding").take(pa.array(at))
        return pa.RecordBatch.from_arrays([vec_id, embedding, pa.array(group, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], ["query_id", "query", "i", "cells"])

    asked = map_batches(index.where(queries).select("vec_id", "embedding"), routes, "query_id long, query array<double>, i int, cells array<int>")
    # a hot first-half centroid is dealt over several blocks of rows, and its queries go to each of them
    many = F.create_map(*(F.lit(x) for pair in enumerate(salts.tolist()) for x in pair)) if len(salts) else None
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), (many[F.col("i")] - 1).cast("int"))))
    dealt = index.withColumn("salt", F.pmod(F.xxhash64("vec_id"), many[F.col("i")]).cast("int"))
    # so are the queries, and the rows go to each of their blocks
    blocks = max(1, -(-index.where(queries).count() // BLOCK_ROWS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def compare(key: tuple, asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        if asked.empty or block.empty:
            return empty
        block = block.sort_values(["j", "vec_id"], kind="stable")
        ids, x, j = block.vec_id.to_numpy(), np.stack(block.embedding.to_numpy()), block.j.to_numpy()
        longest = np.sqrt((x**2).sum(1).max())
        out, rough = [], None
        for n, (query_id, q, cells) in enumerate(zip(asked.query_id, asked["query"], asked.cells)):
            if n % 512 == 0:  # products of some queries with the whole block at a time
                rough = np.stack(asked["query"].iloc[n : n + 512].to_numpy()) @ x.T
            mine = np.zeros(n_second, bool)
            mine[cells] = True
            at = np.flatnonzero(mine[j])
            at = at[ids[at] != query_id]
            if len(at) > k:
                # a fast product leaves all rows that could be among the best; the scores are summed in a fixed order
                near = rough[n % 512, at]
                edge = np.partition(near, len(near) - k)[len(near) - k] - 1e-12 * dim * longest * np.sqrt((q * q).sum())
                at = at[near >= edge]
            score = (x[at] * q).sum(1)
            best = np.lexsort((ids[at], -score))[:k]
            out.append((np.full(len(best), query_id), ids[at][best], score[best]))
        return pd.DataFrame({"query_id": np.concatenate([o[0] for o in out]), "vec_id": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})

    found = asked.groupBy("i", "salt", "block").cogroup(dealt.groupBy("i", "salt", "block")).applyInPandas(compare, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_search(vectors: DataFrame, queries, k: int = 20) -> Iterator[tuple[int, int, int, float]]:
    """The same by comparing everything, on the driver: for tests of recall on small tables."""
    rows = usable(vectors).toPandas()
    x, ids = np.stack(rows.embedding.to_numpy()), rows.vec_id.to_numpy()
    for query_id in usable(vectors.where(queries)).toPandas().vec_id:
        score = (x * x[ids == query_id][0]).sum(1)
        score[ids == query_id] = -np.inf
        best = np.lexsort((ids, -score))[: min(k, len(ids) - 1)]
        yield from ((int(query_id), r, int(ids[b]), float(score[b])) for r, b in enumerate(best, 1))
