"""Exact k-means over vectors whose blocks of dimensions are dictionary-encoded.

The vectors are cut into shards.  In a shard each block of dimensions is a dictionary of its distinct subvectors and one
code per vector, without loss.  Blocks begin as single dimensions; two neighbours become one block where their pairs have
few distinct values for the shard's rows, so repeated and regular vectors get wide blocks.  A round computes the squared
distance of every dictionary entry to every centroid once; a vector's distance is the sum over its codes.  The sums of a
cluster are the entries times how often the cluster's codes name them.  All of this is integer arithmetic.

A shard is one row of a table written once; a round is one pass over it, from which each cluster's counts and sums come
together by a groupBy (centroids times dimensions rows).  Only centroids go to tasks and come back.

Vectors of another dimension than ``dim``, null vectors and vectors with null or non-finite components take no part.
Ties go to the centroid of the smaller number; equal seeds (repeated ids) are ordered by their components.  A vector with
a null id takes part, but is no seed.  Repeated rows count each.  With fewer vectors than ``k`` there are fewer
centroids; an empty table gives an empty result.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import written
from tallyforge.llm.vectors import integer_vectors

SHARD_ROWS = 16_384
#: Two blocks are joined where their dictionary has at most this share of a shard's rows.
ENTRIES_SHARE = 0.25
SHARD_SCHEMA = "vec_ids array<bigint>, widths array<int>, sizes array<int>, entries binary, codes binary"
RESULT_SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def dictionaries(x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Entries (rows of a block's dimensions) and codes of each block of the rows ``x``."""
    blocks = []
    for d in range(x.shape[1]):
        entries, codes = np.unique(x[:, d], return_inverse=True)
        blocks.append((entries[:, None], codes))
    most = int(ENTRIES_SHARE * len(x))
    grown = True
    while grown and len(blocks) > 1:
        grown, out = False, []
        for k in range(0, len(blocks) - 1, 2):
            both = joined(blocks[k], blocks[k + 1], most)
            grown |= both is not None
            out += [both] if both else blocks[k : k + 2]
        blocks = out + blocks[len(blocks) - len(blocks) % 2 :]
    return [b[0] for b in blocks], [b[1] for b in blocks]


def joined(a: tuple, b: tuple, most: int) -> tuple | None:
    """Two neighbouring blocks as one, or None where the pairs have more than ``most`` distinct values."""
    if max(len(a[0]), len(b[0])) > most:
        return None
    pair = a[1] * len(b[0]) + b[1]
    if len(np.unique(pair[: 2 * most])) > most:
        return None
    distinct, codes = np.unique(pair, return_inverse=True)
    return None if len(distinct) > most else (np.hstack([a[0][distinct // len(b[0])], b[0][distinct % len(b[0])]]), codes)


class Shard:
    """The blocks of a shard's row: ``entries`` per block, ``codes`` per block and vector."""

    def __init__(self, row: dict):
        self.vec_ids, self.n = row["vec_ids"], len(row["vec_ids"])
        numbers, self.entries, at = np.frombuffer(row["entries"], "<i4").astype(np.int64), [], 0
        for width, size in zip(row["widths"], row["sizes"]):
            self.entries.append(numbers[at : at + width * size].reshape(size, width))
            at += width * size
        self.codes = np.frombuffer(row["codes"], "<u2").reshape(len(self.entries), self.n)
        self.starts = np.cumsum([0, *row["widths"]])

    @staticmethod
    def row(vec_ids: list, x: np.ndarray) -> tuple:
        entries, codes = dictionaries(x)
        return (
            vec_ids,
            [e.shape[1] for e in entries],
            [len(e) for e in entries],
            b"".join(e.astype("<i4").tobytes() for e in entries),
            np.stack(codes).astype("<u2").tobytes(),
        )

    def vectors(self) -> np.ndarray:
        return np.hstack([e[c] for e, c in zip(self.entries, self.codes)])

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's nearest centroid and squared distance, from the blocks' distances summed by code."""
        total = np.zeros((self.n, len(centroids)), np.int64)
        for k, (entries, codes) in enumerate(zip(self.entries, self.codes)):
            part = centroids[:, self.starts[k] : self.starts[k + 1]]
            total += ((entries[:, None, :] - part[None]) ** 2).sum(2)[codes]
        owner = total.argmin(1)
        return owner, total[np.arange(self.n), owner]

    def sums(self, owner: np.ndarray, k: int) -> np.ndarray:
        """Componentwise sums of each cluster's vectors: every entry times its codes' number in the cluster."""
        out = [np.bincount(owner * len(e) + c, minlength=k * len(e)).reshape(k, len(e)) @ e for e, c in zip(self.entries, self.codes)]
        return np.hstack(out)


def encoded(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows ``vec_id``, ``x`` as shards of at most ``shard_rows`` vectors each."""
    assert 0 < shard_rows <= 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("vec_ids", pa.list_(pa.int64())), ("widths", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("entries", pa.binary()), ("codes", pa.binary())])
        ids, parts, held = [], [], 0

        def shard() -> pa.RecordBatch:
            rows = [Shard.row(ids, np.concatenate(parts))]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, shard_rows):
                part = batch.slice(at, shard_rows)
                if held + part.num_rows > shard_rows:
                    yield shard()
                    ids, parts, held = [], [], 0
                ids += part.column("vec_id").to_pylist()
                parts.append(part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                held += part.num_rows
        if held:
            yield shard()

    return vectors.select("vec_id", "x").mapInArrow(run, SHARD_SCHEMA)


def cluster_totals(shards: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], int]:
    """Per cluster the sum of component d at (cluster, d), the number of vectors at -1, the distances' sum at -2."""
    shared = shards.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        k, dim = centres.shape
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                owner, distance = shard.assign(centres)
                inertia = np.zeros(k, np.int64)
                np.add.at(inertia, owner, distance)
                totals = np.hstack([shard.sums(owner, k), np.bincount(owner, minlength=k)[:, None], inertia[:, None]])
                where = np.r_[np.arange(dim), -1, -2]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), dim + 2)), pa.array(np.tile(where, k)), pa.array(totals.ravel())], ["cluster", "d", "total"])

    found = shards.mapInArrow(run, "cluster long, d long, total long").groupBy("cluster", "d").agg(F.sum("total").alias("total"))
    return {(r.cluster, r.d): r.total for r in found.collect()}


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Each vector's cluster after ``rounds`` rounds, with its squared distance, the clusters' inertia and centroid's hash."""
    spark = vectors.sparkSession
    kept = integer_vectors(vectors, scale, "vec_id").where(F.size("x") == dim)
    shards = written(encoded(kept, shard_rows), "shards")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    seeds = kept.where(F.col("vec_id").isNotNull()).orderBy(order, "x").limit(k).collect()
    if not seeds:
        return spark.createDataFrame([], RESULT_SCHEMA)
    centroids = np.array([s.x for s in seeds], np.int64)
    for _ in range(rounds):
        totals = cluster_totals(shards, centroids)
        for c in range(len(centroids)):
            if n := totals.get((c, -1)):
                centroids[c] = [totals[c, d] // n for d in range(dim)]
    totals = cluster_totals(shards, centroids)
    inertia = np.array([totals.get((c, -2), 0) for c in range(len(centroids))], np.int64)
    hashes = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    shared = spark.sparkContext.broadcast((centroids, inertia, sum(inertia.tolist()), hashes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, inertia, whole, hashes = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                owner, distance = shard.assign(centres)
                columns = [pa.array(shard.vec_ids, pa.int64()), pa.array(owner.astype(np.int32)), pa.array(distance), pa.array(inertia[owner]), pa.array(np.full(shard.n, whole)), pa.array(hashes).take(pa.array(owner))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return shards.mapInArrow(run, RESULT_SCHEMA)
