"""N-gram Jaccard join with an R-tree of count vectors.

A document's set is its distinct word shingles, hashed.  Hash ranges are the coordinates of a point: how many shingles
fall into each range.  For sets A and B the overlap is at most the sum of the coordinates' minima.  Points are packed
into R-trees; a node's box holds the largest count of each coordinate below it and its range of sizes, and two nodes,
then two points, whose summed minima can't reach the threshold are dropped.  What is left is verified on whole sets.

One tree over all points would be compared each leaf with each other, for points of many coordinates all lie about
equally far apart.  The points are therefore dealt to many trees, by a pigeonhole argument on finer count vectors: two
sets at the threshold differ in at most ``r = n / 4`` shingles, so of ``m`` coordinates all but ``r`` hold the very same
shingles.  Each set names ``r + 1`` of its coordinates' contents, in an order that all sets agree on (fullest first, but
those that many sets name last), and a pair of the threshold shares one of these.  A content's points make one tree.

Equal sets are one point from the start.  A content whose tree leaves few pairs gives these.  One with more, or with
over ``LARGE`` points, gives a star; where the star leaves it in several components its points are dealt to blocks by
range, the blocks' boxes make the tree's upper levels, and blocks that these leave are compared across components.

Words are hashes of 61 bits, shingles of 64: two different words of n bytes are taken as equal with odds of n in 2 * 10**18.  Empty or null
text: an empty set, linked with nothing.  Rows with one doc_id are one document.  A row without doc_id has no component.
Repeated rows are equal sets.  An empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import byte_words
from tallyforge.llm.byte_words import mixed
from tallyforge.llm.common import shared_folder, written
from tallyforge.llm.components import connected_components
from tallyforge.llm.shared_arrays import ArrayFile, map_array

WIDTH = 5
PERCENT = 80
#: Coordinates of a point, and of the coarser one that goes along with each content.
GROUPS, COARSE = 32, 8
#: Contents named by more points are named last by all; so many contents at most, the most frequent ones.
SMALL, MOST_FREQUENT = 64, 1_000_000
#: Points of one content that one task may hold as a tree, pairs per point that the tree may leave; all pairs of SMALL points are always few enough.
LARGE, PAIRS_EACH = 4096, 4
BLOCK = 512
LEAF, FAN = 16, 8
SHARD_ROWS = 2_000_000
GROWTH = 2.5
#: Counts of a coarse point in one byte: exact up to 32, then rounded up by at most 4 percent.
CODES = np.r_[np.arange(33), np.cumprod(np.r_[33.0, np.full(221, 1.04)]).astype(np.int64) + 1, 1 << 40].astype(np.int64)


def shingle_sets(words: np.ndarray, lengths: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after the other, and how many each text has.

    ``words`` holds the texts' word hashes.  A text with fewer words than ``width`` is one shingle as a whole.
    """
    n, ends = len(words), np.cumsum(lengths)
    factors = np.random.default_rng(23).integers(1, 1 << 63, width, np.uint64) * np.uint64(2) + np.uint64(1)
    key = words * factors[0]
    for k in range(1, width):
        key[: n - k] += words[k:] * factors[k]
    key = mixed(key)
    whole = np.maximum(lengths - width + 1, np.minimum(lengths, 1))
    for t in np.flatnonzero((lengths > 0) & (lengths < width)):
        own = words[ends[t] - lengths[t] : ends[t]]
        key[ends[t] - lengths[t]] = mixed((own * factors[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))[0]
    mask = np.zeros(n + 1, np.int64)
    np.add.at(mask, ends - lengths, 1)
    np.add.at(mask, ends - lengths + whole, -1)
    key = key[np.cumsum(mask[:-1]) > 0]
    begin = np.cumsum(whole) - whole
    for a, b in zip(begin.tolist(), (begin + whole).tolist()):
        key[a:b].sort()
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    fresh[begin[whole > 0]] = True
    return key[fresh], np.diff(np.r_[0, np.cumsum(fresh)][np.r_[begin, len(key)]])


def count_vectors(sets: np.ndarray, sizes: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Points: shingles of each set by the hash's lowest bits."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    flat = np.bincount(doc * groups + (sets % np.uint64(groups)).astype(np.int64), minlength=len(sizes) * groups)
    return flat.reshape(-1, groups)


def least_overlap(total: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The smallest overlap with 100 * overlap >= percent * union, given the sum of both sizes."""
    return -(-(percent * total) // (100 + percent))


def size_class(n: np.ndarray) -> np.ndarray:
    """The class c with GROWTH ** (c - 1) < n <= GROWTH ** c."""
    return np.searchsorted(np.floor(GROWTH ** np.arange(40)).astype(np.int64), n)


def held_in(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def contents(sets: np.ndarray, sizes: np.ndarray, percent: int = PERCENT, frequent: np.ndarray = np.zeros(0, np.uint64)) -> tuple[np.ndarray, np.ndarray]:
    """Contents that each set names, as hashes, and the number of the set that names each.

    In a size class with ``m`` coordinates, a set with ``e`` empty ones shares at least m - r - e filled contents with
    any partner; by the prefix principle it is enough to name the r + 1 first in an order that all sets agree on:
    ``frequent`` ones last, fullest first, then by hash.  Where m - r - e < 1 the set names all its contents and its
    empty coordinates.  A set also takes part in the next class where a larger partner may be in that.
    """
    out_sig, out_doc = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    own = size_class(sizes)
    upper = size_class(sizes * 100 // percent)
    r = sizes * (100 - percent) // percent
    begin = np.cumsum(sizes) - sizes
    for c in np.unique(np.r_[own, upper]):
        chosen = np.flatnonzero(((own == c) | (upper == c)) & (r > 0))
        if not len(chosen):
            continue
        m = int(GROWTH**c / 3) + 5
        n = sizes[chosen]
        doc = np.repeat(np.arange(len(chosen)), n)
        at = np.repeat(begin[chosen] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        h = sets[at]
        group = (((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (group[1:] != group[:-1])])
        amount = np.diff(np.r_[first, len(h)])
        sig = mixed(np.add.reduceat(mixed(h + np.uint64(c)), first) + group[first].astype(np.uint64))
        owner = doc[first]
        filled = np.bincount(owner, minlength=len(chosen))
        spare = m - r[chosen] - (m - filled)
        late = np.where(held_in(sig, frequent), 256, 255 - np.minimum(amount, 255))
        # one number to sort by: the set, the rank of the amount, the hash's upper bits
        rank = (owner.astype(np.uint64) << np.uint64(48)) | (late.astype(np.uint64) << np.uint64(39)) | (sig >> np.uint64(25))
        order = np.argsort(rank)
        place = np.arange(len(order)) - np.repeat(np.cumsum(filled) - filled, filled)
        keep = order[(place <= r[chosen][owner[order]]) | (spare[owner[order]] < 1)]
        out_sig.append(sig[keep])
        out_doc.append(chosen[owner[keep]])
        for d in np.flatnonzero(spare < 1):
            empty = np.setdiff1d(np.arange(m), group[first][owner == d])
            out_sig.append(mixed(empty.astype(np.uint64) + np.uint64(int(c) << 32) + np.uint64(1 << 60)))
            out_doc.append(np.full(len(empty), chosen[d]))
    return np.concatenate(out_sig), np.concatenate(out_doc)


PLACE = ("folder", "file", "piece", "first", "n_words")


def document_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, a digest of its set, its point, and where its words are.

    Each task keeps its words in one file of the shared folder: piece by piece, the distinct word hashes and then each
    word's number among these, so that sets can be made again where a pair is verified without moving texts.
    """
    folder = shared_folder(docs.sparkSession, "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, kept = uuid.uuid4().hex, None
        for batch in byte_words.pieces(batches):
            words, lengths = byte_words.word_hashes(batch.column("text"))
            sets, sizes = shingle_sets(words, lengths, width)
            ends = np.cumsum(sizes)
            distinct, number = np.unique(words, return_inverse=True)
            kind = np.uint16 if len(distinct) <= 1 << 16 else np.uint32
            kept = kept or ArrayFile(f"{folder}/{name}")
            piece = kept.append(np.array([len(distinct), np.dtype(kind).itemsize], np.uint64), distinct, number.astype(kind))
            points = count_vectors(sets, sizes).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes.astype(np.int64)),
                    pa.array([xxhash.xxh3_128_digest(sets[e - s : e].tobytes()) for s, e in zip(sizes, ends)], pa.binary()),
                    pa.array([name] * len(sizes), pa.string()),
                    pa.array(np.full(len(sizes), piece)),
                    pa.array(np.cumsum(lengths) - lengths),
                    pa.array(lengths),
                    pa.array([p.tobytes() for p in points], pa.binary()),
                ],
                ["doc_id", "n_shingles", "digest", "file", "piece", "first", "n_words", "point"],
            )
        if kept:
            kept.close()

    schema = "doc_id long, n_shingles long, digest binary, file string, piece long, first long, n_words long, point binary"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    return written(rows.withColumn("folder", F.lit(folder)), "sets")


class Sets:
    """Sets made again from the kept words; the last few are remembered."""

    def __init__(self, width: int = WIDTH):
        self.width, self.files, self.made = width, {}, {}

    def words(self, folder: str, file: str, piece: int, first: int, n_words: int) -> np.ndarray:
        if file not in self.files:
            if len(self.files) > 500:
                self.files.clear()
            self.files[file] = map_array(f"{folder}/{file}", np.uint8)
        data = self.files[file]
        n, size = (int(x) for x in data[piece : piece + 16].view(np.uint64))
        at = piece + 16 + 8 * n
        codes = data[at + first * size : at + (first + n_words) * size].view(np.uint16 if size == 2 else np.uint32)
        return data[piece + 16 : at].view(np.uint64)[codes]

    def get(self, *place) -> np.ndarray:
        key = place[1:4]
        if key not in self.made:
            if len(self.made) > 500:
                self.made.clear()
            words = self.words(*place)
            self.made[key] = shingle_sets(words, np.array([len(words)]), self.width)[0]
        return self.made[key]


def many_sets(read: Sets, places: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    words = [read.words(*p) for p in places]
    return shingle_sets(np.concatenate(words), np.array([len(w) for w in words], np.int64), read.width)


def some_words(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` words; a longer text is one by itself."""
    for batch in batches:
        ends = np.cumsum(batch.column("n_words").to_numpy())
        row = 0
        while row < batch.num_rows:
            n = max(1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + most, "right")) - row)
            yield batch.slice(row, n)
            row += n


def places_of(batch: pa.RecordBatch) -> list[tuple]:
    return list(zip(*(batch.column(c).to_pylist() for c in PLACE)))


def frequent_contents(nodes: DataFrame, shards: int, width: int, percent: int) -> np.ndarray:
    """Contents named by more than SMALL points, sorted; of these the MOST_FREQUENT at most, whatever the size of the table.

    They only set an order of the contents, so any choice gives the same links.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Sets(width)
        for batch in some_words(batches):
            sig = np.sort(contents(*many_sets(read, places_of(batch)), percent)[0])
            cut = np.searchsorted(shard_of(sig, shards), np.arange(shards + 1))
            rows = [(s, sig[a:b].tobytes()) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "sig"])

    def count(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        sig = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in part.sig]))
        first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        n = np.diff(np.r_[first, len(sig)])
        many = n > SMALL
        return pd.DataFrame({"sig": sig[first[many]].view(np.int64), "n": n[many]})

    counted = nodes.select(*PLACE).mapInArrow(deal, "shard int, sig binary").groupBy("shard").applyInPandas(count, "sig long, n long")
    found = counted.orderBy(F.desc("n"), "sig").limit(MOST_FREQUENT).select("sig").toArrow()
    return np.sort(found.column("sig").to_numpy().view(np.uint64)) if found.num_rows else np.zeros(0, np.uint64)


def shard_of(sig: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash's upper bits."""
    return ((sig >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


class RTree:
    """An R-tree of points, packed by size and then coordinates: leaves of LEAF points, nodes of FAN nodes.

    ``levels[k]`` has the boxes of a level: largest counts, smallest and largest size.  Level 0 are the points.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((*points.T[:3], sizes))
        box = (points[self.order], sizes[self.order], sizes[self.order])
        self.levels = [box]
        while len(box[0]) > 1:
            cut = np.arange(0, len(box[0]), LEAF if len(self.levels) == 1 else FAN)
            box = (np.maximum.reduceat(box[0], cut), np.minimum.reduceat(box[1], cut), np.maximum.reduceat(box[2], cut))
            self.levels.append(box)


def tree_pairs(a: RTree, b: RTree, percent: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """Index pairs of points that may link: (i, j) of ``a`` and ``b``, or of ``a`` with itself, each pair once.

    Pairs of nodes are followed from the roots down; None as soon as there are more than ``most`` pairs of points.
    """
    out, found = [], 0
    if a is b and len(a.order) == 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    todo = [(len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        u, v, i, j = todo.pop()
        if len(i) > 2048:
            todo += [(u, v, i[k : k + 2048], j[k : k + 2048]) for k in range(0, len(i), 2048)]
            continue
        (p, p_low, p_high), (q, q_low, q_high) = a.levels[u], b.levels[v]
        fits = (p_high[i] * 100 >= q_low[j] * percent) & (q_high[j] * 100 >= p_low[i] * percent)
        i, j = i[fits], j[fits]
        fits = np.minimum(p[i], q[j]).sum(1) >= least_overlap(p_low[i] + q_low[j], percent)
        i, j = i[fits], j[fits]
        if not len(i):
            continue
        if u == v == 0:
            found += len(i)
            if most is not None and found > most:
                return None
            out.append((a.order[i], b.order[j]))
            continue
        # the higher of the two is opened, both where they are of one level
        same = a is b
        if u >= v:
            i, j = children(i, j, LEAF if u == 1 else FAN, len(a.levels[u - 1][0]))
        if v >= u:
            j, i = children(j, i, LEAF if v == 1 else FAN, len(b.levels[v - 1][0]))
        u, v = u - (u >= v), v - (v >= u)
        if same:
            once = i < j if u == 0 else i <= j
            i, j = i[once], j[once]
        todo.append((u, v, i, j))
    none = np.zeros(0, np.int64)
    return (np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])) if out else (none, none)


def children(opened: np.ndarray, other: np.ndarray, fan: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    below = (opened[:, None] * fan + np.arange(fan)).ravel()
    other = np.repeat(other, fan)
    there = below < n
    return below[there], other[there]


def candidates(nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows (``hot``, ``a``, ``b``): pairs of points that the trees leave, and content and point of contents left open."""
    nodes = nodes.where("n_shingles >= 4")  # smaller sets link with equal ones only
    # a set names about a third of its shingles' number
    total = nodes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).collect()[0].n
    shards = max(1, math.ceil(total * 0.3 / SHARD_ROWS))
    # at most MOST_FREQUENT numbers
    shared = nodes.sparkSession.sparkContext.broadcast(frequent_contents(nodes, shards, width, percent))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Sets(width)
        for batch in some_words(batches):
            sig, doc = contents(*many_sets(read, places_of(batch)), percent, shared.value)
            points = np.frombuffer(b"".join(batch.column("point").to_pylist()), np.int32).reshape(-1, GROUPS)
            coarse = np.searchsorted(CODES, points.reshape(len(points), -1, COARSE).sum(1)).astype(np.uint8)
            node, size = batch.column("node").to_numpy(), batch.column("n_shingles").to_numpy().astype(np.int32)
            shard = shard_of(sig, shards)
            order = np.argsort(shard.astype(np.uint16) if shards < 1 << 16 else shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(shards + 1))
            columns: list[list] = [[] for _ in range(5)]
            for s, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
                if b > a:
                    d = doc[order[a:b]]
                    for column, x in zip(columns, (s, *(y.tobytes() for y in ((sig[order[a:b]] & np.uint64(0xFFFFFFFF)).astype(np.uint32), node[d], size[d], coarse[d])))):
                        column.append(x)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["shard", "sig", "node", "size", "point"])

    def meet(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        joined = lambda column, kind: np.frombuffer(b"".join(part[column]), kind)
        sig, node, size, point = joined("sig", np.uint32), joined("node", np.int64), joined("size", np.int32), joined("point", np.uint8).reshape(-1, COARSE)
        order = np.argsort(sig, kind="stable")
        first = np.flatnonzero(np.r_[True, sig[order][1:] != sig[order][:-1]])
        n = np.diff(np.r_[first, len(sig)])
        out_a, out_b, hot_sig, hot_node = [], [], [], []
        for k in np.unique(n[(n > 1) & (n <= LEAF)]):  # contents with one leaf, those of one length together
            i, j = np.triu_indices(k, 1)
            for at in np.array_split(first[n == k], max(1, int((n == k).sum()) * len(i) // 200_000)):
                x, y = order[(at[:, None] + i).ravel()], order[(at[:, None] + j).ravel()]
                s, t = size[x].astype(np.int64), size[y].astype(np.int64)
                near = np.flatnonzero((np.minimum(s, t) * 100 >= np.maximum(s, t) * percent) & (node[x] != node[y]))
                x, y = x[near], y[near]
                near = CODES[np.minimum(point[x], point[y])].sum(1) >= least_overlap(s[near] + t[near], percent)
                out_a.append(node[x[near]])
                out_b.append(node[y[near]])
        for k in np.flatnonzero(n > LEAF):
            mine = order[first[k] : first[k] + n[k]]
            mine = mine[np.unique(node[mine], return_index=True)[1]]
            pairs = None
            if len(mine) <= LARGE:
                tree = RTree(CODES[point[mine]], size[mine].astype(np.int64))
                pairs = tree_pairs(tree, tree, percent, max(PAIRS_EACH * len(mine), SMALL * (SMALL - 1) // 2))
            if pairs is None:
                out_a.append(np.full(len(mine), node[mine].min()))  # a star around the smallest node
                out_b.append(node[mine])
                hot_sig.append(np.full(len(mine), (int(key[0]) << 32) | int(sig[mine[0]])))
                hot_node.append(node[mine])
            else:
                out_a.append(node[mine[pairs[0]]])
                out_b.append(node[mine[pairs[1]]])
        a, b, hot_sig, hot_node = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (out_a, out_b, hot_sig, hot_node))
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)] & (a != b)
        a, b = a[fresh], b[fresh]
        is_hot = np.r_[np.zeros(len(a), bool), np.ones(len(hot_sig), bool)]
        return pd.DataFrame({"hot": is_hot, "a": np.r_[a, hot_sig], "b": np.r_[b, hot_node]})

    named = nodes.select("node", *PLACE, "n_shingles", "point").mapInArrow(name, "shard int, sig binary, node binary, size binary, point binary")
    return written(named.groupBy("shard").applyInPandas(meet, "hot boolean, a long, b long"), "candidates")


def verified(pairs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) that link: first by the bound of their points, then on the whole sets."""
    place = F.struct(*PLACE, "n_shingles", "point")
    left = nodes.select(F.col("node").alias("a"), place.alias("x"))
    right = nodes.select(F.col("node").alias("b"), place.alias("y"))
    # each point beside its pair; the words themselves stay where they are
    joined = pairs.join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Sets(width)
        for batch in (whole.slice(k, 2000) for whole in batches for k in range(0, whole.num_rows, 2000)):
            x, y = (dict(zip((f.name for f in batch.column(c).type), batch.column(c).flatten())) for c in ("x", "y"))
            p, q = (np.frombuffer(b"".join(z["point"].to_pylist()), np.int32).reshape(-1, GROUPS) for z in (x, y))
            need = least_overlap(x["n_shingles"].to_numpy() + y["n_shingles"].to_numpy(), percent)
            near = np.flatnonzero(np.minimum(p, q).sum(1) >= need)
            sides = [list(zip(*(z[f].take(pa.array(near)).to_pylist() for f in PLACE))) for z in (x, y)]
            keep, k = [], 0
            while k < len(near):  # the sets of some pairs are made together
                made, upto, words = {}, k, 0
                while upto < len(near) and (upto == k or words < 1 << 20):
                    for place in (sides[0][upto], sides[1][upto]):
                        words += place[4] if made.setdefault(place, len(made)) == len(made) - 1 else 0
                    upto += 1
                flat, sizes = many_sets(read, list(made))
                ends = np.cumsum(sizes)
                own = lambda place: flat[ends[made[place]] - sizes[made[place]] : ends[made[place]]]  # noqa: E731, B023
                keep += [near[m] for m in range(k, upto) if overlap(own(sides[0][m]), own(sides[1][m])) >= need[near[m]]]
                k = upto
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], ["a", "b"])

    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def overlap(s: np.ndarray, t: np.ndarray) -> int:
    return int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())


def hot_blocks(hot: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Points of the open contents that lie in several components, in blocks of at most BLOCK: one row each, with its box.

    Blocks are cut from ranges of (content, component, size), so a content of any size is spread over tasks.  A block's
    number is a hash of its points, so contents that the same points share have the same blocks.
    """
    marked = hot.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = marked.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    marked = marked.join(open_.select("sig"), "sig").join(nodes.select("node", *PLACE, "n_shingles", "point"), "node")
    order = ("sig", "component", "n_shingles", "node")
    marked = marked.select(*order, *PLACE, "point").repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = batch.column("sig").to_numpy()
            run = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1], True]) if len(sig) else np.zeros(1, np.int64)
            for a, b in ((k, min(k + BLOCK, end)) for begin, end in zip(run[:-1], run[1:]) for k in range(begin, end, BLOCK)):
                part = batch.slice(a, b - a)
                points = np.frombuffer(b"".join(part.column("point").to_pylist()), np.int32).reshape(-1, GROUPS)
                size, component = part.column("n_shingles").to_numpy(), part.column("component").to_numpy()
                one = {"sig": int(sig[a]), "block": xxhash.xxh3_64_intdigest(part.column("node").to_numpy().tobytes()) >> 1, "n_low": int(size.min()), "n_high": int(size.max()), "c_low": int(component.min()), "c_high": int(component.max())}
                blobs = {"box": points.max(0), "nodes": part.column("node").to_numpy(), "sizes": size, "components": component, "points": points}
                places = {c: part.column(c).to_pylist() for c in PLACE}
                yield pa.RecordBatch.from_pylist([one | {k: v.tobytes() for k, v in blobs.items()} | places], BLOCK_SCHEMA)

    return written(marked.mapInArrow(cut, BLOCK_DDL), "blocks")


_LONGS = ("sig", "block", "n_low", "n_high", "c_low", "c_high")
_BLOBS = ("box", "nodes", "sizes", "components", "points")
BLOCK_SCHEMA = pa.schema([(c, pa.int64()) for c in _LONGS] + [(c, pa.binary()) for c in _BLOBS] + [(c, pa.list_(pa.string() if c in ("folder", "file") else pa.int64())) for c in PLACE])
BLOCK_DDL = ", ".join([f"{c} long" for c in _LONGS] + [f"{c} binary" for c in _BLOBS] + [f"{c} array<{'string' if c in ('folder', 'file') else 'bigint'}>" for c in PLACE])


def hot_pairs(hot: DataFrame, labels: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Linked pairs across components within the contents that are left open."""
    blocks = hot_blocks(hot, labels, nodes)

    def upper(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        """Pairs of blocks that the boxes leave; a content has one row here for up to BLOCK points."""
        box = np.frombuffer(b"".join(part.box), np.int32).reshape(-1, GROUPS)
        tree = RTree(box, part.n_low.to_numpy())
        # a box has a range of sizes
        tree.levels[0] = (tree.levels[0][0], tree.levels[0][1], part.n_high.to_numpy()[tree.order])
        for k in range(1, len(tree.levels)):
            at = np.arange(0, len(tree.levels[k - 1][0]), LEAF if k == 1 else FAN)
            tree.levels[k] = (*tree.levels[k][:2], np.maximum.reduceat(tree.levels[k - 1][2], at))
        i, j = tree_pairs(tree, tree, percent)
        every = np.arange(len(part))
        i, j = np.r_[i, every], np.r_[j, every]
        low, high, block = part.c_low.to_numpy(), part.c_high.to_numpy(), part.block.to_numpy()
        apart = ~((low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j]))
        return pd.DataFrame({"i": block[i[apart]], "j": block[j[apart]]})

    boxes = blocks.select("sig", "block", "box", "n_low", "n_high", "c_low", "c_high")
    several = boxes.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sig")
    # a content of one block is compared with itself
    alone = boxes.join(several, "sig", "left_anti").where("c_low != c_high").select(F.col("block").alias("i"), F.col("block").alias("j"))
    pairs = written(boxes.join(several, "sig").groupBy("sig").applyInPandas(upper, "i long, j long").unionByName(alone).distinct(), "block-pairs")
    blocks = blocks.dropDuplicates(["block"])
    one = blocks.select(F.col("block").alias("i"), F.struct(*_BLOBS[1:], *PLACE).alias("x"))
    two = blocks.select(F.col("block").alias("j"), F.struct(*_BLOBS[1:], *PLACE).alias("y"))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(width)
        for batch in batches:
            for row in batch.to_pylist():
                sides, trees = (row["x"], row["y"]), []
                for s in sides:
                    for c in ("nodes", "sizes", "components"):
                        s[c] = np.frombuffer(s[c], np.int64)
                    trees.append(RTree(np.frombuffer(s["points"], np.int32).reshape(-1, GROUPS), s["sizes"]))
                if row["i"] == row["j"]:
                    trees[1] = trees[0]
                i, j = tree_pairs(trees[0], trees[1], percent)
                x, y = sides
                apart = x["components"][i] != y["components"][j]
                i, j = i[apart], j[apart]
                need = least_overlap(x["sizes"][i] + y["sizes"][j], percent)
                a, b = [], []
                bits = [bitmaps(sets, s, np.unique(k)) for s, k in ((x, i), (y, j))]
                for k in range(0, len(i), 20_000):
                    p, q, n = i[k : k + 20_000], j[k : k + 20_000], need[k : k + 20_000]
                    differ = np.bitwise_count(bits[0][p] ^ bits[1][q]).sum(1, dtype=np.int64)
                    near = differ <= x["sizes"][p] + y["sizes"][q] - 2 * n
                    for s, t, least in zip(p[near], q[near], n[near]):
                        if overlap(sets.get(*(x[c][s] for c in PLACE)), sets.get(*(y[c][t] for c in PLACE))) >= least:
                            a.append(min(x["nodes"][s], y["nodes"][t]))
                            b.append(max(x["nodes"][s], y["nodes"][t]))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = pairs.repartition("i", "j").join(one, "i").join(two, "j")
    return dealt.select("i", "j", "x", "y").mapInArrow(leaves, "a long, b long").distinct()


def bitmaps(sets: Sets, block: dict, rows: np.ndarray, bits: int = 2048) -> np.ndarray:
    """The sets of ``rows`` as ``bits`` bits, one for each shingle: two sets differ in at least as many shingles as bits."""
    out = np.zeros((len(block["nodes"]), bits // 64), np.uint64)
    for k in rows:
        one = np.zeros(bits, np.uint8)
        one[((sets.get(*(block[c][k] for c in PLACE)) >> np.uint64(20)) % np.uint64(bits)).astype(np.int64)] = 1
        out[k] = np.packbits(one).view(np.uint64)
    return out


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for every row of ``docs`` (``doc_id``, ``text``)."""
    sets = document_sets(docs, width)
    filled = sets.where("n_shingles > 0 and doc_id is not null")
    place = F.struct("doc_id", *PLACE, "n_shingles", "point")
    nodes = filled.groupBy("digest").agg(F.min_by(place, F.col("doc_id")).alias("p")).select("digest", F.col("p.doc_id").alias("node"), "p.*").drop("doc_id")
    nodes = written(nodes, "nodes")
    found = candidates(nodes, width, percent)
    pairs = found.where("not hot").select("a", "b").distinct()
    # rows of one doc_id are one document, whatever their texts
    same = filled.join(nodes.select("digest", "node"), "digest").where("doc_id != node").groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    same = same.where("lo != hi").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    links = written(verified(pairs, nodes, width, percent).unionByName(same), "links")
    labels = connected_components(links)
    hot = found.where("hot").select(F.col("a").alias("sig"), F.col("b").alias("node"))
    if not hot.isEmpty():
        more = written(hot_pairs(hot, labels, nodes, width, percent), "links")
        if not more.isEmpty():
            labels = connected_components(links.unionByName(more))
    by_digest = nodes.select("digest", "node").join(labels, "node", "left").select(F.col("digest").alias("d"), F.coalesce("component", "node").alias("component_id"))
    joined = sets.join(by_digest, (sets.digest == by_digest.d) & (sets.n_shingles > 0) & sets.doc_id.isNotNull(), "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with one document of each component, that of the smallest id, and all rows without an id.

    Of several rows with that id the one of the smallest row hash stays, so a job run again keeps the same text.
    """
    found = jaccard_components(docs, width, percent)
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    # the document's own columns lie in ``doc``, so that none of them can clash with those used here
    marked = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), F.xxhash64(*docs.columns).alias("hash"), F.struct("*").alias("doc"))
    rows = marked.groupBy("id").agg(F.min("hash").alias("hash")).join(first.withColumnRenamed("doc_id", "id"), "id", "left_semi")
    kept = marked.join(rows, ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"])
    return kept.select(*(F.col("doc")[c].alias(c) for c in docs.columns)).unionByName(docs.where("doc_id is null"))
