"""Hard negatives by inner product, with angles to reference directions as a filter.

Rows are integer vectors with a label.  A few reference directions are taken from the table, and every row's angles to
them are stored.  By the triangle inequality on the sphere the angle between an anchor and a row is at least the
difference of their angles to a reference, and at most their sum (or what is left of a full turn); its cosine's interval
times both norms bounds the score from both sides, with a margin for rounding.  Rows lie in tiles, ordered by label,
nearest reference and angle to it, each with its least and largest angle to every reference and its norms.  A tile is scored, in
integers, against the anchors whose window of wanted scores its interval meets, and against no others.

The positives of an anchor are wanted from its k-th best score so far up; the negatives of a positive from the larger of
the window's lower edge and their k-th best score so far, up to the window's upper edge.  What is not scored can't be among
the results, whatever the data; on vectors without structure few tiles drop out.

The rows are written once, by range, as files of about ``FILE_ROWS`` rows in the shared folder; neighbouring files of up
to ``SPAN_ROWS`` rows together are a span.  A task takes up to ``ANCHORS`` anchors and one span, whose files it maps one
by one; its results, a few rows per anchor, meet those of other spans by the anchor's number.  No row is copied to meet
an anchor.  The files' numbers of rows and the references are all that goes through the driver.

Rows with a null id, a null label, a null or empty vector, null or non-finite components, or another dimension than most
take no part.  Rows of one id are rows each, but none is another's positive; an anchor that occurs twice has its results
twice.  Ties go to the smaller id.  An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import shared_folder, written
from tallyforge.llm.shared_arrays import map_array, write_array
from tallyforge.llm.vectors import integer_vectors

REFERENCES = 32
#: Rows among which the references are chosen.
SAMPLE = 1024
FILE_ROWS = 1 << 18
SPAN_ROWS = 1 << 22
ANCHORS = 256
TILE = 256
#: At least so many candidates wait before they are sorted in among the best.
PENDING = 512
#: Tasks of one step, at most; more spans and blocks of anchors share a task.
MOST_TASKS = 20_000
#: What a double's cosines and angles may be wrong by, with room to spare.
ANGLE_MARGIN, SCORE_MARGIN = 1e-6, 1e-9
NOTHING = np.iinfo(np.int64).min


def chosen_references(points: np.ndarray, most: int) -> np.ndarray:
    """Unit vectors from rows far from each other: each next one has the least largest cosine to those before."""
    points = np.unique(points[(points != 0).any(1)], axis=0).astype(float)
    if not len(points):
        return np.eye(1, points.shape[1])
    unit = points / np.sqrt((points**2).sum(1, keepdims=True))
    found, nearest = [0], unit @ unit[0]
    while len(found) < min(most, len(unit)) and nearest.min() < 1 - 1e-9:
        found.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[found[-1]])
    return unit[found]


def angles(x: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles of rows to the references; a zero row's are right angles."""
    return np.arccos(np.clip((x @ references.T) / np.where(norms > 0, norms, 1)[:, None], -1, 1))


def bounds(own: np.ndarray, norms: np.ndarray, least: np.ndarray, largest: np.ndarray, norm_least: np.ndarray, norm_largest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score that an anchor (a row of ``own`` angles) can have with a row of a tile (a column)."""
    near, far = np.zeros((len(own), len(least))), np.full((len(own), len(least)), np.pi)
    for r in range(own.shape[1]):
        a = own[:, r, None]
        near = np.maximum(near, np.maximum(a - largest[:, r], least[:, r] - a))
        # the sum of both angles, or a full turn less their sum, at the tile's angle nearest to the larger of the two
        widest = np.where(a + largest[:, r] <= np.pi, a + largest[:, r], np.where(a + least[:, r] >= np.pi, 2 * np.pi - a - least[:, r], np.pi))
        far = np.minimum(far, widest)
    high = np.cos(np.clip(near - ANGLE_MARGIN, 0, np.pi))
    low = np.cos(np.clip(far + ANGLE_MARGIN, 0, np.pi))
    n = norms[:, None]
    margin = 1 + SCORE_MARGIN * n * norm_largest
    return n * np.where(low >= 0, low * norm_least, low * norm_largest) - margin, n * np.where(high >= 0, high * norm_largest, high * norm_least) + margin


class Segment:
    """The rows of one file: ids, labels, vectors, and the tiles' intervals of angles and norms."""

    def __init__(self, uri: str, dim: int, n_references: int):
        raw = map_array(uri, np.int64)
        n = int(raw[0]) if len(raw) else 0
        self.n, self.ids, self.labels = n, raw[1 : 1 + n], raw[1 + n : 1 + 2 * n]
        at = 1 + 2 * n
        words = -(-n * dim // 2)
        self.x = raw[at : at + words].view("<i4")[: n * dim].reshape(n, dim)
        rest = raw[at + words :].view("<f8")
        t = -(-n // TILE)
        self.least, self.largest = rest[: t * n_references].reshape(t, -1), rest[t * n_references : 2 * t * n_references].reshape(t, -1)
        self.norm_least, self.norm_largest = rest[2 * t * n_references :].reshape(2, t) if t else np.zeros((2, 0))
        starts = np.arange(0, n, TILE)
        self.label_least, self.label_largest = (f.reduceat(self.labels, starts) if n else np.zeros(0, np.int64) for f in (np.minimum, np.maximum))

    @staticmethod
    def write(uri: str, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, references: np.ndarray) -> None:
        n = len(ids)
        small = np.zeros(-(-x.size // 2) * 2, "<i4")
        small[: x.size] = x.ravel()
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for at in range(0, n, 64 * TILE):
            some = x[at : at + 64 * TILE].astype(float)
            norms, starts = np.sqrt((some**2).sum(1)), np.arange(0, len(some), TILE)
            theta = angles(some, norms, references)
            for part, (f, v) in zip(parts, ((f, v) for v in (theta, norms) for f in (np.minimum, np.maximum))):
                part.append(f.reduceat(v, starts).ravel())
        write_array(uri, np.concatenate([np.r_[np.int64(n), ids, labels], small.view("<i8"), *(p.view("<i8") for part in parts for p in part)]))

    def scores(self, anchors: np.ndarray, tile: int) -> np.ndarray:
        """Inner products of anchors with a tile's rows; doubles are exact below 2**53, larger ones are summed as integers."""
        x = self.x[tile * TILE : (tile + 1) * TILE]
        if np.abs(anchors).max() * float(np.abs(x).max()) * x.shape[1] < 2**53:
            return (anchors.astype(float) @ x.T.astype(float)).astype(np.int64)
        return anchors.astype(np.int64) @ x.T.astype(np.int64)


class Best:
    """The first ``k`` rows (highest score, then smallest id) of each of many lists; ``least`` is a full list's last score."""

    def __init__(self, lists: int, k: int):
        self.k, self.least = k, np.full(lists, NOTHING)
        self.rows = [np.empty(0, np.int64)] * 3
        self.waiting: list[tuple] = []

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(lists):
            self.waiting.append((lists, scores, ids))
            if sum(len(w[0]) for w in self.waiting) >= max(PENDING, len(self.rows[0])):
                self.sort()

    def sort(self) -> list[np.ndarray]:
        """Lists, scores and ids of the best."""
        at, score, row = (np.concatenate(c) for c in zip(self.rows, *self.waiting))
        self.waiting = []
        order = np.lexsort((row, -score, at))
        at, score, row = at[order], score[order], row[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        self.rows = [c[place < self.k] for c in (at, score, row)]
        full = place == self.k - 1
        self.least[at[full]] = score[full]
        return self.rows


def add_positives(best: Best, segment: Segment, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, theta: np.ndarray) -> None:
    """The anchors' best other rows of their label, one list per anchor."""
    norms = np.sqrt((x.astype(float) ** 2).sum(1))
    _, high = bounds(theta, norms, segment.least, segment.largest, segment.norm_least, segment.norm_largest)
    high[(labels[:, None] < segment.label_least) | (labels[:, None] > segment.label_largest)] = -np.inf
    for tile in np.argsort(-high.max(0), kind="stable").tolist():
        mine = np.flatnonzero(high[:, tile] >= np.where(best.least == NOTHING, -np.finfo(float).max, best.least))
        if len(mine):
            rows = slice(tile * TILE, (tile + 1) * TILE)
            score = segment.scores(x[mine], tile)
            fits = (labels[mine, None] == segment.labels[rows]) & (ids[mine, None] != segment.ids[rows]) & (score >= best.least[mine, None])
            a, b = np.nonzero(fits)
            best.add(mine[a], score[a, b], segment.ids[rows][b])


def add_negatives(best: Best, segment: Segment, x: np.ndarray, labels: np.ndarray, theta: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
    """The first rows of other labels in each window ``low[a, p]..high[a, p]`` of anchor a; list a * windows + p."""
    norms, windows = np.sqrt((x.astype(float) ** 2).sum(1)), low.shape[1]
    least, most = bounds(theta, norms, segment.least, segment.largest, segment.norm_least, segment.norm_largest)
    most[(labels[:, None] == segment.label_least) & (labels[:, None] == segment.label_largest)] = -np.inf
    wanted = low <= high
    for tile in np.argsort(-most.max(0), kind="stable").tolist():
        lowest = np.where(wanted, np.maximum(low, best.least.reshape(low.shape)), np.iinfo(np.int64).max)
        # the tile's interval meets one of the anchor's windows
        mine = np.flatnonzero((wanted & (most[:, tile, None] >= lowest) & (least[:, tile, None] <= high)).any(1))
        if len(mine):
            rows = slice(tile * TILE, (tile + 1) * TILE)
            score = segment.scores(x[mine], tile)
            a, b = np.nonzero((labels[mine, None] != segment.labels[rows]) & (score >= lowest[mine].min(1)[:, None]))
            found, ids, a = score[a, b], segment.ids[rows][b], mine[a]
            for p in range(windows):
                fits = (found >= lowest[a, p]) & (found <= high[a, p])
                best.add(a[fits] * windows + p, found[fits], ids[fits])


def dealt(asked: DataFrame, pairs: int) -> DataFrame:
    """Anchors with the numbers ``span`` and ``block``: a task's rows of one pair are together.

    The number of tasks is given, since rows so few in bytes that stand for so much work would else be put together.
    """
    return asked.repartition(max(1, min(pairs, MOST_TASKS)), "span", "block").sortWithinPartitions("span", "block", "anchor")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """The rows of each span and block."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        frame = batch.to_pandas()
        for pair, part in frame.groupby(["span", "block"], sort=False):
            if held and (held[0].span.iloc[0], held[0].block.iloc[0]) != pair:
                yield pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256, references: int = REFERENCES, file_rows: int = FILE_ROWS, span_rows: int = SPAN_ROWS) -> DataFrame:
    """For the rows of ``vectors`` (``vec_id``, ``label``, ``embedding``) where ``anchors`` holds: each positive's negatives.

    Negatives are the first rows of other labels with least * positive_score <= 100 * negative_score <= most * positive_score.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0))
    rows = written(integer_vectors(usable.withColumn("label", F.col("label").cast("long")), scale, "vec_id", "label"), "vectors")
    dims = rows.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], schema)
    dim, total = dims[0].dim, dims[0].n
    rows = rows.where(F.size("x") == dim)
    sample = np.array([r.x for r in rows.orderBy(F.xxhash64("vec_id"), "x").limit(SAMPLE).select("x").collect()])
    directions = chosen_references(sample, references)
    n_references, shared = len(directions), spark.sparkContext.broadcast(directions)  # at most ``references`` vectors

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float)
            theta = angles(x, np.sqrt((x**2).sum(1)), shared.value)
            nearest = theta.argmin(1)
            columns = [*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(theta[np.arange(len(x)), nearest])]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "nearest", "angle"])

    folder = shared_folder(spark, "segments")
    placed_rows = written(rows.mapInArrow(placed, "vec_id long, label long, x array<long>, nearest int, angle double"), "placed")
    by = ["label", "nearest", "angle", "vec_id", F.xxhash64("x")]
    ordered = placed_rows.repartitionByRange(-(-total // file_rows), *by).sortWithinPartitions(*by)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, labels, x = TaskContext.get().partitionId(), [], [], []
        for batch in batches:
            ids.append(batch.column("vec_id").to_numpy())
            labels.append(batch.column("label").to_numpy())
            x.append(batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, dim))
        if ids:
            Segment.write(f"{folder}/{number}", np.concatenate(ids), np.concatenate(labels), np.concatenate(x), shared.value)
            held, n = np.unique(np.concatenate(labels), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), number, np.int32)), pa.array(held), pa.array(n)], ["file", "label", "n"])

    held = written(ordered.select("vec_id", "label", "x").mapInArrow(store, "file int, label long, n long"), "held")
    spans: list[list[int]] = []
    rows_of = 0
    for file in held.groupBy("file").agg(F.sum("n").alias("n")).orderBy("file").collect():  # a number per file
        if not spans or rows_of + file.n > span_rows:
            spans, rows_of = [*spans, []], 0
        spans[-1].append(file.file)
        rows_of += file.n
    first_file = F.array(*(F.lit(s[0]) for s in spans))
    labels_of = held.select((F.size(F.filter(first_file, lambda f: f <= F.col("file"))) - 1).alias("span"), "label").distinct()
    asked = placed_rows.where(anchors).select(F.monotonically_increasing_id().alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "x")
    asked = written(asked, "anchors")
    blocks = -(-asked.count() // ANCHORS) or 1
    asked = asked.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Anchors of one span, at most ``ANCHORS`` at a time, with their vectors, angles and the span's segments."""
        for frame in grouped(batches):
            files = spans[frame.span.iloc[0]]
            for at in range(0, len(frame), ANCHORS):
                part = frame.iloc[at : at + ANCHORS]
                x = np.stack(part.x.to_numpy()).astype(np.int64)
                theta = angles(x.astype(float), np.sqrt((x.astype(float) ** 2).sum(1)), shared.value)
                yield part, x, theta, (Segment(f"{folder}/{file}", dim, n_references) for file in files)

    def best_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, theta, segments in parts(batches):
            best, ids, labels = Best(len(x), positives), part.anchor_id.to_numpy(), part.label.to_numpy()
            for segment in segments:
                add_positives(best, segment, x, ids, labels, theta)
            a, score, row = best.sort()
            yield pa.RecordBatch.from_arrays([pa.array(part.anchor.to_numpy()[a]), pa.array(ids[a]), pa.array(row), pa.array(score)], ["anchor", "anchor_id", "positive_id", "positive_score"])

    def best_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, theta, segments in parts(batches):
            # windows of scores; a place without a positive has none
            low, high = np.ones((len(x), positives), np.int64), np.zeros((len(x), positives), np.int64)
            for k, wanted in enumerate(part.wanted):
                low[k, : len(wanted)], high[k, : len(wanted)] = -(-least * wanted // 100), most * wanted // 100
            best = Best(low.size, negatives)
            for segment in segments:
                add_negatives(best, segment, x, part.label.to_numpy(), theta, low, high)
            a, score, row = best.sort()
            columns = [pa.array(part.anchor.to_numpy()[a // positives]), pa.array((a % positives + 1).astype(np.int32)), pa.array(row), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "place", "negative_id", "negative_score"])

    pairs = len(spans) * blocks
    in_spans = asked.join(labels_of, "label").select("span", "block", "anchor", "anchor_id", "label", "x")
    first = dealt(in_spans, pairs).mapInArrow(best_positives, "anchor long, anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id"))
    found = written(first.withColumn("place", place).where(F.col("place") <= positives), "positives")
    # at most ``positives`` of an anchor
    listed = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("listed"))
    wanted = asked.join(listed, "anchor").select("block", "anchor", "label", "x", F.col("listed.positive_score").alias("wanted"), F.explode(F.sequence(F.lit(0), F.lit(len(spans) - 1))).alias("span"))
    second = dealt(wanted, pairs).mapInArrow(best_negatives, "anchor long, place int, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id"))
    second = second.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return second.join(found, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
