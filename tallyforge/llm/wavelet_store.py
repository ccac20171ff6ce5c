"""Token ids in wavelet matrices: one compressed file per shard, with access, counting and look-up of occurrences.

``write`` encodes documents, orders them by ``doc_id`` and cuts their ids, one document after the other, into shards of
``shard_tokens`` ids; a long document goes on in the next shard.  A shard's file holds the wavelet matrix of its ids: the
ids become numbers in order of falling frequency in the shard, and bit-plane k holds the k-th highest bit of the numbers,
those with a zero in the planes before first.  Planes lie in blocks of 32,768 bits, each compressed by itself, with the
number of ones before each block.  ``rank`` and ``select`` on a plane read only the blocks they touch; on them rest

* ``access(positions)``: the ids at these positions,
* ``rank(token, position)``, ``count(token, start, end)``: how often a token occurs before a position, or in a range,
* ``select(token, k)``, ``occurrences(token, start, end)``: where its k-th, or each, occurrence stands.

A ``TokenStore`` does the same over all shards as Spark jobs: ``documents()``, ``counts(tokens)``, ``occurrences(tokens)``.
Files of tasks that ran twice have names of their own; only those named in the table of shards are read.

Null text: the end id alone.  Null ids come first; rows with one id are ordered by their text's hash and length.  Repeated
rows are a document each.  A document of any length is written in pieces and read back in pieces.  Special tokens'
strings in a text become their ids.  An empty table gives an empty store; further columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm import byte_words
from tallyforge.llm.common import shared_folder, written
from tallyforge.llm.curve_packing import forget_tokens, token_ids
from tallyforge.llm.shared_arrays import ArrayFile, map_array

END_ID = 1
SHARD_TOKENS = 1 << 22
#: Bits of a plane in one compressed block.
BLOCK = 1 << 15
MAGIC = b"WAVELET1"
#: Occurrences in one batch.
READ = 1 << 20
_CODEC = "zstd"
_WORDS = BLOCK // 64


def packed_words(bits: np.ndarray) -> np.ndarray:
    """Bits as little-endian 64-bit words, filled up to whole blocks; the place after the last bit lies in a block too."""
    n_blocks = len(bits) // BLOCK + 1
    out = np.zeros(n_blocks * BLOCK // 8, np.uint8)
    bytes_ = np.packbits(bits, bitorder="little")
    out[: len(bytes_)] = bytes_
    return out.view("<u8")


def put(file: ArrayFile, array: np.ndarray) -> list:
    """Writes an array compressed; where it lies, its sizes and type."""
    raw = np.ascontiguousarray(array)
    small = pa.compress(raw.tobytes(), codec=_CODEC, asbytes=True)
    return [file.append(np.frombuffer(small, np.uint8)), len(small), raw.nbytes, raw.dtype.str]


def got(data: np.ndarray, place: list) -> np.ndarray:
    at, size, raw_size, kind = place
    return np.frombuffer(pa.decompress(data[at : at + size].tobytes(), raw_size, codec=_CODEC, asbytes=True), kind)


def write_matrix(uri: str, tokens: np.ndarray, documents: dict[str, np.ndarray]) -> None:
    """The wavelet matrix of ``tokens``, with the table of the shard's documents, as the file ``uri``."""
    n = np.bincount(tokens)
    distinct = np.flatnonzero(n)
    order = distinct[np.argsort(-n[distinct], kind="stable")]
    number = np.zeros(len(n), np.uint32)
    number[order] = np.arange(len(order))
    sequence = number[tokens]
    depth = max(1, int(len(order) - 1).bit_length())
    file, planes = ArrayFile(uri), []
    for level in range(depth):
        one = ((sequence >> np.uint32(depth - 1 - level)) & np.uint32(1)).astype(bool)
        words = packed_words(one).reshape(-1, _WORDS)
        blocks = [pa.compress(w.tobytes(), codec=_CODEC, asbytes=True) for w in words]
        ones = np.bitwise_count(words).sum(1, dtype=np.int64)
        sizes = np.array([len(b) for b in blocks], "<u4")
        data = np.frombuffer(b"".join(blocks), np.uint8)
        planes.append({"sizes": file.append(sizes), "ones": file.append(ones.astype("<u4")), "data": file.append(data), "zeros": int(len(one) - ones.sum())})
        sequence = np.concatenate([sequence[~one], sequence[one]])
    head = {"n": len(tokens), "planes": planes, "vocabulary": put(file, order.astype("<u4")), "documents": {k: put(file, v) for k, v in documents.items()}}
    said = json.dumps(head).encode()
    at = file.append(np.frombuffer(said, np.uint8))
    file.append(np.array([at, len(said)], "<u8"), np.frombuffer(MAGIC, np.uint8))
    file.close()


class Plane:
    """Rank and select on one bit-plane; blocks are decompressed when they are first needed."""

    def __init__(self, data: np.ndarray, said: dict, n: int):
        self.n, self.n_blocks, self.zeros = n, n // BLOCK + 1, said["zeros"]

        def counts(at: int) -> np.ndarray:
            return data[at : at + 4 * self.n_blocks].view("<u4").astype(np.int64)

        self.data, self.begin = data, said["data"] + np.r_[0, np.cumsum(counts(said["sizes"]))]
        self.ones = np.r_[0, np.cumsum(counts(said["ones"]))]
        self.words = np.zeros(self.n_blocks * _WORDS, np.uint64)
        self.before = np.zeros(self.n_blocks * _WORDS, np.int64)
        self.there = np.zeros(self.n_blocks, bool)

    def need(self, blocks: np.ndarray) -> None:
        for b in np.flatnonzero(~self.there & (np.bincount(blocks, minlength=self.n_blocks) > 0)).tolist():
            raw = pa.decompress(self.data[self.begin[b] : self.begin[b + 1]].tobytes(), BLOCK // 8, codec=_CODEC, asbytes=True)
            at = slice(b * _WORDS, (b + 1) * _WORDS)
            self.words[at] = np.frombuffer(raw, "<u8")
            n = np.bitwise_count(self.words[at]).astype(np.int64)
            self.before[at] = self.ones[b] + np.cumsum(n) - n
            self.there[b] = True

    def bits_and_ranks(self, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bits at the positions, and how many ones stand before each."""
        self.need(positions >> 15)
        at, shift = positions >> 6, (positions & 63).astype(np.uint64)
        word = self.words[at]
        below = np.bitwise_count(word & ((np.uint64(1) << shift) - np.uint64(1)))
        return (word >> shift) & np.uint64(1) > 0, self.before[at] + below

    def all_bits(self) -> np.ndarray:
        self.need(np.arange(self.n_blocks))
        return np.unpackbits(self.words.view(np.uint8), count=self.n, bitorder="little").astype(bool)

    def select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Where the k-th (from 0) one, or zero, stands."""
        held = self.ones if bit else np.minimum(np.arange(self.n_blocks + 1) * BLOCK, self.n) - self.ones
        block = np.searchsorted(held, k, "right") - 1
        self.need(block)
        out = np.empty(len(k), np.int64)
        for b in np.unique(block).tolist():
            mine = block == b
            bits = np.unpackbits(self.words[b * _WORDS : (b + 1) * _WORDS].view(np.uint8), bitorder="little")
            out[mine] = b * BLOCK + np.flatnonzero(bits == bit)[k[mine] - held[b]]
        return out


class WaveletMatrix:
    """One shard's file."""

    def __init__(self, uri: str):
        self.data = map_array(uri, np.uint8)
        assert self.data[-8:].tobytes() == MAGIC, f"{uri} is no wavelet matrix"
        at, size = self.data[-24:-8].view("<u8").tolist()
        head = json.loads(self.data[at : at + size].tobytes())
        self.n = head["n"]
        self.vocabulary = got(self.data, head["vocabulary"])
        self.planes = [Plane(self.data, said, self.n) for said in head["planes"]]
        self.documents = {k: got(self.data, place) for k, place in head["documents"].items()}

    def access(self, positions: np.ndarray) -> np.ndarray:
        at, number = np.asarray(positions, np.int64), np.zeros(len(positions), np.int64)
        for plane in self.planes:
            one, rank = plane.bits_and_ranks(at)
            number = 2 * number + one
            at = np.where(one, plane.zeros + rank, at - rank)
        return self.vocabulary[number]

    def tokens(self) -> np.ndarray:
        """All ids in order, from the last plane to the first: a plane tells how zeros and ones of the next were parted."""
        value = np.zeros(self.n, np.uint32)
        for level, plane in enumerate(reversed(self.planes)):
            one, out = plane.all_bits(), np.empty_like(value)
            out[~one] = value[: plane.zeros]
            out[one] = value[plane.zeros :] | np.uint32(1 << level)
            value = out
        return self.vocabulary[value]

    def number(self, token: int) -> int | None:
        found = np.flatnonzero(self.vocabulary == token)
        return int(found[0]) if len(found) else None

    def down(self, number: int, positions: np.ndarray) -> np.ndarray:
        """Where positions of the text lie after the last plane, counting only ids of this number."""
        at = np.asarray(positions, np.int64)
        for k, plane in enumerate(self.planes):
            rank = plane.bits_and_ranks(at)[1]
            at = plane.zeros + rank if number >> (len(self.planes) - 1 - k) & 1 else at - rank
        return at

    def rank(self, token: int, position: int) -> int:
        """How often ``token`` occurs before ``position``."""
        return self.count(token, 0, position)

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        number = self.number(token)
        if number is None:
            return 0
        low, high = self.down(number, np.array([start, self.n if end is None else end]))
        return int(high - low)

    def select(self, token: int, k: np.ndarray) -> np.ndarray:
        """Positions of the k-th occurrences, from 0; each k must be below ``count(token)``."""
        number = self.number(token)
        at = self.down(number, np.zeros(1, np.int64))[0] + np.asarray(k, np.int64)
        for level in range(len(self.planes) - 1, -1, -1):
            plane = self.planes[level]
            one = number >> (len(self.planes) - 1 - level) & 1
            at = plane.select(at - plane.zeros if one else at, one)
        return at

    def occurrences(self, token: int, start: int = 0, end: int | None = None) -> np.ndarray:
        first = self.rank(token, start)
        n = self.count(token, start, end)
        return self.select(token, first + np.arange(n)) if n else np.empty(0, np.int64)


SHARDS_SCHEMA = "partition int, shard int, uri string, first long, n_tokens long, n_begun long, goes_on boolean"
TOKENS_SCHEMA = "doc_id long, h long, n long, width int, ids binary"


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Ids of every row (16 or 32 bits each, by ``width``), each with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = token_ids(tokenizer)
        kind = np.dtype("<u2") if max(cache.size, end_id + 1) <= 1 << 16 else np.dtype("<u4")
        for batch in byte_words.pieces(batches, 500):
            flat, lengths, _ = cache.encode(batch.column("text"), end_id)
            ends, small = np.cumsum(lengths), flat.astype(kind)
            ids = [small[e - n : e].tobytes() for n, e in zip(lengths, ends)]
            width = np.full(len(lengths), kind.itemsize, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(lengths), pa.array(width), pa.array(ids, pa.binary())], ["doc_id", "h", "n", "width", "ids"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, TOKENS_SCHEMA)


class TokenStore:
    """The shards (``partition``, ``shard``, ``uri``, ``first`` token in its partition, ...) and each partition's first token."""

    def __init__(self, shards: DataFrame):
        self.shards = shards
        # one number per partition of the sort
        totals = {r["partition"]: r.n for r in shards.groupBy("partition").agg(F.sum("n_tokens").alias("n")).collect()}
        self.offsets, at = {}, 0
        for partition in sorted(totals):
            self.offsets[partition], at = at, at + totals[partition]
        self.n_tokens = at

    def _read(self, function, schema: str) -> DataFrame:
        """``function(matrix, shard's row, first token of all)`` gives a record batch for each shard."""
        shared = self.shards.sparkSession.sparkContext.broadcast(self.offsets)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    yield from function(WaveletMatrix(row["uri"]), row, shared.value[row["partition"]] + row["first"])

        # the shards are few small rows that stand for much work; their hash deals them to all tasks
        tasks = int(self.shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return self.shards.repartition(tasks, F.xxhash64("partition", "shard")).mapInArrow(run, schema)

    def documents(self) -> DataFrame:
        """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document, from its ids in the files.

        A shard's task reads the documents that begin in the shard, and follows one that goes on through the next shards.
        """
        of = Window.partitionBy("partition").orderBy("shard")
        runs = self.shards.withColumn("run", F.sum(F.expr("CAST(n_begun > 0 AS int)")).over(of)).withColumn("holds_rest", F.lag("goes_on").over(of))
        # the run of shards that the document before a shard's first one comes from
        follows = runs.where("holds_rest").withColumn("run", F.expr("run - CAST(n_begun > 0 AS int)"))
        following = follows.groupBy("partition", "run").agg(F.sort_array(F.collect_list(F.struct("shard", "uri"))).alias("more"))
        begun = runs.where("n_begun > 0").join(following, ["partition", "run"], "left").select(*self.shards.columns, F.col("more.uri").alias("more"))

        def read(matrix: WaveletMatrix, row: dict, first: int) -> Iterator[pa.RecordBatch]:
            table = matrix.documents
            begins, lengths = table["begin"], table["length"]
            crcs = np.zeros(len(begins), np.int64)
            ids = matrix.tokens().astype("<u4")
            for k, (at, n) in enumerate(zip(begins.tolist(), lengths.tolist())):
                crcs[k] = zlib.crc32(ids[at : at + n].data)
            left = int(begins[-1] + lengths[-1]) - matrix.n
            for uri in row["more"] or []:
                ids = WaveletMatrix(uri).tokens()[:left].astype("<u4")
                crcs[-1] = zlib.crc32(ids.data, int(crcs[-1]))
                left -= len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(table["doc_id"], mask=table["no_id"]), pa.array(first + begins), pa.array(lengths), pa.array(crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])

        store = TokenStore.__new__(TokenStore)
        store.shards, store.offsets = begun, self.offsets
        return store._read(read, "doc_id long, start long, n_tokens long, ids_crc32 long")

    def counts(self, tokens: list[int]) -> DataFrame:
        """``token`` and ``n``, how often it occurs in all documents."""

        def read(matrix: WaveletMatrix, row: dict, first: int) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([matrix.count(t) for t in tokens], pa.int64())], ["token", "n"])

        return self._read(read, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))

    def occurrences(self, tokens: list[int]) -> DataFrame:
        """``token`` and ``position`` (over all documents) of every occurrence."""

        def read(matrix: WaveletMatrix, row: dict, first: int) -> Iterator[pa.RecordBatch]:
            for t in tokens:
                where = matrix.occurrences(t)
                for at in range(0, len(where), READ):
                    part = where[at : at + READ]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), t, np.int64)), pa.array(first + part)], ["token", "position"])

        return self._read(read, "token long, position long")


def write(docs: DataFrame, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> TokenStore:
    """The documents' ids in ascending order of ``doc_id``, in one file per shard."""
    spark = docs.sparkSession
    rows = written(encoded(docs, tokenizer, end_id), "ids")
    ordered = rows.repartitionByRange("doc_id", "h", "n").sortWithinPartitions("doc_id", "h", "n")
    folder = shared_folder(spark, "wavelet")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, names = TaskContext.get().partitionId(), ["partition", "shard", "uri", "first", "n_tokens", "n_begun", "goes_on"]
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        # no text is looked up any more, and the executor's memory is shared with the sort
        forget_tokens()
        parts, begun, held, shard, first = [], [], 0, 0, 0

        def closed(goes_on: bool) -> pa.RecordBatch:
            uri = f"{folder}/{partition}-{shard}-{uuid.uuid4().hex[:12]}"
            ids, begins, lengths = (list(c) for c in zip(*begun)) if begun else ([], [], [])
            table = {"doc_id": np.array([i or 0 for i in ids], np.int64), "no_id": np.array([i is None for i in ids], bool), "begin": np.array(begins, np.int64), "length": np.array(lengths, np.int64)}
            write_matrix(uri, np.concatenate(parts), table)
            row = (partition, shard, uri, first, held, len(begun), goes_on)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        for batch in batches:
            for doc_id, width, blob in zip(batch.column("doc_id").to_pylist(), batch.column("width").to_pylist(), batch.column("ids")):
                ids, at = np.frombuffer(blob.as_buffer(), f"<u{width}"), 0
                while at < len(ids):
                    if not at:
                        begun.append((doc_id, held, len(ids)))
                    n = min(shard_tokens - held, len(ids) - at)
                    parts.append(ids[at : at + n].copy())
                    at, held = at + n, held + n
                    if held == shard_tokens:
                        yield closed(at < len(ids))
                        parts, begun, first, held, shard = [], [], first + held, 0, shard + 1
        if held:
            yield closed(False)

    return TokenStore(written(ordered.select("doc_id", "width", "ids").mapInArrow(run, SHARDS_SCHEMA), "shards"))
