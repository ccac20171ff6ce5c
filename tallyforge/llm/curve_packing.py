"""Packing along a space-filling curve.

A document's token ids, hashed to random directions and added up, give it a place in a few dimensions; the place's number
on a Hilbert curve orders the documents, so that neighbours in a sequence are alike.  The table is sorted by range of
that number, and each range is cut into sequences one after the other.  A range's last sequence is cut into powers of
two, which need no padding.

Null text: the end id alone.  Documents at one place are dealt by their id's hash, so copies can fill several ranges.
Repeated rows are packed each by itself, side by side.  A very long text is cut over as many sequences as it takes.  An
empty table gives an empty result; further columns of the input are ignored.  Pieces of text are told apart by hashes
modulo a prime of 61 bits: two different ones of n bytes are taken as equal with odds of n in 2 * 10**18.
"""

from __future__ import annotations

import json
import math
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import byte_words
from tallyforge.llm.common import give_back, written

LENGTH = 4096
#: Pieces of letters that are encoded together.
TOGETHER = 256
DIMENSIONS = 4
BITS = 15
END_ID = 2
#: Fixed value: how the tokenizers that can be used piece by piece part a text.
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Marks before and after which such a tokenizer always cuts, where a letter or digit stands on the other side.
CUT_MARKS = b".,;:!?#*$%&|"


def byte_classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(range(65, 91)) + list(range(97, 123))] = 1
    out[48:58] = 2
    out[list(CUT_MARKS)] = 3
    return out


_CLASS = byte_classes()


def piece_bounds(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-but-one byte of the pieces of texts: words, parted where letters, digits and CUT_MARKS meet."""
    start, end = byte_words.word_bounds(flat, at)
    kind = _CLASS[flat]
    cut = np.flatnonzero((kind[1:] > 0) & (kind[:-1] > 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))) + 1
    # a cut at a text's first byte is one already
    cut = cut[~is_start(cut, start)]
    return np.sort(np.r_[start, cut]), np.sort(np.r_[end, cut])


def is_start(places: np.ndarray, starts: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(len(places), bool)
    return starts[np.minimum(np.searchsorted(starts, places), len(starts) - 1)] == places


class TokenIds:
    """Token ids of texts, and the sums of their directions, piece by piece.

    A tokenizer of the kind ``by_piece`` recognises drops white space, lower-cases and cuts texts where letters, single
    digits and marks meet, so a text's ids are those of its pieces in order, and pieces may be lower-cased (A-Z) before
    they are looked up.  Pieces met before are found by their hashes; ``ids`` of piece k lie at ``begin[k]:begin[k + 1]``
    of one flat array, ``toward[k]`` is the sum of their directions.  A text that holds the opening of a special token,
    and every text of another kind of tokenizer, is encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_piece = by_piece(path)
        self.table = directions(self.tokenizer.get_vocab_size())
        self.size = len(self.table)
        words = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(self.size, bool)
        self.ends_word[[k for word, k in words.items() if word.endswith("</w>")]] = True
        self.slots = byte_words.Slots(22)
        self.clear()

    def clear(self) -> None:
        self.slots.clear()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 16, np.int64)
        self.toward = np.zeros((1 << 16, DIMENSIONS), np.float32)

    def learn(self, new: list[str]) -> None:
        """Ids of the next pieces."""
        flat, more = self.ids_of(new)
        n = self.slots.n
        ends = self.begin[n] + np.cumsum(more)
        while ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(new) + 1 > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.toward = np.concatenate([self.toward, np.zeros_like(self.toward)])
        self.flat[self.begin[n] : ends[-1]] = flat
        self.begin[n + 1 : n + len(new) + 1] = ends
        sums = np.r_[np.zeros((1, DIMENSIONS)), np.cumsum(self.table[flat], axis=0, dtype=np.float64)]
        self.toward[n : n + len(new)] = sums[np.cumsum(more)] - sums[np.cumsum(more) - more]

    def ids_of(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of pieces, and how many each has.

        Pieces of letters are encoded many at a time with spaces between: each ends at an id that ends a word.  Where
        there are more or fewer such ids than pieces, and for other pieces, each is encoded by itself.
        """
        plain = [k for k, piece in enumerate(new) if piece.isalpha()]
        parts = [plain[a : a + TOGETHER] for a in range(0, len(plain), TOGETHER)]
        flat, more, order, alone = [], [], [], sorted(set(range(len(new))).difference(plain))
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([" ".join([new[k] for k in part]) for part in parts], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            last = np.flatnonzero(self.ends_word[ids])
            if len(last) == len(part) and last[-1] == len(ids) - 1:
                flat.append(ids)
                more.append(np.diff(np.r_[-1, last]))
                order += part
            else:
                alone += part
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([new[k] for k in alone], add_special_tokens=False)]
        flat.append(np.fromiter(chain.from_iterable(ids), np.uint32))
        more = np.concatenate([*more, np.array([len(x) for x in ids], np.int64)])
        # back to the order of ``new``
        flat, place = np.concatenate(flat), np.argsort(np.array(order + alone), kind="stable")
        begin, n = (np.cumsum(more) - more)[place], more[place]
        return flat[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())], n

    def numbers(self, flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The numbers of the pieces, new ones learned."""
        if self.slots.full:
            self.clear()
        keys = byte_words.span_hashes(flat, start, end)
        found = self.slots.find(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            distinct, first = np.unique(keys[new], return_index=True)
            at = new[first]
            self.learn([flat[a:b].tobytes().lower().decode("utf-8", "replace") for a, b in zip(start[at].tolist(), end[at].tolist())])
            self.slots.add(distinct)
            found[new] = self.slots.find(keys[new])
        return found

    def encode(self, column: pa.Array, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids of the texts, each with the end id, how many each has, and the sum of each text's directions."""
        flat, at = byte_words.text_bytes(column)
        n_texts = len(at) - 1
        whole = np.arange(n_texts)
        if self.by_piece:
            opening = np.flatnonzero((flat[:-1] == ord("<")) & (flat[1:] == ord("|")))
            whole = np.unique(np.searchsorted(at, opening, "right") - 1)
        own = {}
        if len(whole):
            flat = flat.copy()
            for k in whole.tolist():
                own[k] = np.array(self.tokenizer.encode(flat[at[k] : at[k + 1]].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
                flat[at[k] : at[k + 1]] = ord(" ")
        start, end = piece_bounds(flat, at)
        number = self.numbers(flat, start, end)
        edges = np.searchsorted(start, at)
        n = self.begin[number + 1] - self.begin[number]
        before = np.r_[0, np.cumsum(n)]
        lengths = before[edges[1:]] - before[edges[:-1]] + 1
        for k, ids in own.items():
            lengths[k] += len(ids)
        out = np.full(int(lengths.sum()), end_id, np.uint32)
        ends = np.cumsum(lengths)
        inside = np.ones(len(out), bool)
        inside[ends - 1] = False
        for k, ids in own.items():
            out[ends[k] - 1 - len(ids) : ends[k] - 1] = ids
            inside[ends[k] - lengths[k] : ends[k]] = False
        out[inside] = self.flat[np.repeat(self.begin[number] - before[:-1], n) + np.arange(before[-1])]
        sums = np.zeros((n_texts, DIMENSIONS), np.float32)
        some = np.flatnonzero(edges[1:] > edges[:-1])
        if len(some):
            sums[some] = np.add.reduceat(self.toward[number], edges[some], axis=0)
        for k, ids in own.items():
            sums[k] = self.table[ids].sum(0)
        return out, lengths, sums


def by_piece(path: str) -> bool:
    """Whether the tokenizer file is of the kind whose texts may be encoded in pieces."""
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    normal = said.get("normalizer") or {}
    lowers = any(n.get("type") == "Lowercase" for n in normal.get("normalizers", [normal]))
    before = said.get("pre_tokenizer") or {}
    splits = [p for p in before.get("pretokenizers", [before]) if p.get("type") == "Split"]
    cuts = any(p["pattern"].get("Regex") == CUT_PATTERN and p["behavior"] == "Removed" and p["invert"] for p in splits)
    special = all(t["content"].startswith("<|") for t in said.get("added_tokens", []))
    return lowers and cuts and special and not (said["model"].get("continuing_subword_prefix") or "")


def directions(size: int, dimensions: int = DIMENSIONS, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, dimensions)).astype(np.float32)


def places(sums: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Each text's place: the direction of its vector, spread over the cube by the logistic curve."""
    long = np.sqrt((sums**2).mean(1, keepdims=True))
    z = sums / np.where(long > 0, long, 1)
    return np.minimum((2**bits / (1 + np.exp(-1.702 * z))).astype(np.int64), 2**bits - 1)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Numbers of points (rows of ``bits``-bit coordinates) on the Hilbert curve, by turning axes bit by bit."""
    x = points.T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> bit) & 1)
    return out


_TOKENS: dict[str, TokenIds] = {}


def token_ids(tokenizer: str) -> TokenIds:
    """The worker's token ids of this tokenizer, kept from task to task."""
    if tokenizer not in _TOKENS:
        give_back()
        _TOKENS[tokenizer] = TokenIds(tokenizer)
    return _TOKENS[tokenizer]


def forget_tokens() -> None:
    _TOKENS.clear()
    give_back()


def tokenised(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id``, ``place``, ``n`` and ``ids`` (16 or 32 bits each, by ``width``) of every row."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = token_ids(tokenizer)
        kind = np.dtype("<u2") if cache.size <= 1 << 16 else np.dtype("<u4")
        for batch in byte_words.pieces(batches, 500):
            flat, lengths, sums = cache.encode(batch.column("text"))
            ends = np.cumsum(lengths)
            small = flat.astype(kind)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(hilbert(places(sums))),
                    pa.array(lengths),
                    pa.array(np.full(len(lengths), kind.itemsize, np.int32)),
                    pa.array([small[e - n : e].tobytes() for n, e in zip(lengths, ends)], pa.binary()),
                ],
                ["doc_id", "place", "n", "width", "ids"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encoded(batches)
        # the worker may stay idle while others work; it keeps its token ids, but not what a batch took
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, place long, n long, width int, ids binary")


def pieces(batches: Iterator[pa.RecordBatch], length: int, first_sequence: int) -> Iterator[tuple]:
    """Pieces (doc_id, start, ids, doc's length, sequence, offset) of the documents in order."""
    sequence, held, waiting = first_sequence, 0, []
    for batch in batches:
        for doc_id, width, blob in zip(batch.column("doc_id").to_pylist(), batch.column("width").to_pylist(), batch.column("ids")):
            ids = np.frombuffer(blob.as_buffer(), f"<u{width}").astype("<u4")
            at = 0
            while at < len(ids):
                n = min(length - held, len(ids) - at)
                waiting.append((doc_id, at, ids[at : at + n], len(ids)))
                at += n
                held += n
                if held == length:
                    yield from laid(waiting, sequence)
                    sequence, held, waiting = sequence + 1, 0, []
    # the rest, largest power of two first
    while held:
        n = 1 << (held.bit_length() - 1)
        now, room = [], n
        while room:
            doc_id, at, ids, whole = waiting.pop(0)
            now.append((doc_id, at, ids[:room], whole))
            if len(ids) > room:
                waiting.insert(0, (doc_id, at + room, ids[room:], whole))
            room -= len(now[-1][2])
        yield from laid(now, sequence)
        sequence, held = sequence + 1, held - n


def laid(parts: list[tuple], sequence: int) -> Iterator[tuple]:
    offset = 0
    for doc_id, at, ids, whole in parts:
        yield doc_id, at, ids, whole, sequence, offset
        offset += len(ids)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row per piece of the documents (``doc_id``, ``text``), with its ids where asked for."""
    rows = written(tokenised(docs, tokenizer), "tokens")
    ordered = rows.withColumn("h", F.xxhash64("doc_id", "n")).repartitionByRange("place", "h").sortWithinPartitions("place", "h", "doc_id", F.crc32("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        # no text is looked up any more, and the executor's memory is shared with the sort
        forget_tokens()
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: 7 + with_ids]
        types = [pa.int64()] * 7 + [pa.list_(pa.int64())]

        def out(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        # a piece's ids are let go as soon as they are summed up, unless they are asked for
        found = []
        for doc_id, start, ids, whole, sequence, offset in pieces(batches, length, first):
            found.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), whole, sequence, offset, *([ids.astype("<i8")] * with_ids)))
            if len(found) == 4096:
                yield out(found)
                found = []
        if found:
            yield out(found)

    return ordered.select("doc_id", "width", "ids").mapInArrow(run, SCHEMA + ", ids array<long>" * with_ids)


def mean_padding(lengths: list[int], length: int = LENGTH) -> float:
    """Padding over all: sequences are padded to ``length`` except at a power of two."""
    padded = sum(n if n & (n - 1) == 0 else length for n in lengths)
    return 1 - math.fsum(lengths) / padded if padded else 0.0
