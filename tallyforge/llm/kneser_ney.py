"""Bigram language model with interpolated modified Kneser-Ney smoothing.

Counting: each task cuts its texts into 64-bit token hashes and sums the bigrams it meets; sums go to shards by the
context's hash, where they are added up, and from there the numbers of distinct contexts go on to the shards of the
words.  Each shard is one set of sorted hash arrays in the shared folder.  Scoring: the workers map the arrays and look
up the distinct bigrams of a batch of texts by binary search; nothing of the model is held in the driver but its
totals and shard names.

Tokens are words and one end per text; a start mark is a context but no token.  Null text: empty, one end token.
Rows repeated: each by itself.  Further columns of the input are ignored.  An empty table gives an empty result.  No training texts: every token has the uniform probability over the one unknown word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import byte_words
from tallyforge.llm.common import shared_folder, written
from tallyforge.llm.shared_arrays import map_array, write_array

START, END = np.uint64(1), np.uint64(2)
#: Shards are made for so many tokens each.
SHARD_TOKENS = 4_000_000
#: Files that a worker keeps mapped.
MAPS = 4000


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and how many tokens each text has."""
    words, n = byte_words.word_hashes(column)
    lengths = n + 1
    flat = np.full(int(lengths.sum()), END, np.uint64)
    inside = np.ones(len(flat), bool)
    inside[np.cumsum(lengths) - 1] = False
    flat[inside] = words
    return flat, lengths


def contexts(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    before = np.empty_like(flat)
    before[1:] = flat[:-1]
    before[np.cumsum(lengths) - lengths] = START
    return before


def pair_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One 64-bit hash of two, by multiplying and shifting."""
    x = context * np.uint64(0x9E3779B97F4A7C15) ^ (word + np.uint64(0x7F4A7C15))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def shard_of(h: np.ndarray, n: int) -> np.ndarray:
    """Shards are ranges of the hash's upper 32 bits."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def summed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, and the columns' sums for each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return (keys[first], *(np.add.reduceat(c[order], first) if len(first) else c[:0] for c in columns))


def blob(*arrays: np.ndarray) -> list[bytes]:
    return [a.tobytes() for a in arrays]


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in four bytes each, or in eight where one needs more."""
    return x.astype(np.uint64 if len(x) and int(x.max()) >> 32 else np.uint32)


def wide(data: bytes | np.ndarray, n: int) -> np.ndarray:
    """What ``narrow`` made of ``n`` numbers."""
    flat = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    return flat.view(np.uint64 if n and len(flat) == 8 * n else np.uint32)


@dataclass
class Model:
    """Where the arrays are, the totals and the discounts of both orders."""

    folder: str
    shards: int
    tokens: int
    vocabulary: int
    bigrams: int
    discounts: dict[int, tuple[float, float, float]]
    lower: tuple[int, int, int]
    filled: dict[str, frozenset[int]]
    files: dict = field(default_factory=dict, repr=False)

    def array(self, name: str, shard: int) -> np.ndarray:
        """The bytes of an array; at most MAPS stay mapped."""
        key = (name, shard)
        if key not in self.files:
            if len(self.files) >= MAPS:
                self.files.clear()
            self.files[key] = map_array(f"{self.folder}/{name}-{shard:06d}", np.uint8)
        return self.files[key]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"files": {}}

    def look_up(self, name: str, keys: np.ndarray, owner: np.ndarray, values: tuple[str, ...]) -> tuple[np.ndarray, ...]:
        """Values of sorted ``keys`` in the shards of the sorted ``owner``; 0 where a key is missing."""
        out = [np.zeros(len(keys), np.int64) for _ in values]
        edges = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True]) if len(owner) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1], edges[1:]):
            shard = int(owner[a])
            if shard in self.filled[name]:
                held = self.array(name, shard).view(np.uint64)
                at = np.minimum(np.searchsorted(held, keys[a:b]), len(held) - 1)
                hit = held[at] == keys[a:b]
                for o, column in zip(out, values):
                    o[a:b] = np.where(hit, wide(self.array(f"{name}.{column}", shard), len(held))[at], 0)
        return tuple(out)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many n-grams occur 1, 2, 3 and 4 times; where a count is 0, the plain values 0.5, 1, 1.5."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * more / less, 0.0), float(k)) for k, less, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def taken_off(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.choose(np.minimum(c, 3).astype(np.int64), (0.0, *d))


def count_bigrams(train: DataFrame, shards: int) -> DataFrame:
    """Rows (shard, context run lengths, words, counts) of each task's own sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0

        def out() -> pa.RecordBatch:
            flat = np.concatenate([w[0] for w in waiting])
            before = np.concatenate([w[1] for w in waiting])
            waiting.clear()
            pair = pair_hash(before, flat)
            order = np.argsort(pair, kind="stable")
            sorted_pair = pair[order]
            first = np.flatnonzero(np.r_[True, sorted_pair[1:] != sorted_pair[:-1]])
            n = np.diff(np.r_[first, len(pair)]).astype(np.uint32)
            v, w = before[order[first]], flat[order[first]]
            by = np.argsort(v, kind="stable")
            v, w, n = v[by], w[by], n[by]
            cut = np.searchsorted(shard_of(v, shards), np.arange(shards + 1))
            rows = [(s, *compact(v[a:b], w[a:b], n[a:b])) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["shard", "context", "run", "word", "n"])

        for batch in byte_words.pieces(batches):
            flat, lengths = tokens(batch.column("text"))
            waiting.append((flat, contexts(flat, lengths)))
            held += len(flat)
            if held >= SHARD_TOKENS:
                yield out()
                held = 0
        if waiting:
            yield out()

    return train.mapInArrow(run, "shard int, context binary, run binary, word binary, n binary")


def compact(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Sorted contexts once each with their run lengths; counts in one byte where they fit, which 255 marks as not."""
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    large = np.flatnonzero(n >= 255)
    small = np.minimum(n, 255).astype(np.uint8)
    return blob(v[first], np.diff(np.r_[first, len(v)]).astype(np.uint32), w, np.r_[small, np.frombuffer(n[large].astype(np.uint32).tobytes(), np.uint8)])


def spread(context: bytes, run: bytes, word: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = np.frombuffer(word, np.uint64)
    v = np.repeat(np.frombuffer(context, np.uint64), np.frombuffer(run, np.uint32))
    c = np.frombuffer(n, np.uint8, len(w)).astype(np.int64)
    c[c == 255] = np.frombuffer(n[len(w) :], np.uint32)
    return v, w, c


def small_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def train_model(train: DataFrame) -> Model:
    """Counts ``train`` (a column ``text``) into a model in the shared folder."""
    spark = train.sparkSession
    folder = shared_folder(spark, "kneser-ney")
    rough = train.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).collect()[0].n
    shards = max(1, -(-rough // (6 * SHARD_TOKENS)))

    def bigrams(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, w, c = (np.concatenate(x) for x in zip(*(spread(*r) for p in parts for r in zip(p.context, p["run"], p.word, p.n))))
        pair = pair_hash(v, w)
        order = np.argsort(pair, kind="stable")
        pair, v, w, c = pair[order], v[order], w[order], c[order]
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        pair, v, w, c = pair[first], v[first], w[first], np.add.reduceat(c, first)
        shard = int(key[0])
        write_array(f"{folder}/pair-{shard:06d}", pair)
        write_array(f"{folder}/pair.n-{shard:06d}", narrow(c))
        context, total, n1, n2, n3 = summed(v, c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c >= 3).astype(np.int64))
        for name, x in (("n", total), ("n1", n1), ("n2", n2), ("n3", n3)):
            write_array(f"{folder}/context.{name}-{shard:06d}", narrow(x))
        write_array(f"{folder}/context-{shard:06d}", context)
        word, kinds, total = summed(w, np.ones(len(w), np.int64), c)
        cut = np.searchsorted(shard_of(word, shards), np.arange(shards + 1))
        rows = [(s, *blob(word[a:b], narrow(kinds[a:b]), narrow(total[a:b]))) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
        out = pd.DataFrame(rows, columns=["shard", "word", "kinds", "n"])
        # the shard's own totals come with its first row
        out["bigrams"] = [[shard, *small_counts(c)]] + [None] * (len(out) - 1)
        yield out

    def unigrams(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for p in parts for r in zip(p.word, p.kinds, p.n)]
        w = np.concatenate([np.frombuffer(r[0], np.uint64) for r in rows])
        kinds, n = (np.concatenate([wide(r[k], len(r[0]) // 8) for r in rows]).astype(np.int64) for k in (1, 2))
        w, kinds, n = summed(w, kinds, n)
        shard = int(key[0])
        write_array(f"{folder}/word-{shard:06d}", w)
        write_array(f"{folder}/word.kinds-{shard:06d}", narrow(kinds))
        write_array(f"{folder}/word.n-{shard:06d}", narrow(n))
        yield pd.DataFrame({"shard": [shard], "n": [int(n.sum())], "v": [len(w)], "kinds": [int(kinds.sum())], "small": [small_counts(kinds)]})

    counted = count_bigrams(train.select("text"), shards)
    words = written(counted.groupBy("shard").applyInPandas(bigrams, "shard int, word binary, kinds binary, n binary, bigrams array<long>"), "kn-words")
    totals = words.groupBy("shard").applyInPandas(unigrams, "shard int, n long, v long, kinds long, small array<long>").toPandas()  # a row for each shard
    pairs = words.where("bigrams is not null").select("bigrams").toPandas().bigrams
    two = np.sum([np.array(x[1:]) for x in pairs], axis=0) if len(pairs) else np.zeros(4, np.int64)
    one = np.sum([np.array(x) for x in totals.small], axis=0) if len(totals) else np.zeros(4, np.int64)
    d1 = discounts(one.tolist())
    kinds = int(totals.kinds.sum()) if len(totals) else 0
    vocabulary = int(totals.v.sum()) if len(totals) else 0
    n3 = vocabulary - int(one[0]) - int(one[1])
    of_pairs = frozenset(int(x[0]) for x in pairs)
    filled = {"pair": of_pairs, "context": of_pairs, "word": frozenset(totals.shard.tolist())}
    return Model(folder, shards, int(totals.n.sum()) if len(totals) else 0, vocabulary, kinds, {1: d1, 2: discounts(two.tolist())}, (int(one[0]), int(one[1]), n3), filled)


def score_batch(model: Model, column: pa.Array) -> dict[str, np.ndarray]:
    """Per text: tokens, known tokens, the base score and the model's log10 probability."""
    flat, lengths = tokens(column)
    text = np.repeat(np.arange(len(lengths)), lengths)
    word, word_at = np.unique(flat, return_inverse=True)
    kinds, n = model.look_up("word", word, shard_of(word, model.shards), ("kinds", "n"))
    n = n.astype(np.float64)
    v_size = model.vocabulary
    base = np.log10((n + 0.1) / (model.tokens + 0.1 * (v_size + 1)))
    total = max(1, model.bigrams)
    d1, d2 = model.discounts[1], model.discounts[2]
    left = sum(d * k for d, k in zip(d1, model.lower)) / total if model.bigrams else 1.0
    p1 = np.maximum(kinds - taken_off(kinds, d1), 0) / total + left / (v_size + 1)
    before = contexts(flat, lengths)
    pair = pair_hash(before, flat)
    order = np.lexsort((pair, shard_of(before, model.shards)))
    first = np.flatnonzero(np.r_[True, pair[order][1:] != pair[order][:-1]]) if len(order) else np.empty(0, np.int64)
    one_of = order[first]
    which = np.empty(len(pair), np.int64)
    which[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)]))
    (c,) = model.look_up("pair", pair[one_of], shard_of(before[one_of], model.shards), ("n",))
    context, context_at = np.unique(before[one_of], return_inverse=True)
    cn, c1, c2, c3 = model.look_up("context", context, shard_of(context, model.shards), ("n", "n1", "n2", "n3"))
    seen = cn > 0
    safe = np.maximum(cn, 1).astype(np.float64)
    gamma = np.where(seen, (d2[0] * c1 + d2[1] * c2 + d2[2] * c3) / safe, 1.0)
    lower = p1[word_at[one_of]]
    log = np.log10(np.maximum(c - taken_off(c, d2), 0) / safe[context_at] * seen[context_at] + gamma[context_at] * lower)
    add = lambda x: np.bincount(text, x, minlength=len(lengths))
    return {"n_tokens": lengths, "n_known": add((n > 0)[word_at]).astype(np.int64), "base_score": add(base[word_at]), "score": add(log[which])}


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (``doc_id``, ``held_out``, ``text``) with the scores and perplexity of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # names and totals only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in byte_words.pieces(batches):
            out = score_batch(shared.value, piece.column("text"))
            out["perplexity"] = 10 ** np.minimum(-out["score"] / out["n_tokens"], 300)
            n = pa.array(np.full(piece.num_rows, shared.value.tokens))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("held_out"), pa.array(out["n_tokens"]), pa.array(out["n_known"]), n, *(pa.array(out[k]) for k in ("base_score", "score", "perplexity"))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def kneser_ney(docs: DataFrame, held_out: Column) -> DataFrame:
    """Scores of every row of ``docs`` (``doc_id``, ``text``) by a model of the rows where ``held_out`` is false."""
    marked = docs.select("doc_id", held_out.alias("held_out"), "text")
    return scored(marked, train_model(marked.where(~F.col("held_out")).select("text")))
