"""Language identification of mixed-language text.

A word's script narrows the languages it may be in; within those it has a log likelihood from character trigrams.
Viterbi's algorithm then labels the words of a text, with a penalty for each switch of language, which gives spans;
the text's language is the one with most letters.  Words are those between white space, cut further where letters of two
scripts meet, so that a Latin name inside Japanese is a word of its own; Han and kana are written together, and a run
that holds both is one of kana.

The model is fitted on about ``fit_docs`` labelled documents at most, as many of each language, taken by a hash of the id
(``LEAST_DOCS`` of each at least).  Null text, or text
without letters: ``und`` with score 0.  Repeated rows: each by itself.  No labelled documents: everything is ``und``.
A very long text is labelled whole.  Ties between languages: the first in code-point order.  An empty table gives an
empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import map_batches, texts

FIT_DOCS = 20_000
#: Rows of a language that are learned from even where there are very many languages.
LEAST_DOCS = 50
SWITCH = 6.0
#: Runs of letters and of numerals that are no digits, such as the superscript two or one half.
RUNS = re.compile(r"[^\W\d_]+")
#: First and last code point of ranges and their script.  Letters elsewhere count as "other".
SCRIPTS = (
    (0x0041, 0x02AF, "latin"),
    (0x0370, 0x03FF, "greek"),
    (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"),
    (0x0600, 0x06FF, "arabic"),
    (0x0900, 0x097F, "devanagari"),
    (0x0980, 0x09FF, "bengali"),
    (0x0E00, 0x0E7F, "thai"),
    (0x1E00, 0x1EFF, "latin"),
    (0x3040, 0x30FF, "kana"),
    (0x4E00, 0x9FFF, "han"),
    (0xAC00, 0xD7AF, "hangul"),
)


#: Scripts that one language writes in one word.
TOGETHER = {"kana": "han"}


def _borders() -> re.Pattern:
    """Places between letters of two scripts that aren't written together; letters elsewhere part nothing."""
    ranges: dict[str, str] = {}
    for low, high, name in SCRIPTS:
        name = TOGETHER.get(name, name)
        ranges[name] = ranges.get(name, "") + f"{chr(low)}-{chr(high)}"
    other = {a: "".join(r for b, r in ranges.items() if b != a) for a in ranges}
    # marks and digits inside the ranges are no letters, so they part nothing either
    return re.compile("|".join(rf"(?<=[{r}])(?<=[^\W\d_])(?=[{other[a]}])(?=[^\W\d_])" for a, r in ranges.items()))


BORDER = _borders()
KANA = re.compile("[\u3040-\u30ff]")


def parted(word: str) -> list[str]:
    """A word cut where letters of another script begin, with what is no letter between them or not."""
    if word.isascii():
        return [word]
    cuts, before = [0], None
    for run in RUNS.finditer(word):
        at = run.start()
        for piece in BORDER.split(run[0]):
            name = TOGETHER.get(script(piece), script(piece))
            if name != "other":
                if before not in (None, name):
                    cuts.append(at)
                before = name
            at += len(piece)
    return [word[a:b] for a, b in zip(cuts, [*cuts[1:], len(word)])]


def letter_runs(text: str) -> list[str]:
    """Runs of what ``str.isalpha`` holds for, cut where two scripts meet."""
    found = RUNS.findall(text)
    if text.isascii():
        return found
    if not all(map(str.isalpha, found)):
        found = [run for part in found for run in ("".join(c if c.isalpha() else " " for c in part).split() if not part.isalpha() else [part])]
    return [run for part in found for run in ([part] if part.isascii() else BORDER.split(part))]


def script(word: str) -> str:
    """The script of a run's first letter; Han with kana is kana."""
    code = ord(word[0])
    if code <= 0x02AF:
        return "latin"
    name = next((name for low, high, name in SCRIPTS if low <= code <= high), "other")
    return "kana" if name == "han" and KANA.search(word) else name


def trigrams(word: str) -> list[str]:
    framed = f"^{word}$"
    return [framed[k : k + 3] for k in range(len(framed) - 2)]


class LanguageModel:
    """Trigram log probabilities and script shares of each language."""

    def __init__(self, counts: dict[tuple[str, str], int], scripts: dict[tuple[str, str], int]):
        self.languages = sorted({lang for lang, _ in counts})
        grams = sorted({g for _, g in counts})
        n = len(self.languages)
        table = np.zeros((len(grams), n))
        where, column = {g: k for k, g in enumerate(grams)}, {lang: k for k, lang in enumerate(self.languages)}
        for (lang, g), c in counts.items():
            table[where[g], column[lang]] = c
        totals = table.sum(0)
        # the last row is for trigrams never seen
        table = np.vstack([table, np.zeros((1, n))])
        self.table = (np.log(table + 0.05) - np.log(totals + 0.05 * len(table))).astype(np.float32)
        self.where = where
        self.may = {}
        words = Counter()
        for (lang, _), c in scripts.items():
            words[lang] += c
        for name in {s for _, s in scripts}:
            shares = np.array([scripts.get((lang, name), 0) / max(1, words[lang]) for lang in self.languages])
            if (shares >= 0.01).any():
                self.may[name] = np.where(shares >= 0.01, 0, -30).astype(np.float32)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of lower-cased words in each language, and their letters.

        A run of letters scores 0 in its best language and -8 at least in any; a word's runs are added.
        """
        grams, starts, owner, scripts = [], [], [], []
        letters = np.zeros(len(words), np.int32)
        get, unseen = self.where.get, len(self.table) - 1
        for k, word in enumerate(words):
            for part in letter_runs(word):
                starts.append(len(grams))
                owner.append(k)
                scripts.append(script(part))
                letters[k] += len(part)
                grams += [get(g, unseen) for g in trigrams(part)]
        rows = np.zeros((len(words), len(self.languages)), np.float32)
        if grams and self.languages:
            sums = np.add.reduceat(self.table[grams], starts)
            for name, narrowed in self.may.items():
                sums[[s == name for s in scripts]] += narrowed
            np.add.at(rows, owner, np.maximum(sums - sums.max(1, keepdims=True), -8.0))
        return rows, letters


class Scores(dict):
    """Rows of a growing table of word scores by lower-cased word, with the word's letters."""

    LIMIT = 500_000
    #: Numbers in the table; with many languages fewer words are kept.
    CELLS = 40_000_000

    def __init__(self, model: LanguageModel):
        self.model = model
        self.limit = min(self.LIMIT, self.CELLS // max(1, len(model.languages)))
        self.parts: dict[str, list[str]] = {}
        self.new: list[str] = []
        self.table = np.zeros((1024, len(model.languages)), np.float32)
        self.letters = np.zeros(1024, np.int32)

    def __missing__(self, word: str) -> int:
        """A word not met before gets the next row, which ``learn`` fills."""
        k = self[word] = len(self)
        self.new.append(word)
        return k

    def trim(self) -> None:
        """Begins anew where the table has grown too large."""
        if len(self) + len(self.parts) > self.limit:
            self.clear()
            self.__init__(self.model)

    def words(self, text: str) -> list[str]:
        """White-space words in lower case, cut where two scripts meet."""
        found = text.lower().split()
        if text.isascii():
            return found
        out = []
        for word in found:
            if word.isascii():
                out.append(word)
                continue
            parts = self.parts.get(word)
            if parts is None:
                parts = self.parts[word] = parted(word)
            out += parts
        return out

    def learn(self) -> None:
        while len(self) > len(self.letters):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        first = len(self) - len(self.new)
        self.table[first : len(self)], self.letters[first : len(self)] = self.model.words(self.new)
        self.new = []


def label_words(scores: np.ndarray, lengths: np.ndarray, switch: float, ids: np.ndarray | None = None) -> np.ndarray:
    """Viterbi labels of many texts at once; ``scores`` has the words of all texts one after the other.

    With ``ids``, the words of the texts are these rows of ``scores``.

    Texts are handled longest first, so that step t touches only the texts that have a word t.  With one penalty for
    every switch, a state comes from itself or from the best state of the step before.
    """
    n_states = scores.shape[1]
    ids = np.arange(len(scores)) if ids is None else ids
    order = np.argsort(-lengths, kind="stable")
    lengths, begin = lengths[order], (np.cumsum(lengths) - lengths)[order]
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(steps), "left")
    labels = np.zeros(len(ids), np.int16)
    if not steps:
        return labels
    stay = np.ones((len(ids), n_states), bool)
    came = np.zeros(len(ids), np.int16)
    best = np.zeros((active[0], n_states), np.float32)
    for t in range(steps):
        a = active[t]
        at = begin[:a] + t
        here = best[:a]
        if t:
            top = here.argmax(1)
            jump = here[np.arange(a), top] - switch
            same = here >= jump[:, None]
            stay[at], came[at] = same, top
            np.maximum(here, jump[:, None], out=here)
        here += scores[ids[at]]
    state = best.argmax(1).astype(np.int16)
    # a text's best state at its own end: rows of ``best`` stop changing when their text ends
    for t in range(steps - 1, -1, -1):
        a = active[t]
        at = begin[:a] + t
        s = state[:a]
        labels[at] = s
        if t:
            state[:a] = np.where(stay[at, s], s, came[at])
    return labels


def fit(labelled: DataFrame, fit_docs: int = FIT_DOCS) -> LanguageModel:
    """A model from the ``text`` and ``lang`` of about ``fit_docs`` rows at most, as many of each language, counted in Spark.

    What comes to the driver are the trigrams of that sample, by language.
    """
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # one row for each language; a rare language gives all its rows, a frequent one its part of ``fit_docs``
    held = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = max(LEAST_DOCS, fit_docs // max(1, len(held)))
    frequent = {lang: int(each / n * 1_000_003) for lang, n in held.items() if n > each}
    sample = labelled
    if frequent:
        limit = F.create_map(*(F.lit(x) for pair in sorted(frequent.items()) for x in pair))[F.col("lang")]
        sample = labelled.where(limit.isNull() | (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < limit))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: Counter = Counter()
        for text, lang in zip(texts(batch), batch.column("lang").to_pylist()):
            for word, n in Counter(letter_runs(text.lower())).items():
                counts[lang, "s" + script(word)] += n
                for g in trigrams(word):
                    counts[lang, "g" + g] += n
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["lang", "feature", "n"])

    rows = map_batches(sample.select("text", "lang"), run, "lang string, feature string, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    counts, scripts = {}, {}
    for r in rows.collect():
        (counts if r.feature[0] == "g" else scripts)[r.lang, r.feature[1:]] = r.n
    return LanguageModel(counts, scripts)


#: Words times languages for which paths are held at once, unless one text alone has more.
PATHS = 40_000_000


def predicted(cache: Scores, batch_texts: list[str], switch: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Each word's text, words per text, each word's label, and the texts' languages and scores.

    Texts are handled a few at a time where they are long, so memory is bounded by ``PATHS`` or by the longest text.
    """
    n = max(1, len(cache.model.languages))
    doc, lengths, labels, pred, score = [], [], [], [], []
    words: list[list[str]] = []
    held = 0

    def close() -> None:
        nonlocal words, held
        d, *more = _predicted(cache, words, switch)
        doc.append(d + len(pred))
        for column, x in zip((lengths, labels, score), (more[0], more[1], more[3])):
            column.append(x)
        pred.extend(more[2])
        words, held = [], 0

    for text in batch_texts:
        found = cache.words(text)
        if words and (held + len(found)) * n > PATHS:
            close()
        words.append(found)
        held += len(found)
    close()
    return np.concatenate(doc), np.concatenate(lengths), np.concatenate(labels), pred, np.concatenate(score)


def _predicted(cache: Scores, words: list[list[str]], switch: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    names = cache.model.languages
    cache.trim()
    lengths = np.array([len(w) for w in words], np.int64)
    ids = np.fromiter(map(cache.__getitem__, chain.from_iterable(words)), np.int64, int(lengths.sum()))
    cache.learn()
    # words without letters take the label of their neighbours, for their scores are all 0
    labels = label_words(cache.table, lengths, switch, ids) if names else np.zeros(len(ids), np.int16)
    doc = np.repeat(np.arange(len(words)), lengths)
    n = max(1, len(names))
    share = np.bincount(doc * n + labels, cache.letters[ids], minlength=len(words) * n).reshape(-1, n)
    total, top = share.sum(1), share.argmax(1)
    pred = [names[k] if t and names else "und" for k, t in zip(top, total)]
    return doc, lengths, labels, pred, np.where(total > 0, share.max(1) / np.maximum(total, 1), 0.0) * bool(names)


def labelled_spans(docs: DataFrame, model: LanguageModel, switch: float = SWITCH, with_spans: bool = True) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (share of the letters) and the spans as (language, first word, words)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch, cache: Scores) -> pa.RecordBatch:
        names = cache.model.languages
        doc, lengths, labels, pred, score = predicted(cache, texts(batch), switch)
        columns = [batch.column("doc_id"), pa.array(pred), pa.array(score)]
        if with_spans:
            change = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (labels[1:] != labels[:-1])]) if len(doc) else np.empty(0, np.int64)
            begin = np.cumsum(lengths) - lengths
            per = np.bincount(doc[change], minlength=len(lengths)) if len(change) else np.zeros(len(lengths), np.int64)
            spans = pa.StructArray.from_arrays(
                [pa.array([names[k] if names else "und" for k in labels[change]], pa.string()), pa.array(change - begin[doc[change]]), pa.array(np.diff(np.r_[change, len(doc)]))], ["lang", "first_word", "n_words"]
            )
            columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per)].astype(np.int32)), spans))
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "spans"][: len(columns)])

    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<lang string, first_word long, n_words long>>" * with_spans
    return map_batches(docs.select("doc_id", "text"), run, schema, lambda: Scores(shared.value))


def identified(docs: DataFrame, train: Column, switch: float = SWITCH, fit_docs: int = FIT_DOCS, with_spans: bool = True) -> DataFrame:
    """Spans and language of every row of ``docs``, by a model of the labelled rows where ``train`` holds."""
    return labelled_spans(docs, fit(docs.where(train).select("doc_id", "text", "lang"), fit_docs), switch, with_spans)


def accepted(docs: DataFrame, model: LanguageModel, switch: float = SWITCH, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of ``least`` or more; ``lang`` becomes that language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batch: pa.RecordBatch, cache: Scores) -> pa.RecordBatch:
        *_, pred, score = predicted(cache, texts(batch), switch)
        columns = list(batch.columns)
        columns[names.index("lang")] = pa.array(pred, pa.string())
        kept = pa.array((score >= least) & (np.array(pred, object) != "und"))
        return pa.RecordBatch.from_arrays(columns, names).filter(kept)

    return map_batches(docs, run, docs.schema, lambda: Scores(shared.value))
