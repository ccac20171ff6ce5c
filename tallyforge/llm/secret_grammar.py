"""Secret scan by grammar inference.

Three fixed patterns label credentials.  From a bounded sample of the labelled values a probabilistic automaton is
inferred per kind: the values, as strings of character classes, make a prefix tree with counts, and states whose
futures don't differ more than chance allows are merged (state merging with the Hoeffding bound).  Every token
of 12 characters or more that is not part of one labelled span is then scored by its length-normalised log likelihood
under each automaton, against the likelihood under an automaton of ordinary tokens, and joins the spans where a kind
explains it as well as its own examples and better than ordinary text does.  A token that a labelled span is only a part
of is scored whole, so spans may overlap.

Values are learned by their first ``DEPTH`` characters (``depth``; None learns them whole), from ``LEAST_EXAMPLES`` values
of a kind on; candidates are scored whole.

Null text: empty.  Rows repeated: each by itself.  Very long texts are scanned whole.  Ties between kinds: the last in
alphabetical order; spans at one place: in the order of KINDS.  An empty table gives an empty result; further columns of
the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from heapq import nsmallest
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import map_batches, texts, written

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: The alphabet and least length of labelled values; a full stop at either end is the sentence's.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{10,}[A-Za-z0-9+/_=-]")
KINDS = ("assign", "access", "hex")
SAMPLE = 4096
#: Steps of an octave in the histogram of hashes that says how far the sample goes.
STEPS = 32
#: Character classes of a value that are learned; what is longer is learned without its end.
DEPTH = 256
#: Labelled values from which a grammar is inferred; with fewer, a kind has its fixed pattern alone.
LEAST_EXAMPLES = 5
CLASSES = 6


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place, end, value) of the fixed patterns, by start and kind."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(spans)


_CLASS = np.full(128, 5, np.uint8)
_CLASS[[*range(48, 58)]] = 0  # digits
_CLASS[[*range(97, 103)]] = 1  # a-f
_CLASS[[*range(103, 123)]] = 2  # g-z
_CLASS[[*range(65, 71)]] = 3  # A-F
_CLASS[[*range(71, 91)]] = 4  # G-Z


def classes(value: str) -> bytes:
    """Character classes of an ASCII value: digits, a-f, g-z, A-F, G-Z, others."""
    return _CLASS[np.frombuffer(value.encode("ascii"), np.uint8)].tobytes()


def differ(n1: int, f1: int, n2: int, f2: int, alpha: float) -> bool:
    """Whether two frequencies differ by more than the Hoeffding bound."""
    return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))


class Automaton:
    """A probabilistic automaton over character classes.

    ``count`` are visits of a state, ``stop`` the values that end there, ``next`` its transitions with their counts.
    """

    def __init__(self, examples: list[bytes], alpha: float = 0.05, depth: int | None = DEPTH):
        self.depth = depth
        self.count, self.stop, self.next = [0], [0], [{}]
        for value in examples:
            self._add(value)
        self.root = list(range(len(self.count)))
        self._merge(alpha)
        self._normalise()

    def _add(self, value: bytes) -> None:
        state = 0
        self.count[0] += 1
        for c in value[: self.depth]:
            step = self.next[state].get(c)
            if step is None:
                step = len(self.count)
                self.count.append(0)
                self.stop.append(0)
                self.next.append({})
                self.next[state][c] = step
            state = step
            self.count[state] += 1
        if self.depth is None or len(value) <= self.depth:
            self.stop[state] += 1
        else:
            self.count[state] -= 1  # how it goes on is not known

    def _find(self, state: int) -> int:
        while self.root[state] != state:
            self.root[state] = self.root[self.root[state]]
            state = self.root[state]
        return state

    def _flow(self, state: int, c: int) -> int:
        step = self.next[state].get(c)
        return 0 if step is None else self.flow[(state, c)]

    def _alike(self, a: int, b: int, alpha: float) -> bool:
        """Whether two states, and the states after them, are compatible."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.count[a], self.count[b]
            if not n or not m:
                continue
            if differ(n, self.stop[a], m, self.stop[b], alpha):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                if differ(n, self._flow(a, c), m, self._flow(b, c), alpha):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    x, y = self._find(self.next[a][c]), self._find(self.next[b][c])
                    if x != y:
                        todo.append((x, y))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Merges state ``b``, the root of a tree, into ``a``, and what is after them where both go on."""
        todo = [(a, b)]
        while todo:
            a, b = self._find(todo[-1][0]), self._find(todo.pop()[1])
            if a == b:
                continue
            self.root[b] = a
            self.count[a] += self.count[b]
            self.stop[a] += self.stop[b]
            for c, step in self.next[b].items():
                self.flow[(a, c)] = self.flow.get((a, c), 0) + self.flow[(b, c)]
                if c in self.next[a]:
                    todo.append((self.next[a][c], step))
                else:
                    self.next[a][c] = step

    def _merge(self, alpha: float) -> None:
        """Red states are final; each blue one, the next to a red, merges with the first alike red or turns red."""
        self.flow = {(s, c): self.count[t] for s, steps in enumerate(self.next) for c, t in steps.items()}
        red, seen = [0], {0}
        while True:
            blue = next((self._find(t) for r in red for _, t in sorted(self.next[r].items()) if self._find(t) not in seen), None)
            if blue is None:
                break
            match = next((r for r in red if self._alike(r, blue, alpha)), None)
            if match is None:
                red.append(blue)
                seen.add(blue)
            else:
                self._fold(match, blue)
                red = [r for r in red if self._find(r) == r]

    def _normalise(self) -> None:
        """Log probabilities with half a count for what was never seen."""
        states = sorted({self._find(s) for s in range(len(self.count))})
        number = {s: k for k, s in enumerate(states)}
        n = len(states)
        self.step = np.zeros((n + 1, CLASSES), np.int32) + n  # state n: left the grammar
        self.log = np.full((n + 1, CLASSES), math.log(1 / (8 * CLASSES)))
        self.end = np.full(n + 1, math.log(1 / 8))
        for s in states:
            total = self.count[s] + 0.5 * (CLASSES + 1)
            self.end[number[s]] = math.log((self.stop[s] + 0.5) / total)
            self.log[number[s]] = math.log(0.5 / total)
            for c, t in self.next[s].items():
                self.step[number[s], c] = number[self._find(t)]
                self.log[number[s], c] = math.log((self.flow[(s, c)] + 0.5) / total)
        self.step, self.log, self.end = self.step.tolist(), self.log.tolist(), self.end.tolist()
        del self.count, self.stop, self.next, self.root, self.flow

    def score(self, value: bytes) -> float:
        """Log likelihood per character."""
        state, total = 0, 0.0
        for c in value:
            total += self.log[state][c]
            state = self.step[state][c]
        return (total + self.end[state]) / (len(value) + 1)


class Grammar:
    """Automata of the kinds and of ordinary tokens, with each kind's threshold."""

    def __init__(self, labelled: dict[str, list[str]], ordinary: list[str], keep: float = 0.95, margin: float = 0.3, depth: int | None = DEPTH):
        self.margin = margin
        self.other = Automaton([classes(v) for v in ordinary], depth=depth)
        self.kinds = {}
        for kind, values in labelled.items():
            examples = sorted(map(classes, values))
            if len(examples) < LEAST_EXAMPLES:
                continue
            automaton = Automaton(examples, depth=depth)
            scores = sorted(map(automaton.score, examples))
            self.kinds[kind] = (automaton, scores[int((1 - keep) * len(scores))])

    def best(self, value: str) -> tuple[str, float] | None:
        """The kind that a token belongs to, with its lead over ordinary tokens."""
        # a number is no credential of any format
        if value.strip("=").isdigit():
            return None
        string = classes(value)
        other = self.other.score(string)
        found = [(a.score(string) - other, kind) for kind, (a, least) in self.kinds.items() if a.score(string) >= least]
        return (max(found)[1], max(found)[0]) if found and max(found)[0] >= self.margin else None


def overlaps(spans: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """A test whether a place overlaps any of the spans, by two looks into sorted lists."""
    spans = sorted(spans)
    starts, upto = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))

    def test(start: int, end: int) -> bool:
        before = bisect_left(starts, end)  # those that begin before the place ends
        return before > 0 and upto[before - 1] > start

    return test


def contains(spans: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """A test whether one of the spans holds a whole place."""
    spans = sorted(spans)
    starts, upto = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))

    def test(start: int, end: int) -> bool:
        before = bisect_right(starts, start)  # those that begin at the place or before it
        return before > 0 and upto[before - 1] >= end

    return test


def examples(docs: DataFrame, sample: int = SAMPLE, depth: int | None = DEPTH) -> dict[str, list[str]]:
    """The ``sample`` distinct labelled values of the lowest hash per kind (all, if fewer), and as many ordinary tokens.

    A task keeps the lowest of its own only.  A histogram of what the tasks kept, by the logarithm of the hash and so of
    63 * ``STEPS`` steps at most, says up to which step values are wanted; about ``sample`` / ``STEPS`` more than the
    sample come to the driver.  Values are told apart by 63 bits of hash of the whole value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lowest: dict[str, dict[int, str]] = defaultdict(dict)

        def add(kind: str, value: str) -> None:
            kept = lowest[kind]
            kept[xxhash.xxh64_intdigest(value) >> 1] = value if depth is None else value[: depth + 1]
            if len(kept) > 2 * sample:
                lowest[kind] = {h: kept[h] for h in nsmallest(sample, kept)}

        for batch in batches:
            for text in texts(batch):
                spans = base_spans(text)
                for _, k, _, value in spans:
                    add(KINDS[k], value)
                touches = overlaps([(s, e) for s, _, e, _ in spans])
                for m in TOKEN.finditer(text):
                    if not touches(m.start(), m.end()):
                        add("other", m[0])
        rows = [(kind, h, kept[h]) for kind, kept in lowest.items() for h in nsmallest(sample, kept)]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()))], ["kind", "h", "value"])

    rows = docs.select("text").mapInArrow(run, "kind string, h long, value string").groupBy("kind", "h").agg(F.min("value").alias("value"))
    rows = written(rows.withColumn("step", F.floor(STEPS * F.log2(F.col("h") + 1.0)).cast("int")), "secret-examples")
    steps: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for r in rows.groupBy("kind", "step").agg(F.count(F.lit(1)).alias("n")).collect():
        steps[r.kind].append((r.step, r.n))
    out: dict[str, list[str]] = {}
    for kind, found in sorted(steps.items()):
        found.sort()
        upto = list(accumulate(n for _, n in found))
        last = found[min(bisect_left(upto, sample), len(found) - 1)][0]
        wanted = rows.where((F.col("kind") == kind) & (F.col("step") <= last)).select("h", "value").collect()
        out[kind] = sorted(r.value for r in nsmallest(sample, wanted))
    return out


def learn(docs: DataFrame, sample: int = SAMPLE, depth: int | None = DEPTH) -> Grammar:
    values = examples(docs, sample, depth)
    return Grammar({k: values.get(k, []) for k in KINDS}, values.get("other", []), depth=depth)


def found_spans(text: str, grammar: Grammar) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind's place, end) of the fixed patterns, and of all spans."""
    base = [(s, k, e) for s, k, e, _ in base_spans(text)]
    more = []
    known = contains([(s, e) for s, _, e in base])
    for m in TOKEN.finditer(text):
        if not known(m.start(), m.end()) and (hit := grammar.best(m[0])):
            more.append((m.start(), KINDS.index(hit[0]), m.end()))
    return base, sorted(base + more)


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secret_scan(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """All spans of each row of ``docs`` (``doc_id``, ``text``): counts of the fixed patterns, and the spans as text."""
    grammar = docs.sparkSession.sparkContext.broadcast(learn(docs, sample))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, base_said, all_said = [], [], []
        for text in texts(batch):
            base, every = found_spans(text, grammar.value)
            n.append([sum(k == i for _, k, _ in base) for i in range(3)])
            base_said.append(digest(base))
            all_said.append(digest(every))
        counts = np.array(n, np.int64).reshape(-1, 3)
        sha = [hashlib.sha256(s.encode()).hexdigest() for s in base_said]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(counts[:, i]) for i in range(3)), pa.array(base_said), pa.array(sha), pa.array(all_said)],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "base_sha256", "spans"],
        )

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, base_sha256 string, spans string")


def redacted(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with every found value replaced by ``<kind>``; an assignment keeps its name.  Null text stays null."""
    grammar = docs.sparkSession.sparkContext.broadcast(learn(docs, sample))
    names = docs.columns
    at = names.index("text")

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        _, spans = found_spans(text, grammar.value)
        out, done = [], 0
        for start, kind, end in spans:
            if end <= done:
                continue
            m = ASSIGN.match(text, start) if kind == 0 else None
            start = max(m.start(2) if m else start, done)
            out += [text[done:start], f"<{KINDS[kind]}>"]
            done = end
        return "".join(out) + text[done:]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(batch.columns)
        columns[at] = pa.array([clean(t) for t in batch.column(at).to_pylist()], pa.string())
        if "n_chars" in names:
            k = names.index("n_chars")
            columns[k] = pa.array([None if t is None else len(t) for t in columns[at].to_pylist()], columns[k].type)
        return pa.RecordBatch.from_arrays(columns, names)

    return map_batches(docs, run, docs.schema)
