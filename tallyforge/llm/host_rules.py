"""Quality rules with host verdicts.

Each document is measured by fixed rules; the failures are added up by host, each host's failure rate is shrunk
towards a beta prior fitted to all hosts by moments, and a host whose shrunk rate is too high is rejected with all
its documents.

Null text: no words, so the document fails.  Null host: a host of its own.  Repeated rows count each by itself.
An empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import map_batches, texts, written

SYMBOLS = "#*$%&|<>"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: So many verdicts at most are sent to all executors, counted first; with more, documents are dealt by host and salt.
FEW_HOSTS, SALTS = 100_000, 32
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(ids: np.ndarray, width: int) -> int:
    """Words that lie in a window of ``width`` words found twice or more; exact, by ranking pairs of ranks."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    distinct = int(ids.max()) + 1
    if distinct**width < 2**62:
        key = ids[:n].copy()
        for k in range(1, width):
            key = key * distinct + ids[k : k + n]
    else:
        key = ids[:n]
        for k in range(1, width):
            _, rank = np.unique(key, return_inverse=True)
            key = rank.astype(np.int64) * distinct + ids[k : k + n]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: str, width: int = 5) -> tuple[int, int, int, int, int]:
    words = text.encode("utf-8", "surrogatepass").split()
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(ids, width) if len(index) < len(words) else 0,
    )


def measured(docs: DataFrame, width: int = 5) -> DataFrame:
    """One row per document: ``doc_id``, ``host`` and the measures."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([measure(t, width) for t in texts(batch)], np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("host"), *(pa.array(rows[:, k]) for k in range(len(MEASURES)))], ["doc_id", "host", *MEASURES]
        )

    return map_batches(docs, run, "doc_id long, host string, " + ", ".join(f"{m} long" for m in MEASURES))


def base_failed(min_words: int = 10, max_repeat_percent: int = 20) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def host_verdicts(marked: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """Per host (``host_key``): documents, failures, the shrunk failure rate and whether the host is rejected.

    The prior Beta(a, b) has the mean and variance of the hosts' raw rates; without variance it is as strong as
    ``a + b = 1000``.  Partial sums are made before the shuffle, so a hot host costs one row per task.
    """
    hosts = marked.groupBy("host_key").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    hosts = hosts.withColumn("rate", F.col("n_failed") / F.col("n_docs"))
    prior = hosts.agg(F.avg("rate").alias("mu"), F.coalesce(F.var_pop("rate"), F.lit(0.0)).alias("var"))
    spread = F.col("mu") * (1 - F.col("mu"))
    strength = F.when(F.col("var") > spread / 1001, F.greatest(spread / F.col("var") - 1, F.lit(0.0))).otherwise(F.lit(1000.0))
    prior = prior.select("mu", strength.alias("strength"))
    shrunk = (F.col("n_failed") + F.col("mu") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))
    return (
        hosts.crossJoin(F.broadcast(prior))  # one row
        .withColumn("shrunk_rate", shrunk)
        .select("host_key", "n_docs", "n_failed", "shrunk_rate", (F.col("shrunk_rate") > max_rate).alias("host_rejected"))
    )


def host_rules(docs: DataFrame, host: str = "source", width: int = 5, max_rate: float = 0.5) -> DataFrame:
    """Measures, verdict of the rules and of the host for every row of ``docs`` (``doc_id``, ``text``, ``host``)."""
    rows = measured(docs.select("doc_id", "text", F.col(host).cast("string").alias("host")), width)
    key = F.coalesce(F.concat(F.lit("="), "host"), F.lit("null"))
    marked = written(rows.withColumn("base_failed", base_failed()).withColumn("host_key", key), "host-rules")
    verdicts = written(host_verdicts(marked, max_rate).select("host_key", "shrunk_rate", "host_rejected"), "host-verdicts")
    if verdicts.count() <= FEW_HOSTS:
        joined = marked.join(F.broadcast(verdicts), "host_key")
    else:
        # a hot host's documents are dealt over SALTS tasks, its verdict goes to each
        salted = marked.withColumn("_salt", F.pmod(F.xxhash64("doc_id", *MEASURES), F.lit(SALTS)).cast("int"))
        joined = salted.join(verdicts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host_key", "_salt"]).drop("_salt")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")).drop("host_key")
