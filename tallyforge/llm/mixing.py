"""Mixing sources to target weights by Sainte-Laguë apportionment.

The words of a source, laid out in shards, are cut into blocks of equal size.  All blocks of the mix are allotted to
the sources, and each source's blocks to its shards, by highest quotients; a shard then selects its blocks by a
seeded permutation.  A document gets what the mix takes of the blocks it lies in.

Null text: size 0, nothing taken.  Null source: a source of its own, last in order.  Repeated rows lie side by side
in their shard and are each taken by themselves.  A very long text spans many blocks.  Ties between quotients: the
lower source or shard.  An empty table gives an empty result; further columns, also of names used here, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import SPACED_WORD, written

WEIGHTS = (3, 1, 2)
#: Primes larger than any number of blocks in a shard; one is the step of a shard's permutation.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)
BLOCK_WORDS = 64
#: A shard has about so many words or rows; a source has at most MAX_SHARDS, which are larger where it has more.
SHARD_WORDS, SHARD_ROWS = 16_384, 200
MAX_SHARDS = 65_536


def hash32(*parts: Column) -> Column:
    """The first 32 bits of an MD5 digest, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Each source's size and target.  ``sizes`` has ``source`` and ``source_size``, one row per source.

    Weights repeat along the sources in code-point order, null last.  Targets share ``share`` of all words; a
    target stops at ``cap`` times its source's size, and what it leaves is shared again by weight.  Sorted by the
    level at which a source is full, the full ones are a prefix, so running sums give the final level at once.
    The table has one row per source; that, not the documents, is what one task sorts.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    place = F.row_number().over(order) - 1
    rows = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int")))
    rows = rows.withColumn("most", cap * F.col("source_size")).withColumn("full_at", F.col("most") / F.col("weight")).withColumn("place", place)
    by_level = Window.orderBy("full_at", "place")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(Window.partitionBy())
    left = share * total - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", left / weight_left)
    rows = rows.withColumn("full", F.col("full_at") <= F.col("level"))
    level = F.min(F.when(~F.col("full"), F.struct("full_at", "place", "level"))).over(Window.partitionBy())["level"]
    target = F.when(F.col("full") | level.isNull(), F.col("most")).otherwise(F.col("weight") * level)
    return rows.select("source", F.col("place").alias("source_no"), "source_size", target.alias("target"), *(c for c in ("n_rows",) if c in sizes.columns))


def sainte_lague(rows: DataFrame, group: list[str], key: str, weight: str, seats: str, quota: str) -> DataFrame:
    """Adds ``quota``: how many of the group's ``seats`` each row gets by the highest quotients weight / (2 k - 1).

    With W the group's weights and S its rows, a divisor of W / (seats - S / 2) hands out too few or just enough
    seats, one of W / (seats + S / 2) enough or too many.  The seats below the first are certain; of the at most
    2 S + 1 quotients between the two the highest take the rest, ties in the order of ``key``.
    """
    whole = Window.partitionBy(*group)
    w, n = F.sum(weight).over(whole), F.count(F.lit(1)).over(whole)
    rows = rows.withColumn("_w", w).withColumn("_n", n)
    at = lambda x: F.when(F.col("_w") > 0, F.floor(F.col(weight) * F.greatest(x, F.lit(0.0)) / F.col("_w") + 0.5)).otherwise(F.lit(0)).cast("long")
    low = F.when(F.col(seats) > F.col("_n") / 2, at(F.col(seats) - F.col("_n") / 2)).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("_low", low).withColumn("_high", at(F.col(seats) + F.col("_n") / 2) + 1)
    rest = F.col(seats) - F.sum("_low").over(whole)
    rows = rows.withColumn("_rest", rest)
    quotients = rows.select(*group, key, "_rest", weight, F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_k")).where(F.col(weight) > 0)
    quotients = quotients.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy((F.col(weight) / (2 * F.col("_k") - 1)).desc(), key, "_k")))
    more = quotients.where(F.col("_rank") <= F.col("_rest")).groupBy(*group, key).agg(F.count(F.lit(1)).alias("_more"))
    return rows.join(more, [*group, key], "left").withColumn(quota, F.col("_low") + F.coalesce("_more", F.lit(0))).drop("_w", "_n", "_low", "_high", "_rest", "_more")


def block_plan(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """What the mix takes of each document.

    ``docs`` has ``doc_id``, ``size`` (words) and ``source``.  The result adds ``source_size``, ``target``, the
    document's ``shard`` and ``start`` there, the shard's ``shard_size``, ``n_blocks``, ``quota`` and ``step``, and
    ``taken``.
    """
    by_source = written(docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")), "mix-by-source")
    sources = source_targets(by_source, weights, share, cap).withColumn("all", F.lit(0))
    total = F.round(F.sum("target").over(Window.partitionBy("all")) / BLOCK_WORDS).cast("long")
    sources = written(sainte_lague(sources.withColumn("seats", total), ["all"], "source_no", "target", "seats", "source_quota"), "mix-sources")
    shards_of = F.least(F.lit(MAX_SHARDS), F.greatest(F.lit(1), F.ceil(F.greatest(F.col("source_size") / SHARD_WORDS, F.col("n_rows") / SHARD_ROWS)))).cast("long")
    sources = sources.select("source", "source_no", "source_size", "target", "source_quota", shards_of.alias("n_shards"))
    at = F.struct(F.col("source").alias("s"))
    joined = docs.withColumn("_s", at).join(sources.withColumn("_t", at).drop("source"), F.col("_s").eqNullSafe(F.col("_t"))).drop("_s", "_t")
    joined = joined.withColumn("_h", hash32(F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    joined = joined.withColumn("shard", F.col("_h") % F.col("n_shards"))
    line = Window.partitionBy("source_no", "shard").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = written(joined.withColumn("start", F.coalesce(F.sum("size").over(line), F.lit(0).cast("long"))).drop("_h", "n_shards"), "mix-docs")
    shards = laid.groupBy("source_no", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    quotas = sainte_lague(shards, ["source_no"], "shard", "shard_size", "source_quota", "shard_quota")
    blocks = F.greatest(F.lit(1).cast("long"), F.round(F.col("shard_size") / BLOCK_WORDS).cast("long"))
    quotas = quotas.withColumn("n_blocks", blocks)
    mixed = hash32(F.lit(str(seed)), F.lit("blocks"), F.col("source_no").cast("string"), F.col("shard").cast("string"))
    quotas = quotas.select(
        "source_no",
        "shard",
        "shard_size",
        "n_blocks",
        F.least(F.col("shard_quota"), (F.lit(cap) * F.col("n_blocks")).cast("long")).alias("quota"),
        F.element_at(F.array(*map(F.lit, PRIMES)), (mixed % len(PRIMES) + 1).cast("int")).cast("long").alias("step"),
        (mixed % F.col("n_blocks")).alias("shift"),
    )
    out = laid.drop("source_quota").join(quotas, ["source_no", "shard"])
    return out.withColumn("taken", taken_words())


def block_start(k: Column) -> Column:
    """Where block ``k`` of a shard begins: blocks differ by one word at most."""
    return F.floor(k * F.col("shard_size") / F.col("n_blocks")).cast("long")


def times(k: Column) -> Column:
    """How often block ``k`` is taken: the quota's whole rounds, and once more for the first of the permutation."""
    rounds, rest = F.floor(F.col("quota") / F.col("n_blocks")), F.col("quota") % F.col("n_blocks")
    return rounds + F.when((F.col("step") % F.col("n_blocks") * (k + F.col("shift"))) % F.col("n_blocks") < rest, 1).otherwise(0)


def block_numbers() -> Column:
    """The blocks that a document of ``size`` > 0 at ``start`` may lie in; one too many at an end does no harm."""
    first = F.floor(F.col("start") * F.col("n_blocks") / F.col("shard_size")).cast("long")
    last = F.floor((F.col("start") + F.col("size") - 1) * F.col("n_blocks") / F.col("shard_size")).cast("long") + 1
    return F.sequence(F.greatest(first - 1, F.lit(0)), F.least(last, F.col("n_blocks") - 1))


def overlap(k: Column) -> Column:
    end = F.least(block_start(k + 1), F.col("start") + F.col("size"))
    return F.greatest(end - F.greatest(block_start(k), F.col("start")), F.lit(0).cast("long"))


def taken_words() -> Column:
    zero = F.lit(0).cast("long")
    sums = F.aggregate(block_numbers(), zero, lambda a, k: a + overlap(k) * times(k))
    return F.when(F.col("size") > 0, sums).otherwise(zero)


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``size`` in words, ``source`` and ``text_hash`` of every row."""
    return docs.select("doc_id", n_words(F.col("text")).alias("size"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_hash"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``, ``source``) with what the mix takes of it."""
    return block_plan(written(sized(docs), "mix-sizes"), weights, share, cap, seed)


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """The mix itself: the columns of ``docs``, with one row for each round in which words of a document are taken.

    A row's ``text`` is made of the document's blocks taken in that round, in order; a document of which nothing is
    taken has no row.
    """
    plan = mix(docs, weights, share, cap, seed)
    spans = F.filter(F.transform(block_numbers(), lambda k: F.struct((F.greatest(block_start(k), F.col("start")) - F.col("start")).alias("a"), overlap(k).alias("n"), times(k).alias("t"))), lambda x: (x["n"] > 0) & (x["t"] > 0))
    return cut(docs, plan.where("taken > 0").select("doc_id", "source", "text_hash", spans.alias("spans")))


def cut(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Cuts the spans of ``plan`` out of the texts; rows with the same id, source and text are matched in any order."""

    def key(text_hash: Column) -> Column:
        # one text column, so that the windows and the join share one partitioning of the texts
        return F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text_hash.cast("string"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")))

    # the document's own columns lie in ``doc``, so that none of them can clash with those used here
    order = Window.partitionBy("key").orderBy(F.lit(0))
    left = docs.where(n_words(F.col("text")) > 0).select(F.struct("*").alias("doc"), key(F.xxhash64("text")).alias("key")).withColumn("n", F.row_number().over(order))
    right = plan.select(key(F.col("text_hash")).alias("key"), "spans").withColumn("m", F.row_number().over(order.partitionBy("key").orderBy("spans"))).withColumnRenamed("key", "their_key")
    joined = left.join(right, (F.col("key") == F.col("their_key")) & (F.col("n") - F.col("m") == 0))
    # a word with the white space before it; the pieces of a text joined again are the text without its trailing space
    pieces = F.regexp_extract_all(F.col("doc")["text"], F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    joined = joined.withColumn("pieces", pieces).withColumn("round", F.explode(F.array(F.lit(1), F.lit(2))))
    kept = F.filter("spans", lambda x: x["t"] >= F.col("round"))
    joined = joined.where(F.size(kept) > 0)
    text = F.array_join(F.transform(kept, lambda x: F.array_join(F.slice("pieces", (x["a"] + 1).cast("int"), x["n"].cast("int")), "")), "")
    joined = joined.withColumn("cut", text)
    new = {"text": F.col("cut")} | ({"n_chars": F.length("cut").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return joined.select(*(new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))
