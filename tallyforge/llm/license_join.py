"""License scan: an exact set-similarity join of text blocks with license templates, in DataFrame operations only.

A block is a window of the text, across line breaks, one and a half times as long as the template in words; one
begins at every template word.  A template matches a block when at least ``threshold`` of the template's distinct
words are in the block.  The words of the templates are ordered by their frequency over all documents, rarest first;
a text can reach the threshold only if it holds one of the template's first ``|T| - need + 1`` words (prefix filter),
enough template words at all (length filter), and enough words from the first shared one on (positional filter).
What is left is verified block by block.  Words outside all templates can't count towards any threshold, so they are
left out early.  Texts are read once: what later steps need of them is written to the shared folder.

Null text: empty.  Rows repeated: each has its own result row.  Very long texts: the work grows with their words, and
with the template words times the template's length where they hold enough of one.  Ties in frequency: by word.  An
empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import ASCII_LOWER, ASCII_UPPER, written

#: ASCII characters that part words.
PARTS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Well-known notices and the label that each stands for.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased: runs of other characters than PARTS."""
    return F.array_remove(F.split(F.translate(text, ASCII_UPPER + PARTS, ASCII_LOWER + " " * len(PARTS)), " "), "")


def phrase_starts(words: str, phrase: str) -> Column:
    """Word numbers from 0 at which the phrase's words stand consecutively in the array column ``words``."""
    first, *rest = phrase.split(" ")

    def here(w: Column, k: Column) -> Column:
        at = w == first
        for n, word in enumerate(rest, 1):
            at = at & (F.get(words, k + n) == word)
        return F.when(at, k.cast("long"))

    return F.array_compact(F.transform(words, here))


def template_rows(templates=TEMPLATES) -> list[tuple[int, str, list[str]]]:
    return [(k, label, sorted({w.lower() for w in re.findall(r"[0-9A-Za-z]+", text)})) for k, (label, text) in enumerate(templates)]


def scanned(docs: DataFrame, rows: list[tuple[int, str, list[str]]], need: dict[int, int]) -> DataFrame:
    """All that later steps need of each text, written once.

    ``own`` are its distinct template words, ``at_<label>`` the number, first and last of a phrase's places, and ``hits``
    its template words with their places where some template could reach its threshold, else null.
    """
    vocabulary = sorted({w for _, _, words in rows for w in words} | {w for p in PHRASES for w in p.split(" ")})
    literal = lambda words: F.array(*map(F.lit, words))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = texts.select("doc_id", F.xxhash64("text").alias("key"), words_of(F.col("text")).alias("words"))
    marked = cut.select("*", F.array_intersect("words", literal(vocabulary)).alias("own"))
    could = F.lit(False)
    for k, _, words in rows:
        could = could | (F.size(F.array_intersect("own", literal(words))) >= need[k])
    hits = F.array_compact(F.transform("words", lambda w, p: F.when(F.array_contains(literal(vocabulary), w), F.struct(p.cast("long").alias("p"), w.alias("w")))))
    places = {}
    for phrase, label in PHRASES.items():
        words = phrase.split(" ")
        every = F.size(F.array_intersect("own", literal(words))) == len(words)
        at = F.transform(F.array(phrase_starts("words", phrase)), lambda x: F.struct(F.size(x).cast("long").alias("n"), F.array_min(x).alias("first"), F.array_max(x).alias("last")))
        places[f"at_{label}"] = F.when(every, F.get(at, F.lit(0)))
    out = marked.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), "own", F.when(could, hits).alias("hits"), *(c.alias(n) for n, c in places.items()))
    return written(out, "license-words")


def word_order(scan: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Places of the template words, rarest first by the number of documents that hold them.

    The result has one row per template word, a fixed number, and so may come to the driver.
    """
    counts = {r.word: r.n for r in scan.select(F.explode("own").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


def needs(rows: list[tuple[int, str, list[str]]], threshold: float) -> dict[int, int]:
    return {k: math.ceil(round(threshold * len(words), 9)) for k, _, words in rows}


def template_matches(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """One row for each text and template that match: ``key``, ``doc_id``, ``template``, ``label``, ``containment``, ``n_blocks``.

    ``containment`` is that of the best block, ``n_blocks`` the number of blocks that match.

    ``key`` is a hash of the text, so that two rows with one ``doc_id`` are told apart.
    """
    rows = template_rows(templates)
    return matches(scanned(docs, rows, needs(rows, threshold)), templates, threshold)


def matches(scan: DataFrame, templates, threshold: float) -> DataFrame:
    rows = template_rows(templates)
    vocabulary = sorted({w for _, _, words in rows for w in words})
    order = word_order(scan, vocabulary)
    need = needs(rows, threshold)
    width = {k: math.ceil(1.5 * len(re.findall(r"[0-9A-Za-z]+", text))) for k, (_, text) in enumerate(templates)}
    prefixes = []
    for k, label, words in rows:
        ranked = sorted(words, key=order.get)
        prefixes += [(k, label, len(words), need[k], order[w], at, width[k], words) for at, w in enumerate(ranked[: len(words) - need[k] + 1], 1)]
    prefix_table = scan.sparkSession.createDataFrame(prefixes, "template int, label string, t_size int, need int, rank int, t_pos int, width int, t_words array<string>")
    contents = F.create_map(*(x for k, _, words in rows for x in (F.lit(k), F.array(*(F.lit(order[w]) for w in words)))))
    rank_of = F.create_map(*(x for w, k in order.items() for x in (F.lit(w), F.lit(k))))
    blocks = scan.where("hits is not null").distinct()
    blocks = blocks.select("doc_id", "key", "hits", F.array_sort(F.array_compact(F.transform("own", lambda w: rank_of[w]))).alias("ranks"))
    probes = blocks.select("*", F.posexplode("ranks").alias("b_pos0", "rank"))
    enough_left = 1 + F.least(F.col("t_size") - F.col("t_pos"), F.size("ranks") - F.col("b_pos0") - 1) >= F.col("need")
    shared = F.array_intersect("ranks", contents[F.col("template")])
    found = (
        probes.join(F.broadcast(prefix_table), "rank")  # a fixed number of rows
        .where((F.size("ranks") >= F.col("need")) & enough_left)
        .withColumn("shared", shared)
        # a pair counts once, at its first shared word, for which the positional bound holds
        .where((F.array_min("shared") == F.col("rank")) & (F.size("shared") >= F.col("need")))
    )
    found = found.withColumn("mine", F.filter("hits", lambda h: F.array_contains("t_words", h["w"])))

    def held(h: Column, k: Column) -> Column:
        """How many distinct template words the block has that begins at the template word ``h``."""
        near = F.filter(F.slice("mine", k + 1, F.col("width")), lambda x: x["p"] < h["p"] + F.col("width"))
        return F.size(F.array_distinct(F.transform(near, lambda x: x["w"])))

    found = found.withColumn("held", F.filter(F.transform("mine", held), lambda n: n >= F.col("need"))).where(F.size("held") > 0)
    return found.select("doc_id", "key", "template", "label", (F.array_max("held") / F.col("t_size")).alias("containment"), F.size("held").alias("n_blocks"))


def license_scan(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Labels, phrase places and the best containment for every row of ``docs`` (``doc_id``, ``text``)."""
    rows = template_rows(templates)
    scan = scanned(docs, rows, needs(rows, threshold))
    by_doc = (
        matches(scan, templates, threshold)
        .groupBy("doc_id", "key")
        .agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment"), F.sum("n_blocks").alias("n_blocks"))
    )
    at = [F.col(f"at_{label}") for label in PHRASES.values()]
    n_base = sum((F.coalesce(x["n"], F.lit(0).cast("long")) for x in at[1:]), F.coalesce(at[0]["n"], F.lit(0).cast("long")))
    base = F.array_compact(F.array(*(F.when(x["n"] > 0, F.lit(label)) for x, label in zip(at, PHRASES.values()))))
    joined = scan.withColumn("mine", F.struct("doc_id", "key")).join(
        by_doc.select(F.struct("doc_id", "key").alias("theirs"), "found", "containment", "n_blocks"), F.col("mine").eqNullSafe(F.col("theirs")), "left"
    )
    labels = F.array_sort(F.array_distinct(F.concat(base, F.coalesce("found", F.array().cast("array<string>")))))
    return joined.select(
        F.col("doc_id"),
        "n_words",
        n_base.alias("n_base"),
        F.array_min(F.array(*(x["first"] for x in at))).alias("first_word"),
        F.array_max(F.array(*(x["last"] for x in at))).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
        F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"),
    )
