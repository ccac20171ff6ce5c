"""The operators' queries over the standard tables, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import angular_negatives, curve_packing, dictionary_kmeans, feistel, host_rules, jaccard_join, kneser_ney, language_spans, license_join, mixing, multi_index_search, secret_grammar, wavelet_store
from tallyforge.llm import sql
from tallyforge.llm.common import crc32_of_id, table

#: The pseudonyms' key; a deployment sets its own.
PSEUDONYM_KEY = os.environ.get("TALLYFORGE_PSEUDONYM_KEY", "change-me")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_multi_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)


def op3_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_join.license_scan(table(spark, sf_dir, "documents")).drop("n_blocks")


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = host_rules.host_rules(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op7_secret_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_grammar.secret_scan(table(spark, sf_dir, "documents")).drop("base_spans")


def op8_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    third = crc32_of_id(F.col("doc_id")) % 3
    found = language_spans.identified(docs, third != 1, with_spans=False)
    return found.select("doc_id", (third == 1).alias("held_out"), "lang_pred", "score")


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return kneser_ney.kneser_ney(docs, crc32_of_id(F.col("doc_id")) % 10 == 0).drop("perplexity")


def op10_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_dictionary_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary_kmeans.cluster(table(spark, sf_dir, "embeddings"))


def op12_wavelet_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet_store.write(table(spark, sf_dir, "documents"), tokenizer_path()).documents()


def op13_angular_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return angular_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_multi_index_search,
        op2_feistel_pseudonyms,
        op3_license_join,
        op4_host_rules,
        op5_source_mix,
        op6_jaccard_join,
        op7_secret_grammar,
        op8_language_spans,
        op9_kneser_ney,
        op10_curve_packing,
        op11_dictionary_kmeans,
        op12_wavelet_store,
        op13_angular_negatives,
    )
}

_SPACED = r"[^\x20\x09-\x0D]"
ORACLE_SQL: dict[str, str] = {
    "op3_license_join": sql.license_sql(),
    "op5_source_mix": sql.mix_sql(),
    "op6_jaccard_join": sql.jaccard_sql(),
    "op11_dictionary_kmeans": sql.kmeans_sql(),
    "op13_angular_negatives": sql.negatives_sql(),
    "op4_host_rules": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, 'null') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '{_SPACED}+') AS w FROM d),
g AS (SELECT r, i, list_slice(w, i, i + 4) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM g) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY r),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{_SPACED}') GROUP BY r),
m AS (SELECT doc_id, host, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN cov USING (r) LEFT JOIN dup USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT host, count(*) AS n, sum(base_failed::INT) AS f, sum(base_failed::INT) / count(*)::DOUBLE AS rate FROM b GROUP BY 1),
p AS (SELECT avg(rate) AS mu, coalesce(var_pop(rate), 0) AS v FROM h),
s AS (SELECT mu, CASE WHEN v > mu * (1 - mu) / 1001 THEN greatest(mu * (1 - mu) / v - 1, 0) ELSE 1000.0 END AS strength FROM p),
x AS (SELECT host, (f + mu * strength) / (n + strength) > 0.5 AS rejected FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM b JOIN x USING (host)
""",
}
