"""SQL that gives the rows of the queries whose operators SQL can express: plain statements of what they compute.

They compare everything with everything in a document, a source or a pair of texts, and so are for small tables.
"""

from __future__ import annotations

import math
import re

from tallyforge.llm import license_join, mixing

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"[^\x20\x09-\x0D]"


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_sql(templates=license_join.TEMPLATES, threshold: float = 0.8) -> str:
    """Every window of one and a half times a template's length that begins at one of its words, against the template."""
    rows = license_join.template_rows(templates)
    need = license_join.needs(rows, threshold)
    width = {k: math.ceil(1.5 * len(re.findall(r"[0-9A-Za-z]+", text))) for k, (_, text) in enumerate(templates)}
    values = ", ".join(f"({k}, {literal(label)}, {literal(w)}, {len(words)}, {need[k]}, {width[k]})" for k, label, words in rows for w in words)
    stands = " ".join("WHEN " + " AND ".join(f"{at} = {literal(w)}" for at, w in zip(("word", "next1", "next2"), phrase.split(" "))) + f" THEN {literal(label)}" for phrase, label in license_join.PHRASES.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1)::BIGINT - 1 AS p FROM d),
n AS (SELECT *, lead(word, 1) OVER o AS next1, lead(word, 2) OVER o AS next2 FROM w WINDOW o AS (PARTITION BY r ORDER BY p)),
base AS (SELECT r, p, CASE {stands} END AS label FROM n),
places AS (SELECT r, count(*) AS n, min(p) AS a, max(p) AS z, list_sort(list(DISTINCT label)) AS labels FROM base WHERE label IS NOT NULL GROUP BY r),
t(template, label, word, size, need, width) AS (VALUES {values}),
m AS (SELECT r, template, label, size, need, width, p, word FROM w JOIN t USING (word)),
held AS (SELECT a.r, a.label, a.size, a.need, count(DISTINCT b.word) AS n FROM m a JOIN m b ON a.r = b.r AND a.template = b.template AND b.p BETWEEN a.p AND a.p + a.width - 1 GROUP BY a.r, a.template, a.label, a.size, a.need, a.p),
found AS (SELECT r, list(DISTINCT label) AS labels, max(n / size) AS best FROM held WHERE n >= need GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(places.n, 0)::BIGINT AS n_base, a AS first_word, z AS last_word, coalesce(array_to_string(places.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(places.labels, []), coalesce(found.labels, [])))), ','), '') AS labels, CASE WHEN places.n > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN places USING (r) LEFT JOIN found USING (r)
"""


def mix_sql(weights=mixing.WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 7) -> str:
    """All quotients of all sources and shards are ranked, and every block is laid over every document of its shard."""

    def hashed(text: str) -> str:
        return f"('0x' || left(md5({text}), 8))::BIGINT"

    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, len(regexp_extract_all(coalesce(text, ''), '{SPACED}+'))::BIGINT AS size, source FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_rows FROM d GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS source_no FROM per),
q AS (SELECT *, {[float(w) for w in weights]}[(source_no % {len(weights)} + 1)::INT] AS weight, {cap} * source_size AS most FROM o),
l AS (SELECT *, most / weight AS full_at, ({share} * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY most / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM q),
s AS (SELECT *, CASE WHEN full_at <= level OR lv IS NULL THEN most ELSE weight * lv END AS target FROM l, (SELECT arg_min(level, (full_at, source_no)) AS lv FROM l WHERE full_at > level)),
seats AS (SELECT round(sum(target) / {mixing.BLOCK_WORDS})::BIGINT AS seats FROM s),
sq AS (SELECT source_no, count(*) AS source_quota FROM (SELECT source_no, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, source_no, k) AS place, seats FROM (SELECT source_no, target, seats, unnest(range(1, seats + 1)) AS k FROM s, seats WHERE target > 0)) WHERE place <= seats GROUP BY 1),
x AS (SELECT r, doc_id, size, source_no, source_size, target, coalesce(source_quota, 0) AS source_quota, {hashed(f"'{seed}|' || coalesce(doc_id::VARCHAR, 'null')")} AS h,
  least({mixing.MAX_SHARDS}, greatest(1, ceil(greatest(source_size / {mixing.SHARD_WORDS}, n_rows / {mixing.SHARD_ROWS}))))::BIGINT AS n_shards FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN sq USING (source_no)),
y AS (SELECT *, h % n_shards AS shard, coalesce(sum(size) OVER (PARTITION BY source_no, h % n_shards ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM x),
sh AS (SELECT source_no, shard, sum(size)::BIGINT AS shard_size, any_value(source_quota) AS source_quota FROM y GROUP BY 1, 2),
shq AS (SELECT source_no, shard, count(*) AS shard_quota FROM (SELECT *, row_number() OVER (PARTITION BY source_no ORDER BY shard_size / (2 * k - 1) DESC, shard, k) AS place FROM (SELECT *, unnest(range(1, source_quota + 1)) AS k FROM sh WHERE shard_size > 0)) WHERE place <= source_quota GROUP BY 1, 2),
b0 AS (SELECT *, greatest(1, round(shard_size / {mixing.BLOCK_WORDS}))::BIGINT AS n_blocks, {hashed(f"'{seed}|blocks|' || source_no || '|' || shard")} AS mixed FROM sh LEFT JOIN shq USING (source_no, shard)),
b1 AS (SELECT *, least(coalesce(shard_quota, 0), floor({cap} * n_blocks))::BIGINT AS quota, {list(mixing.PRIMES)}[(mixed % {len(mixing.PRIMES)} + 1)::INT]::BIGINT % n_blocks AS step FROM b0),
b AS (SELECT source_no, shard, k * shard_size // n_blocks AS lo, (k + 1) * shard_size // n_blocks AS hi, quota // n_blocks + (step * (k + mixed % n_blocks) % n_blocks < quota % n_blocks)::BIGINT AS times FROM (SELECT *, unnest(range(0, n_blocks)) AS k FROM b1)),
t AS (SELECT r, sum((least(hi, start + size) - greatest(lo, start)) * times)::BIGINT AS taken FROM y JOIN b USING (source_no, shard) WHERE hi > start AND lo < start + size GROUP BY 1)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM y LEFT JOIN t USING (r)
"""


def jaccard_sql(words: int = 5, percent: int = 80) -> str:
    """All pairs of different sets with a shingle in common, and all that each set reaches by links."""
    following = " || ' ' || ".join(["word", *(f"lead(word, {i}) OVER o" for i in range(1, words))])
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '{SPACED}+') AS w FROM documents),
w AS (SELECT r, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
grams AS (SELECT r, n, p, {following} AS gram FROM w WINDOW o AS (PARTITION BY r ORDER BY p)),
s AS MATERIALIZED (SELECT d.r, doc_id, coalesce(x.g, CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE [array_to_string(w, ' ')] END) AS g FROM d LEFT JOIN (SELECT r, list_sort(list(DISTINCT gram)) AS g FROM grams WHERE p <= n - {words - 1} GROUP BY r) x USING (r)),
k AS MATERIALIZED (SELECT r, doc_id, g, len(g)::BIGINT AS n, md5(array_to_string(g, chr(10))) AS h FROM s),
c AS MATERIALIZED (SELECT h, n, min(doc_id) AS id, any_value(g) AS g FROM k WHERE n > 0 GROUP BY 1, 2),
t AS MATERIALIZED (SELECT id, n, unnest(g) AS shingle FROM c),
pairs AS MATERIALIZED (SELECT a.id AS x, b.id AS y FROM t a JOIN t b ON a.shingle = b.shingle AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
links AS MATERIALIZED (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach(x, y) AS (SELECT id, id FROM c UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least_of AS (SELECT x, min(y) AS component_id FROM reach GROUP BY 1)
SELECT k.doc_id, k.n AS n_shingles, coalesce(component_id, k.doc_id) AS component_id FROM k LEFT JOIN c ON k.h = c.h AND k.n = c.n AND k.n > 0 LEFT JOIN least_of ON least_of.x = c.id
"""


def kmeans_sql(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """Every component against every centroid's, round after round."""

    def assigned(n: int) -> str:
        return f"""a{n} AS MATERIALIZED (SELECT r, arg_min(c, (distance, c)) AS c, min(distance) AS distance FROM (SELECT v.r, m.c, sum((v.x - m.x) * (v.x - m.x))::BIGINT AS distance FROM v JOIN m{n} m USING (d) GROUP BY 1, 2) GROUP BY r)"""

    def moved(n: int) -> str:
        return f"""s{n} AS (SELECT c, d, sum(x)::BIGINT AS total, count(*) AS n FROM v JOIN a{n - 1} USING (r) GROUP BY 1, 2),
m{n} AS MATERIALIZED (SELECT o.c, o.d, coalesce((total - (total % n + n) % n) // n, o.x) AS x FROM m{n - 1} o LEFT JOIN s{n} s ON o.c = s.c AND o.d = s.d)"""

    steps = ",\n".join([assigned(0)] + [f"{moved(n)},\n{assigned(n)}" for n in range(1, rounds + 1)])
    return f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda y: floor({scale} * y::DOUBLE)::BIGINT) AS xs FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = {dim}),
v AS MATERIALIZED (SELECT r, unnest(xs) AS x, unnest(range({dim})) AS d FROM e),
m0 AS MATERIALIZED (SELECT c, unnest(xs) AS x, unnest(range({dim})) AS d FROM (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), xs) - 1 AS c, xs FROM e WHERE vec_id IS NOT NULL) WHERE c < {k}),
{steps},
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM m{rounds} GROUP BY c),
t AS (SELECT c, sum(distance)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY c)
SELECT vec_id, a.c::INT AS cluster, distance, cluster_inertia, (SELECT sum(distance) FROM a{rounds})::BIGINT AS inertia, centroid_sha256 FROM a{rounds} a JOIN e USING (r) JOIN h USING (c) JOIN t USING (c)
"""


def negatives_sql(positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256) -> str:
    """Every anchor against every row."""
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda y: floor({scale} * y::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = len(embedding)),
u AS MATERIALIZED (SELECT * FROM v WHERE len(x) = (SELECT len(x) FROM v GROUP BY len(x) ORDER BY count(*) DESC, len(x) LIMIT 1)),
s AS MATERIALIZED (SELECT a.r, a.vec_id AS anchor_id, b.vec_id, b.r AS other, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM u a JOIN u b ON a.vec_id <> b.vec_id OR a.label <> b.label WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= {positives}),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score, row_number() OVER (PARTITION BY p.r, p.place ORDER BY n.score DESC, n.vec_id) AS rank
  FROM p JOIN s n ON p.r = n.r AND NOT n.same AND {least} * p.score <= 100 * n.score AND 100 * n.score <= {most} * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {negatives}
"""
