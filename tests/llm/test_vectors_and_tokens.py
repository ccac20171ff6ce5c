"""Word hashes, dictionaries of subvectors, wavelet matrices and hard negatives against plain versions."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.llm import angular_negatives, byte_words, curve_packing, dictionary_kmeans, jaccard_join, kneser_ney, queries, wavelet_store
from tallyforge.llm.vectors import LIMIT, integer_vectors

from .conftest import ODD, documents, odd_vectors

# word hashes


def alternating(n):
    """The word over a and b whose sums of powers cancel modulo powers of two, and its complement."""
    word = "a"
    swap = str.maketrans("ab", "ba")
    while len(word) < n:
        word += word.translate(swap)
    return word[:n], word[:n].translate(swap)


def plain_hash(word):
    value = sum((c + 1) * pow(byte_words._BASE, k, byte_words._PRIME) for k, c in enumerate(word.lower().encode())) % byte_words._PRIME
    return int(byte_words.mixed(np.array([value], np.uint64))[0])


def test_word_hashes_are_polynomials_modulo_a_prime():
    words = ["a", "Hello", "hello", "été", "x" * (byte_words.WINDOW + 5), "yz" * byte_words.WINDOW, *(f"w{k}" for k in range(200))]
    got, n = byte_words.word_hashes(pa.array([" ".join(words[:3]), None, " ".join(words[3:])]))
    assert n.tolist() == [3, 0, len(words) - 3]
    assert got.tolist() == [plain_hash(w) for w in words]


@pytest.mark.parametrize("n", [512, 1024, 2048])
def test_regular_words_have_hashes_of_their_own(n):
    got, _ = byte_words.word_hashes(pa.array([" ".join(alternating(n))]))
    assert got[0] != got[1]


def test_regular_words_in_the_operators(spark):
    one, two = alternating(2048)
    docs = documents(spark, [(1, one, "en", "a"), (2, two, "en", "a"), (3, one, "en", "a")])
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()} == {1: 1, 2: 2, 3: 1}
    scored = {r.doc_id: r for r in kneser_ney.kneser_ney(docs, F.col("doc_id") == 2).collect()}
    assert scored[2].n_known == 1 and scored[1].n_known == 2
    tokenizer = curve_packing.TokenIds(queries.tokenizer_path())
    flat, n, _ = tokenizer.encode(pa.array([one, two]))
    for text, ids in zip((one, two), np.split(flat, np.cumsum(n)[:-1])):
        assert ids.tolist() == tokenizer.tokenizer.encode(text, add_special_tokens=False).ids + [curve_packing.END_ID]


# 11 clusters


@settings(max_examples=40, deadline=None)
@given(st.data())
def test_dictionaries_lose_nothing(data):
    n, dim = data.draw(st.integers(1, 60)), data.draw(st.integers(1, 9))
    rows = data.draw(st.lists(st.lists(st.integers(-LIMIT, LIMIT), min_size=dim, max_size=dim), min_size=n, max_size=n))
    x = np.array(rows + rows[: n // 2], np.int64)
    shard = dictionary_kmeans.Shard(dict(zip(("vec_ids", "widths", "sizes", "entries", "codes"), dictionary_kmeans.Shard.row(list(range(len(x))), x))))
    assert (shard.vectors() == x).all()
    centroids = x[:3]
    owner, distance = shard.assign(centroids)
    want = ((x[:, None] - centroids[None]) ** 2).sum(2)
    assert (owner == want.argmin(1)).all() and (distance == want.min(1)).all()
    assert (shard.sums(owner, len(centroids)) == [x[owner == c].sum(0) for c in range(len(centroids))]).all()


def test_repeated_vectors_make_wide_blocks():
    x = np.random.default_rng(1).integers(-99, 99, (5, 64))[np.arange(400) % 5]
    entries, codes = dictionary_kmeans.dictionaries(x)
    assert [e.shape for e in entries] == [(5, 64)] and len(codes[0]) == 400


def plain_clusters(rows, k=8, rounds=10):
    """Rows (vec_id, components) of 64 finite components."""
    import hashlib

    x = np.floor(np.array([r[1] for r in rows], np.float32).astype(float) * 1024).astype(np.int64)
    order = sorted((i for i in range(len(rows)) if rows[i][0] is not None), key=lambda i: (hashlib.sha256(f"3:{rows[i][0]}".encode()).hexdigest(), x[i].tolist()))
    c = x[order[:k]].copy()

    def nearest():
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        owner, _ = nearest()
        for j in range(len(c)):
            if (owner == j).any():
                c[j] = x[owner == j].sum(0) // (owner == j).sum()
    owner, d = nearest()
    hashes = [hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest() for v in c]
    return sorted(((r[0], int(o), int(e), int(d[owner == o].sum()), int(d.sum()), hashes[o]) for r, o, e in zip(rows, owner, d)), key=repr)


@pytest.mark.parametrize("shard_rows", [1, 37, 16384])
def test_clusters_of_odd_vectors(spark, shard_rows):
    table = odd_vectors(spark)
    rows = [r[:2] for r in table.collect() if r[1] is not None and len(r[1]) == 64 and all(v is not None and np.isfinite(v) for v in r[1])]
    got = dictionary_kmeans.cluster(table.repartition(2), shard_rows=shard_rows)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_clusters(rows)


def test_few_and_no_vectors(spark):
    table = odd_vectors(spark)
    few = [tuple(r) for r in dictionary_kmeans.cluster(table.where("vec_id IN (1, 2, 3)")).collect()]
    assert len(few) == 3 and all(r[2] == 0 for r in few) and {r[1] for r in few} == {0, 1, 2}
    assert dictionary_kmeans.cluster(table.where("false")).collect() == []
    assert dictionary_kmeans.cluster(table.where("vec_id = 402")).collect() == []


def test_components_out_of_range_are_an_error(spark):
    far = spark.createDataFrame([(1, [1e30] * 64, 0)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="component"):
        integer_vectors(far, 1024, "vec_id").collect()


# 12 wavelet matrices


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 3000), st.sampled_from([1, 2, 5, 300, 60_000]))
def test_matrix_answers(tmp_path_factory, seed, n, size):
    rng = np.random.default_rng(seed)
    tokens = (rng.zipf(1.4, n) % size).astype(np.uint32)
    uri = f"file://{tmp_path_factory.mktemp('matrix')}/one"
    wavelet_store.write_matrix(uri, tokens, {"doc_id": np.arange(3)})
    matrix = wavelet_store.WaveletMatrix(uri)
    assert matrix.documents["doc_id"].tolist() == [0, 1, 2]
    assert (matrix.tokens() == tokens).all()
    where = rng.integers(0, n, 50)
    assert (matrix.access(where) == tokens[where]).all()
    low, high = sorted(rng.integers(0, n + 1, 2).tolist())
    for token in [*np.unique(tokens)[:5].tolist(), size + 1]:
        stands = np.flatnonzero(tokens == token)
        assert matrix.rank(token, low) == (stands < low).sum()
        assert matrix.count(token, low, high) == ((stands >= low) & (stands < high)).sum()
        assert matrix.occurrences(token).tolist() == stands.tolist()
        assert matrix.occurrences(token, low, high).tolist() == stands[(stands >= low) & (stands < high)].tolist()


def test_matrix_of_several_blocks(tmp_path):
    tokens = (np.random.default_rng(3).zipf(1.3, 3 * wavelet_store.BLOCK) % 40_000).astype(np.uint16)
    wavelet_store.write_matrix(f"file://{tmp_path}/one", tokens, {})
    matrix = wavelet_store.WaveletMatrix(f"file://{tmp_path}/one")
    token = int(tokens[-1])
    stands = np.flatnonzero(tokens == token)
    assert matrix.select(token, np.array([len(stands) - 1]))[0] == stands[-1]
    assert sum(int(p.there.sum()) for p in matrix.planes) <= 4 * len(matrix.planes)  # only the blocks that are touched are read
    assert matrix.access(np.arange(len(tokens))).tolist() == tokens.tolist()
    assert (tmp_path / "one").stat().st_size < tokens.nbytes


@pytest.fixture(scope="module")
def encoder():
    return curve_packing.TokenIds(queries.tokenizer_path()).tokenizer


def plain_store(rows, encoder):
    """(doc_id, ids) in the store's order, rows of one id in any."""
    ids = [(r[0], encoder.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in rows]
    return sorted(ids, key=lambda d: (d[0] is not None, d[0] or 0))


@pytest.mark.parametrize("shard_tokens", [50, 7001, 1 << 22])
def test_store_of_odd_documents(spark, encoder, shard_tokens):
    rows = [*ODD, (None, "no id", "en", "a"), (None, None, None, None), (12, "<|endoftext|> and <|startoftext|>", "en", "a"), (4, "another of this id", "en", "b")]
    store = wavelet_store.write(documents(spark, rows).repartition(3), queries.tokenizer_path(), shard_tokens=shard_tokens)
    got = store.documents().orderBy("start").collect()
    want = plain_store(rows, encoder)
    assert [r.doc_id for r in got] == [d for d, _ in want]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in want)
    assert [r.start for r in got] == np.r_[0, np.cumsum([r.n_tokens for r in got])][:-1].tolist()
    assert store.n_tokens == sum(len(i) for _, i in want)
    n = Counter(t for _, i in want for t in i)
    asked = [1, encoder.encode("word", add_special_tokens=False).ids[0], 49_400]
    assert {r.token: r.n for r in store.counts(asked).collect()} == {t: n[t] for t in asked}
    ends = sorted(r.position for r in store.occurrences([1]).collect())
    assert set(ends) >= {r.start + r.n_tokens - 1 for r in got} and len(ends) == n[1]


def test_store_of_no_documents(spark):
    store = wavelet_store.write(documents(spark, []).where("false"), queries.tokenizer_path())
    assert store.n_tokens == 0 and store.documents().collect() == [] and store.occurrences([1]).collect() == []


def test_store_of_the_table(spark, sf, docs, encoder):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op12_wavelet_store(spark, sf).collect()}
    start, want = 0, {}
    for doc_id, ids in plain_store([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], encoder):
        want[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want


# 13 hard negatives


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([1, 2, 3, 64]), st.sampled_from([3, 300, 100_000]))
def test_bounds_hold(seed, dim, size):
    rng = np.random.default_rng(seed)
    x = rng.integers(-size, size + 1, (40, dim)) * rng.integers(0, 3, (40, 1))
    x[:5] = x[5:10] * 2  # rows of one direction
    x[10] = -x[5]
    references = angular_negatives.chosen_references(x, 4)
    norms = np.sqrt((x.astype(float) ** 2).sum(1))
    theta = angular_negatives.angles(x.astype(float), norms, references)
    tiles = [np.arange(a, min(a + 7, 40)) for a in range(0, 40, 7)]
    ends = [np.array([f(v[t], axis=0) for t in tiles]) for v in (theta, norms) for f in (np.min, np.max)]
    low, high = angular_negatives.bounds(theta, norms, *ends)
    score = x @ x.T
    for k, t in enumerate(tiles):
        assert (low[:, k] <= score[:, t].min(1)).all() and (high[:, k] >= score[:, t].max(1)).all()


def plain_negatives(rows):
    """Rows (vec_id, label, integer vector): all scores, sorted."""
    out = []
    for aid, label, a in rows:
        if aid % 50:
            continue
        scored = [(-int(a @ x), i, other) for i, other, x in rows]
        near = sorted((s, i) for s, i, other in scored if other == label and i != aid)[:5]
        for s, p in near:
            fits = sorted((n, i) for n, i, other in scored if other != label and 50 * -s <= 100 * -n <= 95 * -s)[:3]
            out += [(aid, p, rank, i, -s, -n) for rank, (n, i) in enumerate(fits, 1)]
    return sorted(out)


def usable_rows(table, scale=256):
    rows = [r for r in table.select("vec_id", "label", "embedding").collect() if None not in r[:3] and len(r[2]) == 64 and all(v is not None and np.isfinite(v) for v in r[2])]
    return [(r[0], r[1], np.floor(np.array(r[2], np.float32).astype(float) * scale).astype(np.int64)) for r in rows]


@pytest.mark.parametrize("file_rows, span_rows", [(1 << 18, 1 << 22), (40, 90), (7, 1)])
def test_negatives_of_odd_vectors(spark, file_rows, span_rows):
    table = odd_vectors(spark)
    got = angular_negatives.hard_negatives(table.repartition(3), F.col("vec_id") % 50 == 0, file_rows=file_rows, span_rows=span_rows)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(usable_rows(table))


def test_tiles_that_cannot_hold_results_are_not_scored(tmp_path, monkeypatch):
    """Groups of rows about 30 directions: same rows as by full scoring, few tiles scored."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 64))
    n = 6000
    x = np.floor((centres[rng.integers(0, 30, n)] + 0.1 * rng.normal(size=(n, 64))) * 100).astype(np.int32)
    labels, ids = rng.integers(0, 3, n), rng.permutation(n)
    references = angular_negatives.chosen_references(x[:500].astype(np.int64), 32)
    monkeypatch.setattr(angular_negatives, "TILE", 32)
    theta = angular_negatives.angles(x.astype(float), np.sqrt((x.astype(float) ** 2).sum(1)), references)
    order = np.lexsort((theta.min(1), theta.argmin(1), labels))
    x, labels, ids, theta = x[order], labels[order], ids[order], theta[order]
    angular_negatives.Segment.write(f"file://{tmp_path}/s", ids, labels, x, references)
    segment = angular_negatives.Segment(f"file://{tmp_path}/s", 64, len(references))
    scored = []
    score = angular_negatives.Segment.scores
    monkeypatch.setattr(angular_negatives.Segment, "scores", lambda self, a, t: scored.append(len(a)) or score(self, a, t))
    some = np.arange(0, n, 60)
    best = angular_negatives.Best(len(some), 5)
    angular_negatives.add_positives(best, segment, x[some].astype(np.int64), ids[some], labels[some], theta[some])
    found = best.sort()
    for k, a in enumerate(some):
        products = x.astype(np.int64) @ x[a].astype(np.int64)
        mine = np.flatnonzero((labels == labels[a]) & (ids != ids[a]))
        want = mine[np.lexsort((ids[mine], -products[mine]))[:5]]
        assert found[2][found[0] == k].tolist() == ids[want].tolist()
    tiles = -(-n // 32)
    assert sum(scored) < 0.3 * len(some) * tiles / 3  # a third of all tiles hold an anchor's label


def test_large_components_are_scored_as_integers(spark):
    rng = np.random.default_rng(2)
    rows = [(k, (rng.integers(-(2**26), 2**26, 64) / 256).tolist(), k % 2) for k in range(101)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = angular_negatives.hard_negatives(table, F.col("vec_id") % 50 == 0)
    want = plain_negatives([(r[0], r[2], np.floor(np.array(r[1]) * 256).astype(np.int64)) for r in rows])
    assert sorted(tuple(r) for r in got.collect()) == want and want


def test_no_vectors_no_negatives(spark):
    table = odd_vectors(spark)
    assert angular_negatives.hard_negatives(table.where("false"), F.col("vec_id") % 50 == 0).collect() == []
    assert angular_negatives.hard_negatives(table.where("vec_id = 51"), F.col("vec_id") % 50 == 0).collect() == []


# Columns of the operators' own names


INNER = ["_row", "_spans", "_key", "_their_key", "_n", "_m", "_p", "_round", "_any", "_hits", "_kinds", "doc", "key", "their_key", "n", "m", "spans", "pieces", "round", "cut", "whole", "any", "hits", "kinds", "hash", "id", "h", "size", "shard", "start", "place"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, "call 415-555-0187 about the red fox and its den by the river", "en", "a"), (2, "call 415-555-0187 about the red fox and its den by the river", "en", "a"), (3, "der Hund und die Katze sind im Haus am Fluss", "de", "b"), (4, None, None, None)]
    return documents(spark, rows).withColumns({c: F.lit(f"own {c}") for c in INNER})


@pytest.mark.parametrize(
    "name",
    ["accepted", "one_of_each", "redacted", "mixed_documents", "pseudonymised"],
)
def test_columns_of_any_name_stay(clashing, name):
    from tallyforge.llm import feistel, language_spans, mixing, secret_grammar

    run = {
        "accepted": lambda d: language_spans.accepted(d, language_spans.fit(d.select("doc_id", "text", "lang"))), "one_of_each": jaccard_join.one_of_each, "redacted": secret_grammar.redacted,
        "mixed_documents": mixing.mixed_documents, "pseudonymised": lambda d: feistel.pseudonymised(d, "secret"),
    }[name]
    out = run(clashing)
    assert out.columns[: len(clashing.columns)] == clashing.columns
    got = out.collect()
    assert got and all(r[c] == f"own {c}" for r in got for c in INNER)


def test_letter_runs():
    from tallyforge.llm.language_spans import letter_runs

    text = "ab1c x² y½z été_über 東京²タワー ᛭ Ⅷx"
    runs, run = [], ""
    for c in text + " ":
        if c.isalpha():
            run += c
        elif run:
            runs, run = [*runs, run], ""
    assert letter_runs(text) == runs


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 8)), max_size=12), st.integers(0, 35), st.integers(1, 9))
def test_overlaps(spans, start, length):
    from tallyforge.llm.secret_grammar import overlaps

    spans = [(s, s + n) for s, n in spans]
    assert overlaps(spans)(start, start + length) == any(s < start + length and start < e for s, e in spans)
