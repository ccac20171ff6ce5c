"""The pipeline's stages one by one, on the smallest table and on odd rows."""

import re
from collections import Counter

import corpus_pipeline as cp
import pytest

from .conftest import ODD, documents
from .test_operators import SPACED, components_py


@pytest.fixture(scope="module")
def kept(spark, docs, sf):
    return cp.identify_language(spark, docs, sf).cache()


def test_language_keeps_clean_documents(kept, docs, rows):
    got = {r.doc_id: r for r in kept.collect()}
    assert kept.columns == docs.columns
    for r in rows:
        assert (r["doc_id"] in got) == bool(re.search(r"[^\W\d_]", r["text"]))
        if r["doc_id"] in got:
            assert got[r["doc_id"]].text == r["text"]


def test_one_of_each_group(spark, kept, sf):
    out = cp.drop_near_duplicates(spark, kept, sf)
    got = sorted(r.doc_id for r in out.collect())
    groups = components_py([(r.doc_id, r.text) for r in kept.collect()])
    assert got == sorted({c for _, _, c in groups}) and out.columns == kept.columns


def test_secrets_are_gone(spark, kept, sf):
    out = {r.doc_id: r for r in cp.replace_secrets(spark, kept, sf).collect()}
    for r in kept.collect():
        new = out[r.doc_id].text
        assert not re.search(r"[0-9a-f]{16,}", new) and out[r.doc_id].n_chars == len(new)
        if not re.search(r"[A-Za-z0-9+/_=-]{16,}", r.text):
            assert new == r.text


def test_mix_and_pack(spark, kept, sf):
    mixed = cp.mix_sources(spark, kept, sf).cache()
    assert mixed.columns == kept.columns
    words, own = Counter(), {r.doc_id: Counter(SPACED.findall(r.text)) for r in kept.collect()}
    for r in mixed.collect():
        found = Counter(SPACED.findall(r.text))
        assert not found - own[r.doc_id]
        words[r.doc_id] += sum(found.values())
    assert all(n <= 2 * sum(own[d].values()) for d, n in words.items())
    pieces = cp.pack(spark, mixed, sf).collect()
    assert {r.doc_id for r in pieces} == set(words)


def test_whole_run(spark, sf):
    out = cp.run(spark, sf)
    assert out.count() > 100 and [c for c, _ in out.dtypes] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_odd_and_empty_rows(spark, sf):
    for data in (ODD, []):
        docs = documents(spark, data).select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in cp.STAGES:
            out = stage(spark, docs, sf)
            assert out.count() >= 0
            docs = out if out.columns == docs.columns else docs
