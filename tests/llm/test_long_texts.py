"""Very long texts beside small ones, in the operators that read whole texts: nothing is cut, and ends count."""

import hashlib
import re

import numpy as np
import pytest

from tessera.llm import exact_dedup, langid, mixing, simhash, url_filter

N = 300_000


@pytest.fixture(scope="module")
def texts():
    """Two megabytes each; the second differs from the first in its last word only, the third in white space only."""
    words = [f"w{i % 9973}x{i % 89}" for i in range(N)]
    base = " ".join(words)
    return {1: base, 2: " ".join([*words[:-1], "last"]), 3: "\n ".join(words), 4: "a b", 5: None}


@pytest.fixture(scope="module")
def df(spark, texts):
    return spark.createDataFrame([(k, v, "s") for k, v in texts.items()], "doc_id long, text string, source string")


def test_exact_dedup(df, texts):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(df).collect()}
    assert {k: (r.keep_id, r.group_size, r.kept) for k, r in got.items()} == {1: (1, 2, True), 2: (2, 1, True), 3: (1, 2, False), 4: (4, 1, True), 5: (5, 1, True)}
    assert all(got[k].text_sha256 == hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", v or "").encode()).hexdigest() for k, v in texts.items())
    assert sorted(len(r.text or "") for r in exact_dedup.kept_documents(df).collect()) == sorted(len(texts[k] or "") for k in (1, 2, 4, 5))


def test_simhash(df, texts):
    """One word of 300,000 turns no bit, or few."""
    got = {r.doc_id: r for r in simhash.near_components(df).collect()}
    assert got[1].fp == got[3].fp and {got[k].component_id for k in (1, 2, 3)} == {1}
    assert all(got[k].fp % 2**64 == simhash.fingerprint(texts[k] or "") for k in texts) and got[5].fp == 0 and got[5].component_id == 5


def test_mix(df):
    got = {r.doc_id: r for r in mixing.mix_sources(df).collect()}
    assert [got[k]["size"] for k in (1, 2, 3, 4, 5)] == [N, N, N, 2, 0]
    assert {r.source_size for r in got.values()} == {3 * N + 2} and sum(r.taken for r in got.values()) == 3 * N + 2


def test_language(df, texts):
    model = langid.Model(["x", "y"], ["▁", "w", "a", "b"], np.array([[0.4, 0.1], [0.1, 0.4], [0.2, 0.2], [0.2, 0.2]]))
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 5)] == [got[1].lang_pred] * 3 + ["und"] and all(0 <= r.score <= 1 for r in got.values())
    even = langid.predict(df, langid.Model(["x", "y"], ["▁", "a"], np.full((2, 2), 0.5))).filter("doc_id < 5").collect()
    assert {(r.lang_pred, r.score) for r in even} == {("x", 0.5)}  # a tie, at any length


def test_urls(spark):
    long = "a" * 1_000_000
    df = spark.createDataFrame([(1, f"http://{'b.' * 60}example.com/en/{long}"), (2, f"http://{long}/en/"), (3, long), (4, f"http://www.example.com/en/?{long}")], "page_id long, url string")
    got = {r.page_id: (len(r.host), len(r.path), r.rule, r.verdict) for r in url_filter.judge_urls(df).collect()}
    assert got == {1: (131, 4 + len(long), "example.com/en/", "block"), 2: (len(long), 4, None, "allow"), 3: (0, 0, None, "allow"), 4: (15, 4, "www.example.com/en/", "allow")}
