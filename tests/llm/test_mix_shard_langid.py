import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, mixing, sharding


def n_words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def water(sizes, weights, epochs=3):
    """Targets by clamping one round after another, in exact arithmetic."""
    from fractions import Fraction

    total, clamped = sum(sizes), set()
    while True:
        left = total - sum(epochs * sizes[i] for i in clamped)
        free = sum(w for i, w in enumerate(weights) if i not in clamped)
        share = {i: Fraction(left * w, free) for i, w in enumerate(weights) if i not in clamped}
        over = {i for i, x in share.items() if x > epochs * sizes[i]}
        if not over:
            return [epochs * sizes[i] if i in clamped else float(share[i]) for i in range(len(sizes))]
        clamped |= over


def test_targets(spark):
    rng = random.Random(4)
    for sizes in ([100, 1, 1, 50, 2], [5], [0, 10, 3], [rng.randint(1, 1000) for _ in range(23)]):
        names = sorted(f"s{i}" for i in range(len(sizes) - 1)) + [None]
        df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = water(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
        assert [got[n] for n in names] == pytest.approx(want)
        assert sum(want) == pytest.approx(sum(sizes))


def test_mix(docs, rows):
    found = mixing.mix_sources(docs).toPandas()
    assert len(found) == len(rows)
    assert (found["size"] == found.text.map(n_words)).all()
    for source, part in found.groupby(found.source.fillna("~null")):
        size, target = part.source_size.iloc[0], part.target.iloc[0]
        assert size == sum(n_words(r[1]) for r in rows if (r[3] or "~null") == source)
        assert (part.taken <= 3 * part["size"]).all() and (part.taken == part["size"] * part.repetitions).all()
        assert abs(part.taken.sum() - target) <= part["size"].max() / 2 + 1
    again = mixing.mix_sources(docs.repartition(7)).toPandas()
    taken = lambda f: sorted(map(str, zip(f.doc_id, f["size"], f.taken, strict=True)))
    assert taken(again) == taken(found)
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns
    assert copies.count() == found.repetitions.sum()


def test_no_row_exceeds_the_epochs(spark):
    """Rows without words in a source at its clamp come first in the order of the draws now and then."""
    rows = [(i, "w" if i % 4 == 0 else "", "small") for i in range(80)] + [(1000 + i, "a b c d e", "big") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    f = mixing.mix_sources(df, weights=(1, 5)).toPandas()
    assert (f.target[f.source == "small"] == 60).all() and f.repetitions.max() == 3
    assert mixing.mixed_documents(df, weights=(1, 5)).groupBy("doc_id").count().agg({"count": "max"}).first()[0] == 3


def test_mix_and_shards_of_nothing(empty):
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mixed_documents(empty).count() == 0
    assert sharding.shuffled(empty).count() == 0


@pytest.mark.parametrize("bucket", [500, 10**6])
def test_shards(docs, rows, bucket):
    found = sharding.shuffled(docs, shards=7, bucket_bytes=bucket).toPandas()
    assert len(found) == len(rows)
    assert (found["size"] == found.text.map(lambda t: len((t or "").encode()) + 8)).all()
    counts = found.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert counts["count"].max() - counts["count"].min() <= 1 and set(counts.index) == set(range(7))
    assert (counts["min"] == 0).all() and (counts["max"] == counts["count"] - 1).all() and (counts["nunique"] == counts["count"]).all()
    again = sharding.shuffled(docs.repartition(5), shards=7, bucket_bytes=bucket).toPandas()
    place = lambda f: sorted(zip(f.shard, f.slot, f.text.map(lambda t: zlib.crc32((t or "").encode())), strict=True))
    assert place(again) == place(found)


def test_shards_are_a_reference_permutation(spark, monkeypatch, tmp_path):
    """The same from the definition on one machine: buckets in order, each sorted, then permuted by its generator."""
    monkeypatch.setattr(sharding, "RUN", 3)  # several runs of buckets
    df = spark.createDataFrame([(i, f"text {i} " * (1 + i % 7)) for i in range(500)] + [(7, "text 7 ")], "doc_id long, text string")
    size, seed, shards = 900, 5, 6
    hashed = df.selectExpr("*", f"xxhash64({seed}, doc_id, xxhash64(text)) AS h", "octet_length(text) + 8 AS size").toPandas()
    buckets = -(-int(hashed["size"].sum()) // size)
    order = []
    for b in range(buckets):
        part = hashed[hashed.h % buckets == b].sort_values(["h", "doc_id"])[["doc_id", "text"]].values.tolist()
        place = np.arange(len(part))
        np.random.Generator(np.random.PCG64([seed, b])).shuffle(place)
        order += [tuple(part[k]) for k in place]
    cuts = [round(x) for x in np.cumsum([0] + [len(order) // shards + (s < len(order) % shards) for s in range(shards)])]
    want = {(s, k): order[cuts[s] + k] for s in range(shards) for k in range(cuts[s + 1] - cuts[s])}
    got = {(r.shard, r.slot): (r.doc_id, r.text) for r in sharding.shuffled(df, shards, seed, bucket_bytes=size).collect()}
    assert got == want
    written = sharding.write_shards(df, str(tmp_path / "s"), shards=shards, seed=seed, bucket_bytes=size)
    for back in (written, spark.read.parquet(str(tmp_path / "s"))):
        assert {(r.shard, r.slot): (r.doc_id, r.text) for r in back.collect()} == want


def test_shards_of_long_texts_and_of_nothing(spark, empty, tmp_path):
    """A text 50 times a bucket, a null id, a null text and rows repeated come back whole from the files."""
    rows = [(1, "word " * 50_000), (None, "a"), (2, None), (3, "b"), (3, "b"), (3, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("own")).withColumn("_x", F.lit(1))
    back = sharding.write_shards(df, str(tmp_path / "long"), shards=4, bucket_bytes=5000)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted(rows, key=str)
    assert {r["count"] for r in back.groupBy("shard").count().collect()} == {1, 2}
    assert sharding.write_shards(empty, str(tmp_path / "none")).count() == 0


def test_shuffle_moves_rows(spark):
    df = spark.range(2000).selectExpr("id AS doc_id", "'x' AS text")
    f = sharding.shuffled(df, shards=4).toPandas().sort_values(["shard", "slot"])
    assert abs(np.corrcoef(f.doc_id, np.arange(2000))[0, 1]) < 0.1


def segmentations(w):
    if not w:
        yield []
    for i in range(1, len(w) + 1):
        for rest in segmentations(w[i:]):
            yield [w[:i], *rest]


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba"]
    p = np.random.default_rng(1).random((len(pieces), 2)) * 0.1
    m = langid.Model(["x", "y"], pieces, p)
    at = dict(zip(pieces, p, strict=True))
    words = ["a", "ab", "abab", "cab", "ba"]
    prob = lambda s: np.prod([at.get(x, langid.UNKNOWN if len(x) == 1 else 0.0) * np.ones(2) for x in s], axis=0)
    for w, got in zip(words, m.score(words), strict=True):
        assert np.exp(got) == pytest.approx(sum(prob(s) for s in segmentations("▁" + w)))
    one, counts = ["abab"], np.array([[2.0, 3.0]])
    want = np.zeros((len(pieces), 2))
    for s in segmentations("▁abab"):
        for x in s:
            if x in at:
                want[pieces.index(x)] += prob(s) * counts[0]
    assert m.expected(one, counts) == pytest.approx(want / np.exp(m.score(one)[0]))
    assert m._score_long("▁" + "ab" * 30) == pytest.approx(m.score(["ab" * 30])[0])
    for w in ("abab", "cab", "ab" * 15):
        out = np.zeros((len(pieces) + 2, 2))
        m._expected_long("▁" + w, counts[0], out)
        assert out[:-2] == pytest.approx(m.expected([w], counts))
    long = m.expected(["ab" * 3000], np.ones((1, 2)))  # a probability far below doubles
    assert np.isfinite(long).all() and (long.T @ [len(x) for x in pieces]) == pytest.approx([6001, 6001])


def test_predictions(spark):
    rng = random.Random(7)
    parts = {"en": ["the", "and", "ing", "tion", "er"], "fr": ["que", "eau", "oux", "é", "ment"], "de": ["sch", "ung", "ich", "keit", "ein"]}
    text = lambda k: " ".join("".join(rng.choice(parts[k]) for _ in range(rng.randint(1, 3))) for _ in range(30))
    rows = [(i, text(k), k) for i, k in enumerate(rng.choice(list(parts)) for _ in range(300))]
    odd = [(900, None, "en"), (901, "", None), (902, "123 ² ½ !?", "fr"), (903, "x" * 5000, None), (None, text("fr"), None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("held", langid.held_out())
    model = langid.fit(df.filter("not held"), langid.default_vocabulary())
    out = {r.doc_id: r for r in langid.predict(df, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert held and np.mean([out[r[0]].lang_pred == r[2] for r in held]) > 0.97
    assert all(out[k].lang_pred == "und" and out[k].score == 0 for k in (900, 901, 902))
    assert out[903].lang_pred in parts and out[None].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in out.values())


def test_nothing_to_learn(empty):
    model = langid.fit(empty, langid.default_vocabulary())
    assert model.langs == [] and langid.predict(empty, model).count() == 0
