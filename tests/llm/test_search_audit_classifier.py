import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import audit, classifier, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k):
    """item -> [(doc, score)], from the definition. docs: (id, text); items: (id, text)."""
    own = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = {}
    for i, q in asked.items():
        scores = []
        for doc, c in own:
            n = sum(c.values())
            m = 100 - 25 + 25 * n * n_docs // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in q.items() if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc, score))
        if scores:
            out[i] = [(d, s) for _, _, d, s in sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k]]
    return out


@pytest.mark.parametrize(("segment", "block"), [(search.SEGMENT, search.BLOCK_BYTES), (150, 2000), (40, 10)])
def test_search_is_brute_force(spark, docs, rows, segment, block):
    """Whole texts, repeated rows and ids, nulls, ties; segments of few terms; items in one block, in several, each in its own."""
    rng = random.Random(4)
    said = [t for _, t, *_ in rows if t]
    items = [(i, " ".join(rng.sample(rng.choice(said).split() or ["x"], 1)[0].upper() if rng.random() < 0.3 else rng.choice(rng.choice(said).split() or ["y"]) for _ in range(rng.randint(1, 9)))) for i in range(30)]
    items += [(30, None), (31, ""), (32, "--- ..."), (33, "no-such-term-at-all"), (34, "word word WORD"), (35, "x" * 3000), (3, "more terms for three"), (None, "one of none"), (36, "Wörd ÉTÉ été 123")]
    asked = spark.createDataFrame([(i, t, 5, 1.0) for i, t in items], "item_id long, text string, rank int, score double")
    index = search.stored(search.postings(docs, segment=segment))
    found = search.search(asked, index, 7, block=block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    got = {}
    for r in sorted(found.collect(), key=lambda r: (str(r.item_id), r["rank"])):
        got.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r["rank"] == len(got[r.item_id])
    assert got == ranked([(r[0], r[1]) for r in rows], items, 7)


def test_search_of_nothing(spark, docs, empty):
    asked = spark.createDataFrame([(1, "one")], "item_id int, text string")
    assert search.search(asked, search.stored(search.postings(empty))).count() == 0
    assert search.search(asked.limit(0), search.stored(search.postings(docs))).count() == 0


def test_search_takes_names_that_clash(spark):
    d = spark.createDataFrame([("b", "alpha beta"), ("a", "beta alpha"), ("c", "gamma")], "term string, body string")
    q = spark.createDataFrame([(1, "alpha", 2), (2, "gamma delta", 3)], "segment int, ask string, weight int")
    got = search.search(q, search.stored(search.postings(d, "term", "body")), 5, "segment", "ask", "term").collect()
    assert sorted((r.segment, r["rank"], r.term) for r in got) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]


def fails(rows):
    """Flags A to E of (id, text, part) rows."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, _ in rows:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        copy = t in first and (i is None or i > first[t])
        out.append((len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), copy))
    return out


def audited(rows, good, toxic):
    """(part, order, step) -> the counts, by applying the filters one after another."""
    flags, out, shares = fails(rows), {}, Counter()
    for part in {p or "" for _, _, p in rows}:
        mine = [(r[0], f) for r, f in zip(rows, flags, strict=True) if (r[2] or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order):
                k = "ABCDE".index(letter)
                gone = [x for x in left if x[1][k]]
                left = [x for x in left if not x[1][k]]
                failing = [x for x in mine if x[1][k]]
                out[part, "".join(order), step + 1] = (len(left), len(gone), len(failing) - len(gone), sum(sum(x[1]) == 1 for x in failing), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone))
                shares[part, letter] += len(gone)
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_is_brute_force(spark, docs, rows):
    """Nulls in every column, copies, repeated rows and ids, clashing names, labels that repeat, contradict or fit nothing."""
    odd = spark.createDataFrame([(900, "A#B C! " * 30, "z"), (901, "Some Words " * 60, ""), (902, "Some Words " * 60, "z"), (903, "lower | case " * 9, None)], "doc_id long, text string, source string")
    both = docs.unionByName(odd, allowMissingColumns=True).selectExpr("*", "1 AS part", "2 AS n", "true AS A", "'x' AS letter", "3 AS mask")
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(40)] + [(0, 1, False), (None, 1, True), (5000, 1, True), (901, None, None), (902, 1, None)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "cast(toxic AS int) AS toxic", "7 AS good")
    got = audit.audit(both, labels)
    plain = [(r.doc_id, r.text, r.source) for r in both.collect()]
    good, toxic = {0, 902, *(i for i in range(40) if i % 2)}, {i for i in range(40) if i % 3 == 0}
    want = audited(plain, good, toxic)
    found = {(r["part"], r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got.collect()}
    assert found == want and len(found) == got.count() == 600 * len({p or "" for _, _, p in plain})
    assert audit.audit(both.limit(0), labels).count() == 0
    assert sum(r.good_lost for r in audit.audit(both, labels.limit(0)).collect()) == 0


def walked(model, tree, row):
    node, nodes = 0, model.feature.shape[1]
    while node < nodes:
        node = 2 * node + (2 if row[model.feature[tree, node]] > model.threshold[tree, node] else 1)
    return model.value[tree, node - nodes]


def test_trees_in_arrays_are_walked_one_by_one():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6)).round(2)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = classifier.grow(x, y, trees=20)
    assert [model.base + sum(walked(model, t, r) for t in range(20)) for r in x[:200]] == pytest.approx(model.raw(x[:200]))
    assert ((model.score(x) >= 0.5) == y).mean() > 0.97
    fresh = rng.normal(size=(3000, 6))
    assert ((model.score(fresh) >= 0.5) == ((fresh[:, 0] > 0.3) ^ (fresh[:, 3] < -0.2))).mean() > 0.95


def test_first_split_is_brute_force():
    """Of all features and thresholds, the root takes the one of the largest gain."""
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 30, (400, 4)).astype(float), rng.integers(0, 2, 400).astype(float)
    x[:, 2] += 8 * y
    model = classifier.grow(x, y, trees=1, levels=1)
    p = 1 / (1 + np.exp(-model.base))
    part = lambda m: (p - y[m]).sum() ** 2 / (m.sum() * p * (1 - p) + classifier.L2)
    gains = {(f, (a + b) / 2): part(x[:, f] <= a) + part(x[:, f] > a) for f in range(4) for a, b in itertools.pairwise(np.unique(x[:, f])) if min((x[:, f] <= a).sum(), (x[:, f] > a).sum()) * p * (1 - p) >= classifier.LEAST_WEIGHT}
    assert (model.feature[0, 0], model.threshold[0, 0]) == max(gains, key=gains.get)


def test_trees_of_little():
    none = classifier.grow(np.zeros((0, 3)), np.zeros(0))
    assert none.score(np.zeros((2, 3))) == pytest.approx([0.5, 0.5])
    same = classifier.grow(np.ones((50, 3)), np.r_[np.ones(40), np.zeros(10)])
    assert same.score(np.ones((1, 3)))[0] == pytest.approx(0.8, abs=0.02)
    assert (classifier.grow(np.ones((9, 2)), np.ones(9)).score(np.zeros((1, 2))) > 0.5).all()


def test_statistics_of_texts():
    names = classifier.STATISTICS
    for text in ("", "   ", "\n\n", "a", "é", "\ud800", "word " * 400_000):
        found = classifier.statistics(text)
        assert len(found) == len(names) and np.isfinite(found).all()
    s = dict(zip(names, classifier.statistics("Ab ab, ab# x\nab ab, ab# x\n"), strict=True))
    assert s["distinct_words"] == 5 / 8 and s["top_word"] == 2 / 8 and s["distinct_lines"] == 1.0 and s["marked_words"] == 2 / 8 and s["share_line"] == 2 / 26
    assert sum(s[f"share_{c}"] for c in (*classifier.CLASSES, "other")) == pytest.approx(1)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    found = classifier.op13_classify(spark, sf)
    assert found.count() == d.count() and found.filter("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.5 AS int)").isEmpty()
    r = found.join(labels, "doc_id").filter("held_out").selectExpr("count(*) AS n", "avg(cast(predicted = quality AS double)) AS right").first()
    assert r.n > 100 and r.right > 0.97
    again = classifier.op13_classify(spark, sf)
    assert again.exceptAll(found).isEmpty()


def test_classifier_edges(spark, docs, empty):
    """Nulls, repeated rows, clashing names, no labels, no documents; a bounded sample doesn't depend on the partitioning."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0), (None, 1), (2, None), (9999, 1)], "doc_id long, quality int")
    model = classifier.fit(docs, labels, sample=25)
    other = classifier.fit(docs.repartition(7), labels.repartition(5), sample=25)
    assert (model.value == other.value).all() and (model.threshold == other.threshold).all()
    out = classifier.predict(docs, model)
    assert set(out.columns) == {*docs.columns, "predicted"} - {"text"} and out.count() == docs.count() and out.filter("score between 0 and 1").count() == docs.count()
    assert classifier.predict(empty, model).count() == 0
    blank = classifier.fit(docs, labels.limit(0))
    assert {r.score for r in classifier.predict(docs, blank).collect()} == {0.5}
    assert classifier.fit(empty, labels).base == 0.0
