import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing

FILE = public_tokenizers.path("word_bpe_49k.json")


def fewest(items, capacity):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b >= items[i]}.values():
            bins[k] -= items[i]
            go(i + 1, bins)
            bins[k] += items[i]
        go(i + 1, [*bins, capacity - items[i]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best[0]


def test_plan_is_optimal_on_small_cases():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.choice([20, 50, 100])
        counts = dict(Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 10))))
        found = packing.plan(counts, capacity)
        used = Counter()
        for pattern, bins in found:
            assert sum(x * k for x, k in pattern) <= capacity
            used.update({x: k * bins for x, k in pattern})
        assert used == Counter(counts)
        assert sum(n for _, n in found) == fewest(list(Counter(counts).elements()), capacity) >= packing.lower_bound(counts, capacity)


def test_bounds_and_the_exact_way():
    """Where items are many and the incumbent is not optimal at first, without a budget of nodes."""
    rng, sharp = random.Random(6), 0
    for _ in range(120):
        capacity = rng.choice([12, 30])
        counts = dict(Counter(rng.randint(capacity // 6, capacity * 3 // 5) for _ in range(rng.randint(6, 11))))
        want = fewest(list(Counter(counts).elements()), capacity)
        assert sum(n for _, n in packing.plan(counts, capacity, nodes=None)) == want
        x = np.array(sorted(counts))
        dual = packing.dual_bound(x, np.array([counts[k] for k in x.tolist()]), capacity)
        assert dual <= packing.lower_bound(counts, capacity) <= want
        sharp += packing.lower_bound(counts, capacity) == want
    assert sharp > 100


def test_plan_of_triples_that_fill_bins():
    rng, counts, triples = random.Random(1), Counter(), 0
    while triples < 2000:
        a, b = rng.randint(1000, 2040), rng.randint(1000, 2040)
        if 1000 <= (c := 4096 - a - b) <= 2040:
            counts.update((a, b, c))
            triples += 1
    found, used = packing.plan(counts), Counter()
    for pattern, bins in found:
        assert sum(x * k for x, k in pattern) <= 4096
        used.update({x: k * bins for x, k in pattern})
    assert len(counts) > 900 and used == counts
    assert sum(n for _, n in packing.best_fit(counts, 4096)) > 2200 and sum(n for _, n in found) <= 2004


def test_fillings_are_all_undominated_ones():
    counts = {9: 1, 5: 2, 4: 1, 3: 2, 2: 1}
    found = [p for p in packing.fillings(counts, 17, 9, most=1) if p]
    assert [17 - sum(x * k for x, k in p) for p in found] == sorted(17 - sum(x * k for x, k in p) for p in found)
    assert {((9, 1), (5, 1), (3, 1)), ((9, 1), (3, 2), (2, 1))} == set(found) and len(found) == 2


def test_plan_does_not_grow_with_the_corpus():
    counts = {k: 10**9 // k for k in range(1, 4097)}
    found = packing.plan(counts)
    assert len(found) < 20_000
    assert sum(n for _, n in found) <= 1.0001 * -(-sum(k * n for k, n in counts.items()) // 4096)
    assert packing.plan({}) == [] and packing.plan({4096: 5}) == [(((4096, 1),), 5)]


def test_ids_are_the_tokenizer_s(rows):
    texts = [r[1] for r in rows if r[1]] + ["Don't <|endoftext|> <|ENDOFTEXT|> STOP it's naïve ª1st x² 3.14 foo_bar 'tis dogs' ...!?' İstanbul \u00a0 nb", "à́ ß Ÿ ﬁ Ⅷ ½ WE'LL '''s", "¿qué? ×÷ \U0001f600x"]
    whole = Tokenizer.from_file(FILE)
    for text, ids in zip(texts, packing.encode(texts, FILE), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_pack_documents(spark, docs, rows):
    capacity = 256
    found = packing.packed_documents(docs, FILE, capacity, with_ids=True).toPandas()
    whole = Tokenizer.from_file(FILE)
    want = Counter()
    for r in rows:
        ids = [*whole.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for p, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[r[0], p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found.itertuples())
    assert got == want
    assert all(zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in found.itertuples())
    for _, part in found.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *part.length.cumsum()[:-1]] and part.length.sum() <= capacity
    assert found.sequence_id.nunique() <= -(-found.length.sum() // capacity) + 1


def test_pack_empty(empty):
    assert packing.packed_documents(empty, FILE).count() == 0


@pytest.mark.parametrize("salts", [1, 50])
def test_ranks_over_many_salts(spark, salts, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", max(1, 600 // salts))
    rows = [(i, 0, 3 if i % 3 else 1000) for i in range(600)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, length long"), 4096).toPandas()
    assert len(found) == 600 and found.sequence_id.nunique() == 50
    assert not found.duplicated(["sequence_id", "offset"]).any()
