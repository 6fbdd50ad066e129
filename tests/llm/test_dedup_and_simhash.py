import hashlib
import random
import re

import numpy as np
import xxhash

from tessera.llm import exact_dedup, simhash


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def test_exact_dedup_is_brute_force(docs, rows):
    found = exact_dedup.exact_dedup(docs).toPandas()
    groups = {}
    for r in rows:
        groups.setdefault(normal(r[1]), []).append(r[0])
    assert len(found) == len(rows)
    assert found.kept.sum() == len(groups)
    for r in found.itertuples():
        ids = groups[normal(r.text)]
        assert r.text_sha256 == hashlib.sha256(normal(r.text).encode()).hexdigest()
        assert r.group_size == len(ids)
        known = [i for i in ids if i is not None]
        assert (r.keep_id == min(known)) if known else np.isnan(r.keep_id)
    assert found.kept[found.doc_id == 3].sum() == 1  # a repeated row
    assert set(found.columns) == {*docs.columns, "text_sha256", "keep_id", "group_size", "kept"}


def test_exact_dedup_keeps_first_documents(docs, rows):
    kept = exact_dedup.kept_documents(docs)
    assert kept.columns == docs.columns
    found = sorted((normal(r.text), r.doc_id is None, r.doc_id) for r in kept.collect())
    first = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(normal(r[1]), r[0])
    assert found == sorted((t, i is None, i) for t, i in first.items())


def test_rows_that_repeat_ids(spark):
    """One id with several texts, one text with several ids, and rows repeated whole, of both and of null ids."""
    a, b = " ".join(f"alpha{i}" for i in range(40)), " ".join(f"beta{i}" for i in range(40))
    rows = [(1, a), (1, b), (1, a), (2, a), (2, "other text"), (3, b), (3, b), (None, a), (None, "of none"), (None, "of none"), (4, None), (5, ""), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in exact_dedup.kept_documents(df).collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (2, "other text"), (None, "of none"), (4, None)], key=str)
    near = sorted(((r.doc_id, r.text) for r in simhash.kept_documents(df).collect()), key=str)
    assert near == sorted([(1, a), (1, b), (2, "other text"), (4, None), (None, a), (None, "of none"), (None, "of none")], key=str)


def test_empty_tables(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.kept_documents(empty).count() == 0
    assert simhash.near_components(empty).count() == 0
    assert simhash.kept_documents(empty).count() == 0


def test_filters_lose_no_repeat(spark):
    rng = random.Random(1)
    values = [rng.getrandbits(63) for _ in range(3000)]
    values += values[:300] + values[:50] * 20
    h = spark.createDataFrame([(v,) for v in values], "h long").repartition(5)
    bits = exact_dedup.repeated_filter(h, len(values))
    hit = np.ones(len(values), bool)
    for s in exact_dedup.spots(np.array(values, np.int64), len(bits) * 8):
        hit &= (bits[s >> 3] >> (7 - (s & 7)).astype(np.uint8) & 1).astype(bool)
    counts = {v: values.count(v) for v in set(values)}
    assert all(hit[i] for i, v in enumerate(values) if counts[v] > 1)
    assert sum(hit[i] for i, v in enumerate(values) if counts[v] == 1) < 200


def fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(prints, radius=4):
    """Smallest reachable index, by comparing all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints(rows):
    assert all(simhash.fingerprint(r[1] or "") == fingerprint(r[1]) for r in rows)
    assert simhash.fingerprint("İ É ß  x") == fingerprint("İ É ß  x")


def test_near_components_are_brute_force(docs, rows):
    found = {(r.doc_id, r.fp): r.component_id for r in simhash.near_components(docs).collect()}
    known = sorted([r for r in rows if r[0] is not None])
    prints = [fingerprint(r[1]) for r in known]
    for r, p, c in zip(known, prints, components(prints), strict=True):
        assert found[r[0], p - (1 << 64) * (p >> 63)] == known[c][0]
    kept = [r.doc_id for r in simhash.kept_documents(docs).collect()]
    assert sorted(x for x in kept if x is not None) == sorted({known[c][0] for c in components(prints)})


def test_links_lose_nothing(spark, monkeypatch):
    """Clusters, chains and far fingerprints; with a small limit, so that hot keys are dealt by their next bits."""
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for centre in list(prints)[:6]:
        x = centre
        for _ in range(25):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 3, 4, 5])))
            prints.add(x)
    prints = sorted(prints)
    monkeypatch.setattr(simhash, "VARIANTS", 3000)
    fp = np.array(prints, np.uint64)
    key_bits = 12
    some, every = np.unique(fp >> np.uint64(52))[::3], np.arange(4096, dtype=np.uint64)  # these keys get more bits
    longer, longest = np.unique(fp >> np.uint64(40)), np.unique(fp >> np.uint64(28))[::2]
    for hot in ([], [some], [every], [every, longer], [some, longer, longest]):
        emitted = list(simhash._emit(key_bits, 2, hot)([__import__("pyarrow").RecordBatch.from_arrays([fp.view(np.int64), np.arange(len(fp))], ["fp", "rep"])]))
        pairs = {(a, b) for out in simhash._collide(key_bits, 4)(emitted) for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True)}
        assert all(bin(prints[a] ^ prints[b]).count("1") <= 4 for a, b in pairs)
        df = spark.createDataFrame(list(pairs), "a long, b long")
        got = {r.id: r.root for r in simhash.components(df).collect()}
        assert [got.get(i, i) for i in range(len(prints))] == components(prints)


def test_hot_keys(spark, monkeypatch):
    """A cluster in which most fingerprints share their top bits: its keys are found, and the links are the same."""
    rng = random.Random(9)
    prints = sorted({(0xABC << 52) | rng.getrandbits(52) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)})
    prints = sorted({*prints, *(x ^ 0b11 << rng.randrange(62) for x in prints[:60])})
    signed = lambda x: x - (1 << 64) * (x >> 63)
    df = spark.createDataFrame([(signed(x), i) for i, x in enumerate(prints)], "fp long, rep long")
    sent = {}
    for x in prints:
        for m in simhash.masks(12, 2).tolist():
            sent[(x >> 52) ^ m] = sent.get((x >> 52) ^ m, 0) + 1
    found = simhash._hot_keys(df, 12, 2, 100)
    assert set(found[0].tolist()) == {k for k, n in sent.items() if n > 100} != set()
    monkeypatch.setattr(simhash, "TASK_ROWS", 100)
    got = {r.id: r.root for r in simhash.components(simhash.links(df, len(prints))).collect()}
    assert [got.get(i, i) for i in range(len(prints))] == components(prints)


def test_keys_of_one_cluster_are_made_longer(spark, monkeypatch):
    """A third of all fingerprints share their first 44 bits: no key gets over the limit, however many there are, but for those
    of the last level; and the links are the same."""
    rng = random.Random(5)
    prints = sorted({(0xABCDEF12345 << 20) | rng.getrandbits(20) for _ in range(100)} | {rng.getrandbits(64) for _ in range(200)})
    signed = lambda x: x - (1 << 64) * (x >> 63)
    df = spark.createDataFrame([(signed(x), i) for i, x in enumerate(prints)], "fp long, rep long")
    hot = simhash._hot_keys(df, 12, 2, 40)
    assert len(hot) > 2
    sent = df.mapInArrow(simhash._emit(12, 2, hot), simhash.SENT).groupBy("level", "key").count()
    assert max(r["count"] for r in sent.collect() if r.level < 4) <= 40
    monkeypatch.setattr(simhash, "TASK_ROWS", 40)
    got = {r.id: r.root for r in simhash.components(simhash.links(df, len(prints))).collect()}
    assert [got.get(i, i) for i in range(len(prints))] == components(prints)


def test_components_of_a_long_chain(spark):
    n = 60
    order = list(range(n))
    random.Random(2).shuffle(order)
    df = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    assert {r.root for r in simhash.components(df).collect()} == {0}
