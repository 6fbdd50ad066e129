"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most R bits share a variant within R/2 bits of both, and all fingerprints that share
such a variant differ in at most R bits. So every distinct fingerprint emits its ball of variants, equal variants meet,
and a star from the first fingerprint at a variant gives all links without pairs. The 2081 variants of a fingerprint
(R = 4) are sent in bundles: a variant's top KEY_BITS bits are the shuffle key, a fingerprint goes once to each key that
one of its variants has (79 keys for 12 bits), and the task that owns the key makes the rest of each variant. Keys that
would get too many fingerprints are counted first and made of 12 more bits, and of 12 more again, until they don't.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, text_of, with_group
from .filters import split

SEED = 42
#: Variants that a task holds at a time (4 MB, and some such arrays), and rows of a task of the variants' shuffle.
VARIANTS = 500_000
TASK_ROWS = 500_000
#: Bits that a hot key has more on each level, and what is sent.
MORE_BITS = 12
SENT = "level int, key long, fp long, rep long"


def fingerprint(text: str, words: int = 4) -> int:
    """64-bit SimHash: a bit is set if it is set in over half the shingles' XXH64; 0 for a text without words."""
    import xxhash

    line = b" ".join(text.encode("utf-8", "surrogatepass").lower().split())  # bytes: only A-Z are lowered, only ASCII space splits
    if not line:
        return 0
    ends = np.append(np.flatnonzero(np.frombuffer(line, np.uint8) == 32), len(line))
    starts = np.append(0, ends[:-1] + 1)
    k = min(words, len(ends))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[: len(starts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fp") -> DataFrame:
    """docs and the SimHash of the whole text as a (signed) long. A null text is empty."""

    @F.pandas_udf("long")
    def simhash(texts):
        return texts.__class__(np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64))

    return docs.withColumn(name, simhash(text_of(text_col)))


@lru_cache(64)
def masks(bits: int, flips: int) -> np.ndarray:
    """All masks of up to ``flips`` (0 to 4) set bits among the low ``bits`` bits."""
    out = level = [(0, -1)]
    for _ in range(flips):
        level = [(m | 1 << b, b) for m, last in level for b in range(last + 1, bits)]
        out = out + level
    return np.array([m for m, _ in out], np.uint64)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def _ball(values, owners, flips, free):
    """Variants of values (their owners beside them) in the low ``free`` bits, by up to flips[i] flips."""
    v, o = [], []
    for r in np.unique(flips):
        m, of = masks(free, int(r)), flips == r
        v.append((values[of][:, None] ^ m[None, :]).ravel())
        o.append(np.repeat(owners[of], len(m)))
    return np.concatenate(v), np.concatenate(o)


def _meet(values, owners, flips, free, links: list) -> None:
    """Adds a link from the first owner of a variant to each other. Too many variants are dealt by their next bits."""
    sizes = np.array([len(masks(free, r)) for r in range(int(flips.max()) + 1)])
    if sizes[flips].sum() > VARIANTS and free > 8:
        low = np.uint64(free - 6)
        part = (values >> low) & np.uint64(63)
        for s in range(64):
            left = flips - _popcount(part ^ np.uint64(s))
            if (of := left >= 0).sum() > 1:
                _meet((values[of] & ~(np.uint64(63) << low)) | (np.uint64(s) << low), owners[of], left[of], free - 6, links)
        return
    v, o = _ball(values, owners, flips, free)
    ordered = np.sort(v)
    met = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(met):
        return
    at = np.minimum(np.searchsorted(met, v), len(met) - 1)
    hit = met[at] == v
    at, o = at[hit], o[hit]
    order = np.lexsort((o, at))
    at, o = at[order], o[order]
    first = np.append(True, at[1:] != at[:-1])
    head = o[first][np.cumsum(first) - 1]
    links.append(np.unique(np.stack([head[~first], o[~first]], 1), axis=0))


def _forest(links: np.ndarray) -> np.ndarray:
    """Of links between row numbers, those that join what was apart."""
    root: dict[int, int] = {}

    def find(x):
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    keep = []
    for i, (a, b) in enumerate(links.tolist()):
        if (a := find(a)) != (b := find(b)):
            root[max(a, b)] = min(a, b)
            keep.append(i)
    return links[keep]


def _emit(key_bits: int, flips: int, hot: list[np.ndarray] = (), only: int | None = None):
    """(level, key, fp, rep) for each key of a variant. The keys of level 0 have key_bits bits; those in hot[0] are followed by their
    next MORE_BITS bits instead (level 1), of these those in hot[1] again, and so on. ``only``: rows of that level."""

    def batch(level, key, fp, rep):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), level, np.int32)), pa.array(key.view(np.int64)), pa.array(fp), pa.array(rep)], ["level", "key", "fp", "rep"])

    def run(batches):
        ms, step = masks(key_bits, flips), 2000 if hot else 20_000
        used = _popcount(ms)
        for b in batches:
            for i in range(0, b.num_rows, step):
                fp, rep = (np.asarray(b.column(c))[i : i + step] for c in (0, 1))
                top = fp.view(np.uint64) >> np.uint64(64 - key_bits)
                key, left = (top[:, None] ^ ms[None, :]).ravel(), np.tile(flips - used, len(fp))
                fp, rep = np.repeat(fp, len(ms)), np.repeat(rep, len(ms))
                for level in range(len(hot) + 1):
                    warm = np.isin(key, hot[level]) if level < len(hot) else np.zeros(len(key), bool)
                    if only in (None, level) and not warm.all():
                        yield batch(level, key[~warm], fp[~warm], rep[~warm])
                    if not warm.any():
                        break
                    free = np.uint64(64 - key_bits - MORE_BITS * (level + 1))
                    longer = []
                    for r in np.unique(left[warm]):
                        of, nexts = warm & (left == r), masks(MORE_BITS, int(r))
                        own = fp[of].view(np.uint64) >> free & np.uint64(2**MORE_BITS - 1)
                        more = (key[of] << np.uint64(MORE_BITS))[:, None] | (own[:, None] ^ nexts[None, :])
                        longer.append((more.ravel(), np.tile(int(r) - _popcount(nexts), len(own)), np.repeat(fp[of], len(nexts)), np.repeat(rep[of], len(nexts))))
                    key, left, fp, rep = (np.concatenate(x) for x in zip(*longer, strict=True))

    return run


def _collide(key_bits: int, radius: int):
    """Links among the fingerprints of each key, from the rows of a task."""

    def met(key, bits, fp, links):
        """Adds links (row numbers) of rows sorted by key, whose keys are prefixes of so many bits."""
        free = 64 - bits
        flips = radius // 2 - _popcount((fp >> np.uint64(free)) ^ key)
        values = (key << np.uint64(free)) | (fp & np.uint64(2**free - 1))
        sizes = np.array([len(masks(free, r)) for r in range(radius // 2 + 1)])[flips]
        ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
        sums, begin, last = np.append(0, np.cumsum(sizes)), 0, 0
        for end in ends.tolist():  # whole keys, as many as may be held at a time
            if sums[end] - sums[begin] > VARIANTS and last > begin:
                _meet(values[begin:last], np.arange(begin, last), flips[begin:last], free, links)
                begin = last
            last = end
        _meet(values[begin:last], np.arange(begin, last), flips[begin:last], free, links)

    def run(batches):
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        t = pa.Table.from_batches(found)
        level, key, fp, rep = (np.asarray(t.column(c).combine_chunks()) for c in range(4))
        pairs = []
        for k in np.unique(level).tolist():
            of = np.flatnonzero(level == k)
            prefix = key[of].view(np.uint64)
            of = of[np.argsort(prefix, kind="stable")]
            links: list = []
            met(np.sort(prefix, kind="stable"), key_bits + MORE_BITS * k, fp[of].view(np.uint64), links)
            pairs += [of[x] for x in links]
        if not pairs:
            return
        pairs, fp = np.concatenate(pairs), fp.view(np.uint64)
        pairs = pairs[np.bitwise_count(fp[pairs[:, 0]] ^ fp[pairs[:, 1]]) <= radius]  # verification
        ids = np.unique(rep, return_inverse=True)
        pairs = _forest(np.unique(ids[1][pairs], axis=0))
        a, b = ids[0][pairs[:, 0]], ids[0][pairs[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _hot_keys(prints: DataFrame, key_bits: int, flips: int, limit: int) -> list[np.ndarray]:
    """For each level the keys that more than ``limit`` fingerprints would be sent to: fewer than those sent by ``limit``. Keys of
    level 0 are counted by the fingerprints' own, longer ones as they would be sent. The last level leaves 4 to 15 bits, so that few
    different fingerprints can share its keys."""
    top = F.shiftrightunsigned("fp", 64 - key_bits).cast("int")
    tops = prints.groupBy(top.alias("top")).agg(F.count("*").alias("n"))
    ms = F.array(*(F.lit(int(m)).cast("int") for m in masks(key_bits, flips)))
    keys = tops.select(F.explode(F.transform(ms, lambda m: m.bitwiseXOR(F.col("top")))).alias("key"), "n").groupBy("key").agg(F.sum("n").alias("n"))
    hot: list[np.ndarray] = []
    while True:
        found = np.array([r[0] for r in keys.filter(F.col("n") > limit).select("key").collect()], np.int64).view(np.uint64)
        if not len(found):
            return hot
        hot.append(np.sort(found))
        if key_bits + MORE_BITS * (len(hot) + 1) > 60:
            return hot
        sent = prints.select("fp", "rep").mapInArrow(_emit(key_bits, flips, hot, len(hot)), SENT)
        keys = sent.groupBy("key").agg(F.count("*").alias("n"))


def links(prints: DataFrame, n: int, radius: int = 4) -> DataFrame:
    """Links (a, b) of ids that connect what is within ``radius`` (even) bits: prints has distinct fp (long) and rep (long).

    Each task gives a forest of the links it has found, so there are fewer links than rows sent. A key is made longer until no
    more than TASK_ROWS fingerprints are sent to it, whatever the corpus; keys start so long that even ones have an eighth.
    """
    flips, key_bits = radius // 2, 12
    while n * len(masks(key_bits, flips)) > 2**key_bits * TASK_ROWS / 8:
        key_bits += 1
    hot = _hot_keys(prints, key_bits, flips, TASK_ROWS)
    tasks = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * len(masks(key_bits, flips)) // TASK_ROWS))
    return prints.select("fp", "rep").mapInArrow(_emit(key_bits, flips, hot), SENT).repartition(tasks, "level", "key").mapInArrow(_collide(key_bits, radius), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable over edges (a, b), for ids with an edge. Alternating large and small stars;
    what is looked up for an id with many edges is broadcast (with_group), so that no task gets all of them."""
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = staged(edges, "links"), None
    counted = lambda: tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = counted()
    while now != before:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = with_group(both.filter("b > a"), low, "a", "n", 2 * now[0]).select(F.col("b").alias("a"), F.col("m").alias("b"))  # to larger neighbours
        large = staged(large.unionByName(low.filter("m < a").select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = with_group(large, least, "a", "n", 2 * now[0]).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))  # to smaller ones
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = staged(small, "links")
        now = counted()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """(id, fp, component_id) for each row of docs. component_id: smallest id reachable over links, its own included.

    A null text counts as empty (fingerprint 0, linked like any other). A row with a null id gets the component of its
    fingerprint's other rows. Repeated rows each get a row. An empty table gives an empty result. A text of any length is read
    whole in its own task, which holds 8 bytes for each of its words; then only its fingerprint is used.
    """
    n_rows = docs.count()
    rows = staged(with_fingerprint(docs.select(id_col, text_col), text_col).select(id_col, "fp"), "simhash")
    prints = staged(rows.groupBy("fp").agg(F.min(id_col).alias("rep"), F.count("*").alias("_t_n")), "prints")
    linked = components(links(prints.filter("rep is not null"), prints.count(), radius))
    of = prints.join(linked, F.col("rep") == F.col("id"), "left").select("fp", F.coalesce("root", "rep").alias("component_id"), "_t_n")
    return with_group(rows, of, "fp", "_t_n", n_rows).drop("_t_n")


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the rows of docs with its smallest id; of rows that repeat id and text one. Rows without an id
    stay. A null text counts as empty; an empty table gives an empty result.

    Texts shuffle only where they may go: rows whose id is not in a filter of the ids that lose or repeat pass straight
    through; the others are staged, so that a task has one Python worker, fingerprinted again and looked up.
    """
    found = near_components(docs, id_col, text_col).filter(F.col(id_col).isNotNull())
    each = found.groupBy(F.col(id_col).alias("_t_id"), F.col("fp").alias("_t_of")).agg(F.count("*").alias("_t_n"), F.min("component_id").alias("_t_root"))
    each = each.withColumn("_t_loses", F.col("_t_id") != F.col("_t_root"))
    gone = staged(each.filter("_t_loses or _t_n > 1").select("_t_id", "_t_of", "_t_loses"), "losers")
    looked, passed = split(docs, F.xxhash64(id_col), gone.select(F.xxhash64("_t_id")))
    looked = with_fingerprint(staged(looked, "looked"), text_col, "_t_fp").withColumn("_t_h", F.sha2(text_of(text_col), 256))
    looked = looked.join(gone, (F.col(id_col) == F.col("_t_id")) & (F.col("_t_fp") == F.col("_t_of")), "left")
    stay = looked.filter(F.col("_t_loses").isNull()).unionByName(looked.filter("not _t_loses").dropDuplicates([id_col, "_t_h"]))
    return passed.unionByName(stay.select(docs.columns))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
