"""Best-fit packing of token sequences by bin completion.

Only the lengths matter, and there are at most ``capacity`` of them: the corpus is reduced to a histogram of lengths, a
plan is searched over the histogram on the driver (its size and time depend on the capacity, not on the corpus), and the
pieces are dealt to the plan's places by their rank within their length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, text_of

CAPACITY = 4096
END_ID = 1
#: Runs, and words, whose ids a task remembers (some 200 bytes each).
CACHE = 100_000
#: Rows of a group whose ranks one task counts.
RANK_ROWS = 50_000
#: Nodes that the search may visit, the incumbent being the answer when they are used up; nodes to a best-fit completion.
NODES, BEST_FIT_EVERY = 5_000, 100
#: Rounding functions of the lower bound.
DUALS = 8

Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


# --- tokens -------------------------------------------------------------------------------------------------------

#: How the vocabulary splits a text of white space, ASCII and the usual letters and signs of Latin-1, lower-cased; and what
#: else a text may hold.
RUN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
OTHER = re.compile("[^\\x09-\\x0d\\x20-\\x7eÀ-ÿ¡-§©«¬®°±¶·»¿]|<\\|")


class Runs(dict):
    """run -> its ids as little-endian unsigned 32-bit numbers, found when first asked for."""

    def __init__(self, ids_of):
        super().__init__()
        self.ids_of = ids_of

    def __missing__(self, run):
        if len(self) >= CACHE:
            self.clear()
        ids = self[run] = array("I", self.ids_of(run)).tobytes()
        return ids


class Encoder:
    """A tokenizer of tokenizers that lower-cases, drops white space and never crosses it: runs that it splits a text into
    are encoded once and remembered. What holds characters beyond RUN's goes to the whole tokenizer word by word."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(file)
        model = whole.model
        # Byte-level vocabularies write a byte as its own character if that prints, and as one from 256 on else.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.runs = Runs(lambda run: [t.id for t in model.tokenize(run if run.isascii() else run.encode().decode("latin-1").translate(chars))])
        self.words = Runs(lambda word: whole.encode(word, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if not OTHER.search(text):
            return b"".join(map(self.runs.__getitem__, RUN.findall(text.lower())))
        words = (w.decode() for w in text.encode("utf-8", "replace").split())
        return b"".join(self.words[w] if OTHER.search(w) else self.encode(w) for w in words)


_encoders: dict[str, Encoder] = {}


def encode(texts: list[str], tokenizer_file: str) -> list[bytes]:
    """Ids of each text, as little-endian unsigned 32-bit numbers."""
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = Encoder(tokenizer_file)
    return [_encoders[tokenizer_file].encode(x) for x in texts]


def forget() -> None:
    """At the end of a task: its worker may serve other operators next."""
    for e in _encoders.values():
        e.runs.clear()
        e.words.clear()


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers) and ids
    (an array, if asked for). A document's ids end with END_ID; only a document longer than the capacity is cut. A null
    text counts as empty: it has the one id END_ID."""
    id_type = docs.schema[id_col].dataType
    end = END_ID.to_bytes(4, "little")

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                rows, ids = [], []
                for k, x in enumerate(encode(part.column(1).to_pylist(), tokenizer_file)):
                    x += end
                    for p, at in enumerate(range(0, len(x), 4 * capacity)):
                        ids.append(x[at : at + 4 * capacity])
                        rows.append((k, p, at // 4, len(ids[-1]) // 4, zlib.crc32(ids[-1])))
                which, *numbers = (pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))
                if with_ids:
                    ends = np.append(0, np.cumsum([len(x) // 4 for x in ids]))
                    numbers.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())))
                yield pa.RecordBatch.from_arrays([part.column(0).take(which), *numbers], [id_col, "piece", "start", "length", "ids_crc32", "ids"][: len(numbers) + 1])
        forget()

    fields = f"`{id_col}` {id_type.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(id_col, text_of(text_col).alias("_t_text")).mapInArrow(run, fields)


# --- the plan -----------------------------------------------------------------------------------------------------


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over a histogram: (pattern, number of bins). Bins that are alike are filled together."""
    rooms: list[int] = []  # of open bins, in order
    open_: dict[int, list[list]] = {}  # room -> [pattern, bins]
    for length in sorted(counts, reverse=True):
        left, made, i = counts[length], [], bisect_left(rooms, length)
        while left and i < len(rooms):
            room = rooms[i]
            k, group = room // length, open_[room]
            while left and group:
                pattern, bins = group.pop()
                if n := min(bins, left // k):
                    made.append((room - k * length, (*pattern, (length, k)), n))
                    left, bins = left - n * k, bins - n
                if left and bins:  # fewer than fill a bin
                    made.append((room - left * length, (*pattern, (length, left)), 1))
                    left, bins = 0, bins - 1
                if bins:
                    group.append([pattern, bins])
            if not group:
                del open_[room], rooms[i]
        k = capacity // length
        if left // k:
            made.append((capacity - k * length, ((length, k),), left // k))
        if left % k:
            made.append((capacity - left % k * length, ((length, left % k),), 1))
        for room, pattern, n in made:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append([pattern, n])
    return [(p, n) for group in open_.values() for p, n in group]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: items over half a bin sit alone, and lengths that fit beside none add up."""
    x = np.array(sorted(counts), np.int64)
    n = np.array([counts[k] for k in x.tolist()], np.int64)
    items, sums = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(n * x))
    half = np.searchsorted(x, capacity / 2, side="right")  # lengths from here on are over half
    low = np.append(0, x[:half])
    high = np.maximum(np.searchsorted(x, capacity - low, side="right"), half)  # and from here on fit beside none from low on
    big, mid = items[-1] - items[high], items[high] - items[half]
    room = mid * capacity - (sums[high] - sums[half])
    small = sums[half] - sums[np.searchsorted(x, low, side="left")]
    return max(int((big + mid + np.maximum(0, -(-(small - room) // capacity))).max()), dual_bound(x, n, capacity))


def dual_bound(x: np.ndarray, n: np.ndarray, capacity: int) -> int:
    """Fekete and Schepers' bound by dual feasible functions: lengths below some e count as 0 and those that fit beside
    none of e as a bin, then what is no whole multiple of 1 / (k + 1) of a bin is rounded down to a multiple of 1 / k."""
    best = 0
    for e in (0, *x[2 * x <= capacity].tolist()):
        y = np.where(x > capacity - e, capacity, np.where(x < e, 0, x))
        for k in range(1, DUALS + 1):
            parts = (k + 1) * y
            best = max(best, -(-int(n @ np.where(parts % capacity == 0, k * y, parts // capacity * capacity)) // (k * capacity)))
    return best


def reachable(counts: dict[int, int], capacity: int) -> list[int]:
    """Subset sums: bit s of entry i is set if items of the i least lengths can add up to s, at most the capacity."""
    mask, table = (1 << capacity + 1) - 1, [1]
    for x in sorted(counts):
        sums, left, k = table[-1], min(counts[x], capacity // x), 1
        while left and sums != mask:
            k = min(k, left)
            sums |= sums << k * x & mask
            left, k = left - k, 2 * k
        table.append(sums)
    return table


def undominated(counts: dict[int, int], capacity: int, own: int) -> Iterator[Pattern | None]:
    """All undominated fillings around an item of length ``own``, least waste first, each found without a dead end; None for
    each dominated one that is passed over.

    One is dominated if an item of it can be replaced by a larger item, left over, that still fits (Martello and Toth);
    a filling to which a left-over item can be added is dominated too.
    """
    full = capacity - own
    rest = {x: n - (x == own) for x, n in counts.items() if n > (x == own) and x <= full}
    rising, table = sorted(rest), reachable(rest, full)

    def exact(i: int, left: int) -> Iterator[Pattern]:
        """Items of the i least lengths that add up to left, which is reachable."""
        if not left:
            yield ()
            return
        i = bisect_right(rising, left, 0, i)
        while i and table[i] >> left & 1:
            i -= 1
            x = rising[i]
            for k in range(min(rest[x], left // x), 0, -1):
                if table[i] >> left - k * x & 1:
                    for taken in exact(i, left - k * x):
                        yield ((x, k), *taken)

    def dominated(room: int, taken: Pattern) -> bool:
        used = dict(taken)
        left = lambda y: rest[y] > used.get(y, 0)
        if any(left(y) for y in rising[: bisect_right(rising, room)]):
            return True
        return any(left(y) for x in used for y in rising[bisect_right(rising, x) : bisect_right(rising, x + room)])

    for total in range(full, -1, -1):
        if table[-1] >> total & 1:
            for taken in exact(len(rising), total):
                if total < full and dominated(full - total, taken):
                    yield None
                else:
                    yield tuple(sorted((Counter({own: 1}) + Counter(dict(taken))).items(), reverse=True))


def fillings(counts: dict[int, int], capacity: int, own: int, most: int = 16) -> Iterator[Pattern | None]:
    """What undominated() gives, ``most`` at a time. The table of sums is not held between two of these, but made again
    from counts, which has to be the same whenever the next one is asked for."""
    done = 0
    while part := list(islice(undominated(counts, capacity, own), done, done + most)):
        yield from part
        done, most = done + len(part), 2 * most


def complete(counts: dict[int, int], capacity: int, incumbent: list[tuple[Pattern, int]], bound: int, nodes: float, own: Callable[[dict[int, int]], int]) -> list[tuple[Pattern, int]]:
    """Bin completion: branches over the undominated fillings around an item of length own(counts left), used for as many
    bins at once as the counts allow, or once; prunes a node whose waste shows that it can't beat the incumbent, and
    completes nodes by best fit for new incumbents (each node of up to BEST_FIT_EVERY lengths, and one in as many of the
    others). The search holds one set of counts, which it takes from and gives back to. Any item is in some bin, so each
    choice of it makes an exact search."""
    total = sum(k * n for k, n in counts.items())
    best, best_n, n_done, waste, path, now, seen = incumbent, sum(n for _, n in incumbent), 0, 0, [], dict(counts), 0

    def children():
        for p in fillings(now, capacity, own(now)):
            if p is None:
                yield None
                continue
            most, room = min(now[x] // k for x, k in p), capacity - sum(x * k for x, k in p)
            for bins in dict.fromkeys((most, 1)):
                yield p, bins, room * bins

    stack = [children()]
    while stack and seen < nodes and best_n > bound:
        step = next(stack[-1], ())
        if step is None:  # a dominated filling
            seen += 1
            continue
        beaten = step and (-(-(total + waste + step[2]) // capacity) >= best_n or n_done + step[1] >= best_n)
        if beaten and step[1] > 1:
            continue
        if beaten or not step:  # the fillings that follow waste as much or more
            stack.pop()
            if path:
                p, bins, wasted = path.pop()
                n_done, waste = n_done - bins, waste - wasted
                for x, k in p:
                    now[x] = now.get(x, 0) + k * bins
            continue
        p, bins, wasted = step
        seen += 1
        path.append(step)
        n_done, waste = n_done + bins, waste + wasted
        for x, k in p:
            now[x] -= k * bins
            if not now[x]:
                del now[x]
        rest = best_fit(now, capacity) if now and (len(now) <= BEST_FIT_EVERY or seen % BEST_FIT_EVERY == 0) else []
        if (not now or rest) and n_done + sum(n for _, n in rest) < best_n:
            best = [(q, n) for q, n, _ in path] + rest
            best_n = sum(n for _, n in best)
        stack.append(children() if now else iter(()))
    return best


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int | None = NODES) -> list[tuple[Pattern, int]]:
    """Bins for a histogram {length: items}, as (pattern, number of bins).

    The best-fit plan is the first incumbent. If it has more bins than the lower bound, bin completion searches around
    the most frequent length, which keeps lengths of all sizes to the end, and then around the largest item, with half
    of the nodes each. Without a number of nodes (None) the second search is exact, and takes as long as it takes.
    """
    counts = {k: n for k, n in counts.items() if n}
    if not counts:
        return []
    full = counts.pop(capacity, 0)
    alone = [(((capacity, 1),), full)] if full else []
    if not counts:
        return alone
    best, bound = best_fit(counts, capacity), lower_bound(counts, capacity)
    most = (NODES // 2, float("inf")) if nodes is None else (nodes // 2, nodes // 2)
    for own, n in zip((lambda now: max(now, key=lambda x: (now[x], x)), max), most, strict=True):
        best = complete(counts, capacity, best, bound, n, own)
    return alone + best


def places(found: list[tuple[Pattern, int]]) -> pd.DataFrame:
    """The plan by length: ranks from ``first`` on go to sequences from ``sequence`` on, ``k`` to each, from ``offset`` on."""
    rows, used, sequence = [], Counter(), 0
    for pattern, bins in found:
        offset = 0
        for x, k in pattern:
            rows.append((x, used[x], sequence, k, offset))
            used[x] += k * bins
            offset += k * x
        sequence += bins
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "k", "offset"]).sort_values(["length", "first"])


# --- packing ------------------------------------------------------------------------------------------------------


def pack(pieces: DataFrame, capacity: int = CAPACITY, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces (with length, 1 to capacity) and sequence_id, offset: in as few sequences of the capacity as the search finds.

    pieces is read three times: give a staged table. Rows that are alike are packed each; null keys are allowed; an
    empty table gives an empty result.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    table = places(plan(counts, capacity))
    salts = max(16, -(-sum(counts.values()) // RANK_ROWS))
    salted = pieces.withColumn("_t_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)))
    parts = salted.groupBy("length", "_t_salt").agg(F.count("*").alias("_t_n"))
    before = parts.withColumn("_t_before", F.sum("_t_n").over(Window.partitionBy("length").orderBy("_t_salt").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = salted.withColumn("_t_i", F.row_number().over(Window.partitionBy("length", "_t_salt").orderBy(*keys)) - 1)
    ranked = ranked.join(before.select("length", "_t_salt", F.coalesce("_t_before", F.lit(0)).alias("_t_before")), ["length", "_t_salt"])
    ranked = ranked.withColumn("_t_rank", F.col("_t_before") + F.col("_t_i"))
    step = 1 << 44  # more than the rows of any length
    at = table["length"].to_numpy(np.int64) * step + table["first"].to_numpy(np.int64)
    first, sequence, k, offset = (table[c].to_numpy(np.int64) for c in ("first", "sequence", "k", "offset"))

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        i = np.searchsorted(at, length * step + rank, side="right") - 1
        own = rank - first[i]
        return pd.DataFrame({"sequence_id": sequence[i] + own // k[i], "offset": offset[i] + own % k[i] * length})

    return ranked.withColumn("_t_at", place("length", "_t_rank")).select(*pieces.columns, "_t_at.*")


def packed_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Documents as packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    A null or empty text is a piece of END_ID alone. Texts of any length are encoded whole and only those over the
    capacity are cut. Repeated rows and null ids are packed each; an empty table gives an empty result; other columns,
    whatever their names, are dropped.
    """
    return pack(staged(token_pieces(docs, tokenizer_file, capacity, with_ids=with_ids), "pieces"), capacity)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
