"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are made in Arrow batches. The trees are grown on the statistics of SAMPLE labelled rows at
most: values become bins, a level of a tree is one histogram of gradients by node, feature and bin. They are complete trees
in flat arrays, so a batch of rows goes down all trees at once, a level at a time, by numpy.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

#: Labelled rows that the trees are grown on, at most; drawn by a hash of the id.
SAMPLE = 20_000
TREES, LEVELS, BINS = 60, 4, 64
RATE, L2, LEAST_WEIGHT = 0.2, 1.0, 1.0
#: Rows that go down the trees at once.
ROWS = 2048

WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall
#: Classes of bytes whose shares are statistics: each byte is in one.
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\r\x0b\x0c", "line": b"\n", "stop": b".?", "comma": b",;:", "call": b"!", "quote": b"\"'()[]{}-", "symbol": b"#$%&*|<>@^_~`+=/\\"}
STATISTICS = [
    *(f"share_{c}" for c in CLASSES), "share_other", "log_bytes", "log_words", "word_bytes", "longest_word", "distinct_words", "distinct_pairs", "top_word", "top_pair", "log_top_word",
    "marked_words", "capital_words", "short_words", "same_next", "line_words", "distinct_lines", "top_line", "ended_lines", "compressed",
]
_CLASS = np.zeros((256, len(CLASSES) + 1))
for _k, _members in enumerate(CLASSES.values()):
    _CLASS[list(_members), _k] = 1
_CLASS[_CLASS.sum(1) == 0, -1] = 1


def statistics(text: str) -> list[float]:
    """The statistics of one whole text, those of an empty one included. Time and memory are linear in its length."""
    data = text.encode("utf-8", "surrogatepass")
    size, words = len(data), WORDS(data)
    n = len(words)
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASS / max(1, size)
    seen, pairs = Counter(words), Counter(zip(words, words[1:], strict=False))
    top, top_pair = max(seen.values(), default=0), max(pairs.values(), default=0)
    lines = [x for x in data.split(b"\n") if x.strip()]
    each = Counter(lines)
    share = lambda k, of: k / of if of else 0.0
    return [
        *shares,
        np.log1p(size),
        np.log1p(n),
        share(sum(map(len, words)), n),
        np.log1p(max(map(len, words), default=0)),
        share(len(seen), n),
        share(len(pairs), n - 1 if n > 1 else 0),
        share(top, n),
        share(top_pair, n),
        np.log1p(top),
        share(sum(1 for w in words if w[-1] in b"#$%&*|<>@^_~!"), n),
        share(sum(1 for w in words if w.isupper() and len(w) > 1), n),
        share(sum(1 for w in words if len(w) < 3), n),
        share(sum(1 for a, b in zip(words, words[1:], strict=False) if a == b), n),
        share(n, len(lines)),
        share(len(each), len(lines)),
        share(max(each.values(), default=0), len(lines)),
        share(sum(1 for x in lines if x.rstrip()[-1:] in (b".", b"!", b"?")), len(lines)),
        share(len(zlib.compress(data, 1)), size),
    ]


@dataclass(frozen=True)
class Model:
    """Complete trees of LEVELS levels, heap order, a row each: a value over the threshold of its node's feature goes right."""

    base: float
    feature: np.ndarray  # trees x nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of rows of statistics."""
        out = np.full(len(x), self.base)
        trees, nodes = self.feature.shape
        tree = np.arange(trees)[None, :]
        for at in range(0, len(x) if trees else 0, ROWS):
            rows = x[at : at + ROWS]
            one = np.arange(len(rows))[:, None]
            node = np.zeros((len(rows), trees), np.int64)
            while nodes and node[0, 0] < nodes:  # all are on one level
                node = 2 * node + 1 + (rows[one, self.feature[tree, node]] > self.threshold[tree, node])
            out[at : at + ROWS] += self.value[tree, node - nodes].sum(1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -60, 60)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds between bins: midpoints of neighbouring values, or else of quantiles."""
    found = np.unique(column)
    if len(found) > bins:
        found = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="nearest"))
    return (found[1:] + found[:-1]) / 2


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, levels: int = LEVELS, bins: int = BINS, rate: float = RATE) -> Model:
    """Trees for the log-loss of labels y (0 or 1). Without rows the score is 0.5 everywhere; without a split that helps, the
    smoothed share of label 1. Of equal gains the first feature and the lowest threshold are taken."""
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    edges = [_edges(c, bins) for c in x.T] if len(x) else []
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1) if len(x) else np.zeros((0, x.shape[1]), np.int64)
    n_features, nodes, leaves = x.shape[1], 2**levels - 1, 2**levels
    feature, threshold, value = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, leaves))
    raw, cell = np.full(len(y), base), binned + np.arange(n_features) * bins
    for t in range(trees if len(y) else 0):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(levels):
            width, first = 2**level, 2**level - 1
            where = (cell + ((node - first) * n_features * bins)[:, None]).ravel()
            left = [np.bincount(where, np.repeat(v, n_features), width * n_features * bins).reshape(width, n_features, bins).cumsum(2) for v in (g, h)]
            whole = [v[:, :, -1:] for v in left]
            right = [w - v for v, w in zip(left, whole, strict=True)]
            gain = sum(a**2 / (b + L2) for a, b in (left, right)) - whole[0] ** 2 / (whole[1] + L2)
            gain[(left[1] < LEAST_WEIGHT) | (right[1] < LEAST_WEIGHT)] = 0
            best = gain.reshape(width, -1).argmax(1)
            split = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            for k in np.flatnonzero(split):
                f, b = divmod(int(best[k]), bins)
                feature[t, first + k], threshold[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[t, node]] > threshold[t, node])
        leaf = node - nodes
        value[t] = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + L2)
        raw += value[t, leaf]
    return Model(base, feature, threshold, value)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are not learned from: crc32 of the id as text (null: empty) leaves 1 by 3."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _matrix(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(-1, len(STATISTICS))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from labelled rows that are not held out, ``sample`` rows of labels at most (the smallest hashes of their ids, so
    that any partitioning gives the same). Null labels and ids are passed over; an id with several labels counts with each."""
    given = labels.select(F.col(id_col).alias("_t_of"), (F.col(label_col) == 1).cast("int").alias("_t_y")).filter(F.col("_t_of").isNotNull() & F.col("_t_y").isNotNull() & ~held_out("_t_of"))
    chosen = given.orderBy(F.xxhash64("_t_of"), "_t_of", "_t_y").limit(sample)
    known = docs.select(F.col(id_col).alias("_t_id"), text_of(text_col).alias("_t_text")).join(F.broadcast(chosen), F.col("_t_id") == F.col("_t_of"))  # sample rows

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "y": f["y"], "x": list(_matrix(f["text"]))})

    rows = known.select(F.col("_t_id").cast("string").alias("id"), F.col("_t_y").alias("y"), F.col("_t_text").alias("text")).mapInPandas(counted, "id string, y int, x array<double>").limit(2 * sample).toPandas()
    rows = rows.assign(key=[tuple(r) for r in rows.x]).sort_values(["id", "y", "key"])  # sums don't depend on the order that rows come in
    return grow(np.array(rows.x.tolist(), float).reshape(-1, len(STATISTICS)), rows.y.to_numpy(float))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the text, with score (0 to 1, higher: label 1 is likelier) and predicted (1 from a score of 0.5 on).

    Every row of docs has one result, repeated rows too; null texts are empty, and an empty text has statistics like any
    other; whole texts of any length count; an empty table gives an empty result. Columns named as results are replaced.
    """

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(texts)))

    out = docs.withColumn("_t_score", score(text_of(text_col))).drop(text_col, "score", "predicted")
    return out.withColumnRenamed("_t_score", "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op13_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels)
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "score", "predicted")
