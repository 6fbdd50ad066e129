"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for each piece of the vocabulary. The probability of a word sums over all its
segmentations into pieces (forward algorithm); the probabilities are learned by expectation maximisation over the same
segmentations, as Spark jobs over the distinct words of a language.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

#: The words of a text; in the vocabulary a word starts with a mark.
LETTERS = re.compile(r"[^\W\d_]+")
START = "▁"
#: Labelled documents a language that the model is fitted on, about; rounds of expectation maximisation.
SAMPLE, ROUNDS = 2000, 2
#: Up to this length words are fitted many at a time, as their probabilities stay within doubles; longer ones by scaling.
PLAIN = 32
#: Added to each expected count of a piece; probability of a character outside the vocabulary.
SMOOTH, UNKNOWN = 0.05, 1e-7
#: Words whose scores a task remembers (some 150 bytes each), and bytes of these scores, at most; longer words are scored
#: one by one.
CACHE, CACHE_BYTES, LONG = 400_000, 2**26, 80


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def vocabulary(model_file: str) -> list[str]:
    """Lower-case pieces of letters, with or without the mark of a word start."""
    import regex
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    kind = regex.compile(rf"{START}?[\p{{L}}\p{{M}}]+")
    return sorted({p for p in pieces if p == START or (kind.fullmatch(p) and p == p.lower())})


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters."""
    return LETTERS.findall(unicodedata.normalize("NFC", text).lower())


def has_letter(words: list[str]) -> bool:
    """LETTERS also takes superscripts, fractions and the like, which are no letters."""
    return any(map(str.isalpha, words)) or any(c.isalpha() for w in words for c in w)


class Model:
    """Probabilities of pieces under each language: a row of ``probs`` for each piece, one for an unknown character and one for no piece."""

    def __init__(self, langs: list[str], pieces: list[str], probs: np.ndarray):
        self.langs, self.pieces, self.id = langs, pieces, uuid.uuid4().hex
        n = len(langs)
        self.probs = np.concatenate([probs.reshape(len(pieces), n), np.full((1, n), UNKNOWN), np.zeros((1, n))])
        self.longest = max(map(len, pieces), default=1)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "at"}

    def _lookup(self, w: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """For words of one length, the piece that each has from i to j."""
        if not hasattr(self, "at"):
            self.at = {p: k for k, p in enumerate(self.pieces)}
        get, unknown = self.at.get, len(self.pieces)
        return {(i, j): np.array([get(x[i:j], unknown + (j - i > 1)) for x in w]) for j in range(1, len(w[0]) + 1) for i in range(max(0, j - self.longest), j)}

    def _by_length(self, words: list[str], most: int = 20_000):
        lengths: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            lengths.setdefault(len(w), []).append(k)
        for n, ks in lengths.items():
            step = max(1, most // max(1, n // 16) ** 2)
            for a in range(0, len(ks), step):
                yield ks[a : a + step]

    def score(self, words: list[str]) -> np.ndarray:
        """log-probability of each word under each language: the forward algorithm over all segmentations of words of one
        length at a time, scaled at every 20th place."""
        out = np.zeros((len(words), len(self.langs)))
        for ks in self._by_length(words):
            if len(words[ks[0]]) > LONG:
                for k in ks:
                    out[k] = self._score_long(START + words[k])
                continue
            w = [START + words[k] for k in ks]
            ids, n = self._lookup(w), len(w[0])
            alpha, log = [np.ones((len(w), len(self.langs)))], 0.0
            for j in range(1, n + 1):
                alpha.append(sum(alpha[i] * self.probs[ids[i, j]] for i in range(max(0, j - self.longest), j)))
                if j % 20 == 0:
                    scale = np.maximum(alpha[j], 1e-290)
                    log = log + np.log(scale)
                    for k in range(max(0, j - self.longest), j + 1):
                        alpha[k] = alpha[k] / scale
            out[ks] = log + np.log(np.maximum(alpha[n], 1e-300))
        return out

    def _score_long(self, w: str) -> np.ndarray:
        """The same for one word of any length, holding the last places only."""
        self._lookup([START])
        get, unknown, last = self.at.get, len(self.pieces), [np.ones(len(self.langs))]
        log = np.zeros(len(self.langs))
        for j in range(1, len(w) + 1):
            now = sum(last[-k] * self.probs[get(w[j - k : j], unknown + (k > 1))] for k in range(1, len(last) + 1))
            scale = np.maximum(now, 1e-290)
            log += np.log(scale)
            last = [x / scale for x in last[-self.longest + 1 :]] + [now / scale]
        return log

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in words, by language: forward and backward."""
        out = np.zeros((len(self.pieces) + 2, len(self.langs)))
        for ks in self._by_length(words):
            if len(words[ks[0]]) > PLAIN:
                for k in ks:
                    self._expected_long(START + words[k], counts[k], out)
                continue
            w, count = [START + words[k] for k in ks], counts[ks]
            ids, n, one = self._lookup(w), len(w[0]), np.ones((len(ks), len(self.langs)))
            alpha, back = [one], [0 * one] * n + [one]
            for j in range(1, n + 1):
                alpha.append(sum(alpha[i] * self.probs[ids[i, j]] for i in range(max(0, j - self.longest), j)))
            weight = count / np.maximum(alpha[n], 1e-300)
            for j in range(n, 0, -1):
                for i in range(max(0, j - self.longest), j):
                    x = self.probs[ids[i, j]] * back[j]
                    back[i] = back[i] + x
                    x = alpha[i] * x * weight
                    for k in range(len(self.langs)):
                        out[:, k] += np.bincount(ids[i, j], x[:, k], len(out))
        return out[:-2]

    def _expected_long(self, w: str, count: np.ndarray, out: np.ndarray) -> None:
        """Adds the uses in one word of any length. c[j] scales the forward sums at j to 1 in each language, so that a
        piece from i to j weighs p / (c[i+1] ... c[j])."""
        self._lookup([START])
        get, unknown, n, one = self.at.get, len(self.pieces), len(w), np.ones((1, len(self.langs)))
        c = np.ones((n + 1, len(self.langs)))

        def ending(j: int) -> tuple[np.ndarray, np.ndarray]:
            """Pieces that end at j, from the shortest on, and c[j-1], c[j-1] c[j-2], ... before each but the first."""
            m = min(self.longest, j)
            ids = np.array([get(w[j - k : j], unknown + (k > 1)) for k in range(1, m + 1)])
            return ids, np.concatenate([one, np.cumprod(c[j - m + 1 : j][::-1], axis=0)])

        for j in range(1, n + 1):
            ids, scale = ending(j)
            c[j] = np.maximum((self.probs[ids] / scale).sum(axis=0), 1e-290)
        back = np.zeros((n + 1, len(self.langs)))
        back[n] = 1.0
        for j in range(n, 0, -1):
            ids, scale = ending(j)
            uses = self.probs[ids] / scale * (back[j] / c[j])
            back[j - len(ids) : j][::-1] += uses
            np.add.at(out, ids, uses * count)


def fit(docs: DataFrame, model_file: str, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the languages of docs, from about ``sample`` (a documented bound) labelled documents of each, drawn by
    a hash of the id. The driver holds a number for each piece and language."""
    seen = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in seen.groupBy(lang_col).count().collect()}
    langs = sorted(counts)
    pieces = vocabulary(model_file)
    if not langs:
        return Model([], [], np.zeros((0, 0)))
    share = F.create_map(*(x for k in langs for x in (F.lit(k), F.lit(sample / counts[k]))))
    u = F.pmod(F.xxhash64(F.lit("language"), F.col(id_col)), F.lit(1_000_003)) / 1_000_003
    drawn = seen.filter(u < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def split(batches):
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = Counter(words_of(text))
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c)), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])

    words = drawn.mapInArrow(split, "lang string, word string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    words = staged(words.groupBy("word").agg(*(F.coalesce(F.sum(F.when(F.col("lang") == k, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, k in enumerate(langs))).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word"), "words")
    start = np.array([math.exp(-0.5 * len(p)) for p in pieces])
    model = Model(langs, pieces, np.repeat((start / start.sum())[:, None], len(langs), 1))
    n = len(langs)
    for _ in range(ROUNDS):

        def expect(batches, now=model):
            sums = np.zeros((len(now.pieces), n))
            for b in batches:
                sums += now.expected(b.column(0).to_pylist(), np.stack([np.asarray(b.column(i + 1), float) for i in range(n)], 1))
            used = np.flatnonzero(sums.sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *(pa.array(sums[used, i]) for i in range(n))], ["piece", *(f"x{i}" for i in range(n))])

        fields = ", ".join(f"x{i} double" for i in range(n))
        found = words.mapInArrow(expect, f"piece long, {fields}").groupBy("piece").agg(*(F.sum(f"x{i}").alias(f"x{i}") for i in range(n))).collect()
        new = np.full((len(pieces), n), SMOOTH)
        for r in found:
            new[r[0]] += r[1:]
        model = Model(langs, pieces, new / new.sum(axis=0))
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (the posterior of lang_pred at equal priors). A text without letters, or null, is
    ``und`` with score 0; so is every text if no language was learned. Whole texts of any length are scored; every row is
    judged on its own, repeated ones alike, and an empty table gives an empty result. Of languages that are equally likely
    the first by name is taken. Columns named lang_pred or score
    are replaced, others pass through."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # pieces of the vocabulary times languages

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def language(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        known, scores = {}, np.zeros((min(CACHE, CACHE_BYTES // (8 * max(1, len(m.langs)))), len(m.langs)))  # goes with the task
        for texts in series:
            out = []
            for a in range(0, len(texts), 500):
                split = [words_of(x) if x else [] for x in texts.iloc[a : a + 500]]
                new = [w for w in {w for words in split for w in words} if w not in known]
                if len(known) + len(new) > len(scores):
                    known.clear()
                    new = list({w for words in split for w in words})
                many = len(new) > len(scores)  # more new words than are remembered: scores of this part only
                at, table = (known, scores) if not many else ({}, np.zeros((len(new), len(m.langs))))
                if m.langs:
                    table[len(at) : len(at) + len(new)] = m.score(new)
                at.update({w: len(at) + k for k, w in enumerate(new)})
                for words in split:
                    if not m.langs or not words or not has_letter(words):
                        out.append(("und", 0.0))
                        continue
                    total = table[[at[w] for w in words]].sum(axis=0)
                    p = np.exp(total - total.max())
                    i = int(p.argmax())
                    out.append((m.langs[i], float(p[i] / p.sum())))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return docs.drop("lang_pred", "score").withColumn("_t_l", language(F.col(text_col))).select("*", "_t_l.lang_pred", "_t_l.score").drop("_t_l")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(~held_out()), default_vocabulary())
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
