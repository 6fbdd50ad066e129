"""Quality rules: per-document statistics, then robust multivariate outliers of each language and source.

The statistics of a document are transformed to a vector; location and scatter of each (language, source) come from the
minimum covariance determinant, and a vector too far from them by Mahalanobis distance is rejected. DataFrame functions
only: a concentration step is one pass that sums counts, vectors and products by group and distance bin.

Estimates of a group are shrunk: PRIOR rows of its language's are added to its own, and as many of all rows' to those of a
language. So a group of any size has its own estimates, and a small one leans on its language.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, n_words, staged, text_of, with_group

WINDOW = 5
MIN_WORDS = 10
MOST_REPEATED = 20  # percent
#: Components of the vector, quantiles of chi-square with that many degrees of freedom: 0.975, and the cutoff's 0.9999.
P, WEIGHED, CUTOFF = 5, 12.8325, 25.745
#: Least standard deviation of each component: most are zero in most documents, and one line that repeats is no fault.
FLOORS = (0.05, 0.05, 0.05, 0.15, 0.15)
#: Rows of the language's estimates that a group's are shrunk with.
PRIOR = 50
#: Concentration goes on until the log-determinant of no group's factor falls by as much; steps at most (some 6 are usual).
FALL, STEPS = 0.01, 50
#: Distance bins to a factor of e, and value bins to a unit for the medians.
BINS = 32
VALUE_BINS = 200
#: Groups whose parameters (some 300 bytes each) are broadcast; with more only hot groups' are, and the join may shuffle.
BROADCAST_GROUPS = 20_000


def chi_square(x: float) -> tuple[float, float]:
    """The distribution functions of chi-square with 5 and 7 degrees of freedom."""
    tail = math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    five = math.erf(math.sqrt(x / 2)) - tail * (1 + x / 3)
    return five, five - tail * x * x / 15


def consistency(share: float) -> float:
    """What the covariance of the share of rows nearest to the middle is multiplied by to be that of all normal rows."""
    low, high = 0.0, 100.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid)[0] < share else (low, mid)
    return share / chi_square(low)[1]


def _count(text: Column, but: str) -> Column:
    return F.length(F.regexp_replace(text, but, "")).cast("long")


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and _t_upper, _t_lines. A null text is empty.

    Lines and 5-word windows are compared by their 64-bit hashes.
    """
    t = F.col("_t_text")
    df = docs.withColumn("_t_text", text_of(text_col))
    df = df.withColumns(
        {
            "n_words": n_words(t),
            "word_chars": _count(t, SPACE),
            "n_symbols": _count(t, r"[^#*$%&|<>]+"),
            "_t_upper": _count(t, r"\P{Lu}+"),
            "_t_lh": F.transform(F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)), lambda x: F.xxhash64(x)),
            "_t_wh": F.transform(F.filter(F.split(t, SPACE), lambda x: x != ""), lambda x: F.xxhash64(x)),
        }
    ).drop("_t_text")
    none = F.array().cast("array<bigint>")
    lines = F.size("_t_lh")
    window = F.transform(F.sequence(F.lit(0), F.size("_t_wh") - WINDOW), lambda i: F.xxhash64(*(F.get("_t_wh", i + k) for k in range(WINDOW))))
    df = df.withColumns({"_t_lines": lines.cast("long"), "n_dup_lines": (lines - F.size(F.array_distinct("_t_lh"))).cast("long"), "_t_win": F.when(F.size("_t_wh") >= WINDOW, window).otherwise(none)}).drop("_t_lh", "_t_wh")
    repeats = F.size(F.array_distinct("_t_win")) < F.size("_t_win")  # most documents stop here
    df = df.withColumn("_t_sorted", F.when(repeats, F.sort_array(F.transform("_t_win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_t_win")
    near = lambda k: F.get("_t_sorted", k)["h"]
    starts = F.filter("_t_sorted", lambda e, k: F.coalesce(e["h"] == near(k - 1), F.lit(False)) | F.coalesce(e["h"] == near(k + 1), F.lit(False)))
    df = df.withColumn("_t_starts", F.sort_array(F.transform(starts, lambda e: e["i"]))).drop("_t_sorted")
    covered = F.aggregate("_t_starts", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")), lambda a, s: F.struct((a["n"] + F.least(F.lit(WINDOW), s - a["at"])).alias("n"), s.alias("at")))
    return df.withColumn("n_repeat_words", F.coalesce(covered["n"], F.lit(0)).cast("long")).drop("_t_starts")


def vector() -> list[Column]:
    """The transformed statistics. Added words keep short texts near the middle."""
    c = F.col
    return [
        F.log((c("word_chars") + 100) / (c("n_words") + 20)),
        F.sqrt(c("n_symbols") / (c("n_words") + 20)),
        F.sqrt(c("_t_upper") / (c("word_chars") + 100)),
        F.sqrt(c("n_dup_lines") / (c("_t_lines") + 10)),
        F.sqrt(c("n_repeat_words") / (c("n_words") + 20)),
    ]


X, M = [f"_t_x{i}" for i in range(P)], [f"_t_m{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _beside(rows: DataFrame, groups: DataFrame, key: str, n: int) -> DataFrame:
    """rows and what groups has for their key: n groups, of which each is in rows."""
    if n <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), key)
    sizes = rows.groupBy(key).agg(F.count("*").alias("_t_rows"))
    return with_group(rows, groups.join(sizes, key), key, "_t_rows", rows.count()).drop("_t_rows")


def _sums() -> list[Column]:
    return [F.count("*").alias("_t_n"), *(F.sum(x).alias(f"_t_s{i}") for i, x in enumerate(X)), *(F.sum(F.col(X[i]) * F.col(X[j])).alias(f"_t_q{i}{j}") for i, j in PAIRS)]


FACTOR = [*M, *(f"_t_l{i}{j}" for i, j in PAIRS)]
SUMS = ["_t_n", *(f"_t_s{i}" for i in range(P)), *(f"_t_q{i}{j}" for i, j in PAIRS)]


def _estimate(sums: DataFrame, keys: list[str], scale: Column) -> DataFrame:
    """Mean and the Cholesky factor of scale * covariance + FLOORS^2, from counts, sums and products."""
    n = F.col("_t_n")
    df = sums.withColumns({M[i]: F.col(f"_t_s{i}") / n for i in range(P)})
    df = df.withColumns({f"_t_c{i}{j}": scale * (F.col(f"_t_q{i}{j}") / n - F.col(M[i]) * F.col(M[j])) + (FLOORS[i] ** 2 if i == j else 0) for i, j in PAIRS})
    return _factor(df, keys)


def _factor(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, means, _t_l (Cholesky factor of the _t_c columns) and _t_det (log of its determinant)."""
    for i, j in PAIRS:  # row by row; a positive floor on the diagonal keeps rounding from making it singular
        rest = F.col(f"_t_c{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"_t_l{i}{k}") * F.col(f"_t_l{j}{k}")
        df = df.withColumn(f"_t_l{i}{j}", F.sqrt(F.greatest(rest, F.lit(min(FLOORS) ** 2 / 100))) if i == j else rest / F.col(f"_t_l{j}{j}"))
    det = sum((F.log(F.col(f"_t_l{i}{i}")) for i in range(P)), F.lit(0.0))
    return df.select(*keys, *M, *(f"_t_l{i}{j}" for i, j in PAIRS), det.alias("_t_det"))


def _distance(rows: DataFrame) -> DataFrame:
    """rows (vector, mean and factor) with the squared Mahalanobis distance _t_d2."""
    for i in range(P):
        rest = F.col(X[i]) - F.col(M[i])
        for k in range(i):
            rest = rest - F.col(f"_t_l{i}{k}") * F.col(f"_t_y{k}")
        rows = rows.withColumn(f"_t_y{i}", rest / F.col(f"_t_l{i}{i}"))
    return rows.withColumn("_t_d2", sum((F.col(f"_t_y{i}") * F.col(f"_t_y{i}") for i in range(P)), F.lit(0.0)))


def _medians(rows: DataFrame, n_groups: int) -> DataFrame:
    """A start: medians, and squared scaled median distances to them as a diagonal covariance."""

    def middle(values: list[Column], of: DataFrame, names: list[str]) -> DataFrame:
        """The median of each value by group, a column each: the middle of the bin in which it falls."""
        long = of.select("_t_g", F.posexplode(F.array(*values)).alias("_t_i", "_t_v"))
        bins = long.groupBy("_t_g", "_t_i", F.floor(F.col("_t_v") * VALUE_BINS).alias("_t_b")).agg(F.count("*").alias("_t_k"))
        by = Window.partitionBy("_t_g", "_t_i")
        run = bins.withColumns({"_t_c": F.sum("_t_k").over(by.orderBy("_t_b")), "_t_all": F.sum("_t_k").over(by)}).filter(2 * F.col("_t_c") >= F.col("_t_all"))
        return run.groupBy("_t_g").agg(*(((F.min(F.when(F.col("_t_i") == i, F.col("_t_b"))) + 0.5) / VALUE_BINS).alias(name) for i, name in enumerate(names)))

    med = staged(middle([F.col(x) for x in X], rows, M), "medians")
    spread = [f"_t_d{i}" for i in range(P)]
    mad = middle([F.abs(F.col(x) - F.col(m)) for x, m in zip(X, M, strict=True)], _beside(rows, med, "_t_g", n_groups), spread)
    diagonal = {f"_t_c{i}{j}": F.pow(1.4826 * F.col(spread[i]), 2) + FLOORS[i] ** 2 if i == j else F.lit(0.0) for i, j in PAIRS}
    return _factor(med.join(mad, "_t_g").withColumns(diagonal).withColumn("_t_start", F.lit(0)), ["_t_g", "_t_start"])


def concentrated(rows: DataFrame, n_groups: int) -> DataFrame:
    """Counts, sums and products of each group's half of least covariance determinant (_t_g, _t_share and SUMS).

    Concentration steps from two starts (medians; all rows) until no determinant falls; of the two halves the one of the
    least determinant is given. rows: _t_g and the vector, read once a step. Of the distance bin that the half ends in,
    rows count in part, so that just the half is summed.
    """
    keys = ["_t_g", "_t_start"]
    kept = [*keys, "_t_share", *SUMS]
    everything = rows.groupBy("_t_g", F.lit(1).alias("_t_start")).agg(*_sums())
    now = staged(_medians(rows, n_groups).unionByName(_estimate(everything, keys, F.lit(1.0))), "mcd")
    by = Window.partitionBy(*keys)
    half = F.least(F.col("_t_of"), F.floor((F.col("_t_of") + P + 1) / 2))
    for step in range(STEPS):
        before = now.select(*keys, F.col("_t_det").alias("_t_was"))
        binned = _distance(_beside(rows, now.select(*keys, *FACTOR), "_t_g", n_groups)).withColumn("_t_b", F.floor(F.log(F.col("_t_d2") + 1e-9) * BINS))
        bins = binned.groupBy(*keys, "_t_b").agg(*_sums())
        bins = bins.withColumns({"_t_of": F.sum("_t_n").over(by), "_t_c": F.sum("_t_n").over(by.orderBy("_t_b")) - F.col("_t_n")}).filter(F.col("_t_c") < half)
        part = F.least(F.lit(1.0), (half - F.col("_t_c")) / F.col("_t_n"))
        sums = bins.withColumn("_t_part", part).groupBy(*keys).agg(F.max(half / F.col("_t_of")).alias("_t_share"), *(F.sum(F.col(x) * F.col("_t_part")).alias(x) for x in SUMS))
        now = staged(_estimate(sums, kept, F.lit(1.0)), "mcd")
        if step and now.join(F.broadcast(before) if n_groups <= BROADCAST_GROUPS else before, keys).filter(F.col("_t_was") - F.col("_t_det") > FALL).isEmpty():
            break
    least = now.groupBy("_t_g").agg(F.min_by(F.struct("*"), F.struct("_t_det", "_t_start")).alias("_t_least"))
    return least.select("_t_least.*").select("_t_g", "_t_share", *SUMS)


def robust_estimates(rows: DataFrame, n_groups: int) -> DataFrame:
    """_t_pair, mean and factor of each (language, source): reweighted MCD of each, shrunk towards the language's, and
    these towards all rows'. rows: _t_pair, _t_lang and the vector."""
    of = rows.withColumn("_t_g", F.explode(F.array("_t_pair", "_t_lang", F.lit("all"))))
    factors = F.array(*(F.lit(consistency(min(0.5 + k / 100, 1 - 1e-9))) for k in range(51)))
    found = concentrated(of, n_groups)
    first = staged(_estimate(found, ["_t_g"], F.get(factors, F.round((F.col("_t_share") - 0.5) * 100).cast("int"))), "mcd")
    near = _distance(_beside(of, first, "_t_g", n_groups)).filter(F.col("_t_d2") <= WEIGHED)
    sums = staged(near.groupBy("_t_g").agg(*_sums()), "mcd")

    def shrunk(own: DataFrame, key: str, towards: DataFrame, on: str) -> DataFrame:
        """own sums and PRIOR rows of those of ``towards``; a group without rows near its middle has the latter alone."""
        there = towards.select(F.col(on).alias("_t_on"), *(F.col(x).alias(f"{x}_to") for x in SUMS))
        both = own.join(sums.withColumnRenamed("_t_g", key), key, "left").join(there, F.col(on) == F.col("_t_on"))
        return both.select(*own.columns, *((F.coalesce(x, F.lit(0)) + PRIOR * F.col(f"{x}_to") / F.col("_t_n_to")).alias(x) for x in SUMS))

    pairs = rows.select("_t_pair", "_t_lang").distinct().withColumn("_t_all", F.lit("all"))
    whole = sums.filter("_t_g = 'all'").withColumnRenamed("_t_g", "_t_all")
    langs = shrunk(pairs.select("_t_lang", "_t_all").distinct(), "_t_lang", whole, "_t_all").drop("_t_all")
    last = staged(shrunk(pairs.select("_t_pair", "_t_lang"), "_t_pair", langs, "_t_lang"), "mcd")
    return staged(_estimate(last, ["_t_pair"], F.lit(0.975 / chi_square(WEIGHED)[1])), "mcd")


def judge(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """docs without text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept.

    base_failed: fewer than 10 words, or over 20 % of them in repeated 5-word windows. The others of each (language,
    source) are kept up to the cutoff of squared distance; null is a language and a source of its own, a null text has no
    words. Repeated rows count each; whole texts of any length are counted; an empty table gives an empty result. Input
    columns named as results are replaced, others pass through.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    own = [c for c in docs.columns if c not in (text_col, *names, "base_failed", "distance", "kept")]
    counted = with_statistics(docs.drop(*names, "base_failed", "distance", "kept"), text_col)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    counted = counted.select(*own, *names, base.alias("base_failed"), *(v.alias(x) for v, x in zip(vector(), X, strict=True)))
    counted = staged(counted, "statistics")
    good = counted.filter("not base_failed")
    rows = staged(good.withColumns({"_t_pair": F.to_json(F.array(lang_col, source_col)), "_t_lang": F.to_json(F.array(lang_col))}), "vectors")
    n_pairs, n_langs = rows.agg(F.count_distinct("_t_pair"), F.count_distinct("_t_lang")).first()
    vectors = rows.select("_t_pair", "_t_lang", *X)
    far = _distance(_beside(rows, robust_estimates(vectors, n_pairs + n_langs + 1), "_t_pair", n_pairs))
    result = [*own, *names, "base_failed"]
    judged = far.select(*result, F.col("_t_d2").alias("distance"), (F.col("_t_d2") <= cutoff).alias("kept"))
    return judged.unionByName(counted.filter("base_failed").select(*result, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
