"""Filter interaction audit: what each filter removes in each order of five, by part.

Documents are counted by part and their five failure flags first (32 rows a part and task at most), and the CUBE of flags and
part is taken over these counts. Of its rows, those with a part and only false flags count the survivors of the selected
filters: one row for each subset. A step of an order is a pair of subsets, before and after it, joined by part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, n_words, staged, text_of, with_group
from .exact_dedup import possibly_repeated

FILTERS = "ABCDE"
MIN_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5  # percent, the last two
SYMBOLS = "[#$%&*|]"
COUNTS = ("n", "good", "toxic")


def flagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """_t_id, part (null: empty) and the failure flags A to E of each row of docs.

    A: under 50 words; B: under 65 % distinct words; C: over 5 % capitals A-Z; D: a symbol; E: a smaller id has the same text.
    A null text is empty. A null id is larger than all others; of repeated rows none has a smaller id. Whole texts count.
    """
    text = F.col("_t_text")
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    df = docs.select(F.col(id_col).alias("_t_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_of(text_col).alias("_t_text"))
    df = df.withColumns({"_t_words": n_words(text), "_t_distinct": F.size(F.array_distinct(words))})
    df = df.select(
        "_t_id",
        "part",
        (F.col("_t_words") < MIN_WORDS).alias("A"),
        (100 * F.col("_t_distinct") < LEAST_DISTINCT * F.col("_t_words")).alias("B"),
        (100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > MOST_CAPITALS * F.length(text)).alias("C"),
        text.rlike(SYMBOLS).alias("D"),
        F.sha2(text.cast("binary"), 256).alias("text_sha256"),
    )
    rows = staged(df, "flags")
    n_rows = rows.count()
    maybe, once = possibly_repeated(rows, n_rows)  # only these shuffle
    groups = maybe.groupBy("text_sha256").agg(F.min("_t_id").alias("_t_first"), F.count("*").alias("_t_size"))
    later = F.coalesce(F.col("_t_id") > F.col("_t_first"), F.col("_t_id").isNull() & F.col("_t_first").isNotNull())
    judged = with_group(maybe, groups, "text_sha256", "_t_size", n_rows).withColumn("E", later)
    return once.withColumn("E", F.lit(False)).unionByName(judged.select(*once.columns, "E")).drop("text_sha256")


def counted(flags: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents by part and flags: n, good (quality is 1) and toxic ones. An id with several labels is good or toxic if one
    of them says so; labels without an id fit none."""
    said = labels.groupBy(F.col(id_col).alias("_t_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    each = flags.join(said, "_t_id", "left")
    return each.groupBy("part", *FILTERS).agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS[1:]))


def survivors(counts: DataFrame) -> DataFrame:
    """part, mask (bit k: filter k is applied) and how many documents pass: a row for each part and subset, zeros included.

    The CUBE of part and flags gives each subset; without a row of false flags only, nothing survives."""
    cube = counts.cube("part", *FILTERS).agg(F.grouping_id().alias("_t_left_out"), *(F.sum(c).alias(c) for c in COUNTS))
    passed = ~F.coalesce(F.greatest(*(F.coalesce(F.col(f), F.lit(False)) for f in FILTERS)), F.lit(False))
    of_part = cube.filter(F.col("_t_left_out") < 2 ** len(FILTERS)).withColumn("mask", sum(((1 - F.shiftright("_t_left_out", len(FILTERS) - 1 - k).bitwiseAND(1)) * 2**k for k in range(len(FILTERS))), F.lit(0)).cast("int"))
    return of_part.groupBy("part", "mask").agg(*(F.coalesce(F.sum(F.when(passed, F.col(c))), F.lit(0)).alias(c) for c in COUNTS))


def steps(spark: SparkSession) -> DataFrame:
    """Each step of each order: filter_order, step, the filter, the subsets before and after it, that of the filter alone, and
    that of all others. 600 rows."""
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    every = sum(bit.values())
    rows = []
    for order in permutations(FILTERS):
        mask = 0
        for k, f in enumerate(order):
            rows.append(("".join(order), k + 1, f, mask, mask | bit[f], bit[f], every - bit[f]))
            mask |= bit[f]
    return spark.createDataFrame(rows, "filter_order string, step int, letter string, before int, after int, alone int, others int")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, letter and, of the part's documents, kept (after the step), removed (by it), redundant (fail its
    filter, removed before), unique_fails (fail its filter only), good_lost, toxic_lost (removed by it) and shapley (removed by
    its filter, summed over all orders): 600 rows a part, zeros included.

    Null texts are empty, null parts the empty string; repeated rows count each; no documents give an empty result. Columns
    other than those named are not read, so none clashes.
    """
    spark = docs.sparkSession
    subsets = staged(survivors(counted(flagged(docs, id_col, text_col, part_col), labels, id_col)), "subsets")
    wide = lambda name: subsets.select("part", F.col("mask").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in COUNTS))
    rows = wide("before").join(F.broadcast(steps(spark)), "before")
    for name in ("after", "alone", "others"):
        rows = rows.join(wide(name), ["part", name])
    whole = subsets.groupBy("part").agg(F.max(F.when(F.col("mask") == 0, F.col("n"))).alias("_t_n"), F.max(F.when(F.col("mask") == 2 ** len(FILTERS) - 1, F.col("n"))).alias("_t_rest"))
    rows = rows.join(whole, "part")
    lost: dict[str, Column] = {c: F.col(f"{c}_before") - F.col(f"{c}_after") for c in COUNTS}
    found = rows.select(
        "part",
        "filter_order",
        "step",
        "letter",
        F.col("n_after").alias("kept"),
        lost["n"].alias("removed"),
        (F.col("_t_n") - F.col("n_alone") - lost["n"]).alias("redundant"),
        (F.col("n_others") - F.col("_t_rest")).alias("unique_fails"),
        lost["good"].alias("good_lost"),
        lost["toxic"].alias("toxic_lost"),
    )
    return found.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter")))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(docs, labels).drop("letter")


SQL = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
c AS (SELECT doc_id, part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b, 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) AS c,
             regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), doc_id IS NULL AND min(doc_id) OVER (PARTITION BY t) IS NOT NULL) AS e FROM w),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
      FROM c LEFT JOIN l USING (doc_id) GROUP BY ALL),
i AS (SELECT unnest(range(1, 6))::INT AS k),
o AS (SELECT a.k AS k1, b.k AS k2, c.k AS k3, d.k AS k4, e.k AS k5 FROM i a JOIN i b ON b.k <> a.k JOIN i c ON c.k NOT IN (a.k, b.k) JOIN i d ON d.k NOT IN (a.k, b.k, c.k) JOIN i e ON e.k NOT IN (a.k, b.k, c.k, d.k)),
s AS (SELECT substr('ABCDE', k1, 1) || substr('ABCDE', k2, 1) || substr('ABCDE', k3, 1) || substr('ABCDE', k4, 1) || substr('ABCDE', k5, 1) AS filter_order, i.k AS step,
             1 << (([k1, k2, k3, k4, k5])[i.k] - 1) AS f, (1 << (k1 - 1)) * (i.k > 1)::INT + (1 << (k2 - 1)) * (i.k > 2)::INT + (1 << (k3 - 1)) * (i.k > 3)::INT + (1 << (k4 - 1)) * (i.k > 4)::INT AS earlier FROM o, i),
r AS (SELECT part, filter_order, step, f, n, good, toxic, bit_count(fails) AS failed, (fails & f) <> 0 AS hit, (fails & earlier) <> 0 AS gone FROM d, s),
a AS (SELECT part, filter_order, step, f, sum(n) FILTER (NOT gone AND NOT hit) AS kept, sum(n) FILTER (NOT gone AND hit) AS removed, sum(n) FILTER (gone AND hit) AS redundant,
             sum(n) FILTER (hit AND failed = 1) AS unique_fails, sum(good) FILTER (NOT gone AND hit) AS good_lost, sum(toxic) FILTER (NOT gone AND hit) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM a
"""
