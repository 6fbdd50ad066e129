"""Mixing sources to target weights by capped water-filling, and seeded sampling of whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, restored, shielded, staged, text_of

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Leading hex digits of a document's draw that make the bins in which a source's words are counted (16^3 bins).
DIGITS = 3
RESULT = ("size", "source_size", "target", "repetitions", "taken")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size and target of each source, from its source and source_size.

    Weights repeat over the sources by code point, null last. The targets share all sizes in proportion to the weights;
    a source is clamped at ``epochs`` times its size, and the excess is shared again until no source is above its clamp.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one task: a row per source, not per document
    s = sources.withColumn("_t_w", F.element_at(F.array(*map(F.lit, weights)), (order % len(weights) + 1).cast("int")))
    s = staged(s.withColumn("_t_cap", F.col("source_size") * epochs), "sources")
    level = -1.0
    while True:  # each round clamps a source at least; what stays is a few numbers
        clamped = F.col("_t_cap") <= F.lit(level) * F.col("_t_w")
        total, caps, left = s.agg(F.sum("source_size"), F.sum(F.when(clamped, F.col("_t_cap"))), F.sum(F.when(~clamped, F.col("_t_w")))).first()
        if not left:
            break
        now = (total - (caps or 0)) / left
        if now <= level:
            break
        level = now
    return s.withColumn("target", F.least(F.col("_t_cap").cast("double"), F.lit(float(level)) * F.col("_t_w"))).drop("_t_w", "_t_cap")


def draw(id_col: str, seed: int) -> Column:
    """A document's seeded draw: hex digits, uniform over ids."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))


def mix_sources(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """docs with size (words), source_size, target, repetitions and taken (size times repetitions).

    A source gives all its documents floor(target / source_size) times, and once more those that come first in the
    order of their draws, up to the target: the one that reaches it is taken if at least half of it is below. No row is
    repeated more than ``epochs`` times. A null or empty text has size 0, a null source is a source of its own, a source
    without words has target 0, and repeated rows count each; an empty table gives an empty result. Extra columns pass
    through; input columns named as result columns are replaced. A text is counted where it is read, at any length. Held are a row per source and 4096 bins of draws for
    each: their words are summed to find the bin in which a source's target falls, and only its rows are ordered.
    """
    docs = docs.drop(*RESULT)
    own = docs.columns
    drawn = docs.withColumns({"size": n_words(text_of(text_col)), "_t_draw": draw(id_col, seed)}).withColumn("_t_bin", F.conv(F.substring("_t_draw", 1, DIGITS), 16, 10).cast("int"))
    bins = drawn.groupBy(F.col(source_col).alias("source"), "_t_bin").agg(F.sum("size").alias("_t_words"))
    bins = staged(bins, "bins")  # 4096 rows a source at most
    sizes = targets(bins.groupBy("source").agg(F.sum("_t_words").alias("source_size")), weights, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sizes = sizes.withColumn("_t_whole", whole.cast("long")).withColumn("_t_rest", F.col("target") - F.col("_t_whole") * F.col("source_size"))
    run = Window.partitionBy("source").orderBy("_t_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (
        bins.withColumn("_t_end", F.sum("_t_words").over(run))
        .join(sizes.withColumnRenamed("source", "_t_s"), F.col("source").eqNullSafe(F.col("_t_s")))
        .filter(F.col("_t_end") > F.col("_t_rest"))
        .groupBy("source")
        .agg(F.min(F.struct("_t_bin", (F.col("_t_end") - F.col("_t_words")).alias("_t_before"))).alias("_t_cut"))
    )
    plan = sizes.join(cut.withColumnRenamed("source", "_t_s"), F.col("source").eqNullSafe(F.col("_t_s")), "left").select(
        F.col("source").alias("_t_source"), "source_size", "target", "_t_whole", "_t_rest", F.coalesce("_t_cut._t_bin", F.lit(16**DIGITS)).alias("_t_cut"), F.coalesce("_t_cut._t_before", F.lit(0)).alias("_t_before")
    )
    if sizes.count() <= 100_000:  # a row of some 80 bytes each; beyond, the join may shuffle
        plan = F.broadcast(plan)
    of = drawn.join(plan, F.col(source_col).eqNullSafe(F.col("_t_source")))
    sure = of.filter("_t_bin <> _t_cut").withColumn("_t_more", (F.col("_t_bin") < F.col("_t_cut")).cast("long"))
    ordered = Window.partitionBy("_t_source").orderBy("_t_draw", id_col, "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_t_before") + F.coalesce(F.sum("size").over(ordered), F.lit(0))
    open_ = of.filter("_t_bin = _t_cut").withColumn("_t_more", (before + F.col("size") / 2 <= F.col("_t_rest")).cast("long"))
    both = sure.unionByName(open_).withColumn("repetitions", F.least(F.col("_t_whole") + F.col("_t_more"), F.lit(epochs)))
    return both.withColumn("taken", F.col("size") * F.col("repetitions")).select(*own, *RESULT)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as mix_sources repeats it, with the columns of docs."""
    mixed = mix_sources(shielded(docs, RESULT), **options).filter("repetitions > 0")
    return restored(mixed.withColumn("_t_copy", F.explode(F.expr("sequence(1, repetitions)"))), docs)


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


#: The same by a closed form of the water level and one ordering of whole sources.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s),
r AS (SELECT *, cap / w AS ratio FROM w),
c AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
             sum(w) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights,
             sum(source_size) OVER () AS total FROM r),
l AS (SELECT max(CAST(total - caps AS DOUBLE) / weights) AS level FROM c WHERE CAST(total - caps AS DOUBLE) / weights < ratio),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(level, 1e300) * w) AS target FROM w CROSS JOIN l),
f AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
o AS (SELECT d.doc_id, d.size, f.source_size, f.target, f.whole, f.target - f.whole * f.source_size AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target, CAST(size * least(3, whole + CASE WHEN before + size / 2 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o
"""
