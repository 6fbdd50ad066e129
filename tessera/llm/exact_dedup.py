"""Exact deduplication by two-pass Bloom filtering.

Pass 1 sends each task's distinct 64-bit hashes (8 bytes a text, never the text) to the segment of a partitioned Bloom
filter that owns them. A hash that finds its bits set already is possibly repeated and goes into a second, small filter.
Pass 2 tests every row against the second filter: only possibly repeated rows shuffle, to be grouped by SHA-256; the
rest pass straight through. False hits of either filter cost a shuffled row, never a wrong answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, restored, shielded, staged, text_of, with_group
from .filters import bits_of, folded, size_for, split, spots, tester

#: Bits of the first filter for each row.
BITS_PER_ROW = 16


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_sha256 (lowercase hex) of the text after each run of white space became one space."""
    return docs.withColumn("text_sha256", F.sha2(F.regexp_replace(text_of(text_col), SPACE, " ").cast("binary"), 256))


def _task_hashes(segments: int):
    def run(batches):
        found = [np.asarray(b.column(0)) for b in batches]
        if found:
            h, count = np.unique(np.concatenate(found), return_counts=True)
            u = h.view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((u >> np.uint64(40)).astype(np.int64) % segments, pa.int32()), pa.array(h, pa.int64()), pa.array(count > 1)], ["segment", "h", "twice"])

    return run


def _segment(bits: int, second: int):
    """Bits of the second filter: those of a segment's hashes that the first has met before, or that one task had twice."""

    def run(table: pa.Table) -> pa.Table:
        seen = np.zeros(bits, bool)
        out = []
        for b in table.to_batches():
            h, group = np.unique(np.asarray(b.column("h")), return_inverse=True)
            twice = np.bincount(group, np.asarray(b.column("twice").to_numpy(zero_copy_only=False), float)) > 0
            one, two = spots(h, bits)
            hit = (seen[one] & seen[two]) | twice | (np.bincount(group) > 1)
            seen[one] = seen[two] = True
            out.append(h[hit])
        return bits_of(np.unique(np.concatenate(out)), second)

    return run


def repeated_filter(hashes: DataFrame, n_rows: int) -> np.ndarray:
    """Pass 1 over a column of 64-bit hashes: the second filter, packed, of at most filters.MAX_BITS bits."""
    segments = int(2 ** np.clip(np.ceil(np.log2(max(1, n_rows) / 50_000)), 4, 16))
    bits = int(2 ** np.ceil(np.log2(max(1024, BITS_PER_ROW * n_rows / segments))))
    dealt = hashes.mapInArrow(_task_hashes(segments), "segment int, h long, twice boolean")
    second = size_for(n_rows)
    return folded(dealt.groupBy("segment").applyInArrow(_segment(bits, second), "block int, bit int"), second)


def possibly_repeated(hashed: DataFrame, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows (with text_sha256) that may be repeated, and rows that surely are not."""
    hashed = hashed.withColumn("_t_h", F.xxhash64("text_sha256"))
    maybe = tester(hashed.sparkSession, repeated_filter(hashed.select("_t_h"), n_rows))
    marked = hashed.withColumn("_t_maybe", maybe("_t_h")).drop("_t_h")
    return marked.filter("_t_maybe").drop("_t_maybe"), marked.filter("not _t_maybe").drop("_t_maybe")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with text_sha256, keep_id (smallest id of its equal texts), group_size and kept.

    A null text counts as empty; a text of any length is hashed whole in its own task, and only its hash goes on. A null id
    sorts last. Where rows repeat both text and id, one of them is kept. An empty
    table gives an empty result. Other columns pass through; input columns named as result columns are replaced.
    """
    return judge(digests(docs.drop("keep_id", "group_size", "kept"), id_col, text_col), id_col)


def judge(hashed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """exact_dedup of rows that have their text_sha256."""
    n_rows = hashed.count()
    maybe, once = possibly_repeated(hashed, n_rows)
    groups = maybe.groupBy("text_sha256").agg(F.min(id_col).alias("keep_id"), F.count("*").alias("group_size"))
    joined = with_group(maybe, groups, "text_sha256", "group_size", n_rows)
    same = Window.partitionBy("text_sha256", id_col).orderBy(F.lit(1))
    judged = joined.withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.row_number().over(same) == 1))
    passed = once.withColumns({"keep_id": F.col(id_col), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    return passed.unionByName(judged)


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with the columns of docs: one for each text, that with the smallest id (a null id sorts
    last). Null texts count as empty; of rows that repeat text and id one stays; an empty table gives an empty result.

    Texts are hashed once and judged by their hashes. Then docs is read again: rows whose id is not in a filter of the ids
    that lose or repeat pass straight through, without hashing or a shuffle; only the others are looked up.
    """
    hashed = staged(digests(shielded(docs, ["text_sha256"]).select(id_col, text_col), id_col, text_col).select(id_col, "text_sha256"), "digests")
    n_rows = hashed.count()
    maybe, _ = possibly_repeated(hashed, n_rows)
    each = maybe.groupBy("text_sha256", id_col).agg(F.count("*").alias("_t_n"))  # a hot text is dealt by its ids
    first = each.groupBy(F.col("text_sha256").alias("_t_of")).agg(F.min(id_col).alias("_t_keep"), F.count("*").alias("_t_ids"))
    some = first.filter("_t_ids > 1").select("_t_of", "_t_keep", "_t_ids")
    judged = with_group(each.withColumnRenamed("text_sha256", "_t_of"), some, "_t_of", "_t_ids", n_rows)
    loses = F.col("_t_ids").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("_t_keep"))
    found = staged(judged.select(F.col(id_col).alias("_t_id"), F.col("_t_of"), loses.alias("_t_loses"), "_t_n").filter("_t_loses or _t_n > 1"), "losers")
    looked, passed = split(docs, F.xxhash64(id_col), found.select(F.xxhash64("_t_id")))
    looked = digests(shielded(looked, ["text_sha256"]), id_col, text_col)
    looked = looked.join(found, (F.col("text_sha256") == F.col("_t_of")) & F.col(id_col).eqNullSafe(F.col("_t_id")), "left")
    stay = looked.filter(F.col("_t_loses").isNull()).unionByName(looked.filter("not _t_loses").dropDuplicates(["text_sha256", id_col]))
    return passed.unionByName(restored(stay, docs))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(staged(digests(docs).select("doc_id", "text_sha256"), "dedup"))


SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
             row_number() OVER (PARTITION BY text_sha256, doc_id) AS n FROM t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND n = 1 AS kept, text_sha256 FROM g
"""
