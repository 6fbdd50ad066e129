"""Ranked lexical search: postings in term buckets, joined with the terms of the items and summed by item and document.

A segment is some documents that one task has read (SEGMENT occurrences of terms, or one longer document). Of each term in
it there is one row of the index with the list of the segment's documents that hold it, so a term that every document holds
has a row for each segment instead of one for each document. Rows are written by bucket of the term's hash, sorted by term:
a search reads the buckets and terms that it needs. To be scored, lists are dealt by segment; all matches of a document
stay in one task then, sums by item and document need no shuffle, and a task passes on its best k of an item only.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_folder, staged, text_of

#: Terms are the maximal matches of this, with A-Z in lower case; in UTF-8 they are these bytes.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES = rb"[0-9a-z\x80-\xff]+"
#: Occurrences of terms in a segment. Buckets of terms; a bucket of as many tasks' segments is in one file.
SEGMENT = 2_000_000
BUCKETS, TASKS = 128, 64
#: Bytes of item terms that are broadcast at once; more are searched in blocks of items.
BLOCK_BYTES = 16_000_000
#: The term of the rows that list all documents of a segment that hold a term at all.
ALL = ""
#: Lists of one length in a row: place of a document in the segment (by id), occurrences in it, its terms with repeats.
PLACE = ("at", "tf", "n")


def _segments(size: int):
    """Rows (segment, term, n_docs, n_terms and PLACE) of batches (id, text in bytes)."""
    find = re.compile(TERM_BYTES).findall

    def run(batches):
        task, made = TaskContext.get().partitionId() << 32, 0
        ids, texts, held = [], [], 0

        def cut() -> pa.RecordBatch:
            known = pa.concat_arrays(ids)
            order = pc.sort_indices(known)  # nulls last
            known = known.take(order)
            each = [texts[i] for i in order.to_pylist()]
            words = pa.concat_arrays(each).dictionary_encode()
            n = np.array([len(x) for x in each])
            at = np.repeat(np.arange(len(n)), n)
            key, tf = np.unique(np.asarray(words.indices, np.int64) * len(n) + at, return_counts=True)
            code, at = key // len(n), key % len(n)
            starts = np.append(np.searchsorted(code, np.arange(len(words.dictionary) + 1)), len(code) + len(n))
            at, tf = np.concatenate([at, np.arange(len(n))]), np.concatenate([tf, n])  # a last list, of all
            lists = [pa.array(x, pa.int32()) for x in (at, tf, n[at])]
            term = pa.concat_arrays([words.dictionary, pa.array([ALL.encode()], pa.binary())])
            columns = [pa.array(np.full(len(term), task | made)), term, pa.array(np.diff(starts)), pa.array(np.add.reduceat(tf, starts[:-1]))]
            columns += [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), x) for x in lists]
            last = pa.array(np.arange(len(term)) < len(term) - 1)
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(np.zeros(len(term), np.int32), len(n)), pa.int32()), known, mask=last))
            return pa.RecordBatch.from_arrays(columns, ["segment", "term", "n_docs", "n_terms", *PLACE, "ids"])

        for b in batches:
            for i, text in enumerate(b.column(1)):
                found = find(text.as_py().lower())  # of bytes, so A-Z only
                if not found:
                    continue
                ids.append(b.column(0).slice(i, 1))
                texts.append(pa.array(found, pa.binary()))
                held += len(found)
                if held >= size:
                    yield cut()
                    made += 1
                    ids, texts, held = [], [], 0
        if texts:
            yield cut()

    return run


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """The index: segment, bucket, term, n_docs and n_terms (documents and occurrences in the lists), the lists of PLACE, and
    ids (of a segment's documents by place; in rows of the term ALL only).

    Every row of docs is a document, repeated rows too. Whole texts of any length are read; null and empty texts, and those
    without a term, are in no list. The rows of the term ALL (which no text has) list every document of the segment.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType().add("segment", "long").add("term", "binary").add("n_docs", "long").add("n_terms", "long")
    for name in (*PLACE, "ids"):
        schema = schema.add(name, T.ArrayType(kind if name == "ids" else T.IntegerType()))
    found = docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text")).mapInArrow(_segments(segment), schema)
    return found.withColumn("term", F.col("term").cast("string")).withColumn("bucket", _bucket())


def _bucket() -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")


def stored(index: DataFrame) -> DataFrame:
    """The index as a table in the shared folder: a folder for each bucket, rows sorted by term. Buckets are dealt with as
    many parts as there are TASKS segments' tasks, so that a bucket with a term of all documents is not in one task."""
    path = new_folder(index.sparkSession, "postings")
    part = F.floor(F.shiftright("segment", 32) / TASKS)
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index.repartition(n, "bucket", part).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)
    return index.sparkSession.read.schema(index.schema).parquet(path)


def terms_of(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, term and how often the item has it. Rows of one item_col (null is one) are one item: their terms add up."""
    lower = F.translate(text_of(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = items.select(F.col(item_col).alias("item"), F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term"))
    return each.groupBy("item", "term").agg(F.count("*").alias("times"))


def _scored(index: DataFrame, terms: DataFrame, n_docs: int, n_terms: int, small: bool) -> DataFrame:
    """segment, at, item and score above 0 of each match of a document and an item. terms: item, term, times."""
    held = F.broadcast if small else lambda df: df
    wanted = [r[0] for r in terms.select(_bucket()).distinct().collect()]  # BUCKETS at most
    near = index.filter(F.col("bucket").isin(wanted) & (F.col("term") != ALL)) if wanted else index.limit(0)
    df = near.select("term", "n_docs").join(held(terms.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    weighed = staged(terms.join(held(df) if small else df, "term").select("item", "term", (F.col("times") * weight).alias("weight")).filter("weight > 0"), "weights")
    lists = near.select("segment", "term", *PLACE).join(held(weighed.select("term").distinct()), "term", "left_semi")
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = lists.repartition(n, "segment").select("segment", "term", F.inline(F.arrays_zip(*PLACE)))
    part = F.expr(f"1000000000L * tf div (1000L * tf + 12 * (100 - 25 + 25L * n * {n_docs}L div {max(1, n_terms)}L))")
    each = each.select("segment", "at", "term", part.alias("part"))
    sums = each.join(held(weighed), "term").groupBy("segment", "at", "item").agg(F.sum(F.col("weight") * F.col("part")).alias("score"))
    return sums.filter("score > 0")


def search(items: DataFrame, index: DataFrame, k: int = 20, item_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id", block: int = BLOCK_BYTES) -> DataFrame:
    """The k documents of highest score above 0 for each item (all, if fewer): item_col, rank from 1, id_col, score.

    Equal scores are ranked by id (null last), then by place in the index. An item without a term that a document holds (a
    null or empty text, say) has no row; no items or no documents give an empty result. Other columns of items are not
    read. Items are searched in blocks whose terms are broadcast; a block that is still too large (one item's own terms)
    is joined by a shuffle instead.
    """
    n_docs, n_terms = index.filter(F.col("term") == ALL).agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    terms = staged(terms_of(items, item_col, text_col), "terms")
    size = F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0))
    blocks = max(1, -(-terms.agg(size).first()[0] // block))
    terms = terms.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    sizes = {r[0]: r[1] for r in terms.groupBy("block").agg(size).collect()}
    best = []
    for b in sorted(sizes) or [0]:
        scores = _scored(index, terms.filter(F.col("block") == b).drop("block"), n_docs, n_terms, sizes.get(b, 0) <= 2 * block)
        by = Window.partitionBy("segment", "item").orderBy(F.desc("score"), "at")  # in a segment, places are in the order of ids
        best.append(scores.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).drop("rank"))
    out = best[0]
    for more in best[1:]:
        out = out.unionByName(more)
    docs = index.filter(F.col("term") == ALL).select("segment", F.posexplode("ids").alias("at", "id"))
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "segment", "at")
    out = out.join(docs, ["segment", "at"]).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return out.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = stored(postings(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), index)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL),
a AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS occurrences FROM d WHERE len(terms) > 0),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, a GROUP BY term, docs),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, r, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // occurrences))))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN p USING (term), a GROUP BY item_id, r, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 20
"""
