"""Sharding by a two-pass external shuffle: scatter into memory-sized buckets, Fisher-Yates each bucket, write in order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, staged, text_of

SHARDS = 24
#: Bytes of text in a bucket, which one task holds; buckets whose counts are summed by one task.
BUCKET_BYTES = 8 * 2**20
RUN = 4096


def _begins(counts: DataFrame) -> DataFrame:
    """_t_bucket and _t_begin, the rows in the buckets before it: sums of RUN buckets each, then those within one. The one
    task that orders the sums has a row for each RUN buckets (3000 at 100 TB)."""
    counts = staged(counts.withColumn("_t_run", F.expr(f"_t_bucket div {RUN}")), "buckets")
    before = lambda w: F.coalesce(F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = counts.groupBy("_t_run").agg(F.sum("count").alias("count")).select("_t_run", before(Window.orderBy("_t_run")).alias("_t_first"))
    within = before(Window.partitionBy("_t_run").orderBy("_t_bucket"))
    return counts.withColumn("_t_within", within).join(runs, "_t_run").select("_t_bucket", (F.col("_t_first") + F.col("_t_within")).alias("_t_begin"))


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Whole records in a seeded random order: docs with size (UTF-8 bytes and 8), shard and slot.

    Pass 1 scatters records by a seeded hash of id and text into as many buckets as hold bucket_bytes each. Pass 2
    shuffles each bucket in memory. Buckets follow one another; the run of all rows is cut into shards whose row counts
    are at most one apart, and slot is the place in the shard, from 0. Reruns agree: a bucket is sorted by hash, id and
    text before its seeded permutation. A null text is none (size 8); null ids and repeated rows are records like any other;
    an empty table gives an empty result. Input columns named as result columns are replaced. A text longer than bucket_bytes
    makes its bucket that much larger.

    Texts are read twice: for their sizes and hashes, and to scatter them. A bucket's task is sent the number of rows before
    it; the driver holds no bucket.
    """
    docs = docs.drop("size", "shard", "slot")
    sized = docs.withColumn("size", F.octet_length(text_of(text_col)).cast("long") + 8)
    own = F.xxhash64(text_of(text_col))
    hashed = sized.withColumn("_t_hash", F.xxhash64(F.lit(seed), F.col(id_col), own))
    hashes = staged(hashed.select("_t_hash", "size"), "hashes")  # sizes and counts of buckets come from these, not from texts
    total, n = hashes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    buckets = max(1, -(-total // bucket_bytes))
    bucket = F.pmod(F.col("_t_hash"), F.lit(buckets))
    dealt = hashed.withColumn("_t_text", own).withColumn("_t_bucket", bucket)
    each, more = divmod(n, shards)
    names = sized.columns

    def permute(key: tuple[pa.Scalar, ...], table: pa.Table, begins: pa.Table) -> pa.Table:
        """The bucket's rows in a fixed order, then in a Fisher-Yates permutation of it."""
        table = table.take(pc.sort_indices(table, sort_keys=[("_t_hash", "ascending"), (id_col, "ascending"), ("_t_text", "ascending")]))
        place = np.arange(table.num_rows)
        np.random.Generator(np.random.PCG64([seed, key[0].as_py()])).shuffle(place)
        at = begins.column("_t_begin")[0].as_py() + np.arange(table.num_rows)
        shard = np.where(at < more * (each + 1), at // (each + 1), more + (at - more * (each + 1)) // max(each, 1))
        slot = at - (shard * each + np.minimum(shard, more))
        out = table.take(pa.array(place)).select(names)
        return out.append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(slot, pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.schema.fields)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(buckets, 100_000))
    begins = _begins(hashes.groupBy(bucket.alias("_t_bucket")).count())
    rows, starts = (x.repartition(tasks, "_t_bucket").groupBy("_t_bucket") for x in (dealt, begins))  # dealt alike: no second shuffle
    return rows.cogroup(starts).applyInArrow(permute, f"{fields}, shard int, slot long")


def write_shards(docs: DataFrame, path: str, **options) -> DataFrame:
    """Writes the shuffled records under ``path``, a folder for each shard, straight from the buckets, and returns what was
    written, to be read from there: a file's records are in the order of their slots, and a bucket's records are in one shard,
    or in two or more where it spans their ends. Cases are those of ``shuffled``; an empty table writes no shard."""
    rows = shuffled(docs, **options)
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards are written to the shared folder; the result is what their files hold."""
    rows = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), new_folder(spark, "shards"))
    return rows.select("doc_id", "size", F.crc32(text_of("text").cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
