"""Helpers that the operators share: word rules, the shared folder, staged tables and skew-proof lookups.

Columns that operators add on the way start with ``_t_``; a result column replaces an input column of its name.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, and words, as the contracts have them (ASCII white space only).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Groups above a thousandth of the rows are hot, so there are a thousand of them at most: their table may be broadcast.
HOT_GROUPS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of the machine's in local
    mode (tests), and an error on a cluster."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        found = sc.getCheckpointDir()
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: cuts lineage, and survives the loss of any executor."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def shielded(docs: DataFrame, names) -> DataFrame:
    """docs with columns of these names renamed, so that an operator's results of those names don't replace them."""
    return docs.withColumnsRenamed({c: f"_t_own_{c}" for c in docs.columns if c in names})


def restored(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, under their names, from rows of a shielded docs."""
    return df.select(*(F.col(f"_t_own_{c}" if f"_t_own_{c}" in df.columns else c).alias(c) for c in docs.columns))


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text, counted by the JVM without making an array."""
    return F.length(F.regexp_replace(F.regexp_replace(text, WORD, "w"), SPACE, "")).cast("long")


def with_group(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """rows ⟕ groups on key, where groups has a row per key with its number of rows in column ``size``.

    A group of more than a thousandth of the rows would land in one task of a plain join. There are fewer than
    HOT_GROUPS such groups whatever the input, so these are broadcast and the others are joined by a shuffle.
    """
    limit = max(HOT_GROUPS, n_rows // HOT_GROUPS)
    cols = [c for c in groups.columns if c != key]
    hot = F.broadcast(groups.filter(F.col(size) > limit).select(F.col(key), F.struct(*cols).alias("_t_hot")))
    marked = rows.join(hot, key, "left")
    done = marked.filter(F.col("_t_hot").isNotNull()).select(*rows.columns, "_t_hot.*")
    rest = marked.filter(F.col("_t_hot").isNull()).select(*rows.columns)
    cold = groups.filter(F.col(size) <= limit)
    return done.unionByName(rest.join(cold, key, "left").select(*rows.columns, *cols))
