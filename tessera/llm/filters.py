"""Bloom filters over 64-bit hashes: built in blocks by Spark, held packed, tested by a Pandas UDF."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most bits of a filter, which is broadcast: 2^28 are 32 MB. Bits of a block that one group builds.
MAX_BITS = 2**28
BLOCK = 2**16


def spots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    u = h.view(np.uint64) if h.dtype == np.int64 else h
    m = np.uint64(bits - 1)
    return (u & m).astype(np.int64), ((u >> np.uint64(29)) * np.uint64(0x9E3779B1) & m).astype(np.int64)


def size_for(n: int) -> int:
    """Bits of a filter for n hashes: 8 for each, in whole blocks, at most MAX_BITS (more of them only make false hits)."""
    return int(min(MAX_BITS, 2 ** np.ceil(np.log2(max(BLOCK, 8 * n)))))


def bits_of(h: np.ndarray, bits: int) -> pa.Table:
    """The set bits of a filter that holds these hashes."""
    where = np.unique(np.concatenate(spots(h, bits)))
    return pa.table({"block": (where // BLOCK).astype(np.int32), "bit": (where % BLOCK).astype(np.int32)})


def folded(found: DataFrame, bits: int) -> np.ndarray:
    """The packed filter of (block, bit) rows. bits / 8 bytes come to the driver."""

    def packed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = np.zeros(BLOCK, bool)
        block[np.asarray(table.column("bit"))] = True
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(block).tobytes()], pa.binary())})

    out = np.zeros((bits // BLOCK, BLOCK // 8), np.uint8)
    for block, row in found.groupBy("block").applyInArrow(packed, "block int, bits binary").collect():
        out[block] = np.frombuffer(row, np.uint8)
    return out.ravel()


def built(hashes: DataFrame, bits: int) -> np.ndarray:
    """The packed filter of a column of 64-bit hashes."""

    def each(batches):
        for b in batches:
            yield from bits_of(np.asarray(b.column(0)), bits).to_batches()

    return folded(hashes.mapInArrow(each, "block int, bit int"), bits)


def tester(spark, packed: np.ndarray):
    """A function of a column of hashes: whether each may be in the filter."""
    sent, bits = spark.sparkContext.broadcast(packed), len(packed) * 8

    @F.pandas_udf("boolean")
    def maybe(h):
        table, values = sent.value, h.to_numpy(np.int64)
        hit = np.ones(len(values), bool)
        for spot in spots(values, bits):
            hit &= (table[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8) & 1).astype(bool)
        return h.__class__(hit)

    return maybe


def split(rows: DataFrame, key: Column, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows whose key (a 64-bit hash) may be listed, and those whose key surely isn't, which no join has to see. listed
    has one column of such hashes; it is read twice."""
    maybe = tester(rows.sparkSession, built(listed, size_for(listed.count())))
    marked = rows.withColumn("_t_maybe", maybe(key))
    return marked.filter("_t_maybe").drop("_t_maybe"), marked.filter("not _t_maybe").drop("_t_maybe")
