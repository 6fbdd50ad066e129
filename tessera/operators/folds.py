"""Ordered folds: the rows of each group, in order, through an object that carries state from row to row.

For what no window expresses, as the next state depends on the last result. Rows are dealt by group and sorted; a task then
streams them in Arrow batches. A group may be longer than a batch, or all that a task has: only the state is held.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


class Fold(Protocol):
    def rows(self, batch: pa.RecordBatch, new: np.ndarray) -> pa.RecordBatch | None:
        """What comes of the next rows. new: whether each is the first of a group."""

    def end(self) -> pa.RecordBatch | None:
        """What is left after the last row."""


def folded(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[], Fold], schema: str) -> DataFrame:
    """The rows that a Fold makes of those of df. Groups (null is a key like others) are whole and in one piece; in each,
    rows are in ``order``, nulls first. Rows that tie in it come in any order. An empty table gives an empty result."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        state, last = fold(), None
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            for k in keys:
                c = b.column(k)
                changed = pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)), False).to_numpy(zero_copy_only=False)
                nulls = c.is_null().to_numpy(zero_copy_only=False)
                new[1:] |= changed | (nulls[1:] != nulls[:-1])
            first = tuple(b.column(k)[0].as_py() for k in keys)
            new[0] = first != last
            last = tuple(b.column(k)[b.num_rows - 1].as_py() for k in keys)
            if (out := state.rows(b, new)) is not None:
                yield out
        if (out := state.end()) is not None:
            yield out

    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
