"""Gridded states that go on from run to run: versions in a folder, and batches that count once however often they come.

A version is a table of (row, col, num, beta). A manifest names the one that counts and the last batch of each stream that is
in it; it is replaced in one step once a version is whole, so a batch that is replayed, or whose run was cut off, changes nothing
or everything.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.resample import merge_states, read_state
from ..sources.files import create, is_file, read_range

SCHEMA = "row int, col int, num double, beta double"
MANIFEST = "state.json"


class StateTable:
    """States of one grid and one method below ``path``. One run at a time may write."""

    def __init__(self, spark: SparkSession, path: str, method: str = "bucket"):
        self.spark, self.path, self.method = spark, path.rstrip("/"), method

    def _manifest(self) -> dict:
        name = f"{self.path}/{MANIFEST}"
        return json.loads(read_range(name)) if is_file(name) else {"version": None, "method": self.method, "batches": {}}

    def read(self) -> DataFrame:
        """row, col, num, beta of the version that counts; no rows before the first."""
        at = self._manifest()
        if at["version"] is None:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{at['version']}")

    def values(self) -> DataFrame:
        return read_state(self.read(), self.method)

    def merge(self, state: DataFrame, batch: int, stream: str = "") -> bool:
        """Adds the state (row, col, num, beta) of a batch of a stream, by the rule of the method: sums add up, ``max`` keeps the
        larger, ``nearest`` takes the later value if its distance is at most the earlier one and 1. Batches of a stream are
        numbered upwards; one up to the last that is in is passed over (False)."""
        at = self._manifest()
        if at["method"] != self.method:
            raise ValueError(f"the states below {self.path} are of method {at['method']}")
        if batch <= at["batches"].get(stream, -1):
            return False
        version = f"version-{uuid.uuid4().hex}"
        now = state.selectExpr("cast(row as int) as row", "cast(col as int) as col", "cast(num as double) as num", "cast(beta as double) as beta")
        merge_states(self.read(), now, self.method).write.parquet(f"{self.path}/{version}")
        create(f"{self.path}/{MANIFEST}", json.dumps({"version": version, "method": self.method, "batches": {**at["batches"], stream: batch}, "before": at["version"]}).encode())
        return True


def run_into(stream: DataFrame, table: StateTable, state_of: Callable[[DataFrame], DataFrame], checkpoint: str, name: str = "", **trigger) -> StreamingQuery:
    """Streams rows into a state table: each batch's state (state_of) is merged under the batch's number. After a failure the stream
    sends its last batch again, which the table passes over if it has it."""

    def batch(df: DataFrame, number: int) -> None:
        table.merge(state_of(df), number, name)

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()
    return query
