"""A transactional sink: rows of (place, name, data, note) become files of a folder, which count only once a manifest names them.

Each task writes its files under names of its own and tells the driver names and sizes. The commit is one step: the manifest,
which lists the files of the tasks that succeeded in the order of their places, gets its name. Files of attempts that failed
are in no manifest; they go when the job ends, but for those that a task is still writing then.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .files import _at, create, read_range

#: The name of a folder's manifest, and the columns of what is written.
MANIFEST = "manifest.json"
COLUMNS = "place long, name string, data binary, note string"


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: place, file, bytes, note."""

    files: list


class Parts(DataSource):
    """``parts``, for writing. Option: path. Mode ``append`` adds to what a manifest names, ``overwrite`` starts anew."""

    @classmethod
    def name(cls) -> str:
        return "parts"

    def schema(self) -> str:
        return COLUMNS

    def writer(self, schema, overwrite):
        return PartsWriter(self.options["path"].rstrip("/"), overwrite)


class PartsWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator):
        store, folder = _at(self.path)
        store.create_dir(folder, recursive=True)
        files = []
        for row in iterator:
            name, data = f"{row['name']}.{self.job}.{uuid.uuid4().hex}", bytes(row["data"])
            with store.open_output_stream(f"{folder}/{name}") as f:
                f.write(data)
            files.append((row["place"], name, len(data), row["note"]))
        return Written(files)

    def _sweep(self, but: set) -> None:
        """Files of this job that no manifest names."""
        store, folder = _at(self.path)
        for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if f".{self.job}." in info.base_name and info.base_name not in but:
                store.delete_file(info.path)

    def commit(self, messages):
        files = sorted(tuple(f) for m in messages if m for f in m.files)
        before = [] if self.overwrite else manifest(self.path)
        start = before[-1][0] + 1 if before else 0
        listed = [*before, *((start + place, *rest) for place, *rest in files)]
        create(f"{self.path}/{MANIFEST}", json.dumps(listed).encode())
        self._sweep({f[1] for f in files})

    def abort(self, messages):
        self._sweep(set())


def manifest(path: str) -> list[tuple]:
    """place, file, bytes and note of the files that count, in order; none where there is no manifest."""
    store, folder = _at(path.rstrip("/"))
    if store.get_file_info(f"{folder}/{MANIFEST}").type == fs.FileType.NotFound:
        return []
    return [tuple(f) for f in json.loads(read_range(f"{path.rstrip('/')}/{MANIFEST}"))]


def write_parts(df: DataFrame, path: str, overwrite: bool = True) -> list[str]:
    """Writes COLUMNS as files below ``path`` and returns the files that count, in order."""
    df.sparkSession.dataSource.register(Parts)
    df.write.format("parts").option("path", path).mode("overwrite" if overwrite else "append").save()
    return [f"{path.rstrip('/')}/{name}" for _, name, *_ in manifest(path)]


def joined(spark: SparkSession, path: str, file: str, block: int = 8 * 2**20) -> str:
    """The parts of a folder as one file, copied in order by one task, a block at a time; the driver sees sizes only."""
    parts = [(name, size) for _, name, size, _ in manifest(path)]

    def run(batches):
        list(batches)
        store, target = _at(file)
        store.create_dir(target.rpartition("/")[0], recursive=True)
        part = f"{target}.{uuid.uuid4().hex}.part"
        with store.open_output_stream(part) as out:
            for name, size in parts:
                for at in range(0, size, block):
                    out.write(read_range(f"{path.rstrip('/')}/{name}", at, min(block, size - at)))
        store.move(part, target)
        return iter(())

    spark.range(1).coalesce(1).mapInArrow(run, "id long").collect()
    return file
