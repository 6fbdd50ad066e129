"""WARC archives of pages with a two-level capture index.

Tasks write gzip-per-record archives to a folder that all machines share and return each record's place. The places are
sorted by reversed-host key into compressed blocks (level 2); the first key of each block makes a sparse directory
(level 1), a file beside each file of blocks. A lookup binary-searches the first keys of the files, of which there are as
many as tasks that wrote them, then the directory of one, reads a block by its byte range and then the record by its own.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import urllib.parse
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, staged, text_of, with_group
from .filters import split

#: Payloads below this many bytes are never revisits.
LEAST_BYTES = 100
#: Index lines of a compressed block, and records that one task writes to an archive.
BLOCK_LINES = 300
FILE_RECORDS = 20_000

LINE = "key string, page_id long, url string, record_type string, file string, offset long, length long"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Ranges:
    """Reads byte ranges of files below a folder; keeps the last file open."""

    def __init__(self, folder: str):
        self.fs, self.path = _open(folder)
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            self.name, self.file = name, self.fs.open_input_file(f"{self.path}/{name}")
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file:
            self.file.close()
        self.name, self.file = None, None


def url_key(url: Column) -> Column:
    """Reversed host, ``)`` and the rest: ``org,example,www)/a?b``. A null url has the key ``)``."""
    u = F.coalesce(url, F.lit(""))
    rest = F.regexp_replace(u, r"^[\s\S]*?://", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(rest, r"^[^/?#]*", ""))


def captures(pages: DataFrame, id_col: str = "page_id", text_col: str = "html") -> DataFrame:
    """pages with payload_bytes, payload_digest, record_type and refers_to; revisits without their payload.

    A null payload is empty. Of payloads of LEAST_BYTES or more that are equal, the one with the smallest id is the
    response. A null id sorts last; of rows that repeat both id and payload, each with the smallest id is a response.

    Which rows revisit another is found from ids and digests alone. A filter of these rows then lets all others pass with their
    payloads, a filter of its false hits tells these, and only they, and what little hits both, are joined with payloads.
    """
    payload = text_of(text_col).cast("binary")
    rows = pages.withColumns({"payload_bytes": F.octet_length(text_of(text_col)).cast("long"), "payload_digest": F.sha2(payload, 256)})
    seen = staged(rows.filter(F.col("payload_bytes") >= LEAST_BYTES).select(F.col(id_col).alias("_t_id"), F.col("payload_digest").alias("_t_of")), "digests")
    groups = seen.groupBy("_t_of").agg(F.min("_t_id").alias("_t_first"), F.count("*").alias("_t_n")).filter("_t_n > 1")
    later = with_group(seen, groups, "_t_of", "_t_n", seen.count()).filter(F.col("_t_first").isNotNull() & ~F.col("_t_id").eqNullSafe(F.col("_t_first")))
    again = staged(later.select("_t_id", "_t_of", "_t_first").distinct(), "revisits")
    key, listed = F.xxhash64(id_col, "payload_digest"), F.xxhash64("_t_id", "_t_of")
    fits = F.col(id_col).eqNullSafe(F.col("_t_id")) & (F.col("payload_digest") == F.col("_t_of"))
    hits, passed = split(rows, key, again.select(listed))
    told = again.select(F.col("_t_id").alias("_t_id2"), F.col("_t_of").alias("_t_of2"))
    named = hits.select(F.col(id_col).alias("_t_id"), F.col("payload_digest").alias("_t_of")).distinct()
    false = staged(named.join(told, F.col("_t_id").eqNullSafe(F.col("_t_id2")) & (F.col("_t_of") == F.col("_t_of2")), "left_anti"), "hits")
    both, sure = split(hits, key, false.select(listed))
    bare = sure.withColumn(text_col, F.lit(None).cast(pages.schema[text_col].dataType))
    told = bare.join(again, fits, "left").unionByName(both.join(again, fits, "left"))
    kind = F.when(F.col("_t_first").isNotNull(), "revisit").otherwise("response")
    text = F.when(F.col("_t_first").isNull(), F.col(text_col))
    told = told.withColumns({"record_type": kind, "refers_to": F.col("_t_first"), text_col: text})
    passed = passed.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast(pages.schema[id_col].dataType)})
    return passed.unionByName(told.select(passed.columns))


def _record(page_id, url, payload: bytes, size: int, digest: str, kind: str, refers_to) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + payload if kind == "response" else http
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        head.append(("WARC-Target-URI", urllib.parse.quote(url, safe="%/:?#[]@!$&'()*+,;=~")))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(size))]
    if kind == "revisit":
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Header fields and payload (empty for a revisit) of a gzip member."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    return {"fields": fields, "payload": body.partition(b"\r\n\r\n")[2]}


def _writer(folder: str):
    def run(batches):
        from pyspark import TaskContext

        context, sent = TaskContext.get(), 0
        fs, path = _open(folder)
        out, name, offset, lines = None, "", 0, []

        def done():
            """A finished archive gets its name at once, and is the same for any attempt that gets as far."""
            nonlocal out, lines
            out.close()
            fs.move(f"{path}/{name}.{context.taskAttemptId()}.tmp", f"{path}/{name}")
            columns = list(zip(*lines, strict=True))
            lines, out = [], None
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "url", "record_type", "file", "offset", "length"])

        for b in batches:
            for at in range(0, b.num_rows, 500):
                for key, page_id, url, payload, size, digest, kind, refers_to in zip(*(c.to_pylist() for c in b.slice(at, 500).columns), strict=True):
                    if out is None:
                        name, offset = f"part-{context.partitionId():05d}-{sent:04d}.{context.taskAttemptId()}.warc.gz", 0
                        out = fs.open_output_stream(f"{path}/{name}.{context.taskAttemptId()}.tmp")
                        sent += 1
                    data = gzip.compress(_record(page_id, url, payload or b"", size, digest, kind, refers_to), 6, mtime=0)
                    out.write(data)
                    lines.append((key, page_id, url, kind, name, offset, len(data)))
                    offset += len(data)
                    if len(lines) >= FILE_RECORDS:
                        yield done()
        if out is not None:
            yield done()

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", text_col: str = "html", url_col: str = "url") -> DataFrame:
    """Writes the archives below ``folder`` and returns the index lines (a staged table). A retried task writes archives
    of its own names; the lines of the attempt that succeeded name the archives that count.

    A null html is an empty payload, a null url has no target and the key ``)``, a null page has no number; repeated rows
    are records each; payloads of any length are whole; an empty table writes no archive. Other columns are dropped.
    """
    fs, path = _open(folder)
    fs.create_dir(f"{path}/archives", recursive=True)
    rows = captures(pages.select(id_col, url_col, text_col), id_col, text_col)
    payload = F.when(F.col("record_type") == "response", text_of(text_col).cast("binary"))
    rows = rows.select(url_key(F.col(url_col)).alias("key"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))
    return staged(rows.mapInArrow(_writer(f"{folder}/archives"), LINE), "places")


def _pair(key: str, page_id) -> tuple:
    """What the index is sorted by: the key, then the page, null first."""
    return key, page_id is not None, page_id or 0


def write_index(lines: DataFrame, folder: str) -> DataFrame:
    """Level 2: lines sorted by key and page in compressed blocks below ``folder``; level 1: a directory file for each of
    these files, with the first line's key, offset and length of each block. Returns a row per file, in order: part, file,
    key and page of its first line, length of its directory, and lines."""
    fs, path = _open(folder)
    fs.create_dir(f"{path}/index", recursive=True)

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, path = _open(f"{folder}/index")
        held, directory, offset, n, out, name = [], [], 0, 0, None, f"part-{context.partitionId():05d}.{context.taskAttemptId()}"

        def block():
            nonlocal held, offset, n, out
            if out is None:
                out = fs.open_output_stream(f"{path}/{name}.idx")
            data = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in held).encode(), 6)
            out.write(data)
            directory.append((held[0][0], held[0][1], offset, len(data)))
            offset, n, held = offset + len(data), n + len(held), []

        for b in batches:
            for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(x)
                if len(held) == BLOCK_LINES:
                    block()
        if held:
            block()
        if out is not None:
            out.close()
            data = zlib.compress(json.dumps(directory).encode(), 6)
            with fs.open_output_stream(f"{path}/{name}.dir") as f:
                f.write(data)
            row = (context.partitionId(), name, directory[0][0], directory[0][1], len(data), n)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["part", "file", "first_key", "first_page", "directory_length", "n"])

    ordered = lines.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return staged(ordered.mapInArrow(run, "part int, file string, first_key string, first_page long, directory_length long, n long"), "index")


class Lookup:
    """Finds records by url key. Held are a row per index file, the directory of one and the lines of one block, so
    lookups in the order of the index read each of these once."""

    def __init__(self, files: list[tuple], folder: str):
        """files: what write_index returns, collected (a row per task that wrote the index, whatever the corpus)."""
        self.files = sorted(tuple(f) for f in files)
        self.firsts = [_pair(f[2], f[3]) for f in self.files]
        self.index, self.archives = Ranges(f"{folder}/index"), Ranges(f"{folder}/archives")
        self.directory: tuple = (None, [], [])  # file number, its blocks, the first pair of each
        self.block: tuple = (None, [], [])  # file and block number, its lines, the pair of each

    def _blocks(self, k: int) -> tuple[list, list]:
        if self.directory[0] != k:
            blocks = json.loads(zlib.decompress(self.index.read(f"{self.files[k][1]}.dir", 0, self.files[k][4])))
            self.directory = k, blocks, [_pair(b[0], b[1]) for b in blocks]
        return self.directory[1:]

    def _lines(self, k: int, i: int) -> tuple[list, list]:
        if self.block[0] != (k, i):
            _, _, offset, length = self._blocks(k)[0][i]
            lines = [json.loads(x) for x in zlib.decompress(self.index.read(f"{self.files[k][1]}.idx", offset, length)).decode().split("\n")]
            self.block = (k, i), lines, [_pair(x[0], x[1]) for x in lines]
        return self.block[1:]

    def between(self, low: tuple, high: tuple) -> Iterator[list]:
        """Index lines whose pair is from low to high, by binary search at each level; they may run over blocks and files."""
        for k in range(max(0, bisect.bisect_left(self.firsts, low) - 1), len(self.files)):
            if self.firsts[k] > high:
                return
            _, firsts = self._blocks(k)
            for i in range(max(0, bisect.bisect_left(firsts, low) - 1), len(firsts)):
                if firsts[i] > high:
                    return
                lines, pairs = self._lines(k, i)
                yield from lines[bisect.bisect_left(pairs, low) : bisect.bisect_right(pairs, high)]

    def lines(self, key: str) -> list[list]:
        """Index lines of all captures of a key."""
        return list(self.between((key, False, 0), (key, True, float("inf"))))

    def records(self, key: str) -> list[dict]:
        return [parse_record(self.archives.read(*x[4:7])) for x in self.lines(key)]

    def close(self) -> None:
        self.index.close()
        self.archives.close()


def read_back(files: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """Every record of the wanted (key, page_id), looked up in the index: page_id, payload_bytes, payload_digest (computed
    from a response's payload, the header's for a revisit), record_type, refers_to.

    Lookups are dealt by ranges of the index, so a hot key is dealt by its pages; each pair is looked up once, however
    often it is wanted, and gives all its records. Null keys are looked up as any other; a pair that is not in the index
    gives no row. Other columns of wanted are dropped.
    """
    held = files.collect()  # a row per task of the index

    def number(x: str):
        x = x.removeprefix("<urn:page:").removesuffix(">")
        return int(x) if x not in ("", "None") else None

    def row(data: bytes) -> tuple:
        r = parse_record(data)
        f, payload = r["fields"], r["payload"]
        if f["WARC-Type"] == "response":
            return number(f["WARC-Record-ID"]), len(payload), hashlib.sha256(payload).hexdigest(), "response", None
        return number(f["WARC-Record-ID"]), int(f["X-Payload-Length"]), f["WARC-Payload-Digest"].removeprefix("sha256:"), "revisit", number(f["WARC-Refers-To"])

    def run(batches):
        look, before = Lookup(held, folder), None
        for b in batches:
            found = []
            for key, page_id in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                pair = _pair(key, page_id)
                if pair != before:
                    found += look.between(pair, pair)
                before = pair
            found.sort(key=lambda x: (x[4], x[5]))  # each archive is opened once for a batch
            rows = [row(look.archives.read(*x[4:7])) for x in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        look.close()

    ordered = wanted.select("key", F.col("page_id").cast("long").alias("page_id")).repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return ordered.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, pages = new_folder(spark, "warc"), spark.read.parquet(f"{sf_dir}/pages.parquet")
    files = write_index(write_archives(pages, folder), folder)
    return read_back(files, folder, pages.select(url_key(F.col("url")).alias("key"), "page_id"))


SQL = """
WITH t AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM t)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM g
"""
