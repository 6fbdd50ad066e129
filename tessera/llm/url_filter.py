"""URL filtering by a Bloom filter cascade.

A filter of level 1 holds the listed keys, one of level 2 the keys of the corpus that level 1 takes wrongly for listed,
one of level 3 the listed keys that level 2 takes wrongly for such, and so on until no key of the corpus is wrong. A key of
the corpus is listed if the first level that misses it is an even one: exact membership, and a row needs no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

#: (verdict, host, path): a rule fits its host and all subdomains where the url's path starts with the rule's.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Bits a key in level 1 and in the others, hash functions of each level, and the least and most bits of a level (8 kB, 2 MB). With a
#: few listed keys the least bits leave next to nothing of a corpus of any size for level 2. At the most bits a level holds some
#: four million keys as meant; with more it takes more of the others wrongly, and more levels follow.
FIRST_BITS, NEXT_BITS, HASHES, MIN_BITS, MAX_BITS = 8, 4, 2, 2**16, 2**24


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Keys under which a rule may be listed that fits: each host suffix with the path's first characters."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    heads = [F.substring(path, 1, n) for n in path_lengths]
    paths = F.array_compact(F.array(*(F.when(F.length(path) >= n, p) for n, p in zip(path_lengths, heads, strict=True)))) if heads else F.array().cast("array<string>")
    return F.flatten(F.transform(suffixes, lambda s: F.transform(paths, lambda p: F.concat(s, p))))


def _spots(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * HASHES + i)), F.lit(bits)) for i in range(HASHES)]


class Cascade:
    """Levels of Bloom filters, each a number of bits and its bytes, which become one binary constant in a query."""

    def __init__(self, levels: list[tuple[int, bytes]]):
        self.levels = levels

    @staticmethod
    def _filter(keys: DataFrame, level: int, per_key: int) -> tuple[int, bytes]:
        bits = MIN_BITS
        n = keys.count()
        while bits < min(MAX_BITS, per_key * n):
            bits *= 2
        spots = keys.select(F.explode(F.array(*_spots(F.col("key"), level, bits))).alias("spot"))
        one = F.expr("shiftleft(1L, cast(spot % 64 as int))")
        words = spots.groupBy(F.floor(F.col("spot") / 64).alias("word")).agg(F.bit_or(one).alias("set"))
        packed = bytearray(bits // 8)
        for word, value in words.collect():  # MAX_BITS / 64 rows at most
            packed[word * 8 : word * 8 + 8] = value.to_bytes(8, "little", signed=True)
        return bits, bytes(packed)

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, most: int = 40) -> Cascade:
        """listed, universe: distinct keys in a column ``key``. Exact for the keys of both. Keys that are left after
        ``most`` levels (filters at their most bits) raise an error."""
        listed = listed.select("key").distinct()
        others = universe.select("key").filter("key is not null").distinct().join(listed, "key", "left_anti")
        made, one, two = cls([]), listed, others
        while len(made.levels) < most:
            if one.isEmpty():
                return made
            made.levels.append(cls._filter(one, len(made.levels), NEXT_BITS if made.levels else FIRST_BITS))
            one, two = two.filter(made._in(F.col("key"), len(made.levels) - 1)), one
        raise ValueError("the cascade does not end: raise the bits a key")

    def _in(self, key: Column, level: int) -> Column:
        bits, packed = self.levels[level]
        table, test = F.lit(packed), F.lit(True)
        for spot in _spots(key, level, bits):
            byte = F.ascii(F.decode(F.substring(table, F.shiftright(spot, 3).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
            test = test & (F.call_function("getbit", byte, spot.bitwiseAND(7).cast("int")) == 1)
        return test

    def contains(self, key: Column) -> Column:
        """Whether a key of the corpus is listed: False if level 1 misses it, True if level 2 does, and so on."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(~self._in(key, level), F.lit(level % 2 == 1)).otherwise(out)
        return out


def judge_urls(pages: DataFrame, rules=RULES, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict.

    The longest rule that fits decides; of rules of one length that with the longer host. Where none fits, the cascades
    say that no key of the url is listed, and the verdict is ``default``. A null url, or one without ``://``, has an
    empty host and path. Repeated rows, an empty table and extra columns are fine; columns named as results are replaced.
    A url of any length is judged whole: its keys are made of the rules' lengths of path and of each suffix of the host.
    """
    spark = pages.sparkSession
    lengths = sorted({len(p) for _, _, p in rules})
    parts = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    keys = candidate_keys(F.col("host"), F.col("path"), lengths)
    universe = staged(parts.select("host", "path").distinct().select(F.explode(keys).alias("key")).distinct(), "keys")  # each level reads it
    verdicts = sorted({v for v, _, _ in rules})
    cascades = {}
    for v in verdicts:
        listed = spark.range(1).select(F.explode(F.array(*(F.lit(h + p) for w, h, p in rules if w == v))).alias("key"))
        cascades[v] = Cascade.build(listed, universe)

    def marked(k: Column) -> Column:
        verdict = F.lit(None).cast("string")
        for v in verdicts:
            verdict = F.when(cascades[v].contains(k), F.lit(v)).otherwise(verdict)
        return F.struct(F.length(k).alias("n"), F.instr(k, "/").alias("h"), k.alias("rule"), verdict.alias("verdict"))

    best = F.array_max(F.filter(F.transform(keys, marked), lambda m: m["verdict"].isNotNull()))
    judged = parts.withColumn("_t_best", best)
    return judged.withColumns({"rule": F.col("_t_best.rule"), "verdict": F.coalesce("_t_best.verdict", F.lit(default))}).drop("_t_best")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH p AS (
  SELECT page_id, lower(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '')) AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
f AS (SELECT p.*, r.verdict, rhost || rpath AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS n
      FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE n = 1
"""
