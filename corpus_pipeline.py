"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing to target weights, best-fit packing.

All stages read whole texts of any length, take null texts as empty and null sources as a source of their own, give an empty table an
empty result, and leave columns of documents that are named like their results as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, langid, mixing, packing, simhash
from tessera.llm.common import new_folder, restored, shielded

#: A document goes if it has no letters, or if no language is more likely than all others together.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; null and empty texts, and those without letters, go. Of languages that are equally likely the
    first of the model counts. Repeated rows are told alike. lang stays as it is."""
    model = langid.fit(docs.filter(~langid.held_out()), langid.default_vocabulary())
    told = langid.predict(shielded(docs, ["lang_pred", "score"]), model)
    return restored(told.filter(f"lang_pred <> 'und' and score >= {LEAST_SCORE}"), docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id (null is the largest); of rows that repeat text and id, one."""
    return exact_dedup.kept_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked texts, the document with the smallest id; rows without an id stay; of rows that repeat text and id, one."""
    return simhash.kept_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix repeats them, three times at most; a text without words has size 0 and is repeated like those beside it."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens; an empty text is one token, repeated rows are packed each."""
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]
#: SQL has no XXH64, no tokenizer and no fitted model: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each is written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
