"""From documents to packed training sequences: language ID, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns the columns of documents, but for the
last, which returns packed pieces. In the first stage texts go that are in none of the languages learned from the labelled documents:
null, without a letter, or likelier under a background model than under the best language; of each group of near-duplicates one
document stays in the second; the third repeats or leaves out documents so that sources have their target shares; the fourth cuts and
packs what is left. Edge cases are those of the operators, in lexibrook/llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexibrook.llm import langid, mixing, packing, simhash
from lexibrook.llm.common import forget, saved, table
from lexibrook.llm.tokens import vocabulary_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, langid.train(docs, vocabulary_path("piece_bpe_32k.model")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(saved(packing.pieces(docs, vocabulary_path("word_bpe_49k.json")), "pipeline-pieces"))


STAGES = [("language_id", known_language), ("simhash_near_dedup", one_of_each), ("mixing", mixed), ("packing", packed)]
#: Neither language scores nor XXH64 fingerprints can be had from DuckDB: tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again; a stage's rows go once the next one's are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            forget(before)
        before = docs
    return docs
