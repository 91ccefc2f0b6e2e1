"""A corpus from raw documents to packed sequences, in five stages; each is written and read again by the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogmill.llm.common import table, written
from dialogmill.llm.near_dedup import keep_one
from dialogmill.llm.packing import pack
from dialogmill.llm.quality import keep_good
from dialogmill.llm.quality_rules import keep_passing
from dialogmill.llm.suffix_dedup import remove_repeats


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without common lines; exact copies count as one text there, as near dedup removes them later."""
    return keep_passing(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a quality score of 0.3 or more, learned from the labelled ones among them."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more; one of repeated rows, with or without an id."""
    return keep_one(docs, size=5)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that occur earlier."""
    return remove_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", rules), ("quality classifier", quality), ("near dedup", near_dedup), ("suffix dedup", suffix_dedup), ("packing", packing)]

#: No SQL: a trained model, a tokenizer and a packing heuristic. tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
