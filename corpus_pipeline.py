"""The corpus pipeline: quality rules, quality classifier, SimHash, repeated passages, packing.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and
gives a DataFrame, with the columns of documents from all stages but the last.
``run`` writes each stage's rows to the shared folder and reads them back as the
next one's. Columns beside doc_id and text pass through as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import classifier, packing, repeats, rules, simhash
from factloom.llm.common import prepare, stage, table

# words a generation of a task's cache: about 85 MB beside the tokenizer, where the queries' own size takes 210 MB
PACKING_WORDS = 1 << 16


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return rules.keep_by_rules(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on the labelled ones of these documents; those scored below the threshold go."""
    return classifier.keep_by_score(docs, table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the least doc_id; five-word shingles count beside the fingerprints."""
    return simhash.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated passages; every document stays."""
    return repeats.without_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two length."""
    return packing.pack(docs, own_words=PACKING_WORDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", pack_sequences),
]

# no SQL: a fitted model, fingerprints by XXH64 and token ids
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
