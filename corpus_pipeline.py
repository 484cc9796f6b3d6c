"""From raw documents to token ids: five stages, each over all that the one before kept.

1. quality rules: documents that the repetition rules reject go.
2. n-gram Jaccard join: of each group of near duplicates the document with the smallest id stays.
3. benchmark decontamination: documents that hold a window of a test item go.
4. secret scans: every finding is masked in its text; no document goes.
5. BPE: ids of each text, their number, and digests of the ids and of the text that they decode to.

Stages 1 to 4 return the columns of `documents` as they were (stage 4 also sets n_chars of a masked text).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tenurekit.llm import bpe, decontaminate, prefix_tree, quality, secrets
from tenurekit.llm.queries import vocabulary_path
from tenurekit.llm.store import ship, written
from tenurekit.llm.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return prefix_tree.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return secrets.mask_secrets(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.round_trip(docs, vocabulary_path(), with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("BPE encoding and decoding", token_ids),
]

#: SQL can't express BPE; tests/llm/test_pipeline.py compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
