"""The pipeline over the documents table, as stages that each write a table and hand it on.

``STAGES`` names the stages in order; each function takes (spark, docs, sf_dir) and returns a
DataFrame. ``run`` applies them, every result written to the shared folder and read back.

* quality rules: documents that the newest policy rejects go;
* near duplicates: of each group of linked documents the one with the smallest id stays (and one
  row of equal ones); documents without an id stay;
* repeated passages: bytes that an earlier document already holds are cut from the text;
  documents of which nothing is left go;
* decontamination: documents with more than half of their words in benchmark windows go, the
  others lose the hit spans;
* packing: pieces of training sequences.

All but the last return the columns of ``docs``; n_chars, where there is one, follows the text.
Empty tables pass through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm import decontaminate, near_duplicates, packing, quality_rules, repeated_passages
from panelmill.llm.common import saved

POLICY = "v3"
VOCABULARY = "byte_bpe_50k.json"


def _recounted(rows: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(rows.schema["n_chars"].dataType))
    return rows.select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no rule of the policy fails."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    blocked = quality_rules.blocked_stems(docs, labels)
    repeated = quality_rules.repeated_stems(docs, labels)
    return quality_rules.ledger(docs, blocked, repeated=repeated).filter(quality_rules.verdict(POLICY)).select(*docs.columns)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near duplicates: its smallest document."""
    groups = near_duplicates.near_duplicates(docs)
    extra = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(extra, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def passage_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds."""
    return _recounted(repeated_passages.without_repeats(docs), docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark windows; mostly contaminated documents go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _recounted(decontaminate.decontaminated(docs, benchmark), docs.columns)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.packed(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicate_removal),
    ("suffix-array dedup", passage_removal),
    ("benchmark decontamination", decontamination),
    ("packing", sequence_packing),
]

# Near duplicates, learned stems and packing have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
