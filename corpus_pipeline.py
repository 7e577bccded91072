"""From raw documents to tokens, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``.

1. quality classifier: documents scored below 0.3 go;
2. MinHash near-dedup: of each group of near-duplicates the smallest doc_id stays;
3. substring dedup: passages of 50 words or more that an earlier document has are cut;
4. benchmark decontamination: documents with a twentieth of their words inside benchmark windows go;
5. SentencePiece encoding: doc_id, n_tokens and ids of what is left.

Stage 3 updates ``n_chars`` of the documents it cuts, and keeps documents that
become empty.  Null texts and ids follow the operators' rules; an empty table
passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagefold.llm import classifier, contamination, near, pieces, substrings
from pagefold.llm.common import settle, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    before = docs.withColumn("__was", F.length("text"))
    cut = substrings.dedup_substrings(before)
    if "n_chars" in docs.columns:
        changed = F.length("text").eqNullSafe(F.col("__was"))
        cut = cut.withColumn("n_chars", F.when(changed, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, pieces.load(spark, pieces.MODEL)).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality_classifier", good_quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: The first and the last stage cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs)
    return docs
