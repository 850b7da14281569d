"""A corpus, from raw documents to packed sequences, in five stages; each is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import near_copies, packing, quality_classifier, quality_rules, substring_dedup
from strandline.llm.common import shared_path, table
from strandline.llm.queries import vocabulary


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the co-trained classifier rejects. It is fitted on labelled documents of this stage's input."""
    return quality_classifier.keep(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the repetition rules reject."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one of the smallest doc_id, of each group of near-duplicates: five-word shingles, Jaccard similarity 0.8."""
    return near_copies.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out words of passages that an earlier document has too; a document that loses every word goes."""
    return substring_dedup.clean(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents left into sequences."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality_classifier", classify), ("quality_rules", rules), ("simhash_dedup", near_duplicates), ("substring_dedup", substrings), ("best_fit_packing", pack)]
#: Fingerprints, trained weights and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
