"""A corpus from raw documents to packed sequences: judged, cleaned, without near copies and secrets, packed.

Every stage takes the documents that the one before kept, as Parquet, and all but the last return their columns. What a
stage learns (classifier, field, models) it learns from its own input, so that it can run on any table of documents.

Defined cases, for every stage: an empty table gives an empty one; rows that repeat are judged each and stay as often as
they were (but for the near copies stage, which keeps one row of each group, so one of rows that repeat an id); a null or
empty text is a text without words; very long texts are read whole; further columns are carried along, whatever their
names; ties are broken by the smallest doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendril.llm import ngram_join, packing, quality_classifier, quality_rules, secret_scan
from tendril.llm.common import stored, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents with a score under a half go. Without labels every score is a half and all stay. A null or empty text has a score as any other."""
    stats = quality_classifier.document_statistics(docs)
    return quality_classifier.keep(docs, quality_classifier.fit(stats, table(spark, sf_dir, "labels")))


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that fail the base rules or hold too little content go; so a null or empty text, of under 50 words, goes."""
    return quality_rules.keep(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def single_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of near copies the document with the smallest id stays. Texts without words are no copies of each other and stay."""
    return ngram_join.representatives(docs)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: secrets are replaced by a mark; every document stays; a null text stays null."""
    return secret_scan.redact(docs, secret_scan.fit(secret_scan.samples(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: where every piece of every document stands; a null or empty text is its end token alone."""
    pieces = packing.token_pieces(docs)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [
    ("quality classifier", classify),
    ("quality rules", judge),
    ("n-gram Jaccard join", single_out),
    ("secret scans", remove_secrets),
    ("best-fit packing", pack),
]
#: The classifier, the field model, the shingle hashes and the tokens have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
