"""The opN_ queries: thin digests over the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, decontamination, fingerprints, html_extract, license_scan, manifest, ngram_join, oracles, packing, quality_classifier, quality_rules, secret_scan, segmentation, url_filter
from .common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"))
    placed = packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each sample, a digest of its ids, and a digest of the text that they decode to."""
    drawn = segmentation.sample(table(spark, sf_dir, "documents"), with_text=True)
    return drawn.select("doc_id", "sample", "n_pieces", "log_prob", "perturbed", "log_inclusion", F.crc32("ids").alias("ids_crc32"), F.crc32("text").alias("text_crc32"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scanned = secret_scan.scan(docs.select("doc_id", "text"), secret_scan.fit(secret_scan.samples(docs)))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{secret_scan.KINDS[kind]}")
    return scanned.select("row.doc_id", number(0), number(1), number(2), F.sha2(secret_scan.written("base"), 256).alias("base_sha256"), secret_scan.written("spans").alias("spans"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality_classifier.document_statistics(table(spark, sf_dir, "documents"))
    model = quality_classifier.fit(stats, table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(stats, model)
    return scored.select("doc_id", (quality_classifier.fold() == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = url_filter.mine(url_filter.labelled_by_rules(pages))
    return url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict", "confidence")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template")


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_quality_rules, op3_fingerprints, op4_sentencepiece, op5_ngram_jaccard_join, op6_license_scan, op7_secret_scan, op8_quality_classifier, op9_url_filter, op10_html_extraction, op11_benchmark_decontamination, op12_merkle_manifest, op13_centroid_clustering)}
ORACLE_SQL = oracles.ORACLE_SQL
