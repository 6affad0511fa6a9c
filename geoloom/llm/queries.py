"""The registered queries of this subpackage: thin views of the operators over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import divergence, exact_dedup, filter_audit, fingerprints, html_extract, line_dedup, packing, quality, sentencepiece_codec, sharding, simhash, suffix_dedup, toxicity
from geoloom.llm.common import scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(mod: int, rest: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == rest, F.lit(False))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), ~_held_out(4, 2))
    return quality.score_documents(docs, model).select("doc_id", _held_out(4, 2).alias("held_out"), "score", (F.col("score") >= quality.GOOD).cast("int").alias("predicted"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(_table(spark, sf_dir, "documents"), keep_first=False)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents")).drop("ids")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: pieces, byte pieces, CRC-32 of the ids, digest of what they decode to."""
    coded = sentencepiece_codec.encode(_table(spark, sf_dir, "documents"))
    return coded.select("doc_id", "n_pieces", "n_bytes", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), ~_held_out(5, 0))
    return toxicity.score_documents(docs, model).select("doc_id", _held_out(5, 0).alias("held_out"), "score", (F.col("score") >= toxicity.TOXIC).cast("int").alias("predicted"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(_table(spark, sf_dir, "documents"))


ARRIVALS = 4


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in ARRIVALS arrivals by a hash of their id, compacted; per document its digest and shard's version."""
    docs, store = _table(spark, sf_dir, "documents"), scratch(spark, "store")
    for k in range(ARRIVALS):
        sharding.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == k), store)
    sharding.compact(spark, store)
    listed = sharding.manifest(spark, store).select("shard", "n_rows", "added")
    rows = sharding.read(spark, store).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.col("_metadata.file_path").alias("shard"))
    return rows.join(listed, "shard").select("doc_id", "text_sha256", F.element_at(F.split("shard", "/"), -1).alias("shard"), F.col("n_rows").alias("shard_rows"), F.col("added").alias("shard_version"))


def op11_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_quality, op3_exact_dedup, op4_suffix_dedup, op5_packing, op6_sentencepiece, op7_toxicity, op8_line_dedup, op9_simhash, op10_sharding, op11_html_extract, op12_filter_audit, op13_source_divergence)}

ORACLE = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
            row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op12_filter_audit": filter_audit.ORACLE_SQL,
    "op13_source_divergence": divergence.ORACLE_SQL,
}
