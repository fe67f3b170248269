"""The queries of this subpackage: opN_<name> applies operator N, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from querncore.llm.common import table
from querncore.llm.sql import RESAMPLING, WARC, sort_means_sql


def tokenizer_path(name: str) -> str:
    """Where the public tokenizers' files lie on this machine; each worker asks for itself, the paths may differ."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querncore.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querncore.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querncore.llm.fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querncore.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), percent=90, width=3)


def op3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querncore.llm.records import read_records, write_records

    manifest = write_records(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end=1)
    return read_records(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from querncore.llm.unigram import encode_texts

    out = encode_texts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querncore.llm.nearest import nearest

    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", 20)


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querncore.llm.lm import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from querncore.llm.licenses import license_scan

    found = license_scan(table(spark, sf_dir, "documents"))
    families = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"])))
    return found.select("doc_id", F.size("found").cast("long").alias("n_found"), F.array_join(families, ",").alias("families"), F.array_max(F.transform("found", lambda x: x["probability"])).alias("top_probability"), F.to_json("found").alias("found"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querncore.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querncore.llm.centroids import cluster

    return cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, seed=1, dims=64, scale=64)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querncore.llm.warc import read_warc, write_warc

    path = write_warc(table(spark, sf_dir, "pages"), least=1000)
    schema = "record_type string, source_id long, payload_bytes long, payload_digest string, refers_to_source_id long"
    records = read_warc(spark, path, schema, where="record_type IN ('response', 'revisit')", verify=True)
    return records.selectExpr("source_id AS page_id", "payload_bytes", "payload_digest", "record_type", "refers_to_source_id AS refers_to")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querncore.llm.resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=1, buckets=10_000, seed=2024, least=20, percent=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_fingerprints, op2_jaccard_join, op3_records, op4_quality, op5_token_counts, op6_unigram, op7_nearest, op8_lm_scores, op9_licenses, op10_mixing, op11_sort_means, op12_warc, op13_resampling, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can express; for the others tests/llm holds brute-force versions."""
    return {"op11_sort_means": sort_means_sql(), "op12_warc": WARC, "op13_resampling": RESAMPLING}
