"""The registered queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, centroids, decontam, html_main, jaccard_join, langid, line_dedup, merkle, quality, repeats, shard_pack, simhash, token_store
from ._common import table

END_ID = 2


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_pack.assign_shards(table(spark, sf_dir, "documents"))


def op2_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_elias_fano_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_store(spark, token_store.write_store(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID))


def op4_pigeonring_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_segment_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op6_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(table(spark, sf_dir, "pages"))


def op9_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op10_prefix_interval_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_drake_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_count_vector_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_vector_packing": op1_vector_packing,
    "op2_byte_cnn": op2_byte_cnn,
    "op3_elias_fano_store": op3_elias_fano_store,
    "op4_pigeonring_simhash": op4_pigeonring_simhash,
    "op5_segment_partition": op5_segment_partition,
    "op6_transducer_bpe": op6_transducer_bpe,
    "op7_cgk_decontamination": op7_cgk_decontamination,
    "op8_host_suffix_array": op8_host_suffix_array,
    "op9_weak_supervision": op9_weak_supervision,
    "op10_prefix_interval_repeats": op10_prefix_interval_repeats,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_drake_centroids": op12_drake_centroids,
    "op13_count_vector_rtree": op13_count_vector_rtree,
}

ORACLES: dict[str, str] = {
    "op5_segment_partition": line_dedup.REPORT_SQL,
    "op11_merkle_manifest": merkle.MANIFEST_SQL,
    "op12_drake_centroids": centroids.CLUSTER_SQL,
    "op13_count_vector_rtree": jaccard_join.LINKED_SQL,
}
