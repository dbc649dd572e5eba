"""The registered queries of the training-data operators: thin digests of whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatwise.llm import backoff_lm, bit_sliced, chunk_dedup, line_dedup, merkle, mixing, packing, periodic, pu_quality, simhash, suffix_dedup, toxic_crf, warc
from seatwise.llm.common import read

#: Scores from which a document is predicted toxic.
TOXIC = 0.7

#: Scores from which a document is predicted to be of quality.
GOOD = 0.3


def op1_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_chunk_recipe_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op3_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup(read(spark, sf_dir, "documents"))
    gone = F.coalesce("gone", F.array().cast(rows.schema["gone"].dataType))
    return rows.select("doc_id", "n_lines", F.size(gone).cast("long").alias("n_dropped"),
                       gone["line"].alias("dropped_lines"), gone["keep_id"].alias("keep_ids"), gone["keep_line"].alias("keep_lines"),
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op4_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = "pmod(crc32(cast(doc_id as string)), 3) = 1"
    model = toxic_crf.fit(docs, read(spark, sf_dir, "labels"), "toxic", held_out)
    return toxic_crf.tag(docs, model).select(
        "doc_id", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op5_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = "pmod(crc32(cast(doc_id as string)), 5) = 0"
    rows = pu_quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), held_out)
    return rows.select("doc_id", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), "score",
                       (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op7_linear_grouping_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), keep_ids=False)


def op8_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced.top_k(read(spark, sf_dir, "embeddings"))


def op9_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.score(read(spark, sf_dir, "documents"))


def op10_simhash_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_dedup(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hex_digits(rows.fp).alias("fingerprint"), "component_id")


def op11_merkle_midstate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.documents_manifest(read(spark, sf_dir, "documents"), "crc32(cast(doc_id as string)) % 7 = 0")


def op12_prefix_doubling_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"), digest=True)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                       F.col("kept").alias("kept_sha256"))


def op13_frequency_split_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(read(spark, sf_dir, "documents"), plant=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_segments": op1_warc_segments,
    "op2_chunk_recipe_dedup": op2_chunk_recipe_dedup,
    "op3_line_edit_join": op3_line_edit_join,
    "op4_toxic_crf": op4_toxic_crf,
    "op5_water_filling": op5_water_filling,
    "op6_pu_quality": op6_pu_quality,
    "op7_linear_grouping_pack": op7_linear_grouping_pack,
    "op8_bit_sliced_topk": op8_bit_sliced_topk,
    "op9_backoff_lm": op9_backoff_lm,
    "op10_simhash_popcount": op10_simhash_popcount,
    "op11_merkle_midstate": op11_merkle_midstate,
    "op12_prefix_doubling_dedup": op12_prefix_doubling_dedup,
    "op13_frequency_split_runs": op13_frequency_split_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc_segments": warc.ORACLE_SQL,
    "op2_chunk_recipe_dedup": chunk_dedup.ORACLE_SQL,
    "op5_water_filling": mixing.ORACLE_SQL,
    "op8_bit_sliced_topk": bit_sliced.ORACLE_SQL,
    "op11_merkle_midstate": merkle.ORACLE_SQL,
    "op12_prefix_doubling_dedup": suffix_dedup.ORACLE_SQL,
}
