"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.bpe import round_trip_digests
from cadenza.llm.collocations import COLLOCATIONS_SQL, collocations
from cadenza.llm.hard_negatives import HARD_NEGATIVES_SQL, hard_negatives
from cadenza.llm.hidden_markov import score
from cadenza.llm.line_dedup import LINE_DEDUP_SQL, drop_recurring_lines
from cadenza.llm.media import read_media, store_as_media
from cadenza.llm.near_text import near_duplicates
from cadenza.llm.near_vectors import near_duplicate_vectors
from cadenza.llm.packing import pack
from cadenza.llm.pages import extract_main_text
from cadenza.llm.repetition import QUALITY_SQL, quality_rules
from cadenza.llm.token_counts import count_tokens
from cadenza.llm.toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op3_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_as_media(table(spark, sf_dir, "documents"))
    named = stored.select(F.struct("doc_id", "n_bytes").alias("doc"), "media")
    read = read_media(named, id_col="doc")
    return read.select("doc.doc_id", "doc.n_bytes", *["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "height", "width", "rgb"])


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    mixed = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives(mixed, anchor=F.col("vec_id") % 100 == 0)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_hidden_markov": op3_hidden_markov,
    "op4_html_extraction": op4_html_extraction,
    "op5_toxicity": op5_toxicity,
    "op6_bpe_round_trip": op6_bpe_round_trip,
    "op7_line_dedup": op7_line_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_media_columns": op10_media_columns,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_quality_rules": op12_quality_rules,
    "op13_collocations": op13_collocations,
}
ORACLES: dict[str, str] = {
    "op7_line_dedup": LINE_DEDUP_SQL,
    "op11_hard_negatives": HARD_NEGATIVES_SQL,
    "op12_quality_rules": QUALITY_SQL,
    "op13_collocations": COLLOCATIONS_SQL,
}
