"""The queries of the training-text operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chatfmt, langid, media, mixing, neardup, oracles, periodic, pieces, pii, quality, secrets, toxicity, trie, warc

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(_table(spark, sf_dir, "documents"), with_text=False)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    control = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return chatfmt.read_back(chatfmt.segments(turns.unionByName(control)))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 9))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(_table(spark, sf_dir, "documents"), pieces.Vocabulary.load(PIECE_MODEL))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents"), with_media=False).drop("error")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(_table(spark, sf_dir, "pages"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.digest(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_minhash_near_dedup": op2_minhash_near_dedup,
        "op3_language_id": op3_language_id,
        "op4_toxicity": op4_toxicity,
        "op5_chat_format": op5_chat_format,
        "op6_source_mixing": op6_source_mixing,
        "op7_pii": op7_pii,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_media_columns": op9_media_columns,
        "op10_secret_scan": op10_secret_scan,
        "op11_warc": op11_warc,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": oracles.quality_sql(),
        "op5_chat_format": oracles.CHAT_SQL,
        "op6_source_mixing": oracles.MIXING_SQL,
        "op7_pii": oracles.pii_sql(),
        "op10_secret_scan": oracles.secrets_sql(),
        "op11_warc": oracles.WARC_SQL,
        "op12_periodic_runs": oracles.PERIODIC_SQL,
        "op13_prefix_trie": oracles.TRIE_SQL,
    }
