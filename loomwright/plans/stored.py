"""Queries that write the given tables as the readers' files and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chat
from ..sources import io, reader
from ..sources.shared import shared_folder
from . import derived


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _by_id(docs: DataFrame) -> DataFrame:
    """The rows in the order of their ids, which Spark's writers keep over the files; Spark reads files in the order of their sizes."""
    return docs.orderBy(F.col("doc_id").asc_nulls_last())


def data_jsonl(spark, sf_dir):
    """Objects of JSON lines, through our own source, with their positions in the files."""
    path = _folder(spark)
    _by_id(_documents(spark, sf_dir).select("doc_id", "text", "lang")).write.json(path)
    rows = reader.read_positioned(spark, path, "doc_id long, text string, lang string")
    return rows.select("doc_id", F.col("_pos").alias("position"), "lang", F.sha2("text", 256).alias("text_sha256"))


def data_jsonl_head(spark, sf_dir):
    """The first hundred objects: the subset is the feature, and only its splits are read."""
    path = _folder(spark)
    _by_id(_documents(spark, sf_dir).select("doc_id", "n_chars")).write.json(path)
    return reader.read_positioned(spark, path, "doc_id long, n_chars long", 100).select("doc_id", F.col("_pos").alias("position"), "n_chars")


def results_file(spark, sf_dir):
    """Results written with the columns of their schema and read as an attempt log."""
    path = io.result_path(_folder(spark), "model", "orders")
    log = derived.view(spark, sf_dir, derived.ATTEMPT_LOG, "orders")
    rows = log.select(F.col("task").cast("string").alias("task_id"), F.col("attempt").alias("fix_mode_attempt_count"), "status", "model")
    io.write_results(rows, path, ["task_id", "fix_mode_attempt_count", "status"])
    return io.read_attempt_log(spark, path)


def record_file(spark, sf_dir):
    """One record for each model, written as JSON and read back."""
    path = io.record_path(_folder(spark), "models")
    log = derived.view(spark, sf_dir, derived.ATTEMPT_LOG, "orders")
    io.write_record(log.groupBy("model").agg(F.count(F.lit(1)).alias("total"), F.sum(F.when(F.col("status") == "pass", 1).otherwise(0)).alias("solved")), path)
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?<=\})\n")).alias("record")).where("trim(record) <> ''")
    return whole.select(F.from_json("record", "model string, total long, solved long").alias("x")).select("x.*")


def documents_file(spark, sf_dir):
    """Records of CSV files as texts of one line for each column."""
    path = f"{_folder(spark)}/documents.csv"
    io.write_results(_documents(spark, sf_dir), path, ["doc_id", "lang", "source"])
    return io.read_documents(spark, path).select("text")


def tuning_file(spark, sf_dir):
    """Pairs of questions and answers, written and read as tuning pairs."""
    path = _folder(spark)
    pairs = chat.qa_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    pairs.select(F.col("question").alias("Question"), F.col("answer").alias("Answer")).write.parquet(path)
    return io.read_tuning_pairs(spark, path, "parquet").select(F.sha2("Question", 256).alias("question_sha256"), F.sha2("Answer", 256).alias("answer_sha256"))


QUERIES = (data_jsonl, data_jsonl_head, results_file, record_file, documents_file, tuning_file)

_LOG = f"l AS ({derived.ATTEMPT_LOG})"
SQL = {
    "data_jsonl": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, lang, sha256(text) AS text_sha256 FROM documents",
    "data_jsonl_head": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, n_chars FROM documents ORDER BY doc_id LIMIT 100",
    "results_file": f"WITH {_LOG} SELECT task::VARCHAR AS task_id, attempt AS fix_mode_attempt_count, status FROM l",
    "record_file": f"WITH {_LOG} SELECT model, count(*) AS total, count(*) FILTER (status = 'pass') AS solved FROM l GROUP BY model",
    "documents_file": "SELECT 'doc_id: ' || doc_id || chr(10) || 'lang: ' || coalesce(lang, '') || chr(10) || 'source: ' || coalesce(source, '') AS text FROM documents",
    "tuning_file": """WITH t AS (SELECT *, lag(text) OVER w AS q, lag(role) OVER w AS asker FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
      SELECT sha256(q) AS question_sha256, sha256(text) AS answer_sha256 FROM t WHERE role = 'assistant' AND asker = 'user'""",
}
