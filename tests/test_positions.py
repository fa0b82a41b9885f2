"""Positions of rows whose files are of different sizes, so that Spark reads a later one first."""

from __future__ import annotations

import pytest
from helpers import assert_same
from pyspark.sql import functions as F

from loomwright.plans import catalogue
from loomwright.sources import io


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents in three files: the last one is the largest, the first one has the last ids."""
    at = tmp_path_factory.mktemp("positions")
    rows = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.repeat(F.sha2(F.col("id").cast("string"), 256), (F.col("id") / 10).cast("int"))).alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    for k, some in enumerate(("doc_id >= 290", "doc_id < 40", "doc_id >= 40 AND doc_id < 290")):
        rows.where(some).coalesce(1).write.mode("append").parquet(f"{at}/parts/{k}")
    for k in range(3):
        part = next((at / "parts" / str(k)).glob("part-*"))
        (at / "documents.parquet").mkdir(exist_ok=True)
        part.rename(at / "documents.parquet" / f"part-{k}.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["data_positions", "data_jsonl", "data_jsonl_head"])
def test_positions_are_those_of_the_ids(spark, duck, folder, name):
    sql = catalogue.oracle_sql()[name]
    before = spark.conf.get("spark.sql.files.openCostInBytes"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        frame = catalogue.queries()[name](spark, folder)
        con = duck.cursor()
        con.execute(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        assert_same(frame, con, sql)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before[0])
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[1])


def test_jsonl_positions_follow_the_names_of_files(spark, tmp_path):
    for k, n in enumerate((3, 50, 7)):
        (tmp_path / f"{k}.jsonl").write_text("".join(f'{{"x": "{k}-{i:02d}"}}\n' for i in range(n)))
    rows = io.read_jsonl(spark, str(tmp_path), "x string")
    assert [r["x"] for r in io.in_order(rows)] == [f"{k}-{i:02d}" for k, n in enumerate((3, 50, 7)) for i in range(n)]
    assert [r["_pos"] for r in io.in_order(rows)] == list(range(60))
