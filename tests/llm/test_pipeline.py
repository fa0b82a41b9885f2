from __future__ import annotations

import sentencepiece
from test_neardup import brute

import corpus_pipeline as cp
from loomwright.llm import mixing, toxicity
from loomwright.llm.queries import PIECE_MODEL


def test_every_stage_does_its_part(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = kept[name] = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "sentencepiece" or docs.columns == columns
    rows = {name: frame.collect() for name, frame in kept.items()}
    start = spark.read.parquet(f"{sf_dir}/documents.parquet")
    field = toxicity.fit(start, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    clean = {r["doc_id"] for r in toxicity.score_documents(start, field).where("predicted = 0").collect()}
    assert {r["doc_id"] for r in rows["toxicity"]} == clean
    groups = brute([(r["doc_id"], r["text"]) for r in rows["toxicity"]], 5, 80)
    assert {r["doc_id"] for r in rows["near_dedup"]} == {i for i, top in groups.items() if i == top}
    assert {r["doc_id"] for r in rows["pii"]} == {r["doc_id"] for r in rows["near_dedup"]}
    expected = {r["doc_id"]: r["n"] for r in mixing.mix(kept["pii"]).groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    got: dict[int, int] = {}
    for r in rows["mixing"]:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == expected
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    texts = {r["doc_id"]: r["text"] for r in rows["mixing"]}
    assert len(rows["sentencepiece"]) == len(rows["mixing"])
    assert all(r["ids"] == model.encode(texts[r["doc_id"]] or "") and r["n_tokens"] == len(r["ids"]) for r in rows["sentencepiece"])


SCHEMA = "doc_id int, text string, lang string, source string, n_chars int, gone string, rate double, score string, ids string, __pii_email string"
GOOD = "A quiet text about rivers and the boats on them, which nobody minds."


def test_stages_keep_odd_rows(spark, tmp_path):
    """Nulls in any column, blank and long texts, ties, repeated rows and clashing names, stage by stage."""
    rows = [
        (1, GOOD, "en", "a", 3, "g", 0.5, "s", "i", "p"), (1, GOOD, "en", "a", 3, "g", 0.5, "s", "i", "p"), (2, GOOD, None, None, None, None, None, None, None, None), (3, None, "en", "a", 0, "g", 0.1, "s", "i", "p"),
        (None, None, None, None, None, None, None, None, None, None), (4, "", "en", "b", 0, "g", 0.1, "s", "i", "p"), (5, "x" * 100_000 + " mail a@b.co", "en", "b", 0, "g", 0.1, "s", "i", "p"), (None, "no id, call a@b.co", "en", "b", 0, "g", 0.1, "s", "i", "p"),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(cp.STAGES)
    plain = lambda frame: sorted(map(repr, map(tuple, frame.collect())))
    assert plain(stages["toxicity"](spark, docs, str(tmp_path))) == plain(docs)
    # Of the rows of one id and of copies one stays; rows without an id all stay.
    kept = stages["near_dedup"](spark, docs, str(tmp_path))
    assert kept.dtypes == docs.dtypes and plain(kept) == sorted(repr(r) for r in [rows[0], *rows[3:]])
    clean = stages["pii"](spark, docs, str(tmp_path))
    assert clean.dtypes == docs.dtypes
    texts = {r["text"] for r in clean.collect()}
    assert texts == {GOOD, None, "", "x" * 100_000 + " mail [EMAIL]", "no id, call [EMAIL]"}
    assert sorted(r["__pii_email"] or "" for r in clean.collect()) == sorted(r[9] or "" for r in rows)
    mixed = stages["mixing"](spark, docs, str(tmp_path))
    assert [c for c, _ in mixed.dtypes] == docs.columns and {repr(tuple(r)) for r in mixed.collect()} <= {repr(tuple(r)) for r in docs.collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    got = stages["sentencepiece"](spark, docs, str(tmp_path)).collect()
    assert sorted((repr(r["doc_id"]), r["ids"]) for r in got) == sorted((repr(r[0]), model.encode(r[1] or "")) for r in rows)


def test_mixing_keeps_columns_of_any_name(spark):
    """Each name that mixing uses itself, in any case, comes back with its own values."""
    names = ("mix_source", "mix_copies", "rate", "copy_no", "mix_key", "mix_salt", "mix_rate", "_mix_copies", "MIX_COPY_NO", "n")
    for name in (*names, None):
        some = names if name is None else (name,)
        docs = spark.range(60).selectExpr("id AS doc_id", "concat('t', id) AS text", "if(id % 3 = 0, 'a', 'b') AS source", *(f"concat('{c} ', id) AS `{c}`" for c in some))
        got = cp.mix_sources(spark, docs, "")
        assert got.columns == docs.columns
        rows = got.collect()
        assert len(rows) > 30 and {tuple(r) for r in rows} <= {tuple(r) for r in docs.collect()}, name
        assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in mixing.mix(docs.select("doc_id", "text", "source")).collect())


def test_stages_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in cp.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name
