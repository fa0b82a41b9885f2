"""Queries with SQL give the SQL's rows; edge rows give their stated results."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import pytest
from helpers import assert_same

from loomwright.llm import queries

ORACLES = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir), duck, ORACLES[name])


EDGES = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t\n", "en", "a"), (4, "x" * 200_000, "en", "a"), (5, "word " * 30_000, None, "b"),
    (6, "same text here for two rows.", "en", "b"), (6, "same text here for two rows.", "en", "b"), (None, "no id at all, but a text.", "en", "c"), (7, "é🙂 ｆｕｌｌ ", "fr", "a"),
]


def tables(spark, folder, rows, labels=(), turns=()):
    extra = spark.createDataFrame([(*r, len(r[1] or ""), "x", True) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, kept boolean")
    extra.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int, score double").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(turns), "conv_id long, turn long, role string, text string, loss string").write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")


LABELS = [(1, 1, None, 0.0), (2, 1, 0, 0.0), (4, 0, 1, 0.5)]
TURNS = [(1, 0, "user", None, "x"), (1, 0, None, "b", "x"), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def full(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("edges"))
    tables(spark, f"{folder}/full", EDGES, LABELS, TURNS)
    tables(spark, f"{folder}/none", [])
    return folder


def rows_of(spark, full, name):
    """Rows by id; the two rows of id 6 must be equal."""
    rows = queries.queries()[name](spark, f"{full}/full").collect()
    assert len(rows) == len(EDGES)
    six = [r for r in rows if r["doc_id"] == 6]
    assert len(six) == 2 and six[0] == six[1]
    return {r["doc_id"]: r for r in rows}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, full, name):
    assert len(queries.queries()[name](spark, f"{full}/none").collect()) == (1 if name == "op5_chat_format" else 0)


def test_edges_of_quality(spark, full):
    got = rows_of(spark, full, "op1_quality_rules")
    assert {i: (r["n_words"], r["word_chars"], r["n_repeat_words"], r["base_failed"], r["kept"]) for i, r in got.items()} == {
        1: (0, 0, 0, True, False), 2: (0, 0, 0, True, False), 3: (0, 0, 0, True, False), 4: (1, 200_000, 0, True, False), 5: (30_000, 120_000, 30_000, True, False),
        6: (6, 23, 0, True, False), None: (7, 19, 0, True, False), 7: (2, 6, 0, True, False),
    }


def test_edges_of_near_duplicates(spark, full):
    got = rows_of(spark, full, "op2_minhash_near_dedup")
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {
        1: (0, 1, True), 2: (0, 2, True), 3: (0, 3, True), 4: (1, 4, True), 5: (1, 5, True), 6: (4, 6, True), None: (5, None, True), 7: (1, 7, True),
    }


def test_edges_of_languages(spark, full):
    got = rows_of(spark, full, "op3_language_id")
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (1, 2, 3))
    assert all(got[i]["lang_pred"] in ("en", "fr") and 0 <= got[i]["score"] <= 1 for i in (4, 5, 6, 7, None)) and not got[None]["held_out"]


def test_edges_of_toxicity(spark, full):
    got = rows_of(spark, full, "op4_toxicity")
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert got[1]["score"] == got[2]["score"] == got[3]["score"] and all(r["spans"] == [] for r in got.values())


def test_edges_of_chats(spark, full):
    got = {r["conv_id"]: r for r in queries.op5_chat_format(spark, f"{full}/full").collect()}
    assert {i: (r["n_turns"], r["loss_chars"]) for i, r in got.items()} == {1: (2, 0), None: (1, 0), -1: (2, len(queries.CONTROL_TEXT))}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"\nb\nuser\n\n").hexdigest() and got[None]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest()
    assert got[-1]["loss_sha256"] == hashlib.sha256(queries.CONTROL_TEXT.encode()).hexdigest()


def test_edges_of_mixing(spark, full):
    got = queries.op6_source_mixing(spark, f"{full}/full").collect()
    counts = Counter(r["doc_id"] for r in got)
    assert counts[6] % 2 == 0 and set(counts) <= {r[0] for r in EDGES}
    rates = {r["source"]: r["rate"] for r in got}
    n = Counter(r[3] or "" for r in EDGES)
    total = sum(k**0.5 for k in n.values())
    assert all(abs(rate - len(EDGES) * n[s or ""] ** 0.5 / total / n[s or ""]) < 1e-6 for s, rate in rates.items())
    assert all(Counter((r["doc_id"], r["copy_no"]) for r in got)[x] == (2 if x[0] == 6 else 1) for x in {(r["doc_id"], r["copy_no"]) for r in got})


@pytest.mark.parametrize(("name", "count"), [("op7_pii", "n_email"), ("op10_secret_scan", "n_hex")])
def test_edges_of_scans(spark, full, name, count):
    got = rows_of(spark, full, name)
    assert all(r[count] == 0 and r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in got.values())


def test_edges_of_pieces(spark, full):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    got = rows_of(spark, full, "op8_sentencepiece")
    for (i, text, *_) in EDGES:
        assert got[i]["ids"] == model.encode(text or "") and got[i]["n_tokens"] == len(got[i]["ids"]) and got[i]["exact"]


def test_media_columns_by_brute_force(spark, full, sf_dir):
    def expected(text):
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])

    got = rows_of(spark, full, "op9_media_columns")
    rows = [(got[i], text) for i, text, *_ in EDGES]
    whole = {r["doc_id"]: r for r in queries.op9_media_columns(spark, sf_dir).collect()}
    rows += [(whole[r["doc_id"]], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for r, text in rows:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == expected(text)
        frames = r["payload_bytes"] // 192
        keys = "".join(f",{a}-{a + 192}" for a in (r["media_bytes"] - r["payload_bytes"] + 192 * k for k in range(0, frames, 16)))[1:]
        assert r["feature"] == f"codec=raw;ms={frames * 192 * 1000 // 8000};samples={frames};keyframes={-(-frames // 16)};ranges={zlib.crc32(keys.encode()):08x}"


def test_narrow_ids_are_read(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a text of some words", "en", "s", 3), (2, None, None, None, None)], "doc_id int, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id int, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in sorted(set(queries.queries()) - {"op5_chat_format", "op6_source_mixing", "op11_warc", "op13_prefix_trie"}):
        assert {r["doc_id"] for r in queries.queries()[name](spark, str(tmp_path)).collect()} == {1, 2}, name
