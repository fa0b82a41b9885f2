"""The trained operators: exact parts against brute force, the rest by held-out accuracy."""

from __future__ import annotations

import time
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa

from loomwright.llm import langid, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_languages_of_held_out_rows(spark):
    got = {r["doc_id"]: r for r in queries.op3_language_id(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    held = [d for d in docs if got[d["doc_id"]]["held_out"]]
    assert len(held) > 150 and len(got) == len(docs)
    assert np.mean([got[d["doc_id"]]["lang_pred"] == d["lang"] for d in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_texts_without_letters_have_no_language():
    x = langid.frequencies(pa.array(["the cat and the dog", "le chat et le chien", "der hund und die katze"] * 5))
    model = langid.train(x, ["en", "fr", "de"] * 5)
    language, score, family = langid.predict(model, pa.array([None, "", "12 . !", "é", "the cat", "ab"]))
    assert language[:3] == ["und"] * 3 and list(score[:3]) == [0, 0, 0] and family[0] is None
    assert "und" not in language[3:]
    assert langid.predict(langid.train(np.zeros((0, 1 << langid.BITS), np.float32), []), pa.array(["abc"]))[0] == ["und"]
    assert langid.predict(langid.train(x[:1], ["en"]), pa.array(["abc"]))[0] == ["en"]


def test_every_language_is_learned(spark):
    words = {f"l{k:02d}": [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{c}{chr(97 + k % 26)}" for c in "xyz"] for k in range(70)}
    rows = [(20 * k + j, " ".join(words[name] * (1 + j % 3)), name) for k, name in enumerate(words) for j in range(20 - k // 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sampled = Counter(r["lang"] for r in langid.sample(docs).collect())
    known = Counter(r["lang"] for r in docs.where(~langid.held_out()).collect())
    assert sampled == known and len(sampled) == 70
    few = Counter(r["lang"] for r in langid.sample(docs.unionByName(docs.where("lang = 'l00'").crossJoin(spark.range(1, 60)).selectExpr("doc_id + 5000 * id AS doc_id", "text", "lang"))).collect())
    assert few["l00"] == langid.quota(langid.SAMPLE_ROWS, 70) == 50 and len(few) == 70
    model = langid.fit(docs)
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["lang_pred"] == r["lang"] for r in got)


def test_a_share_of_the_rows_is_never_none():
    for n in (801, 10**6, 10**9, 10**12, 10**15):
        rows = (langid.limit(800, n) + (1 << 63)) * n / (1 << 64)
        assert abs(rows - 800) < 1, n
    assert langid.limit(800, 800) == (1 << 63) - 1


def test_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(0)
    emission, at = rng.normal(size=7), np.array([0, 3, 3, 7])
    moves, first = rng.normal(size=(2, 2)), rng.normal(size=2)
    a, b = toxicity.forward_backward(emission, at, moves, first)
    p = a[1] * b[1] / (a[1] * b[1] + a[0] * b[0])
    for s, e in ((0, 3), (3, 7)):
        total, toxic = 0.0, np.zeros(e - s)
        for path in product((0, 1), repeat=e - s):
            w = np.exp(first[path[0]] + sum(emission[s + k] * y for k, y in enumerate(path)) + sum(moves[x, y] for x, y in zip(path, path[1:])))
            total, toxic = total + w, toxic + w * np.array(path)
        assert np.allclose(p[s:e], toxic / total)


def test_long_chains_go_in_segments(monkeypatch):
    rng = np.random.default_rng(1)
    at = np.concatenate([[0], np.cumsum([0, 1, 7, 8, 9, 40, 0, 23, 16])])
    emission, moves, first = rng.normal(size=at[-1]) * 3, rng.normal(size=(2, 2)), rng.normal(size=2)
    whole = toxicity.forward_backward(emission, at, moves, first)
    for size in (1, 3, 8):
        monkeypatch.setattr(toxicity, "SEGMENT", size)
        assert np.allclose(toxicity.forward_backward(emission, at, moves, first), whole)


def test_one_long_text_takes_time_in_proportion():
    rng = np.random.default_rng(2)
    moves, first = rng.normal(size=(2, 2)), rng.normal(size=2)

    def seconds(n: int) -> float:
        emission = rng.normal(size=n)
        began = time.process_time()
        toxicity.forward_backward(emission, np.array([0, n]), moves, first)
        return time.process_time() - began

    seconds(1000)
    one, two = seconds(500_000), seconds(1_000_000)
    assert one < 5 and two < 2.5 * one + 0.2


def test_toxicity_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    field = toxicity.fit(docs, labels)
    got = toxicity.score_documents(docs.join(labels, "doc_id", "left_semi"), field).join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in got if r["toxic"] == 1]
    assert np.mean([r["predicted"] for r in toxic]) > 0.8
    assert np.mean([r["predicted"] for r in got if r["toxic"] == 0]) < 0.02
    text = "Thing the idiot was, ÉÇ a moron scum thing."
    score, spans = toxicity.score_texts(field, pa.array([None, text, ""]))
    assert [text[s:e] for s, e in spans[1]] in (["idiot", "moron scum"], ["idiot", "moron", "scum"]) and score[1] > 0.7 > score[0]
    assert spans[0] == spans[2] == [] and score[0] == score[2]
    kept = toxicity.drop_toxic(spark.createDataFrame([(1, text, "x"), (2, "fine words", "y"), (3, None, "z")], "doc_id long, text string, score string"), field).collect()
    assert [tuple(r) for r in kept] == [(2, "fine words", "y"), (3, None, "z")]


def test_votes_are_those_of_brute_force():
    """Every text's winner and its closest duel, counted one by one."""
    rng = np.random.default_rng(7)
    names = ["a", "b", "c", "d"]
    machines = [langid.Machine(x, y, np.zeros(1), 0.0) for k, x in enumerate(names) for y in names[k + 1 :]]
    margins = {id(m): rng.normal(size=200) for m in machines}
    best, sure = langid._winners(names, machines, margins, 200)
    for t in range(200):
        votes, total, closest = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, np.inf)
        for m in machines:
            x = margins[id(m)][t]
            votes[m.first if x >= 0 else m.second] += 1
            for name, own in ((m.first, x), (m.second, -x)):
                total[name] += np.tanh(own)
                closest[name] = min(closest[name], own)
        top = max(names, key=lambda n: (votes[n], total[n]))
        assert names[best[t]] == top and np.isclose(sure[t], 1 / (1 + np.exp(-2 * closest[top])))
