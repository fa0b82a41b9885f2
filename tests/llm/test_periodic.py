"""Periodic runs against a search of every period at every place."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from loomwright.llm import periodic, queries


def runs_of(words: list[str]) -> list[tuple[int, int, int]]:
    found: dict[tuple[int, int], int] = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i + p - start >= max(6, 4 * p):
                found.setdefault((start, i + p), p)
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list[str]) -> str:
    gone = {i for s, size, p in runs_of(words) for i in range(s + p, s + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(seed: int) -> list[str | None]:
    rng = random.Random(seed)
    out: list[str | None] = [None, "", " \n", "é é é é é é", "a"]
    for _ in range(400):
        words = rng.choices("abcdefgh"[: rng.choice((1, 2, 3, 8))], k=rng.randint(0, 60))
        if words and rng.random() < 0.6:
            at, p = rng.randrange(len(words)), rng.randint(1, 6)
            words[at:at] = words[at : at + p] * rng.randint(1, 25)
        out.append(rng.choice((" ", "  ", "\n", "\t ")).join(words))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_runs_by_brute_force(seed):
    rows = texts(seed)
    for r, text in zip(periodic._found(pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows)], ["doc_id", "text"])).to_pylist(), rows):
        words = (text or "").split()
        assert [(x["start"], x["length"], x["period"]) for x in r["runs"]] == runs_of(words)
        assert r["collapsed"] == collapsed(words) and r["n_words"] == len(words)


def test_range_minima_of_every_range():
    values = np.random.default_rng(0).integers(0, 1000, 300).astype(np.int32)
    first, last = (x.ravel() for x in np.meshgrid(np.arange(300), np.arange(1, 301)))
    first, last = first[first < last], last[first < last]
    assert (periodic.RangeMinima(values)(first, last) == [values[a:b].min() for a, b in zip(first, last)]).all()


def test_one_word_and_nested_periods_of_a_long_text():
    """A run of a million words, and one whose period holds a run itself."""
    inner = "x x x x x x x x y "
    rows = ["word " * 1_000_000, inner * 20_000]
    one, two = periodic._found(pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(rows)], ["doc_id", "text"])).to_pylist()
    assert one["runs"] == [{"start": 0, "length": 1_000_000, "period": 1}] and one["collapsed"] == "word"
    assert two["runs"][:2] == [{"start": 0, "length": 8, "period": 1}, {"start": 0, "length": 180_000, "period": 9}] and len(two["runs"]) == 20_001
    assert two["collapsed"] == "x y"


def test_query_by_brute_force(spark, tmp_path):
    """All columns, rows without ids and texts, repeated rows, odd words and other columns of the results' names."""
    import zlib

    rows = [(k, t) for k, t in enumerate(texts(9))] + [(None, "z z z z z z z"), (7, "a b"), (7, "a b"), (-40, "q " * 50)]
    spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, runs int, start string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for i, text in rows:
        w = (text or "").split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[a + (k - a) % p] if k >= a else x for k, x in enumerate(w)]
        runs = runs_of(w)
        s, size, p = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        expected.append((i, len(runs), s, size, p, p and 1000 * size // p, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(w).encode()).hexdigest()))
    got = [tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
