from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwright.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text: str) -> tuple[int, ...]:
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    counts = Counter(grams)
    covered = {j for k, g in enumerate(grams) if counts[g] > 1 for j in range(k, k + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t\x0b\x1f|#", max_size=120), min_size=1, max_size=6))
def test_counts_are_those_of_brute_force(texts):
    got = quality.measure(pa.array(texts))
    for k, text in enumerate(texts):
        assert tuple(int(got[x][k]) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute(text)


def test_words_and_lines_are_told_apart_by_their_bytes():
    """Thue-Morse words and their mirrors, which polynomial hashes modulo a power of two take for equal."""
    for n in (1024, 2048, 4096):
        one = "".join("ab"[k.bit_count() % 2] for k in range(n))
        two = one.translate(str.maketrans("ab", "ba"))
        texts = [f"{one}\n{two}", f"{one}\n{two}\n{one}", " ".join([*"cdefghi", one, *"cdefghi", two]), " ".join([one, *"cdefghi", one, *"cdefghi"])]
        got = quality.measure(pa.array(texts))
        for k, text in enumerate(texts):
            assert (int(got["n_dup_lines"][k]), int(got["n_repeat_words"][k])) == brute(text)[3:]


def test_hashes_that_collide_change_nothing(monkeypatch):
    real, windows = quality.tb.Hasher.__call__, quality.tb.windows
    monkeypatch.setattr(quality.tb.Hasher, "__call__", lambda self, start, end: real(self, start, end) & np.uint64(3))
    monkeypatch.setattr(quality.tb, "windows", lambda hashes, width: windows(hashes, width) & np.uint64(3))
    rng = random.Random(1)
    texts = [rng.choice(" \n").join(rng.choices(["a", "b", "cc", "longer-than-eight", "longer-than-eighT", "x\ny"], k=60)) for _ in range(20)]
    got = quality.measure(pa.array(texts))
    for k, text in enumerate(texts):
        assert tuple(int(got[x][k]) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute(text)


def test_lines_are_judged_first():
    good = "This line is plain prose and stays in the text as it is, with quite a few words in it."
    other = "Here another sentence of entirely different wording follows so that nothing is said a second time."
    bad = ["home | about | contact", "BUY!! NOW!!", "Licensed under the MIT license, all of it.", "$$ %% ##", "two words"]
    got = quality.measure(pa.array(["\n".join([good, *bad, other]), "\n".join([good] + ["a | b | c | d | e | f | g | h"] * 4), None]))
    assert got["cleaned"][0] == f"{good}\n{other}" and got["n_lines_kept"].tolist() == [2, 1, 0]
    assert got["kept"].tolist() == [True, False, False]
