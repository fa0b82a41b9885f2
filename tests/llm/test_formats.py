"""Chat formatting, pieces and containers: exact round trips."""

from __future__ import annotations

import hashlib
import os
import random
import struct
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwright.llm import chatfmt, media, pieces
from loomwright.llm.queries import PIECE_MODEL


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<|\\im_end>\na", max_size=40))
def test_escapes_are_reversible(text):
    assert chatfmt.unescape(chatfmt.escape(text)) == text and "<|" not in chatfmt.escape(text)
    assert chatfmt.unescape_role(chatfmt.escape_role(text)) == text and "\n" not in chatfmt.escape_role(text)


def test_turn_order(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q<|im_end|>"), (1, 2, "assistant", "a<|"), (2, 0, "assistant", "a"), (3, 0, "user", "q"), (4, 0, "user", None), (4, 1, "assistant", "é")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chatfmt.read_back(chatfmt.segments(turns)).collect()}
    assert {k: r["valid"] for k, r in got.items()} == {1: True, 2: False, 3: False, 4: True}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"system\ns\nuser\nq<|im_end|>\nassistant\na<|\n").hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256(b"a<|").hexdigest() and got[1]["loss_chars"] == 3
    text = "".join(r["text"] for r in chatfmt.segments(turns).where("conv_id = 4").orderBy("turn", "segment").collect())
    assert text == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\né<|im_end|>\n" and got[4]["formatted_chars"] == len(text)


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.Vocabulary.load(PIECE_MODEL))


def test_pieces_are_those_of_the_library(encoder):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    rng = random.Random(3)
    marks = "abc  éß\n\t<s>0x世界🙂 the ing er =-_.,\x00ﬁ²▁"
    known = [t.decode() for t in encoder.v.text[300:]]
    texts = [None, "", " ", "  a", "<s> hi</s>", "a" * 3000, " " * 150, "the▁cat"]
    texts += ["".join(rng.choice(marks) for _ in range(rng.randrange(50))) for _ in range(800)]
    texts += ["".join(rng.choice(known) for _ in range(rng.randrange(8))) for _ in range(3000)]
    ids, at, exact = encoder.encode(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        own = ids[at[k] : at[k + 1]].tolist()
        assert own == model.encode(text or "")
        assert exact[k] == ("▁" not in (text or ""))
        data, ends = encoder.decode(np.array(own, np.int64), np.array([0, len(own)]))
        assert data.tobytes().decode() == (text or "").replace("▁", " ")


def thue_morse(n: int, letters: str = "ab") -> str:
    """Letters in an order that polynomial hashes modulo a power of two can't tell from its mirror."""
    return "".join(letters[k.bit_count() % 2] for k in range(n))


def test_cuts_are_told_apart_by_their_bytes(encoder):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    texts = [f(n) for n in (1024, 2048, 4096) for f in (thue_morse, lambda n: thue_morse(n, "ba"))]
    ids, at, exact = encoder.encode(pa.array([" ".join(texts), *texts]))
    assert exact.all()
    for k, text in enumerate([" ".join(texts), *texts]):
        assert ids[at[k] : at[k + 1]].tolist() == model.encode(text)


def test_hashes_that_collide_change_nothing(encoder, monkeypatch):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    own = pieces.Encoder(encoder.v)
    real = pieces.tb.Hasher.__call__
    monkeypatch.setattr(pieces.tb.Hasher, "__call__", lambda self, start, end: real(self, start, end) & np.uint64(7))
    texts = ["the cat sat on the mat", "a dog and a cat", "words and more words in a row", "", None, "the dog"]
    for _ in range(2):
        ids, at, exact = own.encode(pa.array(texts))
        assert exact.all() and [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == [model.encode(t or "") for t in texts]


@pytest.mark.parametrize("run", [1 << 12, 1 << 18])
def test_long_texts_without_spaces(encoder, monkeypatch, run):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    monkeypatch.setattr(pieces, "RUN", run)
    rng = random.Random(5)
    texts = ["a" * 20_000, thue_morse(20_000), "".join(rng.choices("etaoinshr", k=20_000)), "".join(rng.choices("etaoé世🙂x", k=20_000)), "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(9000)), "".join(rng.choices("ABCdefgh0123+/", k=20_000))]
    ids, at, exact = pieces.Encoder(encoder.v).encode(pa.array(texts))
    assert exact.all() and [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == [model.encode(t) for t in texts]


def test_twice_the_text_takes_about_twice_the_time(encoder):
    rng = random.Random(6)

    def seconds(text: str) -> float:
        best = 1e9
        for _ in range(3):
            own = pieces.Encoder.__new__(pieces.Encoder)
            own.__dict__.update(encoder.__dict__)
            own._forget()
            began = time.process_time()
            own.encode(pa.array([text]))
            best = min(best, time.process_time() - began)
        return best

    for text in ("".join(rng.choices("ABCdefgh0123+/xyz", k=200_000)), "a" * 200_000, "".join(rng.choices("etaoinshr", k=200_000))):
        one, two = seconds(text), seconds(text + text[::-1])
        assert two < 2.5 * one + 0.2 and one < 2.0


def test_remembered_cuts_stay_in_their_budget(encoder, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 4000)
    own = pieces.Encoder(encoder.v)
    for k in range(20):
        texts = [" ".join(f"w{k}x{j}" for j in range(40)), "x" * 3000]
        ids, at, exact = own.encode(pa.array(texts))
        assert exact.all() and len(own.keys_known) < 400 and own.cut_at[-1] == len(own.cut_bytes)


def test_decoding_tables(spark):
    vocabulary = pieces.Vocabulary.load(PIECE_MODEL)
    docs = spark.createDataFrame([(1, "Hello  wörld\n"), (2, None)], "doc_id long, text string")
    back = pieces.decode_pieces(pieces.encode_pieces(docs, vocabulary), vocabulary)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {1: "Hello  wörld\n", 2: ""}


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 192 * 64, 192 * 64 + 1, 192 * 129, 100_000])
def test_containers_give_their_payload_back(n):
    payload = media.padded(os.urandom(n))
    stored = media.pack(payload)
    track = media.describe(stored)[0]
    assert b"".join(stored[a:b] for a, b in track.runs) == payload and track.codec == "raw "
    assert [stored[a:b] for a, b in track.keyframes()] == [payload[k * 192 : k * 192 + 192] for k in range(0, len(payload) // 192, 16)]


def test_broken_containers_are_reported():
    stored = media.pack(media.padded(b"x" * 5000))
    rng = random.Random(0)
    for _ in range(500):
        broken = bytearray(stored)
        for _ in range(3):
            broken[rng.randrange(900)] = rng.randrange(256)
        try:
            media.describe(bytes(broken))
        except (ValueError, IndexError, struct.error):
            pass
    with pytest.raises(ValueError):
        media.describe(stored[:300])
    # A box of 64 bits and one up to the end of the file.
    wide = stored.replace(struct.pack(">I", 8 + len(media.padded(b"x" * 5000))) + b"mdat", struct.pack(">I", 0) + b"mdat")
    assert media.describe(wide)[0].keys == media.describe(stored)[0].keys


def test_media_bytes_are_kept(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    for r in media.media_columns(docs).collect():
        assert hashlib.sha256(bytes(r["media"])).hexdigest() == r["media_sha256"] and r["payload_bytes"] == 192 and r["error"] is None


def test_a_binary_column_is_described(spark):
    stored = media.pack(media.padded(b"x" * 5000))
    rows = spark.createDataFrame([("a", bytearray(stored), 1), ("b", None, 2), ("c", bytearray(b"no container"), 3), ("d", bytearray(stored[:300]), 4)], "name string, body binary, error int")
    got = {r["name"]: r for r in media.describe_media(rows, "name", "body").collect()}
    track = media.describe(stored)[0]
    assert got["a"]["error"] is None and [(k["start"], k["end"]) for k in got["a"]["tracks"][0]["keyframes"]] == track.keyframes()
    assert (got["a"]["tracks"][0]["codec"], got["a"]["tracks"][0]["samples"], got["a"]["tracks"][0]["duration_ms"]) == ("raw", 27, 648)
    assert all(got[k]["tracks"] is None and got[k]["error"] for k in "bcd")


def test_compact_sizes():
    body = lambda bits, count, rest: memoryview(bytes([0, 0, 0, 0, 0, 0, 0, bits]) + struct.pack(">I", count) + rest)
    assert media._sizes({b"stz2": body(4, 3, bytes([0x12, 0x30]))}, 99) == [1, 2, 3]
    assert media._sizes({b"stz2": body(8, 2, bytes([7, 9]))}, 99) == [7, 9]
    assert media._sizes({b"stz2": body(16, 2, bytes([1, 0, 0, 2]))}, 999) == [256, 2]
    with pytest.raises(ValueError):
        media._sizes({b"stz2": body(4, 9, b"a")}, 99)
