"""The trie of conversation prefixes against one made of tuples."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from loomwright.llm import queries, trie

NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def expected(rows: list[tuple]) -> list[tuple]:
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[conv].append((turn is not None, turn or 0, mark, role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}
    members = defaultdict(list)
    for c in own:
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 4 if base != c else 0
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append((c, d == len(path)))
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        convs = sorted(members[node])
        below = [out[c] for c in children[node]]
        words = len(node[-1][1].split()) if node else 0
        out[node] = (
            convs[0][0], len(node), min(members[node[:-1]])[0] if node else None, len(convs), len(below), sum(b[5] for b in below) or 1,
            (len(convs) - 1) * words + sum(b[6] for b in below), hashlib.sha256(",".join(str(c) for c, last in convs if last).encode()).hexdigest(),
        )
    return sorted(out.values(), key=repr)


def result(spark, folder, rows):
    spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, node string").write.parquet(f"{folder}/conversations.parquet")
    got = queries.op13_prefix_trie(spark, str(folder))
    assert tuple(got.columns) == NAMES
    return sorted(map(tuple, got.collect()), key=repr)


def forest(seed: int) -> list[tuple]:
    """Conversations that share beginnings of any length, some of them equal, some short of what they leave out."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 90), 60):
        for k in range(rng.choice((0, 1, 2, 3, 6))):
            rows.append((c, k, rng.choice(("user", "assistant", None)), rng.choice(("a b", "a  b c\n", "é", "", None))))
    return rows + [(5, None, "user", "null turn"), (7, 1, None, None), (7, 1, None, None), (None, 1, "user", "nobody"), (41, 9, "user", "a b")]


@pytest.mark.parametrize("seed", range(3))
def test_nodes_by_brute_force(spark, tmp_path, seed):
    rows = forest(seed)
    assert result(spark, tmp_path, rows) == expected(rows)


def test_long_and_common_conversations(spark, tmp_path):
    """One conversation of 3,000 turns beside many that share its beginning, one of them ending at each of its first turns."""
    rows = [(1000, k, "user", f"turn {k}") for k in range(3000)]
    rows += [(1020 + 20 * c, k, "user", f"turn {k}") for c in range(150) for k in range(c % 40)]
    rows += [(20_000 + 20 * c, 0, "user", "turn 0") for c in range(300)] + [(40_000 + 20 * c, 0, "user", f"own {c}") for c in range(300)]
    assert result(spark, tmp_path, rows) == expected(rows)


def test_a_node_of_many_ends_is_hashed_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_IDS", 16)
    rows = [(20 * c, 0, "user", "same") for c in random.Random(1).sample(range(20_000), 20_000)]
    assert result(spark, tmp_path, rows) == expected(rows)


def test_totals_go_up_once_for_each_prefix(spark, tmp_path):
    """What is exploded grows with the turns, not with the square of a conversation's length."""
    rows = [(20 * c, k, "user", f"{k if k < 500 else (c, k)}") for c in range(4) for k in range(1000)]
    marks = trie.turn_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    nodes = trie.prefix_trie(trie.with_shared_beginnings(marks))
    assert nodes.count() == 501 + 4 * 500
    root = nodes.where("depth = 0").first()
    assert (root["n_leaves"], root["saved_tokens"], root["n_children"]) == (4, 3 * 500, 1)


def test_empty_and_rootless(spark, tmp_path):
    assert result(spark, tmp_path / "none", []) == []
    assert result(spark, tmp_path / "nobody", [(None, 0, "user", "x")]) == []
