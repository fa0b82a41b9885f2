from __future__ import annotations

import random
import re

import pytest

from loomwright.llm import neardup
from loomwright.llm.components import components
from loomwright.llm.storage import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text: str | None, width: int) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) >= width:
        return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))
    return frozenset([tuple(words)] if words else [])


def smallest(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    links = []
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                links.append((i, j))
    return smallest([i for i, _ in sets], links)


def corpus(seed: int):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, rows = text(60), []
    for family in range(4):
        origin = text(150)
        for _ in range(40 if family == 0 else 6):
            copy = list(origin)
            for _ in range(rng.randrange(9)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
            if rng.random() < 0.2:
                rows.append(" ".join(copy).upper())
    rows += [" ".join(text(40) + passage + text(40)) for _ in range(30)] + ["one two", "One  two\n", "three", "", None, " \t"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_groups_are_those_of_all_pairs(spark, width, percent):
    rows = corpus(width) + [(None, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "y").selectExpr("doc_id", "text", "1 AS kept", "'c' AS component_id")
    got = neardup.groups(docs, width, percent).collect()
    expected = brute(rows, width, percent)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == expected
    sizes = {i: len(shingles(t, width)) for i, t in rows if i is not None}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] and r["kept"] == (r["component_id"] == r["doc_id"]) for r in got if r["doc_id"] is not None)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


def test_lists_of_members_far_from_their_hub(spark):
    """Documents that share most of their text without being similar, with some that are."""
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(5000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, rows = text(200), []
    for k in range(60):
        own = text(rng.choice([25, 60, 90]))
        rows.append(" ".join(own + passage))
        if k % 3 == 0:
            own[rng.randrange(len(own))] = "changed"
            rows.append(" ".join(own + passage))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = {r["doc_id"]: r["component_id"] for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    expected = brute(rows, 3, 85)
    assert got == expected and 1 < len(set(expected.values())) < len(rows)


def test_rows_of_one_id_are_one_document(spark):
    one, two, other = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(5, one, "x"), (5, two, "y"), (5, one, "z"), (7, two, "x"), (9, other, "x"), (9, other, "x"), (None, one, "x"), (None, one, "x"), (3, one + " more", "x")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, kept string")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.groups(docs, 3, 85).collect()}
    assert got == {(5, 3, False), (7, 3, False), (9, 9, True), (None, None, True), (3, 3, True)}
    kept = neardup.keep_one(docs, 3, 85)
    assert kept.dtypes == docs.dtypes
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, [(3, one + " more", "x"), (9, other, "x"), (None, one, "x"), (None, one, "x")]))
    several = spark.createDataFrame([(1, "b b b b", "x"), (1, "a a a a", "y"), (1, None, "z")], "doc_id long, text string, gone string")
    assert [tuple(r) for r in neardup.keep_one(several, 3, 85).collect()] in ([(1, None, "z")], [(1, "a a a a", "y")])


def test_sets_that_only_a_weak_hash_confuses(spark):
    """Thue-Morse words and their mirrors, of which polynomial hashes modulo a power of two are equal."""
    rows = []
    for n in (1024, 2048, 4096):
        word = "".join("ab"[k.bit_count() % 2] for k in range(n))
        rows += [f"{word} x y z", f"{word.translate(str.maketrans('ab', 'ba'))} x y z"]
    rows = list(enumerate(rows))
    got = {r["doc_id"]: r["component_id"] for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == brute(rows, 3, 85) == {i: i for i in range(6)}


def test_components(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(100, 140)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)] + [(200, 200 + k) for k in range(1, 50)]
    links = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in links if a != b]
    got = components(spark.createDataFrame(links, "a long, b long"), Workspace(spark), "c")
    nodes = {x for pair in links for x in pair}
    assert {r["node"]: r["component"] for r in got.collect()} == smallest(nodes, links)
    assert components(spark.createDataFrame([], "a long, b long"), Workspace(spark), "none").count() == 0


@pytest.mark.parametrize("own", [8, 14, 60])
def test_documents_of_one_template(spark, monkeypatch, own):
    """A long common part and texts of their own, some with a near copy; every list counts as a long one, and few pairs meet."""
    monkeypatch.setattr(neardup, "LIST_MEMBERS", 2)
    rng = random.Random(own)
    vocabulary = [f"w{k}" for k in range(9000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    common, section, rows = text(110), text(12), []
    for k in range(150):
        mine = text(own) + (section if k % 2 else [])
        rows.append(" ".join(common + mine))
        if k % 10 == 0:
            mine[rng.randrange(own)] = "changed"
            rows.append(" ".join(common + mine))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    tried = []
    across = neardup._across

    def counted(lists, centred, percent):
        sizes = lists.groupBy("hub", "element").count().collect()
        tried.append(sum(r["count"] ** 2 for r in sizes))
        return across(lists, centred, percent)

    monkeypatch.setattr(neardup, "_across", counted)
    got = {r["doc_id"]: r["component_id"] for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == brute(rows, 3, 85)
    assert sum(tried) < 20 * len(rows)


def test_copies_with_words_of_their_own_make_no_lists(spark, tmp_path):
    """Copies whose edits are nobody else's have no partner but the base, so their differences aren't listed; those that share edits are linked."""
    import random

    from loomwright.llm.storage import Workspace

    rng = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for k in range(60):
        words = list(base)
        for at in rng.sample(range(0, 150, 6), 6):
            words[at] = f"own{k}-{at}"
        texts.append(words)
    # Two that share all edits but one.
    texts.append([*texts[0][:75], "other", *texts[0][76:]])
    docs = spark.createDataFrame([(0, " ".join(base)), *((k + 1, " ".join(x)) for k, x in enumerate(texts))], "doc_id long, text string")
    pairs = spark.createDataFrame([(0, k + 1) for k in range(len(texts))], "a long, b long")
    space = Workspace(spark)
    near = space.keep("near", neardup.compared(pairs, docs, 5, 80))
    centred = space.keep("centred", neardup._centred(neardup._around_hubs(near), 80))
    joined = spark.createDataFrame([], "node long, component long")
    able = neardup._with_partners(neardup._outside(centred, joined), 80)
    assert {1, 61} <= {r["class"] for r in able.collect()} <= {0, 1, 61}
    links = neardup._links_of_lists(centred, joined, space, 80)
    assert {frozenset(r) for r in links.select("a", "b").collect()} == {frozenset((1, 61))}


def test_shuffle_files_go_with_the_table_that_needed_them(spark):
    import time

    from loomwright.llm.storage import Workspace

    def held() -> int:
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        n = 0
        while files.hasNext():
            n += files.next().getName().startswith("shuffle_")
        return n

    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    before = held()
    table = Workspace(spark).keep("counts", spark.range(20000).selectExpr("id % 977 AS k").groupBy("k").count())
    until = time.time() + 20
    while held() > before and time.time() < until:
        time.sleep(0.2)
    assert held() <= before and table.count() == 977
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting
