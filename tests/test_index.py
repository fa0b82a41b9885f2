"""The stored index against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.operators import index as ix
from loomwright.operators import retrieval

SCHEMA = "vec_id long, embedding array<float>"


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + k, None if v is None else [float(x) for x in v]) for k, v in enumerate(vectors)], SCHEMA)


def rows(found):
    return sorted((r["qid"], r["rank"], r["vec_id"], round(r["sim"], 9)) for r in found.collect())


def clustered(n: int, groups: int, seed: int = 0, spread: float = 0.05) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, 24))
    return centers[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, 24)) * 3


@pytest.mark.parametrize(("blocks", "k"), [(16384, 3), (64, 5)])
def test_rows_are_those_of_all_pairs(spark, tmp_path, monkeypatch, blocks, k):
    """Clustered vectors, a third of them one and the same, zeros, nulls, repeated ids; also with clusters of many rings and parts."""
    monkeypatch.setattr(ix, "BASE_BLOCK", blocks)
    monkeypatch.setattr(ix, "QUERY_BLOCK", 32)
    vectors = [*clustered(1200, 30), *[np.ones(24)] * 600, np.zeros(24), None, -np.ones(24)]
    base = frame(spark, vectors).unionByName(frame(spark, vectors[:2]))
    queries = base.where("vec_id % 9 = 0 OR vec_id >= 1799").unionByName(frame(spark, [np.zeros(24), None, clustered(1, 1, 5)[0]], 9000))
    found = ix.VectorIndex.build(base, f"{tmp_path}/i", 30)
    assert rows(found.nearest(queries, k)) == rows(retrieval.nearest(base, queries.dropDuplicates(["vec_id"]), k))
    assert found.vectors().count() == 1200 + 600 + 2 + 2
    assert found.blocks().agg(F.max("n")).first()[0] <= max(2 * blocks, 1200)


def test_few_pairs_of_clustered_vectors(spark, tmp_path):
    base = frame(spark, clustered(4000, 60, 3))
    found = ix.VectorIndex.build(base, f"{tmp_path}/i", 60)
    share = found.share(base.where("vec_id % 20 = 0"))
    print(f"share of pairs computed: {share:.4f}")
    assert share < 0.1


def test_batches_are_added_and_lost_ones_do_not_count(spark, tmp_path):
    vectors = clustered(300, 8, 2)
    one, two = frame(spark, vectors[:200]), frame(spark, vectors[200:], 200)
    ix.VectorIndex.build(one, f"{tmp_path}/i").add(two)
    again = ix.VectorIndex(spark, f"{tmp_path}/i")
    queries = two.where("vec_id % 5 = 0")
    assert rows(again.nearest(queries)) == rows(retrieval.nearest(one.unionByName(two), queries))
    # A batch whose blocks were not written whole.
    lost = tmp_path / "i" / "batches" / "lost"
    (lost / "blocks").mkdir(parents=True)
    one.write.parquet(f"{lost}/vectors")
    assert again.vectors().count() == 300


def test_small_and_empty_indexes(spark, tmp_path):
    none = frame(spark, [])
    queries = frame(spark, [[1.0, 0.0]])
    assert ix.VectorIndex.build(none, f"{tmp_path}/none").nearest(queries).collect() == []
    few = frame(spark, [[1.0, 0.0], [0.0, 1.0]])
    assert rows(ix.VectorIndex.build(few, f"{tmp_path}/few").nearest(queries)) == [(0, 1, 0, 1.0), (0, 2, 1, 0.0)]
    zeros = frame(spark, [[0.0, 0.0], [0.0, 0.0]])
    assert rows(ix.VectorIndex.build(zeros, f"{tmp_path}/zeros").nearest(queries)) == [(0, 1, 0, 0.0), (0, 2, 1, 0.0)]


def test_the_best_of_a_block_are_found_in_little_memory():
    """The same vectors as by sorting all similarities at once, ties by id included, without a matrix of all of them."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from loomwright.operators import retrieval

    rng = np.random.default_rng(2)
    table = lambda name, v: pa.table({name: pa.array(rng.permutation(len(v))), "v": pa.array(list(v))})
    asked, there = table("qid", rng.integers(-2, 3, (256, 4)).astype(float)), table("vec_id", rng.integers(-2, 3, (12000, 4)).astype(float))
    tracemalloc.start()
    got = retrieval.best_of(3)(asked, there)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    sims = np.round(retrieval.matrix(asked) @ retrieval.matrix(there).T, retrieval.DIGITS)
    ids = there.column("vec_id").to_numpy()
    order = np.lexsort((np.broadcast_to(ids, sims.shape), -sims))[:, :3]
    assert got.column("vec_id").to_pylist() == ids[order].ravel().tolist()
    assert peak < sims.nbytes
