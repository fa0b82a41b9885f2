"""A stored index of vectors whose search is exact and passes over what can't be among the best.

Vectors are dealt to the nearest of some centroids, and inside a cluster into rings by their
angle to its centroid; a ring too large for one group is parted further. With a the angle of
a query to a centroid, and [lo, hi] the angles of a block's vectors to it, no vector of the
block is nearer to the query than ``max(a - hi, lo - a)``, by the triangle inequality.

A search has two rounds. The first one takes for each query one block of the cluster it is
nearest to, which gives it a similarity that the k best reach. The second one takes, of all
clusters and then of their blocks, those that may reach it, and multiplies these alone. A
block is copied once for every ``QUERY_BLOCK`` queries that want it, not for every query.
How much is passed over depends on the data: vectors in clusters leave a small share of the
pairs, vectors that point anywhere leave nearly all of them.

The driver holds the centroids and three numbers for each, ``CLUSTERS`` at most. Centroids are
fitted on a bounded sample; every vector is indexed. An index is a folder: each ``add`` is a
batch that counts once it is written whole.

Cases: null vectors are left out, on both sides. A vector of zeros has similarity 0 to all.
Repeated ids are vectors of their own. An empty index has no results; with fewer than k
vectors all of them are results. Ties go to the smaller id.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import unit
from ..sources.shared import complete
from .retrieval import BASE_BLOCK, NEAREST, QUERY_BLOCK, best_of, matrix

#: Centroids at most, and vectors that they are fitted on at most.
CLUSTERS, SAMPLE = 4096, 16384
ROUNDS = 12
#: Rings of a cluster at most; borders are some of its quantiles.
RINGS = 64
#: Angles near 0 are known to some 1e-8; similarities count up to nine digits.
ANGLE_SLACK, SLACK = 1e-7, 2e-9

VECTORS = "cluster int, ring int, part int, block long, vec_id long, v array<double>, angle double"
BLOCKS = "cluster int, ring int, part int, block long, n long, lo double, hi double"


def centroids_of(vectors: np.ndarray, count: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids by spherical k-means, begun at evenly spaced rows; empty clusters are left out."""
    centers = vectors[np.linspace(0, len(vectors) - 1, count).astype(int)]
    for _ in range(rounds):
        nearest = np.concatenate([(vectors[k : k + 4096] @ centers.T).argmax(1) for k in range(0, len(vectors), 4096)])
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, vectors)
        size = np.linalg.norm(sums, axis=1)
        centers = sums[size > 1e-9] / size[size > 1e-9, None]
    return centers


def _vectors(frame: DataFrame, name: str) -> DataFrame:
    return frame.where(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias(name), unit(F.col("embedding")).alias("v"))


class VectorIndex:
    """An index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def build(cls, base: DataFrame, folder: str, clusters: int | None = None) -> VectorIndex:
        """A new index of ``vec_id, embedding``; by default as many clusters as the square root of their number."""
        index = cls(base.sparkSession, folder)
        vectors = _vectors(base, "vec_id")
        count = clusters or math.isqrt(vectors.count())
        sample = [r["v"] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()]
        filled = np.array([v for v in sample if any(v)], float)
        centers = centroids_of(filled, max(1, min(count, CLUSTERS, len(filled)))) if len(filled) else np.zeros((0, 0))
        rows = [(k, c.tolist()) for k, c in enumerate(centers)]
        index.spark.createDataFrame(rows, "cluster int, centroid array<double>").coalesce(1).write.parquet(f"{index.folder}/centroids")
        index.add(base)
        return index

    def _centroids(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.folder}/centroids").orderBy("cluster").collect()
        return np.array([r["centroid"] for r in rows], float)

    def _batches(self) -> list[str]:
        return [b.removesuffix("/blocks") for b in complete(self.spark, f"{self.folder}/batches/*/blocks")]

    def _read(self, table: str, schema: str) -> DataFrame:
        paths = [f"{b}/{table}" for b in self._batches()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def vectors(self) -> DataFrame:
        return self._read("vectors", VECTORS)

    def blocks(self) -> DataFrame:
        return self._read("blocks", BLOCKS)

    def add(self, more: DataFrame) -> None:
        """Indexes further vectors under the centroids that there are."""
        centers, name = self._centroids(), uuid.uuid4().hex

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = matrix(batch)
                # A vector of zeros, or one where there are no centroids, is in no cluster.
                cluster, angle = np.full(len(v), -1, np.int32), np.zeros(len(v))
                some = v.any(1) if len(centers) else np.zeros(len(v), bool)
                if some.any():
                    sims = v[some] @ centers.T
                    cluster[some] = sims.argmax(1)
                    angle[some] = np.arccos(np.clip(sims.max(1), -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster), pa.array(angle)], ["vec_id", "v", "cluster", "angle"])

        near = _vectors(more, "vec_id").mapInArrow(assign, "vec_id long, v array<double>, cluster int, angle double")
        # Borders of rings: as many quantiles as there are blocks' worth of vectors.
        quantiles = F.percentile_approx("angle", [k / RINGS for k in range(1, RINGS)], 1000)
        sizes = near.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), quantiles.alias("q"))
        rings = F.least(F.ceil(F.col("n") / BASE_BLOCK), F.lit(RINGS)).cast("int")
        borders = F.transform(F.when(rings > 1, F.sequence(F.lit(1), rings - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.get("q", F.floor(k * RINGS / rings).cast("int") - 1))
        ring = F.size(F.filter("borders", lambda b: b < F.col("angle"))).alias("ring")
        ringed = near.join(F.broadcast(sizes.select("cluster", borders.alias("borders"))), "cluster").select("cluster", ring, "vec_id", "v", "angle")
        counts = ringed.groupBy("cluster", "ring").agg(F.ceil(F.count(F.lit(1)) / BASE_BLOCK).alias("parts"))
        # Clusters and rings are bounded, so are these rows.
        parted = ringed.join(F.broadcast(counts), ["cluster", "ring"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
        rows = parted.withColumn("block", F.xxhash64(F.lit(name), "cluster", "ring", "part")).select(*(x.split()[0] for x in VECTORS.split(", ")))
        at = f"{self.folder}/batches/{name}"
        rows.write.parquet(f"{at}/vectors")
        written = self.spark.read.schema(VECTORS).parquet(f"{at}/vectors")
        blocks = written.groupBy("cluster", "ring", "part", "block").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi"))
        blocks.write.parquet(f"{at}/blocks")

    def _wanted(self, asked: DataFrame, first: bool) -> DataFrame:
        """``qid, v, cluster, a, tau``: of each query the clusters that may have one of its best vectors; in the first round the nearest one.

        ``a`` is null where the triangle inequality says nothing.
        """
        centers = self._centroids()
        known = {r["cluster"]: (r["lo"], r["hi"]) for r in self.blocks().groupBy("cluster").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}
        numbers = np.array(sorted(known), np.int32)
        lo, hi = (np.array([known[c][k] for c in numbers.tolist()]) for k in (0, 1))
        loose = numbers < 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    v, tau = matrix(part), part.column("tau").to_numpy()
                    angles = np.zeros((len(v), len(numbers)))
                    if (~loose).any():
                        angles[:, ~loose] = np.arccos(np.clip(v @ centers[numbers[~loose]].T, -1, 1))
                    unbound = loose[None, :] | ~v.any(1)[:, None]
                    least = np.where(unbound, 0, np.maximum(np.maximum(angles - hi, lo - angles) - ANGLE_SLACK, 0))
                    if first:
                        query, which = np.arange(len(v)), np.where(unbound, np.pi, angles).argmin(1)
                    else:
                        query, which = np.nonzero(unbound | (np.cos(least) + SLACK >= tau[:, None]))
                    rows = part.take(pa.array(query))
                    a = pa.array(angles[query, which], mask=unbound[query, which])
                    yield pa.RecordBatch.from_arrays([rows.column("qid"), rows.column("v"), pa.array(numbers[which]), a, rows.column("tau")], ["qid", "v", "cluster", "a", "tau"])

        if not len(numbers):
            return self.spark.createDataFrame([], "qid long, v array<double>, cluster int, a double, tau double")
        return asked.select("qid", "v", "tau").mapInArrow(run, "qid long, v array<double>, cluster int, a double, tau double")

    def _round(self, asked: DataFrame, k: int, first: bool) -> DataFrame:
        """``qid, v, block, n``: the blocks that each query is held against."""
        least = F.greatest(F.col("a") - F.col("hi"), F.col("lo") - F.col("a"), F.lit(0.0))
        least = F.coalesce(F.greatest(least - ANGLE_SLACK, F.lit(0.0)), F.lit(0.0))
        pairs = self._wanted(asked, first).join(self.blocks(), "cluster").withColumn("least", least)
        if not first:
            return pairs.where(F.cos("least") + SLACK >= F.col("tau")).select("qid", "v", "block", "n")
        top = F.min(F.struct(F.col("n") < k, "least", "block", "n")).alias("x")
        return pairs.groupBy("qid").agg(F.first("v").alias("v"), top).select("qid", "v", "x.block", "x.n")

    def _best(self, wanted: DataFrame, k: int) -> DataFrame:
        """``qid, vec_id, sim``: the k best of each block for each query that wants it."""
        copies = wanted.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("copies"))
        slot = F.pmod(F.xxhash64("qid"), F.col("copies")).cast("int")
        asked = wanted.join(copies, "block").select("qid", "v", "block", slot.alias("slot"))
        there = self.vectors().select("vec_id", "v", "block").join(copies, "block")
        there = there.select("vec_id", "v", "block", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("slot"))
        return asked.groupBy("block", "slot").cogroup(there.groupBy("block", "slot")).applyInArrow(best_of(k), "qid long, vec_id long, sim double")

    def _asked(self, queries: DataFrame, k: int) -> DataFrame:
        """``qid, v, tau``: queries with a similarity that their k-th best vector reaches at least."""
        asked = _vectors(queries, "qid").dropDuplicates(["qid"]).withColumn("tau", F.lit(-2.0))
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim")))
        reached = self._best(self._round(asked, k, True), k).withColumn("r", rank).where(F.col("r") == k).select("qid", F.col("sim").alias("tau"))
        return asked.drop("tau").join(reached, "qid", "left").withColumn("tau", F.coalesce("tau", F.lit(-2.0)))

    def nearest(self, queries: DataFrame, k: int = NEAREST) -> DataFrame:
        """``qid, vec_id, sim, rank``: the k most similar vectors of every query (``vec_id, embedding``), by cosine."""
        every = self._best(self._round(self._asked(queries, k), k, False), k)
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "vec_id"))
        return every.withColumn("rank", rank).where(F.col("rank") <= k)

    def share(self, queries: DataFrame, k: int = NEAREST) -> float:
        """The part of all pairs of query and vector that a search computes, in both rounds."""
        asked = self._asked(queries, k)
        n = F.sum("n").alias("n")
        done = sum(frame.agg(n).first()["n"] or 0 for frame in (self._round(asked.withColumn("tau", F.lit(-2.0)), k, True), self._round(asked, k, False)))
        every = asked.count() * (self.blocks().agg(n).first()["n"] or 0)
        return done / every if every else 0.0

