"""Mixing sources to target weights by Poisson replication.

Every document is repeated as often as a Poisson variable says whose mean is its source's
repetition rate; the variable is the inverse of the distribution at a number between 0 and
1 hashed from seed and document. Copies are then dealt over all partitions and ordered
inside them by another hash. DataFrame functions only; a result depends on nothing but
the input and the seed, so lost tasks are simply run again.

A source's rate is ``size * share / documents``; ``share`` is its part of the weights.
Without weights given, they are the power ``alpha`` of the sources' sizes.

Cases: a null source is the source ``''``; a source without a weight has weight 0 and is
left out. Repeated rows are repeated alike. A row without an id goes by a hash of its source
and, where there is one, its text, so such rows are drawn apart unless these are the same.
An empty table gives an empty result. All
columns stay, whatever their names; only in the result of ``mix``, ``copy_no``, ``rate`` and
``mix_key`` replace columns of these names, while ``repeat`` gives the input's columns alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources up to which their rates are sent to every executor (under 1 MB); beyond that they are joined by salted keys.
BROADCAST_SOURCES = 4096
SALTS = 64
#: A larger mean is drawn as a sum of several Poisson variables, each with a mean up to this.
LARGEST_MEAN = 64.0


def uniform(*parts: Column) -> Column:
    """A number from 0 to below 1 by the hash of the parts, in steps of 2^-52."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def poisson(mean: Column, draw) -> Column:
    """The Poisson variable of this mean; ``draw`` gives the hashed number of each part of it."""
    parts = F.greatest(F.ceil(mean / LARGEST_MEAN), F.lit(1)).cast("int")
    each = mean / parts

    def one(j: Column) -> Column:
        u = draw(j)
        zero = F.struct(F.exp(-each).alias("p"), F.exp(-each).alias("cdf"), F.when(u >= F.exp(-each), 1).otherwise(0).alias("k"))
        # Terms far beyond the mean; what is left of the distribution there is below the step of u.
        far = F.ceil(each + F.sqrt(each) * 12 + 24).cast("int")

        def step(s: Column, k: Column) -> Column:
            p = s["p"] * each / k
            cdf = s["cdf"] + p
            return F.struct(p.alias("p"), cdf.alias("cdf"), (s["k"] + F.when(u >= cdf, 1).otherwise(0)).alias("k"))

        return F.aggregate(F.sequence(F.lit(1), far), zero, step, lambda s: s["k"])

    return F.when(mean > 0, F.aggregate(F.transform(F.sequence(F.lit(1), parts), one), F.lit(0), lambda a, x: a + x)).otherwise(0)


def named(docs: DataFrame) -> Column:
    """What a row's draws and its place are hashed from: its id, or else its content."""
    content = F.xxhash64(*(c for c in ("source", "text") if c in docs.columns))
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("content:"), content.cast("string")))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, size: int | None = None) -> DataFrame:
    """``mix_source, rate``: how often a document of each source is to be expected."""
    counts = docs.groupBy(F.coalesce("source", F.lit("")).alias("mix_source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        known = F.map_from_arrays(F.array(*map(F.lit, weights)), F.array(*(F.lit(float(w)) for w in weights.values()))) if weights else F.create_map().cast("map<string,double>")
        weighed = counts.withColumn("w", F.coalesce(F.try_element_at(known, F.col("mix_source")), F.lit(0.0)))
    total = weighed.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()
    all_w, target = total["w"] or 0.0, float(size if size is not None else total["n"] or 0)
    return weighed.select("mix_source", (F.lit(target) * F.col("w") / F.lit(all_w) / F.col("n") if all_w > 0 else F.lit(0.0)).alias("rate"))


def _free(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores in front until no column has one of them."""
    taken, mark = {c.lower() for c in columns}, ""
    while any(f"{mark}{n}" in taken for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]


def _repeated(docs: DataFrame, weights: dict[str, float] | None, alpha: float, size: int | None, seed: int) -> tuple[DataFrame, list[str]]:
    """All columns of ``docs`` and, under the names given back, a copy's number, its source's rate and the key that copies are dealt by."""
    names = _free(docs.columns, "mix_copy_no", "mix_rate", "mix_key", "mix_source", "mix_salt", "mix_copies")
    copy_no, rate, key, source, salt, copies = names
    own, name = F.coalesce("source", F.lit("")), named(docs)
    few = rates(docs, weights, alpha, size).select(F.col("mix_source").alias(source), F.col("rate").alias(rate))
    some = few.limit(BROADCAST_SOURCES + 1).collect()
    if len(some) <= BROADCAST_SOURCES:
        small = docs.sparkSession.createDataFrame([tuple(r) for r in some], few.schema)
        rated = docs.withColumn(source, own).join(F.broadcast(small), source)
    else:
        spread = few.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rated = docs.withColumn(source, own).withColumn(salt, F.pmod(F.xxhash64(name), F.lit(SALTS)).cast("int")).join(spread, [source, salt])
    many = rated.withColumn(copies, poisson(F.col(rate), lambda j: uniform(F.lit(str(seed)), j.cast("string"), name))).where(F.col(copies) > 0)
    every = many.withColumn(copy_no, F.explode(F.sequence(F.lit(1), F.col(copies))))
    keyed = every.withColumn(key, F.substring(F.md5(F.concat_ws(":", F.lit(f"order{seed}"), F.col(copy_no).cast("string"), name)), 1, 16))
    shuffled = keyed.repartition(key).sortWithinPartitions(key)
    return shuffled, names[:3]


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, size: int | None = None, seed: int = 17) -> DataFrame:
    """``docs`` with every row repeated to its source's rate and all rows shuffled, and ``copy_no, rate, mix_key``."""
    out, names = _repeated(docs, weights, alpha, size, seed)
    new = dict(zip(("copy_no", "rate", "mix_key"), names))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in new), *(F.col(n).alias(c) for c, n in new.items()))


def repeat(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, size: int | None = None, seed: int = 17) -> DataFrame:
    """The rows of ``mix`` with the columns of ``docs`` alone, all of them as they were."""
    return _repeated(docs, weights, alpha, size, seed)[0].select(*(F.col(f"`{c}`") for c in docs.columns))
