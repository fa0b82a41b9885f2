"""Chunks of documents and the nearest vectors to a set of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import unit

# Defaults of the splitter and the search, and what is said without an answer.
SIZE, OVERLAP = 1000, 100
SEPARATORS = ("\n\n", "\n", "")
NEAREST = 3
NO_ANSWER = "Couldn't generate a response at this time. Please try again later."
RAG_PROMPT = "You are a document search assistant. Answer the following question based on the provided context only."
#: Query vectors and base vectors that meet in one group, about, and queries of it that are multiplied at a time.
QUERY_BLOCK, BASE_BLOCK, QUERY_ROWS = 2048, 16384, 256
#: Vectors that these meet at a time; memory grows with this, not with the block.
BASE_ROWS = 2048
#: Similarities count as equal up to so many digits; the smaller id comes first then.
DIGITS = 9


def split_text(text: str | None, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` code points, cut at the coarsest separator that helps, that share up to ``overlap`` with the one before."""
    text = text or ""
    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    by = next((s for s in separators if s in text), "")
    finer = separators[separators.index(by) + 1 :] if by in separators else ()
    if by == "":
        step = size - overlap
        return [c for k in range(0, max(len(text) - overlap, 1), step) if (c := text[k : k + size].strip())]
    out: list[str] = []
    held: list[str] = []
    length = 0

    def close() -> None:
        joined = by.join(held).strip()
        if joined:
            out.append(joined)

    for part in (p for p in text.split(by) if p):
        if len(part) > size:
            close()
            held, length = [], 0
            out += split_text(part, size, overlap, finer)
            continue
        if held and length + len(by) + len(part) > size:
            close()
            while held and (length > overlap or length + len(by) + len(part) > size):
                length -= len(held.pop(0)) + len(by) * bool(held)
        length += len(part) + len(by) * bool(held)
        held.append(part)
    close()
    return out


def chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, chunk_no, chunk`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cut = [split_text(t, size, overlap) for t in part.column("text").to_pylist()]
                counts = np.array([len(c) for c in cut], np.int64)
                ids = part.column("doc_id").take(pa.array(np.repeat(np.arange(len(cut)), counts)))
                yield pa.RecordBatch.from_arrays([ids, pa.array([k for c in cut for k in range(len(c))], pa.int32()), pa.array([x for c in cut for x in c], pa.string())], ["doc_id", "chunk_no", "chunk"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, chunk_no int, chunk string")


class _Splitter:
    def eval(self, text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple[int, str]]:
        yield from enumerate(split_text(text, size, overlap))


def register_splitter(spark: SparkSession, name: str = "split_text") -> None:
    """Makes the splitter a table function in SQL: ``FROM docs, LATERAL split_text(docs.text)``, with size and overlap if wanted."""
    spark.udtf.register(name, F.udtf(_Splitter, returnType="chunk_no int, chunk string"))


def matrix(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    """The column ``v`` of equally long lists as a matrix."""
    flat = rows.column("v")
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)


def best_of(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For groups of queries (``qid, v``) and vectors (``vec_id, v``): the k most similar vectors of each query."""

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("qid", pa.int64()), ("vec_id", pa.int64()), ("sim", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ids, vectors = right.column("vec_id").to_numpy(), matrix(right).T
        out = []
        for at in range(0, left.num_rows, QUERY_ROWS):
            part = left.slice(at, QUERY_ROWS)
            asked, sims, near = matrix(part), np.zeros((part.num_rows, 0)), np.zeros((part.num_rows, 0), np.int64)
            for first in range(0, len(ids), BASE_ROWS):
                own = ids[first : first + BASE_ROWS]
                # The best so far and these.
                sims = np.concatenate([sims, np.round(asked @ vectors[:, first : first + BASE_ROWS], DIGITS)], 1)
                near = np.concatenate([near, np.broadcast_to(own, (part.num_rows, len(own)))], 1)
                order = np.lexsort((near, -sims))[:, :k]
                sims, near = np.take_along_axis(sims, order, 1), np.take_along_axis(near, order, 1)
            out.append((np.repeat(part.column("qid").to_numpy(), near.shape[1]), near.ravel(), sims.ravel()))
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], schema=schema)

    return best


def nearest(base: DataFrame, queries: DataFrame, k: int = NEAREST) -> DataFrame:
    """``qid, vec_id, sim, rank``: the k most similar base vectors of every query, by cosine.

    Both sides have ``vec_id`` and ``embedding``. They are dealt into blocks of about ``QUERY_BLOCK``
    and ``BASE_BLOCK`` rows by hashes of their ids, and every pair of blocks meets once, in a group of
    its own that gives the k best of its vectors for each of its queries; only these meet. Nothing goes
    through the driver but the two counts.
    """
    n_queries, n_base = (max(1, -(-frame.count() // size)) for frame, size in ((queries, QUERY_BLOCK), (base, BASE_BLOCK)))

    def dealt(frame: DataFrame, name: str, own: str, n: int, other: str, m: int) -> DataFrame:
        rows = frame.where(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias(name), unit(F.col("embedding")).alias("v"))
        return rows.withColumn(own, F.pmod(F.xxhash64(name), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    asked, there = dealt(queries, "qid", "q", n_queries, "b", n_base), dealt(base, "vec_id", "b", n_base, "q", n_queries)
    every = asked.groupBy("q", "b").cogroup(there.groupBy("q", "b")).applyInArrow(best_of(k), "qid long, vec_id long, sim double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k)


def embedded(docs: DataFrame, embed: Callable[[list[str]], np.ndarray], key: str = "doc_id") -> DataFrame:
    """``vec_id, embedding``: each text through a pluggable embedder, which gets a list of texts and gives a row for each.

    The same function embeds queries. A null text counts as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = np.asarray(embed([t or "" for t in part.column("text").to_pylist()]), np.float32)
                ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))], ["vec_id", "embedding"])

    return docs.select(F.col(key).cast("long").alias("vec_id"), "text").mapInArrow(run, "vec_id long, embedding array<float>")


def contexts(found: DataFrame, texts: DataFrame) -> DataFrame:
    """``qid, context``: the texts of each query's vectors, best first, one line with a hyphen each."""
    joined = found.join(texts.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    ranked = F.sort_array(F.collect_list(F.struct("rank", "text")))
    lines = F.transform("r", lambda x: F.concat(F.lit("- "), x["text"]))
    return joined.groupBy("qid").agg(ranked.alias("r")).select("qid", F.array_join(lines, "\n").alias("context"))


def answered(questions: DataFrame, generate: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """Questions through a pluggable generator of Arrow batches; its missing answers become a fixed apology."""
    return questions.mapInArrow(generate, schema).withColumn("answer", or_apology(F.col("answer")))


def or_apology(answer: Column) -> Column:
    return F.coalesce(answer, F.lit(NO_ANSWER))
