"""A trie of conversation prefixes: one node for each distinct sequence of first turns.

A prefix is named by a chain of SHA-256 digests, each of the digest before and of its own
turn, so equal names are equal prefixes. Every conversation gives a row for each of its
prefixes, and grouping these by depth and digest gives the nodes with their members.

Sums over subtrees go to all ancestors, but not from each node, which would give the square
of a conversation's length. A node belongs to its smallest member, and what a conversation
owns is the lower end of its own path. So values are first added up along that end, and only
its total is exploded to the ancestors above it: one row at most for each prefix of the
conversations.

What is shuffled are digests, not texts. A conversation's chain is made in order by one
task, as a stream of some 50 bytes a turn; its other sums are windows over such rows. Nodes
that many conversations share are counted before the shuffle; the digest of those that end
at a node is made of pieces of their sorted list, which whole ranges of it give in parallel.

Cases: null roles and texts count as empty, a null turn comes first; rows that tie in their
turn are ordered by their content's digest, and repeated rows are repeated turns. Rows without
a conversation id belong to no conversation and are left out. An empty table has no nodes.
Only the four columns named are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import Workspace

#: Nodes whose children are looked up by a broadcast are those with more than a thousandth of all; so they are fewer than this.
HOT_SHARE = 1000
#: Ids of ending conversations that make one piece of a list.
PIECE_IDS = 4096


def turn_digests(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, mark, n_words``: each turn by the digest of its role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    named = turns.where(F.col("conv_id").isNotNull())
    return named.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(F.sha2(whole, 256)).alias("mark"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"),
    )


def with_shared_beginnings(marks: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Every conversation rebuilt: some first turns become those of the conversation whose id is the multiple of ``every`` towards zero.

    How many, 0 to below ``most``, goes by a hash of the id. Adds ``part`` (0: turns of the other
    conversation, 1: own) and ``skip`` (own turns to leave out). Own rows that are left out stay, so no
    conversation is lost.
    """
    conv = F.col("conv_id")
    share = F.when(conv % every == 0, F.lit(0)).otherwise(F.crc32(conv.cast("string")) % most).cast("int")
    own = marks.withColumns({"part": F.lit(1), "skip": share})
    first = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "mark")
    begins = marks.where(conv % every == 0).withColumn("k", F.row_number().over(first)).where(F.col("k") < most)
    begins = begins.select(conv.alias("base"), F.col("k").cast("long").alias("turn"), "mark", "n_words")
    sharing = marks.select(conv, (conv - conv % every).alias("base"), share.alias("skip")).where("skip > 0").distinct()
    borrowed = sharing.join(begins, "base").where(F.col("turn") <= F.col("skip"))
    return own.unionByName(borrowed.select("conv_id", "turn", "mark", "n_words", F.lit(0).alias("part"), "skip"))


PREFIX = "conv_id long, depth long, node binary, parent binary, n_words long, last boolean"
_ROOT = hashlib.sha256(b"").digest()
#: Rows of a batch that is given back.
_ROWS = 8192


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """``conv_id, depth, node, parent, n_words, last``: a row for every prefix of every conversation, the empty one as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, node, depth, left = None, _ROOT, 0, 0
        names = [x.split()[0] for x in PREFIX.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())

        def batch(rows: list[tuple], ended: bool) -> pa.RecordBatch:
            """All rows but the last one, unless its conversation has ended as well; a row is a conversation's last if the next one isn't its own."""
            columns = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)]
            owner = columns[0].to_numpy()
            last = pa.array(np.append(owner[1:] != owner[:-1], True))
            whole = pa.RecordBatch.from_arrays([*columns, last], names)
            return whole if ended else whole.slice(0, len(rows) - 1)

        for rows in batches:
            for c, part, skip, mark, n in zip(*(rows.column(x).to_pylist() for x in ("conv_id", "part", "skip", "mark", "n_words"))):
                if c != conv:
                    conv, node, depth, left = c, _ROOT, 0, skip
                    out.append((c, 0, _ROOT, None, 0))
                if part and left:
                    left -= 1
                    continue
                before, node, depth = node, hashlib.sha256(node + mark).digest(), depth + 1
                out.append((c, depth, node, before, n))
            if len(out) > _ROWS:
                yield batch(out, False)
                out = out[-1:]
        if out:
            yield batch(out, True)

    ordered = rebuilt.repartition("conv_id").sortWithinPartitions("conv_id", "part", F.col("turn").asc_nulls_first(), "mark")
    return ordered.select("conv_id", "part", "skip", "mark", "n_words").mapInArrow(run, PREFIX)


def _ends(paths: DataFrame) -> DataFrame:
    """``node, ends_sha256``: of the ids of the conversations that end at each node.

    The rows are sorted over all partitions by node and id, so a node's list lies in one or several
    of them; each gives pieces of it, and the pieces of a node are hashed in their order.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []

        def pieces(rows: pa.Table) -> pa.RecordBatch:
            node, ids = rows.column("node").combine_chunks(), rows.column("conv_id").to_numpy()
            head = np.ones(len(ids), bool)
            head[1:] = pc.not_equal(node[1:], node[:-1]).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(head)
            ends = np.append(at[1:], len(ids))
            return pa.RecordBatch.from_arrays(
                [node.take(pa.array(at)), pa.array(ids[at]), pa.array([",".join(map(str, ids[a:b].tolist())) for a, b in zip(at, ends)])], ["node", "first", "ids"]
            )

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= PIECE_IDS:
                yield pieces(pa.Table.from_batches(held))
                held = []
        if held and sum(b.num_rows for b in held):
            yield pieces(pa.Table.from_batches(held))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple] = []
            for own, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if own != node:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), (pa.binary(), pa.string()))], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    ending = paths.where("last").select("node", "conv_id")
    ranged = ending.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    listed = ranged.mapInArrow(cut, "node binary, first long, ids string")
    return listed.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashed, "node binary, ends_sha256 string")


def _owner_of_parent(tops: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """``node, above``: of nodes whose parent another conversation owns, that conversation.

    Children of a node may be many: nodes with more than a ``HOT_SHARE``-th of all rows as children, of
    which there are fewer than ``HOT_SHARE``, are sent to every task; the others are joined.
    """
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"), "n_children")
    hot = F.col("n_children") > total // HOT_SHARE
    common = F.broadcast(parents.where(hot).select("parent", F.col("above").alias("hot")))
    split = tops.select("node", "parent").join(common, "parent", "left")
    rest = split.where(F.col("hot").isNull()).select("node", "parent").join(parents.where(~hot).select("parent", "above"), "parent")
    return split.where(F.col("hot").isNotNull()).select("node", F.col("hot").alias("above")).unionByName(rest.select("node", "above"))


def _below(values: Column) -> Column:
    """Sum along a conversation's own nodes from each one downwards."""
    return F.sum(values).over(Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0))


def prefix_trie(rebuilt: DataFrame) -> DataFrame:
    """One row for each node of the trie of the conversations in ``rebuilt`` (see ``with_shared_beginnings``).

    ``node, parent`` are the digests of prefixes; the other columns are as in the query. Prefixes and
    nodes are written to the shared folder, from which the result is read.
    """
    space = Workspace(rebuilt.sparkSession)
    paths = space.keep("paths", prefixes(rebuilt))
    members = paths.groupBy("depth", "node").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("parent").alias("parent"), F.min("n_words").alias("n_words")
    )
    grouped = space.keep("grouped", members)
    children = grouped.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = grouped.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    own_path = Window.partitionBy("conv_id").orderBy("depth")
    summed = counted.withColumns({
        "saved": _below((F.col("n_convs") - 1) * F.col("n_words")), "leaves": _below((F.col("n_children") == 0).cast("long")), "before": F.lag("conv_id").over(own_path),
    })
    nodes = space.keep("nodes", summed)
    total = nodes.count()
    tops = nodes.where("before IS NULL AND depth > 0")
    # Each conversation's total, once for every prefix above what it owns.
    totals = tops.select("conv_id", F.col("depth").alias("top"), "saved", "leaves")
    given = paths.select("conv_id", "depth", "node").join(totals, "conv_id").where(F.col("depth") < F.col("top"))
    added = given.groupBy("node").agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
    joined = nodes.join(added, "node", "left").join(_owner_of_parent(tops, nodes, total), "node", "left").join(_ends(paths), "node", "left")
    none = F.lit(0).cast("long")
    return joined.select(
        "node", "parent", "conv_id", "depth", F.coalesce("before", "above").alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("leaves") + F.coalesce("more_leaves", none)).alias("n_leaves"), (F.col("saved") + F.coalesce("more_saved", none)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def digest(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of the conversations, rebuilt with shared beginnings."""
    return prefix_trie(with_shared_beginnings(turn_digests(conversations))).drop("node", "parent")
