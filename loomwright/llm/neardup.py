"""Near-duplicates by bottom-k sketches from one hash function.

1. Every text becomes the set of its word shingles, as 64-bit hashes; equal sets are one
   class from here on, whatever the number of copies. Sets are equal if their sizes and sums
   under two unrelated hashes are.
2. A class's sketch is its ``SKETCH`` smallest hashes. Inverted lists of the ``LISTED``
   smallest give the overlaps. Two similar sets share at least a known part of those values
   (five standard deviations below the expected one), so it is enough to list each class
   under its rarest values up to that part: two that share more still meet.
3. Lists are worked off by hubs. A list's hub is the member whose values are most frequent;
   every member that is likely to be similar to it, and every member of a list of more than
   ``LIST_MEMBERS``, is compared with it on full sets. That gives links, and for each such
   member its difference from the hub. Two members of a hub differ by what their differences
   don't share, so all pairs of them are decided exactly by these. What more than half of a
   hub's members have in their difference belongs to the hub alone, or to a text that all
   others share; it is turned round, so differences are those from the core of the group.
   Members so close to the core that this alone makes them similar are linked to the closest
   one. Any other pair must share a part of their differences that is known for each member,
   so differences get inverted lists of their rarest shingles, and the test runs inside the
   join on these lists, first against each list's member with the smallest difference, then
   across components; a long list is a group with a core of its own once more. Documents that share a template and have texts of their own besides
   have no shingles of their differences in common, so they meet nobody.
   Members of shorter lists that weren't compared with their hub meet the list's members of
   other components whose sets have such a size that they can be similar. That join lets out
   only pairs that the sketches find likely. No list is capped.
4. A pair's similarity is first estimated from the sketch of the union; likely pairs (4.5
   standard deviations of room) are confirmed on the full sets of the whole texts, by another
   hash than the one that made them candidates.

Links that would join what is joined already are not needed and not looked for, so a group
of copies gives about as many pairs as it has different texts.

Cases: a text without words, or null, has an empty set and is linked with nothing. A row
without an id is linked with nothing and has a null component. Rows with the same id are one
document: its texts' groups are joined, and all its rows have the same component; ``keep_one``
keeps the one with the smallest text. A text with fewer words than a shingle has its whole
sequence as its one shingle. Empty tables give empty results. Only the id and text columns
are read, so other columns may have any names; very long texts are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .components import components
from .storage import Workspace, small_batches

SKETCH = 64
LISTED = 32
#: Lists up to so many members are compared pair by pair, by their sketches; those of longer ones by their differences from the hub.
LIST_MEMBERS = 64
#: How often a long list of a group becomes a group itself.
DEEPEST = 4
#: Partitions that a hub's members are dealt over at least.
SALTS = 64
#: Tables that the result is read from.
RESULT = ("prints", "ids")
#: Keys of the hash of candidates and of the one that confirms them.
PROPOSE, CONFIRM = 1, 2


def shingle_sets(column: pa.Array, width: int, key: int = PROPOSE) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    data, at = tb.buffers(column)
    data = tb.LOWER[data]
    word = tb.words(data, at)
    hashes = tb.Hasher(data, key)(word.start, word.end)
    grams = tb.windows(hashes, width)
    out = []
    for first, last in zip(word.at[:-1].tolist(), word.at[1:].tolist()):
        n = last - first
        out.append(np.unique(grams[first : last - width + 1]) if n >= width else tb.windows(hashes[first:last], n) if n else grams[:0])
    return out


def prints(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, mark, n_shingles, fa, fb, sketch`` of each row; equal sets have equal fa and fb, ``mark`` is the text's own."""
    names = ["doc_id", "mark", "n_shingles", "fa", "fb", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.parts(batches, "text"):
            sets = shingle_sets(part.column("text"), width)
            fa = np.array([np.add.reduce(tb.mix(s), dtype=np.uint64) for s in sets], np.uint64)
            fb = np.array([np.add.reduce(tb.mix(s), dtype=np.uint64) for s in shingle_sets(part.column("text"), width, CONFIRM)], np.uint64)
            heads = [s[:SKETCH] for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(h) for h in heads])])
            flat = np.concatenate(heads) if heads else np.zeros(0, np.uint64)
            # Spark's longs are signed; with the top bit turned they keep the order of the hashes.
            flat = (flat ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array([len(s) for s in sets], pa.int64()), pa.array(fa.view(np.int64)), pa.array(fb.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names)

    return small_batches(_marked(docs)).mapInArrow(run, "doc_id long, mark long, n_shingles long, fa long, fb long, sketch array<long>")


def _marked(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two sets by their sketches: the part of the union's sketch that both have."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)


def _may_reach(a: Column, b: Column, least: float) -> Column:
    """Whether the estimate can be so high, by the values in common alone; the union's sketch is no shorter than either one."""
    return F.size(F.array_intersect(a, b)) >= F.greatest(F.size(a), F.size(b)) * least


def _likely(pairs: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (a, b with n and sketch each) those of a ``long`` list and those that may be similar enough, by size and by estimate."""
    t = percent / 100
    least = t - 4.5 * math.sqrt(t * (1 - t) / SKETCH)
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    near = sizes & _may_reach(F.col("sketch_a"), F.col("sketch_b"), least) & (estimate(F.col("sketch_a"), F.col("sketch_b")) >= least)
    return pairs.where(F.col("long") | near).select("a", "b")


def compared(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``a, b, n_a, n_b, linked, delta``: each pair held against each other on full sets; delta has what only one of them has.

    Elements of ``delta`` are hashes whose lowest bit tells whether a has them.
    ``texts``: doc_id, text of at least all documents in ``pairs``.
    """
    names = ["a", "b", "n_a", "n_b", "linked", "delta"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.parts(batches, "text_b", tb.SLICE_BYTES // 2):
            seen: dict[int, np.ndarray] = {}
            rows = []
            for k, (a, b, y) in enumerate(zip(part.column("a").to_pylist(), part.column("b").to_pylist(), shingle_sets(part.column("text_b"), width, CONFIRM))):
                x = seen.get(a)
                if x is None:
                    x = seen[a] = shingle_sets(part.column("text_a").slice(k, 1), width, CONFIRM)[0]
                gone, new = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                delta = np.concatenate([gone | np.uint64(1), new & ~np.uint64(1)])
                both = (len(x) + len(y) - len(delta)) // 2
                rows.append((a, b, len(x), len(y), 100 * both >= percent * (both + len(delta)), delta.view(np.int64)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)], names)

    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    whole = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    return small_batches(whole).mapInArrow(run, "a long, b long, n_a long, n_b long, linked boolean, delta array<long>")


def groups(docs: DataFrame, width: int = 5, percent: int = 80, space: Workspace | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row: its near-duplicates' smallest id, and whether that is its own.

    The result is read from the tables ``RESULT`` of ``space``.
    """
    space = space or Workspace(docs.sparkSession)
    key = ["fa", "fb", "n_shingles"]
    every = space.keep("prints", prints(docs, width))
    known = every.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    first = F.min(F.struct("doc_id", "mark")).alias("first")
    classes = known.groupBy(*key).agg(F.first("sketch").alias("sketch"), first)
    # Written once, so a class keeps its number.
    sketches = space.keep("sketches", classes.withColumn("class", F.monotonically_increasing_id()).withColumn("n", F.col("n_shingles")))
    lists = space.keep("lists", _lists(sketches, percent))
    # Texts of one id belong together.
    several = known.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("x"), F.max(F.struct(*key)).alias("y")).where("x <> y").select("doc_id")
    own = known.join(several, "doc_id").join(sketches.select(*key, "class"), key).select("doc_id", "class")
    links = own.join(own.groupBy("doc_id").agg(F.min("class").alias("a")), "doc_id").where("class <> a").select("a", F.col("class").alias("b")).distinct()
    joined = _classes_joined(docs, sketches, lists, links, space, width, percent)
    roots = sketches.join(joined, F.col("class") == F.col("node"), "left").select(*key, "first.doc_id", F.coalesce("component", "class").alias("component"))
    smallest = roots.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = space.keep("ids", roots.join(smallest, "component").select(*key, "component_id"))
    steps = range(DEEPEST + 4)
    space.drop("sketches", "lists", "listed", "texts", "hubs", "near", "far", "links-far", *(f"{x}-{k}" for k in steps for x in ("joined", "stars", "links", "centred", "able", "open", "left", "across")))
    out = every.select("doc_id", *key).join(ids, key, "left")
    own_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own_id.alias("component_id"), F.coalesce(own_id == F.col("doc_id"), F.lit(True)).alias("kept"))


def _classes_joined(docs: DataFrame, sketches: DataFrame, lists: DataFrame, links: DataFrame, space: Workspace, width: int, percent: int) -> DataFrame:
    """``node, component`` of classes that are linked with others, by ``links`` and by the lists; steps without input are left out."""
    none = sketches.sparkSession.createDataFrame([], "node long, component long")
    if not lists.take(1):
        return _joined(links, none, space, 0)
    likely = space.keep("listed", sketches.join(lists.select("class").distinct(), "class", "left_semi"))
    # One text of each listed class.
    texts = _marked(docs).join(likely.select("first.doc_id", "first.mark", "class"), ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"])
    texts = space.keep("texts", texts.select(F.col("class").alias("doc_id"), "text"))
    hubs = space.keep("hubs", _hubs(lists))
    pairs = lists.join(hubs, "value").where("class <> hub").groupBy(F.col("hub").alias("a"), F.col("class").alias("b")).agg((F.max("size") > LIST_MEMBERS).alias("long"))
    pairs = space.keep("pairs", _with_sketches(pairs, likely, percent))
    near = space.keep("near", compared(pairs, texts, width, percent))
    space.drop("pairs")
    centred = space.keep("centred-0", _centred(_around_hubs(near), percent))
    links = space.keep("links-0", links.unionByName(near.where("linked").select("a", "b")).unionByName(_to_core(centred)))
    joined = _joined(links, none, space, 0)
    more = _links_of_lists(centred, joined, space, percent)
    far = space.keep("far", _far_pairs(lists, hubs, near, joined, likely, percent))
    more = more.unionByName(compared(far, texts, width, percent).where("linked").select("a", "b"))
    return _joined(space.keep("links-far", more), joined, space, DEEPEST + 2)


def _links_of_lists(centred: DataFrame, joined: DataFrame, space: Workspace, percent: int) -> DataFrame:
    """All links of centred groups that their lists give and that join what isn't joined.

    Members of a list whose first member's component leaves out more than ``LIST_MEMBERS`` of them have
    something in common that others of the group don't have, so the list is a group with a core of its
    own. After ``DEEPEST`` such steps what is left is met pair by pair.
    """
    every = joined.sparkSession.createDataFrame([], "a long, b long")
    for turn in range(1, DEEPEST + 2):
        able = space.keep(f"able-{turn}", _with_partners(_outside(centred, joined), percent))
        open_ = space.keep(f"open-{turn}", _open(_delta_lists(able, percent), joined))
        if not open_.take(1):
            return every
        links = space.keep(f"links-{turn}", _to_smallest(open_, centred, percent))
        every = every.unionByName(links)
        if 20 * links.count() > open_.count():
            # Worth a further round of components: fewer pairs are open then. Where there are few links, they wait.
            joined = _joined(every, joined, space, turn)
            open_ = space.keep(f"left-{turn}", _open(open_.drop("component", "first_component"), joined))
        long = _long_lists(open_) if turn <= DEEPEST else open_.limit(0)
        deeper = bool(long.take(1))
        short = open_.join(long, ["hub", "element"], "left_anti") if deeper else open_
        every = every.unionByName(space.keep(f"across-{turn}", _across(short, centred, percent)))
        if not deeper:
            return every
        same = _sizes(open_).join(long, ["hub", "element"]).groupBy("hub", "size", "sum_1", "sum_2").agg(F.min("element").alias("element"))
        members = open_.join(same.select("hub", "element"), ["hub", "element"]).select("hub", "element", "class").join(centred.select("hub", "class", "n", "delta"), ["hub", "class"])
        centred = space.keep(f"centred-{turn}", _centred(members.select(F.xxhash64("hub", "element").alias("hub"), "class", "n", "delta"), percent))
        every = every.unionByName(_to_core(centred))
    return every


def _sizes(lists: DataFrame) -> DataFrame:
    """``hub, element, size`` of lists, and two sums that tell which members they have."""
    sums = [F.sum(F.xxhash64("class", F.lit(k)).cast("decimal(38,0)")).alias(f"sum_{k}") for k in (1, 2)]
    return lists.groupBy("hub", "element").agg(F.count(F.lit(1)).alias("size"), *sums)


def _long_lists(lists: DataFrame) -> DataFrame:
    """``hub, element`` of lists with more than ``LIST_MEMBERS`` members outside the first member's component."""
    return lists.where("component <> first_component").groupBy("hub", "element").agg(F.count(F.lit(1)).alias("outside")).where(F.col("outside") > LIST_MEMBERS).select("hub", "element")


def _lists(sketches: DataFrame, percent: int) -> DataFrame:
    """``value, class, weight``: each class under its rarest values; weight says how frequent its values are."""
    t = percent / 100
    shared = t - 5 * math.sqrt(t * (1 - t) / LISTED)
    values = sketches.select("class", F.explode(F.slice("sketch", 1, LISTED)).alias("value"))
    often = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    mine = values.join(often, "value").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("found"), F.sum("df").alias("weight"))
    size = F.least(F.size("sketch"), F.lit(LISTED))
    # Values that nobody else has come first in the order and give no list.
    room = size - F.greatest(F.ceil(size * shared), F.lit(1)) + 1 - (size - F.size("found"))
    sized = mine.join(sketches.select("class", "sketch"), "class").withColumn("room", room).where("room > 0")
    return sized.select("class", "weight", F.explode(F.slice("found", 1, F.col("room").cast("int"))).alias("x")).select(F.col("x.value").alias("value"), "class", "weight")


def _hubs(lists: DataFrame) -> DataFrame:
    """``value, hub, size``: of each list with two members or more, the one whose values are most frequent, and how many they are."""
    top = lists.groupBy("value").agg(F.max(F.struct(F.col("weight"), F.bitwise_not("class").alias("other"))).alias("top"), F.count(F.lit(1)).alias("size"))
    return top.where("size > 1").select("value", F.bitwise_not("top.other").alias("hub"), "size")


def _joined(links: DataFrame, joined: DataFrame, space: Workspace, turn: int) -> DataFrame:
    """Components with further links; what is joined already goes on as one edge for each class."""
    if not links.take(1):
        return joined
    graph = links.unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return space.keep(f"joined-{turn}", components(graph, space, f"stars-{turn}"))


def _around_hubs(near: DataFrame) -> DataFrame:
    """``hub, class, n, delta``: the groups of hubs with a member that isn't linked to them; the hub is a member itself."""
    open_ = near.groupBy("a").agg(F.min("linked").alias("all_linked"), F.count(F.lit(1)).alias("size"), F.first("n_a").alias("n")).where("NOT all_linked AND size > 1")
    # A hub may have very many members: they are dealt over several partitions, each of which gets the hub's row.
    spread = open_.select("a", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = near.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(spread, ["a", "salt"])
    own = open_.select(F.col("a").alias("hub"), F.col("a").alias("class"), "n", F.array().cast("array<long>").alias("delta"))
    return rows.select(F.col("a").alias("hub"), F.col("b").alias("class"), F.col("n_b").alias("n"), "delta").unionByName(own)


def _centred(rows: DataFrame, percent: int) -> DataFrame:
    """``hub, class, n, delta, d, slack, most, best``: members of groups by their difference from the core of the group.

    The lowest bit of an element tells whether the core has it, as it tells in ``rows`` of what their differences are from.

    With sizes n and differences d from anything, two sets are similar enough if ``(100 - p) (n_x + n_y)``
    is no less than ``(100 + p)`` times what only one of them has, which is ``d_x + d_y`` less twice what
    the differences share. ``slack`` is a member's part of that without the shared ones, ``best`` the
    member with the most.
    """
    sizes = rows.groupBy("hub").agg(F.count(F.lit(1)).alias("size"))
    # What more than half of the members have; these elements are no more than twice an average difference.
    often = rows.select("hub", F.explode("delta").alias("element")).groupBy("hub", "element").agg(F.count(F.lit(1)).alias("df"))
    core = often.join(sizes, "hub").where("2 * df > size").groupBy("hub").agg(F.collect_list("element").alias("core"))
    spread = sizes.join(core, "hub", "left").select("hub", F.coalesce("core", F.array().cast("array<long>")).alias("core"))
    spread = spread.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int")).join(spread, ["hub", "salt"])
    turned = salted.select("hub", "salt", "class", "n", F.concat(F.array_except("delta", "core"), F.transform(F.array_except("core", "delta"), lambda e: e.bitwiseXOR(F.lit(1)))).alias("delta"))
    d = F.size("delta")
    sized = turned.withColumn("d", d).withColumn("slack", (100 - percent) * F.col("n") - (100 + percent) * d)
    most = sized.groupBy("hub").agg(F.max(F.struct("slack", "class")).alias("x")).select("hub", F.col("x.slack").alias("most"), F.col("x.class").alias("best"))
    most = most.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return sized.join(most, ["hub", "salt"]).drop("salt")


def _to_core(centred: DataFrame) -> DataFrame:
    """Links of the members that are similar to the closest one by their distances from the core alone."""
    return centred.where("slack + most >= 0 AND class <> best").select(F.col("best").alias("a"), F.col("class").alias("b"))


def _outside(centred: DataFrame, joined: DataFrame) -> DataFrame:
    """The groups that have members outside the component of their closest one, and which members these are; close members never are.

    Of two members that are to be joined one is such a member, so what none of them has in its
    difference is shared by no pair that is still open.
    """
    of, best = (joined.select(F.col("node").alias(k), F.col("component").alias(v)) for k, v in (("class", "own"), ("best", "main")))
    told = centred.join(of, "class", "left").join(best, "best", "left").withColumn("outside", F.coalesce("own", "class") != F.coalesce("main", "best")).drop("own", "main")
    return _of_open_groups(told)


def _of_open_groups(told: DataFrame) -> DataFrame:
    return told.join(told.where("outside").select("hub").distinct(), "hub", "left_semi")


def _with_partners(told: DataFrame, percent: int) -> DataFrame:
    """The members of which a similar one can be there, by what they have beside the core and no other member has.

    What only one of two sets has is half of their difference and of the first's size less the other's.
    Most members of a template or of a base with many edits end here.
    """
    t, part = percent / 100, (100 - percent) / (100 + percent)
    extra = told.select("hub", "class", F.explode(F.filter("delta", lambda e: e.bitwiseAND(F.lit(1)) == 0)).alias("element"))
    own = extra.groupBy("hub", "element").agg(F.count(F.lit(1)).alias("df"), F.min("class").alias("class")).where("df = 1")
    alone = own.groupBy("hub", "class").agg(F.count(F.lit(1)).alias("alone"))
    least = told.groupBy("hub").agg(F.min("n").alias("n_least"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = told.join(alone, ["hub", "class"], "left").withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int")).join(least, ["hub", "salt"])
    other = F.greatest(F.col("n_least"), F.col("n") * t)
    left = salted.where(2 * F.coalesce("alone", F.lit(0)) <= F.col("n") - other + part * (F.col("n") + other) + 1e-6).drop("alone", "n_least", "salt")
    return _of_open_groups(left)


def _delta_lists(centred: DataFrame, percent: int) -> DataFrame:
    """``hub, element, class, d, close``: members of hubs under their difference's rarest shingles, of those that an ``outside`` member has.

    ``close`` members are linked to the closest one, so of a pair that is still open one isn't close. Two
    must share ``-(slack_x + slack_y) / (2 (100 + p))`` elements; that a partner's slack is no more than the
    most there is, or less than its negative where it isn't close itself, gives the least that a member
    can share with any partner. A shared part is also no less than the difference without all that the
    member and a similar set can differ by. ``gain`` is what a difference has of elements that can be
    shared, less the others: two members differ by no less than the one's difference less the other's
    gain, so a member that is too far from the core for the largest gain of its group has no partner.
    """
    t, per, part = percent / 100, 2 * (100 + percent), (100 - percent) / (100 + percent)
    close = F.col("slack") + F.col("most") >= 0
    rows = centred.withColumn("close", close).where("d > 0")
    elements = rows.select("hub", "class", "outside", F.explode("delta").alias("element"))
    # What only members of one component have is as good as what nobody else has.
    often = elements.groupBy("hub", "element").agg(F.count(F.lit(1)).alias("df"), F.max("outside").alias("outside")).where("df > 1 AND outside").select("hub", "element", "df")
    found = elements.select("hub", "class", "element").join(often, ["hub", "element"]).groupBy("hub", "class").agg(F.sort_array(F.collect_list(F.struct("df", "element"))).alias("found"))
    held = found.join(rows.select("hub", "class", "n", "d", "slack", "most", "close"), ["hub", "class"]).withColumn("gain", 2 * F.size("found") - F.col("d"))
    tops = held.groupBy("hub").agg(F.max("gain").alias("gain"), F.max("n").alias("n_most")).withColumnRenamed("gain", "top")
    tops = tops.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = held.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int")).join(tops, ["hub", "salt"]).drop("salt")
    # What the member and a similar set of the group can differ by.
    apart = part * (F.col("n") + F.least(F.col("n") / t, F.col("n_most")))
    least = F.when(F.col("close"), (F.col("most") - F.col("slack")) / per).otherwise(F.greatest(-(F.col("slack") + F.col("most")) / per, F.col("d") - apart))
    # A little less than the bounds, for the rounding of them.
    room = F.size("found") - F.greatest(F.ceil(least - 1e-6), F.lit(1)) + 1
    sized = held.where(F.col("d") - F.col("top") <= apart + 1e-6).withColumn("room", room).where("room > 0")
    return sized.select("hub", "class", "d", "close", F.explode(F.slice("found", 1, F.col("room").cast("int"))).alias("x")).select("hub", "class", "d", "close", F.col("x.element").alias("element"))


def _open(lists: DataFrame, joined: DataFrame) -> DataFrame:
    """The lists that still have several components and a member that isn't close, with components; ``first_component`` is that of the member with the smallest difference."""
    now = lists.join(joined, F.col("class") == F.col("node"), "left").withColumn("component", F.coalesce("component", "class")).drop("node")
    some = now.groupBy("hub", "element").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("close").alias("all_close"), F.min(F.struct("d", "class", "component")).alias("top"))
    return now.join(some.where("x <> y AND NOT all_close").select("hub", "element", F.col("top.component").alias("first_component")), ["hub", "element"])


def _apart() -> Column:
    """How many shingles only one of two members has, by their differences from the same core."""
    return F.size("delta_a") + F.size("delta_b") - 2 * F.size(F.array_intersect("delta_a", "delta_b"))


def _similar(percent: int) -> Column:
    n = F.col("n_a") + F.col("n_b")
    return 100 * (n - _apart()) >= percent * (n + _apart())


def _sides(centred: DataFrame) -> tuple[DataFrame, DataFrame]:
    own = {side: centred.select("hub", F.col("class").alias(f"class_{side}"), F.col("n").alias(f"n_{side}"), F.col("delta").alias(f"delta_{side}")) for side in "ab"}
    return own["a"], own["b"]


def _to_smallest(lists: DataFrame, centred: DataFrame, percent: int) -> DataFrame:
    """Links between each list's member with the smallest difference and its members of other components."""
    first = lists.groupBy("hub", "element").agg(F.min(F.struct("d", "class", "component", "close")).alias("x")).select("hub", "element", F.col("x.class").alias("class_a"), F.col("x.component").alias("component_a"), F.col("x.close").alias("close_a"))
    pairs = lists.join(first, ["hub", "element"]).where("component <> component_a AND NOT (close AND close_a)").select("hub", "class_a", F.col("class").alias("class_b")).distinct()
    one, two = _sides(centred)
    held = pairs.join(two, ["hub", "class_b"]).join(one, ["hub", "class_a"]).where(_similar(percent))
    return held.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct()


def _across(lists: DataFrame, centred: DataFrame, percent: int) -> DataFrame:
    """Links between any two members of a list in different components; the test runs inside the join.

    One of the two isn't in the component of the list's first member, so only such members are held against all.
    """
    one, two = _sides(centred)
    slim = {side: lists.select("hub", "element", *(F.col(x).alias(f"{x}_{side}") for x in ("class", "close", "component"))) for side in "ab"}
    outside = lists.where("component <> first_component").select("hub", "element", F.col("class").alias("class_a"))
    one, two = slim["a"].join(outside, ["hub", "element", "class_a"], "left_semi").join(one, ["hub", "class_a"]), slim["b"].join(two, ["hub", "class_b"])
    open_ = (F.col("component_a") != F.col("component_b")) & ~(F.col("close_a") & F.col("close_b"))
    pairs = one.join(two, (one["hub"] == two["hub"]) & (one["element"] == two["element"]) & open_ & _similar(percent))
    return pairs.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct()


def _with_sketches(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    one = sketches.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    two = sketches.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    return _likely(pairs.join(two, "b").join(one, "a"), percent)


def _far_pairs(lists: DataFrame, hubs: DataFrame, near: DataFrame, joined: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Likely pairs across components of a list where one of the two wasn't compared with the list's hub; no such list is long."""
    t = percent / 100
    least = t - 4.5 * math.sqrt(t * (1 - t) / SKETCH)
    known = near.select(F.col("a").alias("hub"), F.col("b").alias("class"), F.lit(True).alias("near"))
    now = lists.join(hubs, "value").join(known, ["hub", "class"], "left").join(joined, F.col("class") == F.col("node"), "left")
    # The hub itself was compared with all members by their sketches, so only its likely ones are near it.
    rows = now.select("value", "class", (F.coalesce("near", F.lit(False)) | (F.col("class") == F.col("hub"))).alias("near"), F.coalesce("component", "class").alias("component"))
    some = rows.groupBy("value").agg(F.min("near").alias("all_near"), F.min("component").alias("x"), F.max("component").alias("y")).where("NOT all_near AND x <> y").select("value")
    # Similar sets' sizes are in the same part or in neighbouring ones; the parts are a little wider than need be, for rounding.
    part = F.floor(F.log(F.col("n")) / (-1.001 * math.log(t))).cast("int")
    rows = rows.join(some, "value").join(sketches, "class").select("value", "class", "near", "component", "n", "sketch", part.alias("part"))
    one, two = (rows.select("value", "part", *(F.col(x).alias(f"{x}_{s}") for x in ("class", "near", "component", "n", "sketch"))) for s in "ab")
    one = one.where("NOT near_a").withColumn("part", F.explode(F.sequence(F.col("part") - 1, F.col("part") + 1)))
    sized = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    likely = (F.col("component_a") != F.col("component_b")) & (F.col("near_b") | (F.col("class_a") < F.col("class_b"))) & sized & _may_reach(F.col("sketch_a"), F.col("sketch_b"), least) & (estimate(F.col("sketch_a"), F.col("sketch_b")) >= least)
    met = one.join(two, (one["value"] == two["value"]) & (one["part"] == two["part"]) & likely)
    return met.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")).distinct()


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows whose near-duplicates have a smaller id; rows without an id stay.

    Of rows with the same id the one with the smallest text stays. All columns stay as they are.
    """
    space = Workspace(docs.sparkSession)
    gone = space.keep("gone", groups(docs, width, percent, space).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct())
    space.drop(*RESULT)
    left = docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
    repeated = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col("doc_id").alias("__id"))
    if not repeated.take(1):
        return left
    own = F.struct(*(F.col(f"`{c}`").alias(c) for c in docs.columns))
    order = F.struct(F.col("text"), F.xxhash64(*(f"`{c}`" for c, kind in docs.dtypes if "map<" not in kind)))
    many = left.join(repeated, left["doc_id"] == repeated["__id"], "left_semi").groupBy("doc_id").agg(F.min_by(own, order).alias("__row")).select("__row.*")
    return left.join(repeated, left["doc_id"] == repeated["__id"], "left_anti").unionByName(many)
