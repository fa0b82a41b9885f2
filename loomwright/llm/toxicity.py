"""Toxic spans by a linear-chain conditional random field over the words of a text.

Words are runs of letters in lower case. Each has two states, clean and toxic; what speaks
for one of them are weights of the word's hash and of the hashes of its proper prefixes,
and transitions tie neighbours together. Forward-backward marginals give each word's
probability; they are summed up to a score of the document, and words that are toxic more
likely than not, joined where they are neighbours, are its offending spans.

Labels are of documents. Words of a toxic document are labelled toxic where one of their
features occurs in toxic documents far more often than in others; the field is trained on
these labelled words, and a logistic model of the marginals' sums is fitted to the
documents' labels. Training takes a bounded sample of labelled rows that aren't held out;
toxic ones get a quarter of it at least, as far as there are so many, and the documents'
model is corrected for that.

Cases: a null text, or one without a letter, has no words and gets the score of such texts.
Labels that are null or missing aren't used; an id with several labels is toxic if one of
them is; of an id with several texts the smallest one is learned from. If no toxic row is
among the labelled, every score is near 0. Repeated rows give repeated results, empty tables
none. Only the columns named are read, so others may have any names, and scores see only the
text. Very long texts are scored whole; their chains go in segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .storage import small_batches

BITS = 18
#: Lengths, in bytes, of the proper prefixes that are features; the word itself is one as well.
PREFIXES = (4, 5, 6, 7, 8, 9)
#: Labelled rows that the model is fitted on, at most, and code points of each.
SAMPLE_ROWS = 6000
SAMPLE_CHARS = 20_000
#: A feature marks words as toxic if so many toxic documents have it, and so many times as often as others.
LEAST_DOCS, LEAST_RATIO = 5, 24.0
#: Bytes of texts that are scored at a time.
SCORED = 1 << 22
#: From this score on a document counts as toxic.
TOXIC = 0.7

SCHEMA = "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int>>"


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the capital letters from À to Þ."""
    out = tb.LOWER[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


@dataclass
class Words:
    """The words of some texts: features (a row for each), where each text's begin, and their places in bytes."""

    features: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray


def words_of(column: pa.Array) -> Words:
    data, at = tb.buffers(column)
    low = lowered(data)
    run = tb.Spans(data, at, tb.LETTER[data])
    hasher = tb.Hasher(low)
    length = run.end - run.start
    # The last slot of the weights is always 0: it stands for prefixes that a word doesn't have.
    features = np.full((len(run.start), 1 + len(PREFIXES)), 1 << BITS, np.int32)
    shift = np.uint64(64 - BITS)
    features[:, 0] = hasher(run.start, run.end) >> shift
    for k, size in enumerate(PREFIXES, 1):
        long = np.flatnonzero(length > size)
        features[long, k] = tb.mix(hasher(run.start[long], run.start[long] + size) + np.uint64(k)) >> shift
    return Words(features, run.at, run.start, run.end)


def words_by_slices(column: pa.Array) -> Words:
    """The same, slice by slice, so that little more than the features is held; the words' places are left out."""
    parts = [x.column("text") for x in tb.slices(pa.RecordBatch.from_arrays([column], ["text"]), "text")]
    sizes = [tb.Spans(data, at, tb.LETTER[data]).per_text() for data, at in map(tb.buffers, parts)]
    at = np.concatenate([[0], np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int64)]))]).astype(np.int64)
    features, k = np.empty((int(at[-1]), 1 + len(PREFIXES)), np.int32), 0
    for part in parts:
        more = words_of(part).features
        features[k : k + len(more)] = more
        k += len(more)
    none = np.zeros(0, np.int64)
    return Words(features, at, none, none)


@dataclass
class Field:
    """Weights for toxic over clean, log weights of transitions (from, to) and of the first state; the documents' model."""

    weights: np.ndarray
    bias: float
    moves: np.ndarray
    first: np.ndarray
    document: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        total = np.full(len(features), self.bias, np.float32)
        for k in range(features.shape[1]):
            total += self.weights[features[:, k]]
        return total


#: Words of a chain that go one after the other; longer chains are cut into such segments, which go side by side.
SEGMENT = 512


def _segments(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the segments of all chains begin (one more entry at the end), which are a chain's first and which its last."""
    size = np.diff(at)
    count = -(-size // SEGMENT)
    first = np.cumsum(count) - count
    inner = np.arange(int(count.sum())) - np.repeat(first, count)
    begin = np.repeat(at[:-1], count) + inner * SEGMENT
    return np.append(begin, at[-1]), inner == 0, inner == np.repeat(count, count) - 1


def _products(odds: np.ndarray, at: np.ndarray, which: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Of these segments, the product of the steps' matrices (transition, then the word's odds), up to a factor."""
    start, size = at[which], at[which + 1] - at[which]
    m = np.zeros((2, 2, len(which)))
    m[0, 0] = m[1, 1] = 1
    order = np.argsort(-size, kind="stable")
    start, ranked = start[order], -size[order]
    for k, n in enumerate(np.searchsorted(ranked, -np.arange(int(size.max(initial=0))), "left")):
        clean = m[:, 0, :n] * t[0, 0] + m[:, 1, :n] * t[1, 0]
        toxic = (m[:, 0, :n] * t[0, 1] + m[:, 1, :n] * t[1, 1]) * odds[start[:n] + k]
        total = (clean + toxic).sum(0)
        m[:, 0, :n], m[:, 1, :n] = clean / total, toxic / total
    out = np.empty_like(m)
    out[:, :, order] = m
    return out


def forward_backward(emission: np.ndarray, at: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised forward and backward weights (two columns) of every word.

    All chains go step by step side by side. A long one goes in segments: the product of a segment's
    matrices carries the weights across it, so that every segment can begin with the right ones.
    """
    odds = np.exp(np.clip(emission, -25, 25)).astype(np.float64)
    t, f = np.exp(moves), np.exp(first)
    at, is_first, is_last = _segments(at)
    n_segments = len(at) - 1
    # What enters a segment from before and from behind; a chain's first word has weights of its own.
    enter, leave = np.ones((2, n_segments)), np.ones((2, n_segments))
    if not is_first.all():
        many = np.flatnonzero(~(is_first & is_last))
        product = _products(odds, at, many, t)
        p = np.ones(2)
        for k, s in enumerate(many.tolist()):
            m = product[:, :, k]
            if is_first[s]:
                p = _start(odds, at[s], at[s + 1], t, f)
            else:
                enter[:, s] = p
                p = p @ m
                p = p / p.sum()
        b = np.ones(2)
        for k, s in reversed(list(enumerate(many.tolist()))):
            if is_last[s]:
                b = np.ones(2)
            leave[:, s] = b
            b = product[:, :, k] @ b
            b = b / b.sum()
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    start, ranked = at[:-1][order], -size[order]
    longest = int(size.max(initial=0))
    active = np.searchsorted(ranked, -np.arange(longest), "left")
    ahead, back = np.ones((2, len(emission))), np.ones((2, len(emission)))
    p0, p1 = enter[0][order], enter[1][order]
    opening = is_first[order]
    for k in range(longest):
        n = active[k]
        here = start[:n] + k
        q0, q1 = p0[:n] * t[0, 0] + p1[:n] * t[1, 0], p0[:n] * t[0, 1] + p1[:n] * t[1, 1]
        if k == 0:
            q0, q1 = np.where(opening[:n], f[0], q0), np.where(opening[:n], f[1], q1)
        q1 = q1 * odds[here]
        total = q0 + q1
        p0, p1 = q0 / total, q1 / total
        ahead[0, here], ahead[1, here] = p0, p1
    b0, b1 = leave[0][order], leave[1][order]
    ends = start + size[order] - 1
    filled = size[order] > 0
    back[0, ends[filled]], back[1, ends[filled]] = b0[filled], b1[filled]
    for k in range(longest - 2, -1, -1):
        n = active[k + 1]
        after = start[:n] + k + 1
        toxic = odds[after] * b1[:n]
        c0, c1 = t[0, 0] * b0[:n] + t[0, 1] * toxic, t[1, 0] * b0[:n] + t[1, 1] * toxic
        total = c0 + c1
        b0[:n], b1[:n] = c0 / total, c1 / total
        back[0, after - 1], back[1, after - 1] = b0[:n], b1[:n]
    return ahead, back


def _start(odds: np.ndarray, begin: int, end: int, t: np.ndarray, f: np.ndarray) -> np.ndarray:
    """The weights after a chain's first segment."""
    p0, p1 = f[0], f[1] * odds[begin]
    for x in odds[begin + 1 : end].tolist():
        p0, p1 = p0 * t[0, 0] + p1 * t[1, 0], (p0 * t[0, 1] + p1 * t[1, 1]) * x
        total = p0 + p1
        p0, p1 = p0 / total, p1 / total
    total = p0 + p1
    return np.array([p0 / total, p1 / total])


def marginals(field: Field, features: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each word's probability of being toxic."""
    a, b = forward_backward(field.emissions(features), at, field.moves, field.first)
    toxic = a[1] * b[1]
    return toxic / (toxic + a[0] * b[0])


def summed(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What the documents' model sees: expected toxic words, words above one half, the largest probability, and 1."""
    n = len(at) - 1
    most = np.zeros(n)
    filled = np.diff(at) > 0
    if filled.any():
        most[filled] = np.maximum.reduceat(p, at[:-1][filled])
    return np.stack([np.log1p(tb.sums(p.astype(np.float64), at)), np.log1p(tb.sums(p > 0.5, at)), most, np.ones(n)], 1)


def label_words(words: Words, toxic: np.ndarray) -> np.ndarray:
    """Of each word, whether it counts as toxic by its document's label and its features' counts of documents."""
    doc = np.repeat(np.arange(len(toxic)), np.diff(words.at))
    label = np.zeros(len(doc), bool)
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    for k in range(words.features.shape[1]):
        pair = words.features[:, k].astype(np.int64)
        pair *= len(toxic)
        pair += doc
        pair.sort()
        first = np.ones(len(pair), bool)
        first[1:] = pair[1:] != pair[:-1]
        pair = pair[first]
        of = toxic[pair % len(toxic)]
        pair //= len(toxic)
        d1, d0 = (np.bincount(pair[x], minlength=(1 << BITS) + 1) for x in (of, ~of))
        telling = (d1 >= LEAST_DOCS) & ((d1 + 0.5) / (n1 + 1) >= LEAST_RATIO * (d0 + 0.5) / (n0 + 1))
        telling[-1] = False
        label |= telling[words.features[:, k]]
    label &= toxic[doc]
    return label


def train(words: Words, toxic: np.ndarray, rounds: int = 6, batch: int = 400, rate: float = 0.8, ridge: float = 1e-4, seed: int = 3) -> Field:
    """Fits the field to labelled words by adaptive gradient steps on their conditional likelihood, then the documents' model."""
    label = label_words(words, toxic)
    # Pairs of neighbouring words by their labels; a document's first word follows none.
    pair = label[:-1] * 2 + label[1:]
    heads = words.at[:-1][np.diff(words.at) > 0]
    counts = (1 + np.bincount(pair, minlength=4) - np.bincount(pair[heads[heads > 0] - 1], minlength=4)).reshape(2, 2).astype(float)
    del pair
    field = Field(np.zeros((1 << BITS) + 1, np.float32), 0.0, np.log(counts / counts.sum(1, keepdims=True)), np.log(np.array([0.99, 0.01])), np.zeros(4))
    seen, seen_moves, seen_bias = np.full((1 << BITS) + 1, 1e-6), np.full((2, 2), 1e-6), 1e-6
    rng = np.random.default_rng(seed)
    for _ in range(rounds if label.any() else 0):
        order = rng.permutation(len(toxic))
        for k in range(0, len(order), batch):
            docs = order[k : k + batch]
            size = np.diff(words.at)[docs]
            rows = np.repeat(words.at[docs] - np.cumsum(size) + size, size) + np.arange(size.sum())
            at = np.concatenate([[0], np.cumsum(size)])
            features, y = words.features[rows], label[rows]
            emission = field.emissions(features)
            a, b = forward_backward(emission, at, field.moves, field.first)
            p = a[1] * b[1] / (a[1] * b[1] + a[0] * b[0])
            miss = y - p
            flat = features.ravel().astype(np.int64)
            grad = np.bincount(flat, np.repeat(miss, features.shape[1]), minlength=(1 << BITS) + 1) - ridge * len(docs) * field.weights
            seen += grad * grad
            field.weights += (rate * grad / np.sqrt(seen)).astype(np.float32)
            field.weights[-1] = 0
            seen_bias += float(miss.sum()) ** 2
            field.bias += rate * float(miss.sum()) / seen_bias**0.5
            inner = np.setdiff1d(np.arange(len(rows)), at[:-1])
            odds = np.exp(np.clip(emission[inner], -25, 25))
            joint = np.exp(field.moves)[:, :, None] * a[:, None, inner - 1] * b[None, :, inner]
            joint[:, 1] *= odds
            joint /= joint.sum((0, 1))
            seen_pairs = np.zeros((2, 2))
            np.add.at(seen_pairs, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
            step = seen_pairs - joint.sum(2)
            seen_moves += step * step
            field.moves += rate * 0.3 * step / np.sqrt(seen_moves)
    x = np.concatenate([summed(marginals(field, words.features[words.at[k] : words.at[m]], at := words.at[k : m + 1] - words.at[k]), at) for k in range(0, len(toxic), batch) for m in [min(k + batch, len(toxic))]] or [np.zeros((0, 4))])
    field.document = _logistic(x, toxic.astype(np.float64))
    return field


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Newton steps for a logistic model with a small ridge on all but the constant."""
    w = np.zeros(x.shape[1])
    hold = ridge * np.diag([1.0] * (x.shape[1] - 1) + [1e-3])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (y - p) - hold @ w)
    return w


def score_texts(field: Field, column: pa.Array, with_spans: bool = True) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """The score of each text and its offending spans in code points. Weights are looked up slice by slice, the chains of all texts run together."""
    emission, sizes, places, base = [], [], [], 0
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    for part in tb.slices(batch, "text"):
        data, _ = tb.buffers(part.column("text"))
        words = words_of(part.column("text"))
        emission.append(field.emissions(words.features))
        sizes.append(np.diff(words.at))
        if with_spans:
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]).astype(np.int64)
            places.append(np.stack([points[words.start], points[words.end]]) + base)
            base += int(points[-1])
    if not emission:
        return np.zeros(0), []
    flat, at = np.concatenate(emission), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    a, b = forward_backward(flat, at, field.moves, field.first)
    p = a[1] * b[1] / (a[1] * b[1] + a[0] * b[0])
    score = 1 / (1 + np.exp(-(summed(p, at) @ field.document)))
    spans: list[list[tuple[int, int]]] = [[] for _ in range(len(score))]
    if with_spans:
        start, end = np.concatenate(places, 1)
        lengths = np.array([len(x.as_py() or "") for x in column], np.int64)
        text_at = np.cumsum(lengths) - lengths
        for k in np.flatnonzero(p > 0.5).tolist():
            text = int(np.searchsorted(at, k, "right")) - 1
            s, e = int(start[k] - text_at[text]), int(end[k] - text_at[text])
            mine = spans[text]
            if mine and k and p[k - 1] > 0.5 and at[text] <= k - 1:
                mine[-1] = (mine[-1][0], e)
            else:
                mine.append((s, e))
    return score, spans


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def quotas(toxic: int, clean: int, rows: int) -> tuple[int, int]:
    """How many toxic and how many clean rows are learned from: their shares, but a quarter of toxic ones if there are so many."""
    if toxic + clean <= rows:
        return toxic, clean
    some = max(rows * toxic // (toxic + clean), min(toxic, rows // 4))
    return some, min(clean, rows - some)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Field:
    """A model of a bounded sample of the labelled rows that aren't held out, chosen by hashes of their ids.

    Chosen rows whose texts are longer than ``SAMPLE_CHARS`` or that ``docs`` doesn't have are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = counts.get(True, 0), counts.get(False, 0)
    order = (F.xxhash64("doc_id", F.lit("toxicity")), "doc_id")
    some = [known.where(F.col("toxic") == flag).orderBy(*order).limit(n) for flag, n in zip((True, False), quotas(n1, n0, rows))]
    # The sample is bounded by ``rows``, so every executor can have it.
    chosen = F.broadcast(some[0].unionByName(some[1]).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= SAMPLE_CHARS)
    got = own.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toArrow()
    got = got.take(pa.array(np.argsort(got.column("doc_id").to_numpy(), kind="stable")))
    texts, toxic = got.column("text").combine_chunks(), got.column("toxic").to_numpy()
    texts = texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    words = words_by_slices(texts)
    del got, texts
    field = train(words, toxic)
    del words
    tb.release()
    s1, s0 = int(toxic.sum()), int((~toxic).sum())
    if s1 and s0:
        field.document[-1] += np.log(n1 / n0) - np.log(s1 / s0)
    return field


def score_documents(docs: DataFrame, field: Field, with_spans: bool = True) -> DataFrame:
    """Score, verdict and offending spans of every whole text, one row for each row of ``docs``."""
    shipped = docs.sparkSession.sparkContext.broadcast(field)
    kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.parts(batches, "text", SCORED):
            score, spans = score_texts(shipped.value, part.column("text"), with_spans)
            listed = pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], kinds)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= TOXIC).astype(np.int32)), listed], [x.split()[0] for x in SCHEMA.split(", ")])

    return small_batches(docs).select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(run, SCHEMA)


def drop_toxic(docs: DataFrame, field: Field, least: float = TOXIC) -> DataFrame:
    """``docs`` without the rows whose text scores ``least`` or more; all columns stay as they are."""
    shipped = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.parts(batches, "text", SCORED):
            score, _ = score_texts(shipped.value, part.column("text"), False)
            yield part.filter(pa.array(score < least))

    return small_batches(docs).mapInArrow(run, docs.schema)
