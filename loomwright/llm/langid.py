"""Language identification in two steps: the language family first, then its languages one against one.

Both steps are linear support vector machines over the frequencies of hashed byte trigrams
of the lower-cased text. A family is told by one-versus-one votes between families, a
language by one-versus-one votes between the languages of that family. Models are trained
on a sample of labelled rows, bounded for each language, and are a table of weights for
each pair, so a text is scored by its trigrams' frequencies times these tables. Every
language that a usable row has is learned; the tables, and with them the work, grow with
the square of the number of families and of a family's languages.

Cases: a null text, or one without a letter, is ``und`` with score 0. With one learned
language every other text gets it, with score 1; with none all are ``und``. Languages that
the table of families doesn't have are a family of their own each. Empty tables give empty
results. Only the columns named are read, and predictions see only the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .storage import small_batches

#: Families of languages by ISO 639-1 codes.
FAMILIES = {
    "germanic": ("da", "de", "en", "is", "lb", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}
UNKNOWN = "und"
#: Weights are looked up by so many bits of a trigram's hash.
BITS = 12
#: Rows that a model is fitted on: so many, dealt evenly over the languages, but LANGUAGE_ROWS of each language at least
#: (or all it has), however many languages there are; and code points of each row, at most.
SAMPLE_ROWS = 3200
LANGUAGE_ROWS = 50
SAMPLE_CHARS = 40_000
#: Rows whose trigrams are counted together, and machines that are applied together, so that memory follows neither.
COUNTED = 256
APPLIED = 256

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, family string"


def family_of(language: str) -> str:
    return next((name for name, members in FAMILIES.items() if language in members), language)


def trigrams(data: np.ndarray) -> np.ndarray:
    """The hashed trigram that begins at each byte but the last two."""
    x = tb.LOWER[data].astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64)
    code = x[:-2] | (x[1:-1] << 8) | (x[2:] << 16)
    return ((code * np.uint32(2654435769)) >> np.uint32(32 - BITS)).astype(np.int64)


def frequencies(column: pa.Array) -> np.ndarray:
    """A row for each text: what part of its trigrams falls on each hash."""
    data, at = tb.buffers(column)
    out = np.zeros((len(at) - 1, 1 << BITS), np.float32)
    for k in range(len(at) - 1):
        t = trigrams(data[at[k] : at[k + 1]])
        if len(t):
            out[k] = np.bincount(t, minlength=1 << BITS) / len(t)
    return out


@dataclass
class Machine:
    """``weights`` over trigram hashes and ``bias``: above 0 for ``first``, below for ``second``."""

    first: str
    second: str
    weights: np.ndarray
    bias: float


def train_machine(x: np.ndarray, sign: np.ndarray, first: str, second: str, rounds: int = 12, strength: float = 1e-4, seed: int = 5) -> Machine:
    """A linear support vector machine by averaged subgradient steps over mini-batches (hinge loss, L2)."""
    rng = np.random.default_rng(seed)
    scale = np.float32(1 / max(float(np.sqrt((x * x).sum(1)).mean()), 1e-9))
    w, total, bias, bias_total, steps = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float64), 0.0, 0.0, 0
    # Both sides weigh the same, whatever their numbers of rows.
    weigh = np.where(sign > 0, 0.5 / max((sign > 0).mean(), 1e-9), 0.5 / max((sign < 0).mean(), 1e-9)).astype(np.float32)
    for turn in range(rounds):
        order = rng.permutation(len(x))
        for k in range(0, len(order), 64):
            rows = order[k : k + 64]
            near = sign[rows] * (x[rows] @ w * scale + bias) < 1
            rate = 1 / (1 + 0.05 * (turn * len(order) / 64 + k / 64))
            pull = (sign[rows] * weigh[rows] * near).astype(np.float32)
            w *= np.float32(1 - rate * strength)
            w += np.float32(rate) * scale * (pull @ x[rows]) / len(rows)
            bias += rate * 0.1 * float(pull.mean())
            if turn >= rounds // 2:
                total += w
                bias_total += bias
                steps += 1
    return Machine(first, second, (total / max(steps, 1) * scale).astype(np.float32), bias_total / max(steps, 1))


@dataclass
class Model:
    families: dict[str, list[str]]
    between_families: list[Machine]
    within: dict[str, list[Machine]]

    def machines(self) -> list[Machine]:
        return self.between_families + [m for name in sorted(self.within) for m in self.within[name]]


def train(x: np.ndarray, languages: list[str]) -> Model:
    labels = np.array(languages)
    families: dict[str, list[str]] = {}
    for language in sorted(set(languages)):
        families.setdefault(family_of(language), []).append(language)
    kin = np.array([family_of(v) for v in languages])

    def duel(names: np.ndarray, a: str, b: str) -> Machine:
        rows = np.flatnonzero((names == a) | (names == b))
        return train_machine(x[rows], np.where(names[rows] == a, 1.0, -1.0).astype(np.float32), a, b)

    return Model(families, [duel(kin, a, b) for a, b in combinations(sorted(families), 2)], {name: [duel(labels, a, b) for a, b in combinations(members, 2)] for name, members in families.items()})


def _winners(names: list[str], machines: list[Machine], margins: dict[int, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the name with most votes (by total margin where they tie), and how sure its closest duel is."""
    if len(names) == 1:
        return np.zeros(n, np.int64), np.ones(n)
    votes = np.zeros((n, len(names)))
    closest = np.full((n, len(names)), np.inf)
    for m in machines:
        margin, a, b = margins[id(m)], names.index(m.first), names.index(m.second)
        soft = 0.001 * np.tanh(margin)
        votes[:, a] += (margin >= 0) + soft
        votes[:, b] += (margin < 0) - soft
        closest[:, a] = np.minimum(closest[:, a], margin)
        closest[:, b] = np.minimum(closest[:, b], -margin)
    best = votes.argmax(1)
    return best, 1 / (1 + np.exp(-2 * closest[np.arange(n), best]))


def predict(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray, list[str | None]]:
    data, at = tb.buffers(column)
    n = len(at) - 1
    grams = trigrams(data)
    # Trigrams that begin in the last two bytes of a text would reach into the next one.
    inside = np.ones(len(grams) + 2, bool)
    for back in (1, 2):
        ends = at[1:] - back
        inside[ends[ends >= at[:-1]]] = False
    inside = inside[: len(grams)]
    names, machines = sorted(model.families), model.machines()
    language, score = np.full(n, UNKNOWN, object), np.zeros(n)
    for first in range(0, n if names else 0, COUNTED):
        rows = min(COUNTED, n - first)
        where = np.flatnonzero(inside[at[first] : at[first + rows]]) + at[first]
        text = np.searchsorted(at[first : first + rows + 1], where, "right") - 1
        x = np.bincount((text << BITS) + grams[where], minlength=rows << BITS).reshape(rows, 1 << BITS).astype(np.float32)
        x /= np.maximum(x.sum(1, keepdims=True), 1)
        margins = {}
        for k in range(0, len(machines), APPLIED):
            some = machines[k : k + APPLIED]
            margin = x @ np.stack([m.weights for m in some]).T + np.array([m.bias for m in some])
            margins |= {id(m): margin[:, j] for j, m in enumerate(some)}
        families, sure = _winners(names, model.between_families, margins, rows)
        for k, name in enumerate(names):
            members = model.families[name]
            best, own = _winners(members, model.within[name], margins, rows)
            here = np.flatnonzero(families == k)
            language[first + here] = np.array(members, object)[best[here]]
            score[first + here] = np.minimum(sure, own)[here]
    letters = tb.sums(tb.LETTER[data] & (data < 128), at) > 0
    for k in np.flatnonzero(~letters).tolist():
        if not any(c.isalpha() for c in bytes(data[at[k] : at[k + 1]]).decode()):
            language[k], score[k] = UNKNOWN, 0.0
    return language.tolist(), score, [None if v == UNKNOWN else family_of(v) for v in language]


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def quota(rows: int, languages: int) -> int:
    """Rows that are sampled of each language, at most."""
    return max(rows // max(languages, 1), LANGUAGE_ROWS)


def limit(wanted: int, n: int) -> int:
    """The 64-bit hash up to which about ``wanted`` of ``n`` rows lie; all rows if there are no more."""
    return (1 << 63) - 1 if wanted >= n else (wanted << 64) // n - (1 << 63)


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Labelled rows that aren't held out, of every language, by hashes of their ids: ``quota`` of each at most."""
    usable = docs.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    usable = usable.select("lang", "text", F.xxhash64("doc_id", F.lit("langid")).alias("hash"))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("first")).collect()
    if not counts:
        return usable.select("lang", "text").limit(0)
    most = quota(rows, len(counts))
    # A few more than are wanted pass by the hash alone; the smallest hashes of each language are taken from these.
    some = most + 6 * math.isqrt(most)
    limits = docs.sparkSession.createDataFrame([(r["lang"], max(r["first"], limit(some, r["n"]))) for r in counts], "lang string, limit long")
    chosen = usable.join(F.broadcast(limits), "lang").where("hash <= limit")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash", F.xxhash64("text")))
    return chosen.withColumn("place", place).where(F.col("place") <= most).select("lang", "text")


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model of the bounded sample; its rows come to the driver as frequencies of trigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = frequencies(part.column("text")).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    got = sorted(((r["lang"], bytes(r["x"])) for r in sample(docs, rows).mapInArrow(run, "lang string, x binary").collect()))
    x = np.array([np.frombuffer(v, np.float16) for _, v in got], np.float32).reshape(len(got), 1 << BITS)
    return train(x, [name for name, _ in got])


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The language of every whole text, one row for each row of ``docs``; without a model one is fitted on ``docs``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.parts(batches, "text"):
            language, score, family = predict(shipped.value, part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(language, pa.string()), pa.array(score, pa.float64()), pa.array(family, pa.string())], [x.split()[0] for x in SCHEMA.split(", ")])

    return small_batches(docs).select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(run, SCHEMA)
