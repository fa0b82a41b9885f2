"""A corpus from raw documents to token ids, in stages that each write what they keep.

Every stage works on all rows that its predecessor kept. All but the last return the
columns of ``documents``, whatever other columns there are and whatever their names.

Cases, for all stages: an empty table gives an empty one; texts of any length are taken
whole; rows without an id and null or blank texts pass all stages (mixing may draw no copy
of them). A stage's own docstring says what it does with ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwright.llm import mixing, neardup, pieces, pii, toxicity
from loomwright.llm.queries import PIECE_MODEL
from loomwright.llm.storage import Workspace


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the limit; the model learns from those that came in.

    A null or blank text has the score of texts without words. Repeated rows stay or go alike. An
    id's labels count as toxic if one is; null labels don't count; without a toxic one all rows stay.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Rows of one id are one document, of which the row with the smallest text stays (null before any
    other, then by a hash of the row). Rows without an id and texts without words are no duplicates.
    """
    return neardup.keep_one(docs, width=5, percent=80)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind; a null text stays null.

    ``n_chars``, where there is one, follows the text. Repeated rows stay, and stay equal.
    """
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the weights of their sources and shuffled; copies keep their document's id.

    Repeated rows are repeated alike; rows without an id are drawn by their content. A null source is
    a source of its own.
    """
    return mixing.repeat(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, one row for each row; a null or empty text has none."""
    return pieces.encode_pieces(docs, pieces.Vocabulary.load(PIECE_MODEL))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: A trained model, sketches and piece merging aren't expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for ``documents``; each stage's rows are written to the shared folder first."""
    space = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = space.keep(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
