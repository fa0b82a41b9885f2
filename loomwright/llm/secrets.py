"""Secret scans with a ledger of blobs: every version of a file is known by its content.

A version's text is addressed by its SHA-256. A ``Ledger`` is a folder with two tables: the
pairs of blob and rule version that have been scanned, with their findings, and the paths
with the blob that each version of them had. A scan takes only the pairs that aren't there
yet, once for each blob however many paths hold it, adds them to the folder, and joins the
findings back to all paths, new and old. DataFrame functions only.

Every scan adds a batch of its own; a batch counts once it is written whole, so a scan that
is lost halfway is as if it hadn't been. A batch that is written twice, or by two scans at
the same time, changes nothing: rows of the ledger are read once each.

The three base kinds follow fixed patterns and rules; ``pem`` and ``jwt`` are added.

Cases: a null text counts as the empty blob, which has no findings. Repeated rows give
repeated results, empty tables none; versions of a path that tie are all kept. Offsets are
code points, ends exclusive. Only the id and text columns are read, so others may have any
names; the text may be of any length.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spans import SPAN, each, only, places, quoted
from .storage import Workspace


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The group whose length counts, and the least length of it.
    group: int = 0
    least: int = 1
    #: Characters that every match has, to pass over most texts quickly.
    needs: str = ""
    base: bool = True


RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}+", needs="AKIA"),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}+"),
    Rule("pem", r"-----BEGIN\x20(?:[A-Z]++\x20)*+KEY-----", needs="-----BEGIN ", base=False),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", needs="eyJ", base=False),
)


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    """A name for these rules that changes whenever one of them does."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


FINDINGS = "array<struct<start:int,rank:int,end:int,kind:string>>"
LEDGER = f"blob binary, rules string, findings {FINDINGS}"
PATHS = "path string, version long, blob binary"


def address(text: Column) -> Column:
    """The blob that a text is: its SHA-256 in 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def find(text: Column | str, rules: tuple[Rule, ...] = RULES) -> Column:
    """All findings in a text, which is a column of a table or its name, by start and then in the order of the rules."""
    name = text if isinstance(text, str) else str(text).removeprefix("Column<'").removesuffix("'>")
    return F.expr("array_sort(concat(" + ", ".join(_found(f"`{name}`", rule, rank) for rank, rule in enumerate(rules)) + "))")


def _found(text: str, rule: Rule, rank: int) -> str:
    hits = places(text, rule.pattern, rule.group)
    if rule.needs:
        hits = f"CASE WHEN contains({text}, {quoted(rule.needs)}) THEN {hits} ELSE cast(array() as {SPAN}) END"
    good = only(hits, lambda s: f"length({s}.part) >= {rule.least}")
    return each(good, lambda s: f"named_struct('start', {s}.start, 'rank', {rank}, 'end', {s}.`end`, 'kind', {quoted(rule.kind)})")


def _of_rank(findings: Column, rank: int) -> Column:
    return F.filter(findings, lambda s: s["rank"] == rank)


def scan_new(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows of the blobs in ``docs`` that this version of the rules hasn't scanned yet, one for each blob."""
    blobs = docs.select(address(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rules") == rule_version(rules)).select("blob"), "blob", "left_anti")
    return blobs.dropDuplicates(["blob"]).select("blob", F.lit(rule_version(rules)).alias("rules"), find("text", rules).alias("findings"))


class Ledger:
    """A ledger in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _batches(self, table: str) -> list[str]:
        """The batches of a table that are written whole."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}/*/_SUCCESS")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(f.getPath().getParent().toString() for f in files or [])

    def _read(self, table: str, schema: str) -> DataFrame:
        batches = self._batches(table)
        return self.spark.read.schema(schema).parquet(*batches) if batches else self.spark.createDataFrame([], schema)

    def _add(self, table: str, rows: DataFrame) -> str:
        path = f"{self.folder}/{table}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def scanned(self) -> DataFrame:
        """``blob, rules, findings`` of every pair that has been scanned."""
        rows = self._read("scanned", LEDGER)
        # Only scans side by side can have added a pair twice.
        return rows.dropDuplicates(["blob", "rules"]) if len(self._batches("scanned")) > 1 else rows

    def paths(self) -> DataFrame:
        """``path, version, blob`` of every version that has been seen."""
        return self._read("paths", PATHS)

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scans what is new in ``versions`` (path, version, text) and returns the rows that were added to the ledger."""
        blobs = versions.select(F.col("path").cast("string"), F.col("version").cast("long"), address(F.col("text")).alias("blob"))
        before = self.scanned() if self._batches("scanned") else None
        added = self._add("scanned", scan_new(versions, before, rules))
        self._add("paths", blobs)
        return self.spark.read.schema(LEDGER).parquet(added)

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """``path, version, blob, findings`` of every version seen, whenever its blob was scanned."""
        return joined_back(self.paths(), self.scanned(), rules)


def joined_back(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``paths`` with ``findings`` of their blobs. Only blobs with findings are joined; the others have none.

    Both sides are read from tables, so a blob with very many paths is a skewed partition that
    Spark splits when it runs.
    """
    hits = ledger.where((F.col("rules") == rule_version(rules)) & (F.size("findings") > 0)).select("blob", "findings")
    return paths.join(hits, "blob", "left").withColumn("findings", F.coalesce("findings", F.array().cast(FINDINGS)))


def digest(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and spans of each row of ``docs``, after scanning what the ledger doesn't have; without one, a new one is made."""
    ledger = ledger or Ledger(docs.sparkSession, Workspace(docs.sparkSession).path)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ledger.scan(own.select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), "text"), rules)
    found = joined_back(own.select("doc_id", address(F.col("text")).alias("blob")), ledger.scanned(), rules)

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    n_base = sum(r.base for r in rules)
    base = F.filter("findings", lambda s: s["rank"] < n_base)
    counts = [F.size(_of_rank(F.col("findings"), k)).cast("long").alias("n_" + r.kind) for k, r in enumerate(rules) if r.base]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"), F.lower(F.hex("blob")).alias("blob_sha256"))
