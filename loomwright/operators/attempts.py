"""How often each further attempt solves what is left.

An attempt log has one row for each task: ``model``, ``attempt`` (index of the last
attempt) and ``status``. One aggregation per group gives the count of rows and the passes
of each attempt; all that follows is arithmetic on that one small row, without another
shuffle, join or window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import rounded

#: The last attempt's index, and the status that counts.
LAST_ATTEMPT = 5
PASS = "pass"


def passes(log: DataFrame, keys: tuple[str, ...] = ("model",), last: int = LAST_ATTEMPT) -> DataFrame:
    """Each group's rows ``total`` and, in ``s``, the passes of every attempt up to ``last``."""
    passed = F.col("status") == PASS
    counts = [F.count(F.when(passed & (F.col("attempt") == i), 1)).alias(f"s{i}") for i in range(last + 1)]
    return log.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *counts).select(*keys, "total", F.array(*(f"s{i}" for i in range(last + 1))).alias("s"))


def left_before(s: Column, total: Column, i: Column) -> Column:
    return total - F.aggregate(F.slice(s, 1, i), F.lit(0).cast("long"), lambda a, x: a + x)


def hazards(counted: DataFrame) -> DataFrame:
    """With ``steps``: for every attempt i its passes S, the tasks N left before it, and I = S / N (0 if none is left)."""

    def step(s: Column, i: Column) -> Column:
        n = left_before(F.col("s"), F.col("total"), i)
        ratio = F.when(n > 0, s.cast("double") / n).otherwise(F.lit(0.0))
        return F.struct(i.alias("i"), s.alias("S_i"), n.alias("N_i"), ratio.alias("I_i"), rounded(ratio * 100.0).alias("pct"))

    return counted.withColumn("steps", F.transform("s", step))


def influence(log: DataFrame, keys: tuple[str, ...] = ("model",), last: int = LAST_ATTEMPT) -> DataFrame:
    """One row for each group and attempt: ``i, S_i, N_i, I_i, pct``."""
    return hazards(passes(log, keys, last)).select(*keys, F.explode("steps").alias("x")).select(*keys, "x.*")


def effectiveness(steps: Column) -> Column:
    """Percentages by the keys E_0, D_1, D_2, ..., of attempts that had tasks left."""
    kept = F.filter(steps, lambda x: x["N_i"] > 0)
    return F.map_from_entries(F.transform(kept, lambda x: F.struct(F.when(x["i"] == 0, "E_0").otherwise(F.concat(F.lit("D_"), x["i"].cast("string"))).alias("k"), x["pct"].alias("v"))))


def points(norm: Column) -> Column:
    """The numbered values of an effectiveness map in order, other keys ignored."""
    own = F.filter(F.map_entries(norm), lambda e: e["key"].rlike("^[ED]_[0-9]+$"))
    return F.array_sort(F.transform(own, lambda e: F.struct(F.split(e["key"], "_")[1].cast("int").alias("i"), e["value"].alias("y"))))


def overall(counted: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    solved = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x)
    rate = solved.cast("double") / F.col("total")
    return counted.select(*keys, F.col("total").alias("total_problems"), solved.alias("total_solved"), rounded(rate, 9).alias("overall_success_rate"), rounded(rate * 100.0).alias("A_phi"))


def summary_lines(steps: Column) -> Column:
    """One line of text for every attempt that had tasks left."""
    kept = F.filter(steps, lambda x: x["N_i"] > 0)
    return F.transform(kept, lambda x: F.format_string("Attempt %d: %d/%d = %.4f (%.2f%%)", x["i"], x["S_i"], x["N_i"], rounded(x["I_i"]), rounded(x["I_i"] * 100.0, 2)))
