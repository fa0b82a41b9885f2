"""The solver against a plain one, on series that fall, rise, jump and fall very fast."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from loomwright.operators import decay


def squares(points, rate):
    """The least squares for a rate, at the best height."""
    f = [math.exp(-rate * i) for i, _ in points]
    height = sum(y * z for (_, y), z in zip(points, f)) / sum(z * z for z in f)
    return sum((y - height * z) ** 2 for (_, y), z in zip(points, f)), height


def plain(points, top=90.0):
    """A rate from 0 on with the least squares: the best of a grid, then thirds of its surroundings."""
    grid = [top * (k / 9000) ** 2 for k in range(9001)]
    best = min(range(len(grid)), key=lambda k: squares(points, grid[k])[0])
    low, high = grid[max(best - 1, 0)], grid[min(best + 1, 9000)]
    for _ in range(200):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if squares(points, a)[0] <= squares(points, b)[0] else (a, high)
    return (low + high) / 2


def series():
    rng = random.Random(5)
    out = []
    for _ in range(60):
        height, rate = rng.uniform(1, 100), rng.uniform(0.01, 3)
        out.append([(i, height * math.exp(-rate * i) * rng.uniform(0.8, 1.25)) for i in range(rng.randint(3, 8))])
    out += [[(i, 1.0 + i * rng.random()) for i in range(5)] for _ in range(10)]
    out += [[(0, 5.0), (1, 5.0), (2, 5.0)], [(1, 3.0), (2, 2.0), (4, 1.0)], [(0, 100.0), (1, 1.0), (2, 90.0), (3, 0.5)]]
    return out


def solved(spark, rows, **more):
    frame = spark.createDataFrame([(k, p) for k, p in enumerate(rows)], "k int, p array<struct<i:int,y:double>>")
    got = {r["k"]: r["x"] for r in frame.select("k", decay.solved("p", **more).alias("x")).collect()}
    return [got[k] for k in range(len(rows))]


def test_rates_are_those_of_a_plain_search(spark):
    rows = series()
    for points, x in zip(rows, solved(spark, rows)):
        best, height = squares(points, plain(points))
        cost = sum((y - x["e"] * math.exp(-x["l"] * i)) ** 2 for i, y in points)
        assert cost <= best * (1 + 1e-9) + 1e-18, points
        assert abs(x["e"] - height) <= 1e-4 * height


def test_rates_above_fifty_and_no_fall(spark):
    fast = [(i, 100 * math.exp(-63.0 * i)) for i in range(4)]
    rising = [(i, 1.0 + i) for i in range(4)]
    x, y = solved(spark, [fast, rising])
    assert abs(x["l"] - 63) < 1e-6 and abs(x["e"] - 100) < 1e-9
    assert (y["l"], round(y["e"], 12)) == (0.0, 2.5)


def test_a_search_without_an_end_fails(spark):
    rows = [[(i, 100 * math.exp(-9.0 * i)) for i in range(4)]]
    assert solved(spark, rows, evaluations=3) == [None]
    frame = spark.createDataFrame([(rows[0],)], "points array<struct<i:int,y:double>>")
    r = decay.with_fit(frame).select(*decay.rounded_record()).first()
    assert abs(r["lambda"] - 9) < 1e-4 and r["fit_quality"] == "excellent"
