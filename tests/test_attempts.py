from __future__ import annotations

import math

from pyspark.sql import functions as F

from loomwright.operators import attempts, decay


def _golden(spark):
    rows = [("m", 0, "pass")] * 5 + [("m", 1, "pass")] * 2 + [("m", 2, "pass")] + [("m", 5, "fail")] * 2
    return spark.createDataFrame(rows, "model string, attempt int, status string")


def test_golden_case(spark):
    rows = sorted(attempts.influence(_golden(spark)).collect(), key=lambda r: r["i"])
    assert [(r["S_i"], r["N_i"], r["pct"]) for r in rows] == [(5, 10, 50.0), (2, 5, 40.0), (1, 3, 33.3333), (0, 2, 0.0), (0, 2, 0.0), (0, 2, 0.0)]
    counted = attempts.hazards(attempts.passes(_golden(spark)))
    assert attempts.overall(counted).first()["A_phi"] == 80.0
    lines = counted.select(attempts.summary_lines(F.col("steps")).alias("x")).first()["x"]
    assert lines[2] == "Attempt 2: 1/3 = 0.3333 (33.33%)"


def test_golden_fit(spark):
    counted = attempts.hazards(attempts.passes(_golden(spark))).withColumn("points", attempts.points(attempts.effectiveness(F.col("steps"))))
    r = decay.with_fit(counted).withColumn("t", decay.thresholds(F.col("lambda"))).first()
    assert math.isclose(r["fitted_E_0"], 49.7823, abs_tol=1e-3) and math.isclose(r["lambda"], 0.2055, abs_tol=1e-4)
    assert math.isclose(r["r_squared"], 0.99687, abs_tol=1e-4) and r["fit_quality"] == "excellent"
    assert [x["t_theta_ceiling"] for x in r["t"]] == [4, 8, 12, 15, 23]


def test_few_points_have_no_rate(spark):
    rows = [("all", 0, "pass")] * 3 + [("two", 0, "pass"), ("two", 1, "pass"), ("two", 5, "fail"), ("no", 0, "PASS")]
    log = spark.createDataFrame(rows, "model string, attempt int, status string")
    counted = attempts.hazards(attempts.passes(log)).withColumn("norm", attempts.effectiveness(F.col("steps")))
    got = {r["model"]: r for r in decay.with_fit(counted.withColumn("points", attempts.points(F.col("norm")))).withColumn("t", decay.thresholds(F.col("lambda"))).collect()}
    assert got["all"]["norm"] == {"E_0": 100.0} and got["all"]["fitted_E_0"] == 100.0
    for r in got.values():
        assert r["lambda"] is None and r["fit_quality"] == "N/A" and r["t"] == []
    assert got["no"]["norm"]["E_0"] == 0.0


def test_rising_values_have_no_decay(spark):
    frame = spark.sql("SELECT array(struct(0 AS i, 10.0D AS y), struct(1 AS i, 20.0D AS y), struct(2 AS i, 30.0D AS y)) AS points")
    r = decay.with_fit(frame).withColumn("t", decay.thresholds(F.col("lambda"))).first()
    assert r["lambda"] == 0.0 and all(x["t_theta"] is None for x in r["t"])


def test_quality_boundaries(spark):
    rows = spark.sql("SELECT * FROM VALUES (0.9D), (0.7D), (0.91D), (NULL) AS t(r)").select(decay.quality(F.col("r"))).collect()
    assert [r[0] for r in rows] == ["good", "poor", "excellent", "N/A"]
