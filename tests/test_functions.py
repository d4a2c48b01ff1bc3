import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import special, tails, values
from plumbline.operators import fuse, groups, rules


def test_loo_tails_closed_form(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)], "g string, v double")
    got = {r["v"]: r for r in tails.places(df, ["g"], "v").collect()}
    assert got[100.0]["upper"] == pytest.approx(0.2) and got[100.0]["two_sided"] == pytest.approx(0.4) and got[100.0]["loo_percentile"] == 1.0 and got[100.0]["direction"] == "HIGH"
    assert got[3.0]["two_sided"] == 1.0


def test_zero_mad_and_quantiles(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 1.0, 1.0, 5.0)], "g string, v double")
    got = {(r["v"], r["mad_status"], r["robust_z"]) for r in tails.robust(df, ["g"], "v").collect()}
    assert got == {(1.0, "OK", 0.0), (5.0, "ZERO_MAD", None)}
    q = tails.quantiles(df, ["g"], "v", {"q": 0.75}).first()
    assert q["q"] == pytest.approx(2.0)


def test_finite_and_month(spark):
    df = spark.createDataFrame([(x,) for x in ("1.5", "1d", "NaN", "Infinity", " 2 ", "", None)], "x string")
    assert [r[0] for r in df.select(values.finite(F.col("x"))).collect()] == [1.5, None, None, None, 2.0, None, None]
    months = spark.createDataFrame([(x,) for x in ("01", "1.0", "2.5", "x")], "x string")
    assert [r[0] for r in months.select(values.month(F.col("x"))).collect()] == ["1", "1", "2.5", "x"]


def test_special_tails():
    assert special.norm_sf(1.959963984540054) == pytest.approx(0.025)
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert special.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05)
    assert special.binom_sf(8, 10, 0.5) == pytest.approx(56 / 1024)


def test_bh_monotone(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate((0.01, 0.02, 0.03, 0.5, None))], "i int, p double").withColumn("f", F.lit(1))
    q = {r["i"]: r["q"] for r in tails.bh(df, ["f"], "p", ["i"]).collect()}
    assert q[0] == q[1] == q[2] == pytest.approx(0.04) and q[3] == 0.5 and q[4] is None


def test_backoff_level(spark):
    rows = [("s", "x", f"e{i}") for i in range(3)]
    got = groups.assign(spark.createDataFrame(rows, "a string, b string, c string"), [["a", "b", "c"], ["a", "b"]], 3).collect()
    assert {(r["level"], r["group_size"]) for r in got} == {(1, 3)}


def test_rule_self_test(spark):
    rule = {"id": "R", "type": "range", "column": "age", "min": 0, "max": 120, "tests": [{"record": {"age": "130"}, "expect": "violates"}, {"record": {"age": ""}, "expect": "passes"}]}
    assert rules.self_test(spark, rule)


def test_tiers_respect_budget_and_cap(spark):
    rows = [(i, i % 2, 0.001 * (i + 1), None, False, False) for i in range(10)]
    df = spark.createDataFrame(rows, "case_id long, cluster long, p double, coding_p double, hard boolean, soft boolean")
    got = {r["case_id"]: (r["tier"], r["reason"]) for r in fuse.tiers(df, budget=3, threshold=0.01, cap=1).collect()}
    assert [k for k, v in got.items() if v[0] == "A"] == [0, 1] and got[2] == ("B", "CAP")


def test_sidak(spark):
    p = spark.range(1).select(tails.sidak(F.lit(0.1), F.lit(2))).first()[0]
    assert math.isclose(p, 0.19)
