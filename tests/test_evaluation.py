"""Injected errors and metrics on known rows."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import evaluation


def test_each_kind_alters_what_it_names(spark):
    rows = [(i, 1000.0 + 83 * i, "ab"[i % 2]) for i in range(80)] + [(None, 5.0, "a"), (100, None, "a"), (101, 7.0, None), (102, -3.0, "b")]
    df = spark.createDataFrame(rows, "id long, v double, c string")
    got = evaluation.inject(df, "id", "v", "c", per_kind=3).collect()
    was = {r[0]: r for r in rows}
    assert len(got) == len(rows) + 3
    count = {k: sum(r["error_type"] == k for r in got) for k in evaluation.KINDS}
    assert count.pop("duplicate_record") == 6 and count.pop("digit_transposition") <= 3 and set(count.values()) == {3}
    factor = {"scale_x10": 10, "scale_x12": 12, "scale_x100": 100, "scale_div10": 0.1}
    for r in got:
        _, v, c = was[r["id"]]
        kind = r["error_type"]
        assert (r["c"] != c) == (kind == "code_miscode")
        assert r["v"] == (pytest.approx(v * factor[kind], abs=0.51) if kind in factor else r["v"] if kind == "digit_transposition" else v)
        if kind == "digit_transposition":
            assert sorted(str(int(r["v"])).zfill(len(str(int(v))))) == sorted(str(int(v))) and abs(r["v"] - v) >= 0.2 * v
    assert all(r["error_type"] is None for r in got if r["id"] in (None, 100, 101, 102))


def test_inject_takes_an_empty_table(spark):
    assert evaluation.inject(spark.createDataFrame([], "id long, v double, c string"), "id", "v", "c").count() == 0


def test_metrics_on_known_ranks(spark):
    df = spark.createDataFrame([(i, i in (1, 4, 90), "x" if i < 50 else "y" if i < 95 else "z") for i in range(1, 101)], "i long, hit boolean, g string")
    at = {r["share"]: r for r in evaluation.at_shares(df, [F.col("i")], "hit").collect()}
    assert (at[0.01]["true_positives"], at[0.01]["precision"]) == (1, 1.0) and at[0.05]["true_positives"] == 2
    assert at[0.05]["f0_5"] == pytest.approx(1.25 * 0.4 * (2 / 3) / (0.25 * 0.4 + 2 / 3))
    by = {r["value"]: (r["injected"], r["recall"]) for r in evaluation.recall_by(df, [F.col("i")], "hit", ["g"]).collect()}
    assert by == {"x": (2, 1.0), "y": (1, 0.0), "z": (0, None)}
