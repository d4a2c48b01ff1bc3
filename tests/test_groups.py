"""Rows with a missing dimension back off to a coarser group and stay members of it."""

from plumbline.operators import groups

LEVELS = [["a", "b"], ["a"]]


def test_null_dimension_backs_off(spark):
    rows = [(i, "x", "y", float(i)) for i in range(3)] + [(3, "x", None, 3.0), (4, None, "y", 4.0)]
    df = spark.createDataFrame(rows, "id int, a string, b string, v double")
    got = {r["id"]: (r["level"], r["group_size"]) for r in groups.assign(df, LEVELS, 3).collect()}
    assert got == {0: (0, 3), 1: (0, 3), 2: (0, 3), 3: (1, 4), 4: (None, None)}
    assert {r["id"]: (r["level"], r["n"]) for r in groups.evidence(df, LEVELS, "v", 3).collect()} == {0: (0, 3), 1: (0, 3), 2: (0, 3), 3: (1, 4)}
    assert {(r["level"], r["group_size"]) for r in groups.issued(groups.assign(df, LEVELS, 3), LEVELS).collect()} == {(0, 3), (1, 4)}
