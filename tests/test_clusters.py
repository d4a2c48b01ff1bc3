"""Near duplicates over whole tables, against brute force."""

import random
from itertools import combinations

import duckdb
import pytest

from plumbline.operators import clusters
from plumbline.plans import catalog

SF = "/root/testdata/sf0.01"


def test_every_supplier_is_compared(spark):
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    sql = catalog.ORACLES["near_duplicate_pairs"]
    got = sorted(map(tuple, catalog.QUERIES["near_duplicate_pairs"](spark, SF).collect()))
    assert got == sorted(con.sql(sql).fetchall()) and max(r[0] for r in got) > 20


@pytest.mark.parametrize(("common", "equal"), [(4, 0.95), (4, 0.7), (2, 0.6), (6, 0.8)])
def test_pairs_equal_brute_force(spark, common, equal):
    rng = random.Random(4)
    items = list("uvwxyz")
    rows = [(rng.choice([1, 2, None]), rng.choice([7, 8, 9, None]), i, *[rng.choice(["a", "a", "b", None]) for _ in items]) for i in range(120)]

    def near(a, b):
        both = [(x, y) for x, y in zip(a[3:], b[3:], strict=True) if x is not None and y is not None]
        return len(both) >= common and sum(x == y for x, y in both) >= equal * len(both)

    want = [(a[0], a[2], b[2]) for a, b in combinations(rows, 2) if a[0] is not None and a[0] == b[0] and a[1] is not None and b[1] is not None and a[1] != b[1] and near(a, b)]
    df = spark.createDataFrame(rows, "c int, p int, i int, " + ", ".join(f"{x} string" for x in items))
    assert sorted(map(tuple, clusters.near_pairs(df, "c", "p", "i", items, common, equal).collect())) == sorted(want)
