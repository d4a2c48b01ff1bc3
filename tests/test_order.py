"""Global order and ranks over ranges against their window forms."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import tails
from plumbline.operators import groups
from plumbline.sources import scratch


def frame(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), float(rng.choice([1, 2, 2, 3, rng.randrange(50)]))) for i in range(500)]
    return spark.createDataFrame(rows, "id int, g string, v double")


def test_numbers_and_running_sums(spark):
    df, order = frame(spark), [F.col("v").desc(), F.col("id")]
    w = Window.orderBy(*order)
    want = {r["id"]: (r["n"], r["s"]) for r in df.withColumns({"n": F.row_number().over(w), "s": F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))}).collect()}
    assert {r["id"]: r["n"] for r in scratch.numbered(df, order, "n").collect()} == {k: n for k, (n, _) in want.items()}
    assert {r["id"]: r["s"] for r in scratch.running(df, order, {"s": F.col("v")}).collect()} == {k: s for k, (_, s) in want.items()}
    empty = df.where("id < 0")
    assert scratch.numbered(empty, order, "n").count() == 0 and scratch.running(empty, order, {"s": F.col("v")}).count() == 0


def test_spread_ranks_and_quantiles_equal_windows(spark):
    df = frame(spark)
    one, two = (sorted(map(str, tails.places(df, ["g"], "v", x).select("id", "midrank", "loo_percentile", "two_sided", "direction").collect())) for x in (False, True))
    assert one == two and len(one) == 500
    ps = {"a": 0.05, "b": 0.5, "c": 0.77}
    one, two = (sorted(map(str, tails.quantiles(df, ["g"], "v", ps, x).select("g", "n", *ps).collect())) for x in (False, True))
    assert one == two and len(one) == 3


def test_large_groups_give_the_same_evidence(spark):
    df = spark.createDataFrame([(i, i % 3, i % 2, float(i * 37 % 101)) for i in range(300)], "id int, a int, b int, v double")
    cols = ["id", "level", "n", "median", "q05", "q95", "mad", "midrank", "robust_z"]
    got = [sorted(map(str, groups.evidence(df, [["a", "b"], ["a"]], "v", 51, large).select(*cols).collect())) for large in (10, 10**6)]
    assert got[0] == got[1] and len(got[0]) == 300


@pytest.mark.parametrize("name", ["queue_order", "case_page", "ranking_metrics", "queue_tiers"])
def test_only_totals_of_partitions_are_ordered_in_one_task(spark, name):
    from plumbline.plans import catalog

    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    unpartitioned = [x for x in re.findall(r"windowspecdefinition\(([^,]+)", plan) if " ASC" in x or " DESC" in x]
    assert all(x.startswith("_part#") for x in unpartitioned) and (unpartitioned or name == "queue_tiers")
