"""No task holds a whole domain, cell or table: read from the plans of a query and of the tables it writes on its way."""

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from plumbline.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture
def plans(spark, monkeypatch):
    """name -> physical plans, with joins broadcast only where the code says so."""
    seen, parquet = [], DataFrameWriter.parquet

    def write(self, *a, **b):
        seen.append(self._df)
        return parquet(self, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")

    def of(name):
        seen.clear()
        last = catalog.queries()[name](spark, SF)
        return [x._jdf.queryExecution().executedPlan().toString() for x in [*seen, last]]

    yield of
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.enabled")


def windows(plans):
    """(partition columns, order columns) of each window."""
    out = set()
    for spec in (x for p in plans for x in re.findall(r"windowspecdefinition\((.*?), specifiedwindowframe", p)):
        parts = spec.split(", ")
        out.add(tuple(tuple(re.findall(r"(\w+)#", x)[0] for x in parts if bool(re.search(" ASC| DESC", x)) == ordered) for ordered in (False, True)))
    return out


def sorted_by(plans):
    """Keys of the joins that sort both sides."""
    return {tuple(re.findall(r"(\w+)#", x)) for p in plans for x in re.findall(r"SortMergeJoin \[([^\]]*)\]", p)}


def exchanged(plans):
    return {tuple(re.findall(r"(\w+)#", x)) for p in plans for x in re.findall(r"Exchange hashpartitioning\(([^)]*)", p)}


@pytest.mark.parametrize("name", ["median_woodruff", "weighted_quantile"])
def test_no_task_sums_the_weights_of_a_domain(plans, name):
    assert all("_part" in by + order for by, order in windows(plans(name)))


def test_impacts_meet_their_domain_without_a_sort(plans):
    assert ("l_returnflag",) not in sorted_by(plans("value_impact"))


def test_psus_meet_before_levels_and_indicators_multiply_them(plans, monkeypatch):
    monkeypatch.setattr("plumbline.plans.areas.ROWS_A_TASK", 1_000)
    keys = exchanged(plans("area_estimates"))
    assert ("flag", "period", "p_brand", "l_suppkey") in keys and not any({"area_level", "l_suppkey"} <= set(k) for k in keys)


def test_estimates_are_made_once_for_their_changes(plans):
    assert sum(len(re.findall(r"Scan parquet.*lineitem", p)) for p in plans("area_changes")) == 1 and not any("lineitem" in p or "rows-" in p for p in plans("area_changes")[-1:])


def test_changes_are_made_once_for_both_seasons(plans):
    assert not any("lag(" in p for p in plans("known_events")[-1:])


def test_digest_deals_rows_to_as_many_tasks_as_read_them(spark, plans):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        (n,) = {int(x) for p in plans("content_digest") for x in re.findall(r"hashpartitioning\(l_suppkey#\d+L?, (\d+)\)", p)}
        assert n >= catalog.table(spark, SF, "lineitem").rdd.getNumPartitions() > 7
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("name", ["mann_whitney_u", "duration_u", "over_dispersion", "cluster_p_values"])
def test_no_task_ranks_a_cell(plans, name):
    assert all("_part" in by + order or "l_suppkey" in by for by, order in windows(plans(name)))


def test_nulls_are_equal_and_last_among_ranks(spark):
    from plumbline.operators import clusters

    rows = [("a", i % 2, v) for i, v in enumerate([3.0, None, 1.0, 3.0, 5.0, 2.0])] + [(None, 7, 1.0)]
    got = {(r["c"], r["k"]): (r["n1"], r["n2"], r["u1"]) for r in clusters.rank_sums(spark.createDataFrame(rows, "c string, k int, v double"), ["c"], "k", "v").collect()}
    assert got == {("a", 0): (3, 3, 3.5 + 1 + 5 - 6), ("a", 1): (3, 3, 6 + 3.5 + 2 - 6), (None, 7): (1, 0, 0.0)}


@pytest.mark.parametrize("name", ["same_season_tail", "conformal_tail"])
def test_no_task_orders_all_of_a_group(plans, name):
    assert all("_q" in by + order for by, order in windows(plans(name)))


def test_history_is_moved_once_whatever_the_lags(plans):
    last = plans("history_tail_probability")[-1]
    (at,) = (i for i, x in enumerate(last.splitlines()) if re.search(r"Exchange hashpartitioning\(l_returnflag#\d+, l_linestatus#\d+, p_brand#\d+, _q#", x))
    assert "Generate explode" in "\n".join(last.splitlines()[:at])


def test_tails_over_many_ranges_equal_counts(spark, monkeypatch):
    import random

    from plumbline.functions import tails

    monkeypatch.setattr(tails, "RANGE", 7)
    monkeypatch.setattr(tails, "TASK", 20)
    rng = random.Random(5)
    rows = [(i, rng.choice("abc") if i else None, rng.randrange(6), rng.choice([None, float("inf"), -3.0, rng.gauss(0, 1), float(rng.randrange(4))])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, g string, t int, v double")

    def want(v, refs):
        n, ge, le = len(refs), sum(x >= v for x in refs), sum(x <= v for x in refs)
        return n, round((ge + 1) / (n + 1), 9), round((le + 1) / (n + 1), 9)

    got = {r["id"]: (r["n"], r["upper"] and round(r["upper"], 9), r["lower"] and round(r["lower"], 9)) for r in tails.earlier(df, ["g"], "t", [1, 3], "v").collect()}
    refs = {i: [x for _, h, u, x in rows if h == g and t - u in (1, 3) and x is not None] for i, g, t, _ in rows}
    assert got == {i: want(v, refs[i]) if v is not None else (len(refs[i]), None, None) for i, _, _, v in rows}
    got = {r["id"]: (r["n"], round(r["upper"], 9), round(r["lower"], 9)) for r in tails.out_of_sample(df.where("t > 2 and v is not null"), df.where("t <= 2").select("g", "v"), ["g"], "v").collect()}
    assert got == {i: want(v, [x for _, h, u, x in rows if h == g and u <= 2 and x is not None]) for i, g, t, v in rows if t > 2 and v is not None}


def test_a_sample_is_ranked_from_few_rows_before_it_is_sent(spark, monkeypatch):
    from plumbline.operators import models
    from plumbline.sources import scratch

    sizes = []
    monkeypatch.setattr(models, "written", lambda df, tag: [sizes.append((tag, (out := scratch.written(df, tag)).count())), out][1])
    df = spark.range(20_000).selectExpr("cast(id as string) id", "id * 2 as x").repartition(16)
    got = models.sampled(df, "id", 500)
    want = sorted(range(20_000), key=lambda i: __import__("hashlib").sha256(str(i).encode()).digest()[:8])[:500]
    assert list(got["id"]) == list(map(str, want))
    assert [t for t, _ in sizes] == ["candidates", "sample"] and sizes[0][1] < 700 and sizes[1][1] == 500
    same = spark.createDataFrame([("a", i) for i in range(50)] + [(None, 7)], "id string, x int")
    assert len(models.sampled(same, "id", 10)) == 10


def test_rows_meet_their_cells_start_without_a_sort(plans):
    assert ("l_returnflag",) not in sorted_by(plans("reduced_spread"))
