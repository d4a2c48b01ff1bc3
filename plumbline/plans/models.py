"""Model queries. They have no SQL but the legacy baseline; tests check their properties and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import models
from plumbline.plans.catalog import query
from plumbline.plans.roles import CASES, cases, records, table


def _rows(spark, d):
    r = records(spark, d).withColumn("year", F.year("l_shipdate"))
    return r.select(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate").alias("row_id"), "year", "l_suppkey", "l_quantity", "l_discount", "p_size", "p_type", "o_orderpriority", "l_extendedprice")


@query()
def gbt_expected_value(spark, d):
    """Each year by trees fitted on earlier years, the first by the other half of its clusters, with conformal p-values and range."""
    done, _ = models.expected_values(_rows(spark, d), "row_id", "year", "l_extendedprice", ["l_quantity", "l_discount", "p_size"], ["p_type", "o_orderpriority"], "l_suppkey", keep=["row_id", "year", "l_extendedprice"])
    return done.select("row_id", "year", "l_extendedprice", F.round("expected", 2).alias("expected"), F.round("lo", 2).alias("lo"), F.round("hi", 2).alias("hi"), F.round("p_model", 6).alias("p_model"), "n_calibration")


@query()
def model_registry(spark, d):
    """A row a fitted model: its scheme, period, rows and parameters."""
    _, registry = models.expected_values(_rows(spark, d), "row_id", "year", "l_extendedprice", ["l_quantity", "p_size"], [], "l_suppkey", s=models.Trees(iterations=10))
    rows = [(int(r["period"]), r["half"], r["scheme"], int(r["fitted_rows"]), r.get("trees"), r["rate"], r["depth"]) for r in registry]
    return spark.createDataFrame(rows, "period int, half int, scheme string, rows int, trees int, rate double, depth int")


@query()
def isolation_forest(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus", F.dayofyear("o_orderdate").cast("double").alias("day"))
    return models.isolation_forest(t, "o_orderkey", ["o_totalprice", "day"], ["o_orderpriority", "o_orderstatus"]).select("o_orderkey", F.round("score", 6).alias("score"))


@query()
def peer_lof(spark, d):
    return models.peer_lof(table(spark, d, "orders").withColumn("day", F.dayofyear("o_orderdate")), "o_orderkey", ["o_orderpriority", "o_orderstatus"], ["o_totalprice", "day"]).select("o_orderkey", F.round("score", 6).alias("score"), "reason")


@query(f"""WITH {CASES}, r AS (SELECT case_id, CASE WHEN coding_p IS NOT NULL THEN 1 - coding_p END AS r2, 1 - p AS r1, 1 + impact / (max(impact) OVER (PARTITION BY state)) AS influence FROM cases)
SELECT case_id, round((CASE WHEN greatest(r1, coalesce(r2, 0)) >= 0.99 THEN greatest(r1, coalesce(r2, 0)) ELSE (0.7 * r1 + coalesce(0.3 * r2, 0)) / (0.7 + CASE WHEN r2 IS NOT NULL THEN 0.3 ELSE 0 END) END) * influence, 6) AS legacy_score FROM r""")
def legacy_baseline(spark, d):
    c = cases(spark, d).withColumns({"r1": 1 - F.col("p"), "r2": 1 - F.col("coding_p"), "influence": 1 + F.col("impact") / F.max("impact").over(Window.partitionBy("state"))})
    return models.legacy_score(c, {"r1": 0.7, "r2": 0.3}, "influence").select("case_id", F.round("legacy_score", 6).alias("legacy_score"))
