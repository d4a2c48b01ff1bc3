"""Preparation and checks of deliveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import values
from plumbline.operators import groups
from plumbline.plans.catalog import query
from plumbline.plans.roles import table
from plumbline.sources import checks, delivery
from plumbline.sources.scratch import numbered


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) + 1 AS source_row, 'R' || year(o_orderdate) AS release, CASE WHEN trim(o_orderpriority) = '' THEN 'incomplete' ELSE 'complete' END AS key_status, lpad((o_custkey % 36)::VARCHAR, 2, '0') AS area FROM orders")
def context_columns(spark, d):
    o = numbered(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"), [F.col("o_orderkey")], "source_row")
    status = F.when(values.all_present([F.col("o_orderpriority")]), "complete").otherwise("incomplete")
    return o.select("o_orderkey", (F.col("source_row") + 1).alias("source_row"), F.concat(F.lit("R"), F.year("o_orderdate")).alias("release"), status.alias("key_status"), F.lpad((F.col("o_custkey") % 36).cast("string"), 2, "0").alias("area"))


@query("""WITH e AS (SELECT *, l_linestatus = 'O' AS ready, l_quantity >= 3 AS valid FROM lineitem), n AS (SELECT l_returnflag, l_suppkey, l_linenumber, count(*) AS n FROM e WHERE ready AND valid GROUP BY ALL)
SELECT e.l_orderkey, e.l_linenumber, CASE WHEN NOT ready THEN 'PREPARED_RECORD_NOT_READY' WHEN NOT valid THEN 'TARGET_VALUE_MISSING_OR_INVALID' WHEN n.n < 30 THEN 'NO_CONFIGURED_GROUP_MEETS_MINIMUM' END AS reason FROM e LEFT JOIN n ON ready AND valid AND e.l_returnflag = n.l_returnflag AND e.l_suppkey = n.l_suppkey AND e.l_linenumber = n.l_linenumber""")
def assessability_reason(spark, d):
    t = table(spark, d, "lineitem").withColumns({"ready": F.col("l_linestatus") == "O", "valid": F.col("l_quantity") >= 3})
    return groups.reasons(t, [["l_returnflag", "l_suppkey", "l_linenumber"]], F.col("ready"), F.col("valid")).select("l_orderkey", "l_linenumber", "reason")


@query("SELECT p_partkey FROM part WHERE trim(p_brand) <> '' AND trim(p_type) <> '' AND p_size % 7 <> 0")
def complete_context(spark, d):
    p = table(spark, d, "part").withColumn("size", F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("string")).otherwise(""))
    return groups.complete(p, ["p_brand", "p_type", "size"]).select("p_partkey")


@query("SELECT 'region' AS field, count(DISTINCT r_regionkey - r_regionkey) AS n_values, true AS homogeneous FROM region UNION ALL SELECT 'status', count(DISTINCT o_orderstatus), count(DISTINCT o_orderstatus) = 1 FROM orders")
def boundary_homogeneity(spark, d):
    one = checks.homogeneity(table(spark, d, "region").withColumn("region", F.col("r_regionkey") - F.col("r_regionkey")), ["region"])
    return one.unionByName(checks.homogeneity(table(spark, d, "orders").withColumnRenamed("o_orderstatus", "status"), ["status"]))


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def unknown_ids(spark, d):
    return table(spark, d, "lineitem").select("l_partkey").distinct().join(table(spark, d, "part").where("p_size <= 25"), F.col("l_partkey") == F.col("p_partkey"), "left_anti")


@query("WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) <= 1997), b AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) > 1997) SELECT count(*) AS n, count(*) FILTER (o_custkey IN (SELECT o_custkey FROM a)) AS n_overlap, round(avg((o_custkey IN (SELECT o_custkey FROM a))::INT), 6) AS share FROM b")
def delivery_overlap(spark, d):
    """Ids are compared by keyed hash, so deliveries can be compared without their ids."""
    o = table(spark, d, "orders")
    keyed = lambda df: df.select(values.hmac_sha256(F.col("o_custkey").cast("string"), "key of the deployment").alias("id")).distinct()
    return checks.overlap(keyed(o.where(F.year("o_orderdate") > 1997)), keyed(o.where(F.year("o_orderdate") <= 1997)), "id").select("n", "n_overlap", F.round("share", 6).alias("share"))


@query("""WITH k AS (SELECT count(*) AS n_rows, count(*) FILTER (trim(o_orderpriority) = '') AS n_blank, count(*) - count(DISTINCT o_orderkey) AS n_repeated FROM orders), c AS (SELECT avg((l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0))::INT) AS matched FROM lineitem)
SELECT n_rows, n_blank, n_repeated, round(1 - matched, 6) AS orphan_share, CASE WHEN 1 - matched > 0.5 THEN 'BLOCKED' WHEN n_blank + n_repeated > 0 OR matched < 1 THEN 'WARNING' ELSE 'PASSED' END AS verdict FROM k, c""")
def preflight(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    return checks.preflight(o.withColumn("key", F.col("o_orderkey")), ["o_orderpriority"], "key", l, "l_orderkey", o.where("o_orderkey % 3 <> 0").withColumn("key", F.col("o_orderkey"))).withColumn("orphan_share", F.round("orphan_share", 6))


@query("WITH r AS (SELECT o_orderkey AS id, 'R1' AS release, o_totalprice AS amount FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'R2', o_totalprice FROM orders WHERE o_orderkey % 2 = 1) SELECT release, count(*) AS n, round(sum(amount), 2) AS amount FROM r GROUP BY 1")
def multi_release(spark, d):
    o = table(spark, d, "orders")
    first = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("ORDER_NO"), F.col("o_totalprice").alias("AMT"), F.lit("x").alias("unused"))
    second = o.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("Ord_Id"), F.col("o_totalprice").alias("Amount"))
    every = delivery.load_releases({"R1": (first, {"id": "ORDER_NO", "amount": "AMT"}), "R2": (second, {"id": "Ord_Id", "amount": "Amount"})}, ["id", "amount"])
    return every.groupBy("release").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) SELECT o_custkey, o_orderkey AS run FROM r WHERE k = 1 AND o_orderstatus = 'F'")
def run_resolution(spark, d):
    """The latest run of each input, if it is complete."""
    runs = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("made"), F.col("o_orderstatus").alias("status"))
    return checks.latest_run(runs, ["o_custkey"], ["made", "run"]).where("status = 'F'").select("o_custkey", "run")


@query("SELECT 'lineitem' AS name, count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS n_ids, count(*) = count(DISTINCT (l_orderkey, l_linenumber)) AS unique_ids FROM lineitem UNION ALL SELECT 'orders', count(*), count(DISTINCT o_orderkey), count(*) = count(DISTINCT o_orderkey) FROM orders")
def run_integrity(spark, d):
    return checks.unique_ids(table(spark, d, "lineitem"), "lineitem", ["l_orderkey", "l_linenumber"]).unionByName(checks.unique_ids(table(spark, d, "orders"), "orders", ["o_orderkey"]))


@query("SELECT count(*) AS n_rows, true AS same_content, false AS same_as_changed FROM lineitem")
def content_digest(spark, d):
    """The table's digest against those of its rows in other partitions (as many as it is read in at least) and with one supplier's tax altered."""
    t = table(spark, d, "lineitem")
    parts = max(7, t.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    one, two, other = (delivery.content_digest(x) for x in (t, t.repartition(parts, "l_suppkey"), t.withColumn("l_tax", F.col("l_tax") + F.when(F.col("l_suppkey") == 1, 0.01).otherwise(0))))
    both = one.select("n_rows", F.col("digest").alias("a")).join(two.select(F.col("digest").alias("b"))).join(other.select(F.col("digest").alias("c")))
    return both.select("n_rows", (F.col("a") == F.col("b")).alias("same_content"), (F.col("a") == F.col("c")).alias("same_as_changed"))


@query("SELECT row_number() OVER (ORDER BY column_index)::INTEGER AS position, column_name FROM duckdb_columns() WHERE table_name = 'lineitem'")
def footer_columns(spark, d):
    """Names from the Parquet footers alone: no row is read."""
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(table(spark, d, "lineitem").columns)], "position int, column_name string")


@query("SELECT o_orderkey FROM (SELECT *, md5(concat_ws('|', o_custkey::VARCHAR, o_orderstatus, o_orderpriority, year(o_orderdate)::VARCHAR)) AS h FROM orders) QUALIFY count(*) OVER (PARTITION BY h) > 1")
def full_row_duplicates(spark, d):
    """Rows equal to another in every field but their id."""
    from pyspark.sql import Window

    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    return o.withColumn("n", F.count("*").over(Window.partitionBy("o_custkey", "o_orderstatus", "o_orderpriority", "y"))).where("n > 1").select("o_orderkey")


@query("SELECT to_timestamp(floor(epoch(ts) / 900) * 900)::TIMESTAMP AS slot_start, count(*) AS n FROM events GROUP BY 1")
def event_slots(spark, d):
    from plumbline.streaming import drops

    return drops.slots(table(spark, d, "events"), "ts", 15)
