"""Registered queries and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import special, tails, values
from plumbline.operators import audit, clusters, fuse, groups, rules, survey
from plumbline.plans.roles import CASES, RECORDS, cases, records, table
from plumbline.sources.scratch import running

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LEVELS = [["l_returnflag", "l_linestatus", "p_brand", "o_orderpriority"], ["l_returnflag", "l_linestatus", "p_brand"], ["l_returnflag", "l_linestatus"]]
CELL = ["l_returnflag", "l_linestatus"]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def r6(c: str):
    return F.round(c, 6).alias(c)


# Preparation


@query("SELECT o_orderkey, concat_ws('|', trim(o_orderpriority), o_custkey::VARCHAR, o_orderkey::VARCHAR) AS record_key FROM orders")
def prepare_keys(spark, d):
    return table(spark, d, "orders").select("o_orderkey", values.composite_key([F.col("o_orderpriority"), F.col("o_custkey"), F.col("o_orderkey")]).alias("record_key"))


@query("""WITH t AS (SELECT o_orderkey, month(o_orderdate) AS m, CASE o_orderkey % 4 WHEN 0 THEN lpad(month(o_orderdate)::VARCHAR, 2, '0') WHEN 1 THEN month(o_orderdate) || '.0' WHEN 2 THEN month(o_orderdate) || '.5' ELSE 'x' || month(o_orderdate) END AS raw FROM orders)
SELECT o_orderkey, raw, CASE WHEN o_orderkey % 4 < 2 THEN m::VARCHAR ELSE raw END AS month FROM t""")
def month_normalise(spark, d):
    m, k = F.month("o_orderdate").cast("string"), F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.lpad(m, 2, "0")).when(k == 1, F.concat(m, F.lit(".0"))).when(k == 2, F.concat(m, F.lit(".5"))).otherwise(F.concat(F.lit("x"), m))
    return table(spark, d, "orders").select("o_orderkey", raw.alias("raw")).withColumn("month", values.month(F.col("raw")))


@query("""SELECT p_partkey, CASE WHEN length(p_partkey::VARCHAR) = 3 THEN substr(p_partkey::VARCHAR, 1, 1) WHEN length(p_partkey::VARCHAR) IN (4, 5) THEN substr(p_partkey::VARCHAR, 1, 2) WHEN length(p_partkey::VARCHAR) <= 2 THEN lpad(p_partkey::VARCHAR, 2, '0') ELSE '' END AS major FROM part""")
def context_dimensions(spark, d):
    return table(spark, d, "part").select("p_partkey", values.major_group(F.col("p_partkey")).alias("major"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'APPLICABLE' WHEN 'P' THEN 'ZERO_BY_DEFINITION' ELSE 'NOT_APPLICABLE' END AS applicability FROM orders")
def applicability(spark, d):
    return table(spark, d, "orders").select("o_orderkey", values.applicability(F.col("o_orderstatus"), ["F"], ["P"]).alias("applicability"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN year(l_shipdate) >= 1998 THEN l_quantity / 100 WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = l_suppkey % 7 THEN l_quantity / 100 ELSE l_quantity / 200 END, 6) AS weight FROM lineitem""")
def final_weight(spark, d):
    nss = F.when(F.col("l_linenumber") != 7, F.col("l_linenumber"))
    w = values.final_weight(F.col("l_quantity"), nss, F.col("l_suppkey") % 7, F.year("l_shipdate") >= 1998)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(w, 6).alias("weight"))


@query("SELECT o_orderkey, (year(o_orderdate) * 4 + quarter(o_orderdate))::INTEGER AS period_index, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS label FROM orders")
def period_index(spark, d):
    return table(spark, d, "orders").select("o_orderkey", values.quarter_index(F.col("o_orderdate")).alias("period_index"), F.concat(F.year("o_orderdate"), F.lit("-Q"), F.quarter("o_orderdate")).alias("label"))


FIELDS = ["l_discount", "l_tax", "l_returnflag"]


@query("""SELECT field, sum((v = '')::INT)::BIGINT AS n_blank, coalesce(sum((try_cast(v AS DOUBLE) = 0)::INT), 0)::BIGINT AS n_zero, count(*) AS n FROM (
SELECT 'l_discount' AS field, coalesce(l_discount::VARCHAR, '') AS v FROM lineitem UNION ALL SELECT 'l_tax', coalesce(l_tax::VARCHAR, '') FROM lineitem UNION ALL SELECT 'l_returnflag', CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END FROM lineitem) GROUP BY field""")
def missingness_profile(spark, d):
    t = table(spark, d, "lineitem").select("l_discount", "l_tax", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("l_returnflag"))
    long = t.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), values.clean(F.col(c)).alias("v")) for c in FIELDS])).alias("x")).select("x.*")
    return long.groupBy("field").agg(F.count_if(F.col("v") == "").alias("n_blank"), F.count_if(F.coalesce(values.finite(F.col("v")) == 0, F.lit(False))).alias("n_zero"), F.count("*").alias("n"))


@query("""WITH bad AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events WHERE event_type NOT IN ('click', 'view'))
SELECT event_type AS code, event_id, 1::BIGINT AS n FROM bad WHERE r <= 5 UNION ALL SELECT event_type || '_ADDITIONAL', NULL, count(*) FROM bad WHERE r > 5 GROUP BY event_type""")
def invalid_codes(spark, d):
    bad = table(spark, d, "events").where(~F.col("event_type").isin("click", "view")).withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")))
    shown = bad.where("r <= 5").select(F.col("event_type").alias("code"), "event_id", F.lit(1).cast("long").alias("n"))
    more = bad.where("r > 5").groupBy(F.concat("event_type", F.lit("_ADDITIONAL")).alias("code")).agg(F.count("*").alias("n")).withColumn("event_id", F.lit(None).cast("long"))
    return shown.unionByName(more)


@query("""WITH s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1)
SELECT c_custkey, CASE WHEN c_nationkey IS NULL THEN 'not_assessable' WHEN n IS NULL THEN 'unmatched' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS link_status FROM customer LEFT JOIN s ON c_nationkey = k""")
def link_status(spark, d):
    n = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    status = F.when(F.col("c_nationkey").isNull(), "not_assessable").when(F.col("n").isNull(), "unmatched").when(F.col("n") == 1, "matched").otherwise("ambiguous")
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("k"), "left").select("c_custkey", status.alias("link_status"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT c_custkey, 'pg_' || substr(sha256(concat_ws('|', c_mktsegment, c_nationkey::VARCHAR)), 1, 24) AS group_id FROM customer")
def stable_hash_id(spark, d):
    return table(spark, d, "customer").select("c_custkey", values.hash_id("pg_", F.col("c_mktsegment"), F.col("c_nationkey")).alias("group_id"))


@query("SELECT c_custkey, (list_reduce(list_transform(range(1, 17), lambda i: (instr('0123456789abcdef', substr(sha256(c_custkey::VARCHAR), i, 1)) - 1)::HUGEINT), lambda a, b: a * 16 + b) % 5)::INTEGER AS bucket FROM customer")
def stable_hash_bucket(spark, d):
    return table(spark, d, "customer").select("c_custkey", values.hash_bucket(F.col("c_custkey"), 5).alias("bucket"))


# Rules

LINE, ORDER = ["l_orderkey", "l_linenumber"], ["o_orderkey"]


def rule_query(name: str, rule: dict, frame: Callable[[SparkSession, str], DataFrame], unit: list[str], sql: str) -> None:
    def run(spark, d):
        return rules.evaluate(frame(spark, d), [rule | {"id": name}], unit).select(*unit)

    QUERIES[name], ORACLES[name] = run, sql


_line, _order = (lambda s, d: table(s, d, "lineitem")), (lambda s, d: table(s, d, "orders"))
rule_query("rule_unique", {"type": "unique", "fields": LINE}, _line, LINE, "SELECT l_orderkey, l_linenumber FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1")
rule_query("rule_allowed_values", {"type": "allowed_values", "column": "l_returnflag", "values": ["A", "N"]}, _line, LINE, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE trim(l_returnflag) <> '' AND l_returnflag NOT IN ('A', 'N')")
rule_query("rule_range", {"type": "range", "column": "l_quantity", "min": 5, "max": 45, "when": {"l_linestatus": {"in": ["F"]}}}, _line, LINE, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F' AND (l_quantity < 5 OR l_quantity > 45)")
_blank = lambda s, d: table(s, d, "lineitem").withColumn("note", F.when(F.col("l_suppkey") % 3 == 0, "x"))
rule_query("rule_required_when", {"type": "required_when", "column": "note", "when": {"l_returnflag": {"in": ["R"]}}}, _blank, LINE, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey % 3 <> 0")
rule_query("rule_absent_when", {"type": "absent_when", "column": "note", "when": {"l_returnflag": {"not_in": ["R"]}}}, _blank, LINE, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE trim(l_returnflag) NOT IN ('', 'R') AND l_suppkey % 3 = 0")
rule_query("rule_value_when", {"type": "value_when", "column": "l_linestatus", "values": ["F"], "when": {"l_quantity": {"min": 48}}}, _line, LINE, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 48 AND l_linestatus <> 'F'")
rule_query("rule_not_value_when", {"type": "not_value_when", "column": "l_linenumber", "values": ["3"], "when": {"l_quantity": {"max": 2}}}, _line, LINE, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity <= 2 AND l_linenumber = 3")
rule_query("rule_arithmetic", {"type": "arithmetic", "target": "l_linenumber", "terms": [{"column": "l_quantity", "factor": 0.1}], "tolerance": 2}, _line, LINE, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_linenumber - l_quantity * 0.1::DOUBLE) > 2 + 1e-9")
rule_query("rule_lower_bound_sum", {"type": "lower_bound_sum", "target": "l_quantity", "terms": [{"column": "l_linenumber", "factor": 2.0}]}, _line, LINE, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE coalesce(l_quantity, 0) < l_linenumber * 2.0 - 1e-9")
_kids = lambda s, d: rules.child_counts(table(s, d, "orders"), table(s, d, "lineitem"), "o_orderkey", "l_orderkey", {"n_lines": F.lit(True), "n_first": F.col("l_linenumber") == 1}).withColumn("declared", F.col("o_orderkey") % 7 + 1)
_KIDS = "WITH k AS (SELECT l_orderkey, count(*) AS n_lines, sum((l_linenumber = 1)::INT) AS n_first FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey, coalesce(n_lines, 0) AS n_lines, coalesce(n_first, 0) AS n_first FROM orders LEFT JOIN k ON o_orderkey = l_orderkey) "
rule_query("rule_exists_exactly", {"type": "exists_exactly", "count": "n_first", "value": 1}, _kids, ORDER, _KIDS + "SELECT o_orderkey FROM o WHERE n_first <> 1")
rule_query("rule_count_matches", {"type": "count_matches", "count": "n_lines", "declared": "declared"}, _kids, ORDER, _KIDS + "SELECT o_orderkey FROM o WHERE n_lines <> o_orderkey % 7 + 1")
_dated = lambda s, d: table(s, d, "orders").withColumns({"survey_date": F.date_format("o_orderdate", "ddMMyyyy"), "q": F.pmod(F.col("o_orderkey"), F.lit(4)).cast("string")})
_MONTHS = {str(q): [f"{3 * q + i + 1:02d}" for i in range(3)] for q in range(4)}
rule_query("rule_within_period", {"type": "within_period", "column": "survey_date", "period": "q", "months": _MONTHS}, _dated, ORDER, "SELECT o_orderkey FROM orders WHERE quarter(o_orderdate) - 1 <> o_orderkey % 4")


_coded = lambda s, d: table(s, d, "lineitem").withColumn("code", F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("0"), F.col("l_linenumber"))).otherwise(F.col("l_linenumber").cast("string")))
_CODED = "WITH c AS (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN '0' ELSE '' END || l_linenumber AS code FROM lineitem) SELECT l_orderkey, l_linenumber FROM c WHERE "
rule_query("rule_code_as_text", {"type": "value_when", "column": "code", "values": ["1", "3", "06"], "when": {"code": {"not_in": ["05", "2"]}}}, _coded, LINE, _CODED + "code NOT IN ('05', '2') AND code NOT IN ('1', '3', '06')")
rule_query("rule_code_as_number", {"type": "value_when", "column": "code", "values": [1, 3, 6], "when": {"l_quantity": {"min": 10}}}, _coded, LINE, _CODED + "l_quantity >= 10 AND l_linenumber NOT IN (1, 3, 6)")


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)")
def rule_references(spark, d):
    codes = table(spark, d, "nation").where("n_regionkey <> 2").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("c"))
    return rules.references(table(spark, d, "customer").withColumn("c", F.col("c_nationkey").cast("string")), codes, ["c"], ["c_custkey"])


@query("""SELECT 'flag' AS rule_id, true AS applicable, count(*) AS n_units FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag NOT IN ('A', 'N'))
UNION ALL SELECT 'missing', false, 0""")
def rule_dry_run(spark, d):
    return rules.dry_run(table(spark, d, "lineitem"), [{"id": "flag", "type": "allowed_values", "column": "l_returnflag", "values": ["A", "N"]}, {"id": "missing", "type": "range", "column": "nowhere", "min": 0}], LINE)


# Groups and distributions

_SIZES = RECORDS + """, sized AS (
  SELECT *, count(*) OVER (PARTITION BY l_returnflag, l_linestatus, p_brand, o_orderpriority) AS n0, count(*) OVER (PARTITION BY l_returnflag, l_linestatus, p_brand) AS n1, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n2 FROM records),
assigned AS (SELECT *, CASE WHEN n0 >= 30 THEN 0 WHEN n1 >= 30 THEN 1 WHEN n2 >= 30 THEN 2 END AS level, CASE WHEN n0 >= 30 THEN n0 WHEN n1 >= 30 THEN n1 WHEN n2 >= 30 THEN n2 END AS group_size FROM sized)"""


@query(f"WITH {_SIZES} SELECT l_orderkey, l_linenumber, level, group_size FROM assigned")
def peer_assignments(spark, d):
    return groups.assign(records(spark, d), LEVELS).select("l_orderkey", "l_linenumber", "level", "group_size")


@query(f"""WITH {_SIZES}, g AS (SELECT DISTINCT level, group_size, CASE level WHEN 0 THEN concat_ws('|', l_returnflag, l_linestatus, p_brand, o_orderpriority) WHEN 1 THEN concat_ws('|', l_returnflag, l_linestatus, p_brand) ELSE concat_ws('|', l_returnflag, l_linestatus) END AS group_values FROM assigned WHERE level IS NOT NULL)
SELECT level, group_size, group_values, 'pg_' || substr(sha256(level || '|' || group_values), 1, 24) AS group_id FROM g""")
def peer_references(spark, d):
    return groups.issued(groups.assign(records(spark, d), LEVELS), LEVELS)


def _level_sql(i: int) -> str:
    by = ", ".join(LEVELS[i])
    return f"""SELECT *, {i} AS lv, rank() OVER (PARTITION BY {by} ORDER BY l_extendedprice) - 1 AS below, count(*) OVER (PARTITION BY {by} ORDER BY l_extendedprice) AS le, count(*) OVER (PARTITION BY {by}) AS n,
  quantile_cont(l_extendedprice, 0.5) OVER (PARTITION BY {by}) AS median, quantile_cont(l_extendedprice, 0.05) OVER (PARTITION BY {by}) AS q05, quantile_cont(l_extendedprice, 0.95) OVER (PARTITION BY {by}) AS q95 FROM assigned"""


@query(f"""WITH {_SIZES}, every AS ({" UNION ALL ".join(_level_sql(i) for i in range(3))})
SELECT l_orderkey, l_linenumber, level, n, round(median, 6) AS median, round(q05, 6) AS q05, round(q95, 6) AS q95, round((below + le) / (2.0::DOUBLE * n), 6) AS midrank,
 round((below + 0.5 * (le - below - 1))::DOUBLE / (n - 1), 6) AS loo_percentile, round(least(1.0::DOUBLE, 2 * least((n - below)::DOUBLE / n, le::DOUBLE / n)), 6) AS two_sided,
 CASE WHEN n - below < le THEN 'HIGH' WHEN n - below > le THEN 'LOW' ELSE 'CENTRE' END AS direction FROM every WHERE level = lv""")
def peer_tail_probability(spark, d):
    r = records(spark, d).select("l_orderkey", "l_linenumber", *LEVELS[0], "l_extendedprice")
    e = groups.evidence(r, LEVELS, "l_extendedprice")
    return e.select("l_orderkey", "l_linenumber", "level", "n", r6("median"), r6("q05"), r6("q95"), r6("midrank"), r6("loo_percentile"), r6("two_sided"), "direction")


@query("""WITH m AS (SELECT *, median(o_totalprice) OVER (PARTITION BY o_orderpriority) AS med FROM orders), s AS (SELECT *, median(abs(o_totalprice - med)) OVER (PARTITION BY o_orderpriority) AS mad FROM m)
SELECT o_orderkey, round(med, 4) AS median, round(mad, 4) AS mad, round(0.6744897501960817 * (o_totalprice - med) / mad, 4) AS robust_z FROM s""")
def robust_deviation(spark, d):
    r = tails.robust(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice")
    return r.select("o_orderkey", F.round("median", 4).alias("median"), F.round("mad", 4).alias("mad"), F.round("robust_z", 4).alias("robust_z"))


@query("""WITH o AS (SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS was FROM orders)
SELECT o_orderkey, round(o_totalprice - was, 4) AS change, round(abs(o_totalprice - was), 4) AS absolute, round(CASE WHEN was <> 0 THEN (o_totalprice - was) / was END, 6) AS relative, CASE WHEN o_totalprice > was THEN 'UP' WHEN o_totalprice < was THEN 'DOWN' ELSE 'SAME' END AS direction FROM o WHERE was IS NOT NULL""")
def revisit_change(spark, d):
    o = table(spark, d, "orders").withColumn("was", F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).where("was is not null")
    ch = F.col("o_totalprice") - F.col("was")
    return o.select("o_orderkey", F.round(ch, 4).alias("change"), F.round(F.abs(ch), 4).alias("absolute"), F.round(F.when(F.col("was") != 0, ch / F.col("was")), 6).alias("relative"), F.when(ch > 0, "UP").when(ch < 0, "DOWN").otherwise("SAME").alias("direction"))


def _codes(spark, d):
    c = records(spark, d).groupBy(*CELL, "p_brand").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*CELL)
    return c.withColumns({"n": F.sum("c").over(w), "upto": F.sum("c").over(w.orderBy("c").rangeBetween(Window.unboundedPreceding, 0))})


@query(f"""WITH {RECORDS}, c AS (SELECT l_returnflag, l_linestatus, p_brand, count(*) AS c FROM records GROUP BY 1, 2, 3)
SELECT l_returnflag, l_linestatus, p_brand, c, round(c / (sum(c) OVER w)::DOUBLE, 6) AS frequency, round(-ln(c / (sum(c) OVER w)::DOUBLE), 6) AS surprisal, round((sum(c) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY c)) / (sum(c) OVER w)::DOUBLE, 6) AS tail FROM c WINDOW w AS (PARTITION BY l_returnflag, l_linestatus)""")
def code_frequency_tail(spark, d):
    f = F.col("c") / F.col("n")
    return _codes(spark, d).select(*CELL, "p_brand", "c", F.round(f, 6).alias("frequency"), F.round(-F.log(f), 6).alias("surprisal"), F.round(F.col("upto") / F.col("n"), 6).alias("tail"))


@query(f"""WITH {RECORDS}, c AS (SELECT l_returnflag, l_linestatus, p_brand, count(*) AS c FROM records GROUP BY 1, 2, 3), t AS (SELECT *, sum(c) OVER (PARTITION BY l_returnflag, l_linestatus) AS n, sum(c) OVER (PARTITION BY l_returnflag, p_brand) / (sum(c) OVER (PARTITION BY l_returnflag))::DOUBLE AS prior FROM c)
SELECT l_returnflag, l_linestatus, p_brand, round((c + 1.0 * prior) / (n + 1.0), 6) AS share FROM t""")
def smoothed_code_share(spark, d):
    prior = F.sum("c").over(Window.partitionBy("l_returnflag", "p_brand")) / F.sum("c").over(Window.partitionBy("l_returnflag"))
    return _codes(spark, d).withColumn("prior", prior).select(*CELL, "p_brand", F.round((F.col("c") + F.col("prior")) / (F.col("n") + 1.0), 6).alias("share"))


def _history(spark, d, lags: list[int]):
    by = [*CELL, "p_brand"]
    r = records(spark, d).select(*LINE, "l_extendedprice", "period", *by).dropna(subset=[*by, "period"])  # no group without its keys
    x = tails.earlier(r, by, "period", lags, "l_extendedprice")
    return x.where("n >= 30").select(*LINE, "period", "n", r6("upper"), r6("lower"), r6("two_sided"), r6("percentile"))


def _history_sql(lags: str) -> str:
    return f"""WITH {RECORDS}, refs AS (SELECT l_returnflag, l_linestatus, p_brand, period + k AS period, l_extendedprice AS v FROM records, unnest({lags}) AS u(k)),
j AS (SELECT t.l_orderkey, t.l_linenumber, t.period, count(v) AS n, sum((v >= l_extendedprice)::INT) AS ge, sum((v <= l_extendedprice)::INT) AS le FROM (SELECT *, row_number() OVER () AS rid FROM records) t JOIN refs f ON t.l_returnflag = f.l_returnflag AND t.l_linestatus = f.l_linestatus AND t.p_brand = f.p_brand AND t.period = f.period GROUP BY t.rid, 1, 2, 3)
SELECT l_orderkey, l_linenumber, period, n, round((ge + 1)::DOUBLE / (n + 1), 6) AS upper, round((le + 1)::DOUBLE / (n + 1), 6) AS lower, round(least(1.0::DOUBLE, 2 * least((ge + 1)::DOUBLE / (n + 1), (le + 1)::DOUBLE / (n + 1))), 6) AS two_sided, round((n - ge + 0.5 * (ge + le - n))::DOUBLE / n, 6) AS percentile FROM j WHERE n >= 30"""


@query(_history_sql("[1, 2, 3, 4]"))
def history_tail_probability(spark, d):
    return _history(spark, d, [1, 2, 3, 4])


@query(_history_sql("[4]"))
def same_season_tail(spark, d):
    return _history(spark, d, [4])


@query("""WITH p AS (SELECT quarter(o_orderdate) AS period, min(o_orderstatus) AS keep FROM orders GROUP BY 1) SELECT o_orderkey FROM orders JOIN p ON quarter(o_orderdate) = period AND o_orderstatus = keep""")
def period_dedup(spark, d):
    o = table(spark, d, "orders").withColumn("period", F.quarter("o_orderdate"))
    first = o.groupBy("period").agg(F.min("o_orderstatus").alias("keep"))
    return o.join(first, "period").where("o_orderstatus = keep").select("o_orderkey")


@query("""WITH s AS (SELECT event_id, sha256(concat_ws('|', event_type, props, user_id % 10)) AS signature FROM events) SELECT event_id, signature, count(*) OVER (PARTITION BY signature) AS n_same FROM s""")
def response_signature(spark, d):
    e = table(spark, d, "events").select("event_id", F.sha2(F.concat_ws("|", "event_type", "props", (F.col("user_id") % 10).cast("string")), 256).alias("signature"))
    return e.withColumn("n_same", F.count("*").over(Window.partitionBy("signature")))


# Survey estimates

_RATIO = """psu AS (SELECT l_returnflag, l_linestatus AS stratum, l_suppkey, sum(l_quantity * l_extendedprice) AS wy, sum(l_quantity) AS wx FROM lineitem GROUP BY 1, 2, 3),
r AS (SELECT *, sum(wy) OVER d / sum(wx) OVER d AS ratio, sum(wx) OVER d AS sx FROM psu WINDOW d AS (PARTITION BY l_returnflag)), z AS (SELECT *, (wy - ratio * wx) / sx AS z FROM r),
c AS (SELECT *, count(*) OVER s AS h, avg(z) OVER s AS mh, avg(z) OVER (PARTITION BY l_returnflag) AS m FROM z WINDOW s AS (PARTITION BY l_returnflag, stratum))"""


@query(f"WITH {_RATIO} SELECT l_returnflag, round(any_value(ratio), 4) AS ratio, round(sqrt(sum(CASE WHEN h > 1 THEN h / (h - 1)::DOUBLE * (z - mh) ** 2 ELSE (z - m) ** 2 END)), 4) AS se, count(*) AS n_psu FROM c GROUP BY 1")
def ratio_design_se(spark, d):
    g = survey.ratio_se(table(spark, d, "lineitem"), ["l_returnflag"], "l_linestatus", "l_suppkey", F.col("l_extendedprice"), F.lit(1.0), F.col("l_quantity"))
    return g.select("l_returnflag", F.round("ratio", 4).alias("ratio"), F.round("se", 4).alias("se"), "n_psu")


@query("""WITH s AS (SELECT l_returnflag, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS c, sum(w) OVER (PARTITION BY l_returnflag) AS t FROM s)
SELECT l_returnflag, min(CASE WHEN c >= 0.25 * t - 1e-9 THEN v END) AS q25, min(CASE WHEN c >= 0.5 * t - 1e-9 THEN v END) AS q50 FROM c GROUP BY 1""")
def weighted_quantile(spark, d):
    return survey.weighted_quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", F.col("l_quantity"), {"q25": 0.25, "q50": 0.5})


@query("""WITH s AS (SELECT l_returnflag, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), r AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS c, sum(w) OVER (PARTITION BY l_returnflag) AS t FROM s),
med AS (SELECT l_returnflag, min(v) FILTER (c >= 0.5 * t - 1e-9) AS median FROM r GROUP BY 1), ps AS (SELECT l_returnflag, l_linestatus, l_suppkey, sum(CASE WHEN l_extendedprice <= median THEN l_quantity ELSE 0 END) AS wy, sum(l_quantity) AS wx FROM lineitem JOIN med USING (l_returnflag) GROUP BY 1, 2, 3),
z AS (SELECT *, (wy - sum(wy) OVER d / sum(wx) OVER d * wx) / sum(wx) OVER d AS z FROM ps WINDOW d AS (PARTITION BY l_returnflag)), u AS (SELECT *, count(*) OVER st AS h, avg(z) OVER st AS mh, avg(z) OVER (PARTITION BY l_returnflag) AS m FROM z WINDOW st AS (PARTITION BY l_returnflag, l_linestatus)),
p AS (SELECT l_returnflag, CASE WHEN count(*) >= 2 THEN sqrt(sum(CASE WHEN h > 1 THEN h / (h - 1)::DOUBLE * (z - mh) ** 2 ELSE (z - m) ** 2 END)) END AS p FROM u GROUP BY 1),
e AS (SELECT l_returnflag, min(v) FILTER (c >= greatest(0.5 - 1.96 * p, 0) * t - 1e-9) AS low, min(v) FILTER (c >= least(0.5 + 1.96 * p, 1) * t - 1e-9) AS high FROM r JOIN p USING (l_returnflag) GROUP BY 1)
SELECT l_returnflag, median, low, high, round((high - low) / (2 * 1.96::DOUBLE), 4) AS se FROM med JOIN e USING (l_returnflag)""")
def median_woodruff(spark, d):
    m = survey.woodruff_median(table(spark, d, "lineitem"), ["l_returnflag"], "l_linestatus", "l_suppkey", "l_extendedprice", F.col("l_quantity"))
    return m.select("l_returnflag", "median", "low", "high", F.round("se", 4).alias("se"))


@query(f"""WITH {RECORDS} SELECT l_returnflag, l_linestatus, p_type, period, grouping_id(l_returnflag, l_linestatus, p_type)::BIGINT AS level, round(sum(l_quantity * (l_discount > 0.05)::INT) / sum(l_quantity), 6) AS share, count(*) AS n FROM records
GROUP BY GROUPING SETS ((l_returnflag, period), (l_returnflag, l_linestatus, period), (l_returnflag, l_linestatus, p_type, period))""")
def area_indicators(spark, d):
    sets = [["l_returnflag", "period"], ["l_returnflag", "l_linestatus", "period"], ["l_returnflag", "l_linestatus", "p_type", "period"]]
    g = records(spark, d).groupingSets([[F.col(c) for c in s] for s in sets], "l_returnflag", "l_linestatus", "p_type", "period")
    share = F.sum(F.col("l_quantity") * (F.col("l_discount") > 0.05).cast("int")) / F.sum("l_quantity")
    out = g.agg(F.round(share, 6).alias("share"), F.count("*").alias("n"), (F.grouping("l_returnflag") * 4 + F.grouping("l_linestatus") * 2 + F.grouping("p_type")).cast("long").alias("level"))
    return out.select("l_returnflag", "l_linestatus", "p_type", "period", "level", "share", "n")


@query(f"""WITH {RECORDS}, a AS (SELECT p_brand, period, avg(l_extendedprice) AS v FROM records GROUP BY 1, 2), c AS (SELECT *, CASE WHEN lag(period) OVER w = period - 1 THEN v - lag(v) OVER w END AS change FROM a WINDOW w AS (PARTITION BY p_brand ORDER BY period)),
m AS (SELECT *, median(change) OVER (PARTITION BY period) AS med, count(change) OVER (PARTITION BY period) AS k FROM c), s AS (SELECT *, median(abs(change - med)) OVER (PARTITION BY period) AS mad FROM m)
SELECT p_brand, period, round(change, 4) AS change, round(CASE WHEN k >= 5 AND mad > 0 THEN 0.6745 * (change - med) / mad END, 4) AS robust_z FROM s WHERE change IS NOT NULL""")
def change_screen(spark, d):
    a = records(spark, d).groupBy("p_brand", "period").agg(F.avg("l_extendedprice").alias("v"))
    w = Window.partitionBy("p_brand").orderBy("period")
    c = a.withColumn("change", F.when(F.lag("period").over(w) == F.col("period") - 1, F.col("v") - F.lag("v").over(w))).where("change is not null")
    r = tails.robust(c, ["period"], "change").withColumn("k", F.count("*").over(Window.partitionBy("period")))
    return r.select("p_brand", "period", F.round("change", 4).alias("change"), F.round(F.when((F.col("k") >= 5) & (F.col("mad") > 0), 0.6745 * (F.col("change") - F.col("median")) / F.col("mad")), 4).alias("robust_z"))


@query(f"""WITH {RECORDS}, q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM records GROUP BY 1), b AS (SELECT l_returnflag, l_linestatus, l_quantity, least(len(list_filter(list_distinct(e), lambda x: x <= l_extendedprice)), len(list_distinct(e)) - 1) AS b FROM records JOIN q USING (l_returnflag)),
h AS (SELECT l_returnflag, b, coalesce(sum(l_quantity) FILTER (l_linestatus <> 'O'), 0) AS p, coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0) AS q FROM b GROUP BY 1, 2), s AS (SELECT l_returnflag, p / sum(p) OVER w AS p, q / sum(q) OVER w AS q FROM h WINDOW w AS (PARTITION BY l_returnflag))
SELECT l_returnflag, round(sqrt(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2), 4) AS js FROM s GROUP BY 1""")
def js_distance(spark, d):
    r = records(spark, d).withColumn("side", (F.col("l_linestatus") == "O").cast("int"))
    return survey.js_distance(r, ["l_returnflag"], "side", "l_extendedprice", F.col("l_quantity")).select("l_returnflag", F.round("js", 4).alias("js"))


@query(f"""WITH {_RATIO}, se AS (SELECT l_returnflag, any_value(ratio) AS mean, sqrt(sum(CASE WHEN h > 1 THEN h / (h - 1)::DOUBLE * (z - mh) ** 2 ELSE (z - m) ** 2 END)) AS se FROM c GROUP BY 1), w AS (SELECT l_returnflag, sum(l_quantity) AS tw FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, round(abs(l_quantity * (l_extendedprice - mean) / tw) / se, 6) AS impact FROM lineitem JOIN se USING (l_returnflag) JOIN w USING (l_returnflag)""")
def value_impact(spark, d):
    t = table(spark, d, "lineitem")
    g = survey.ratio_se(t, ["l_returnflag"], "l_linestatus", "l_suppkey", F.col("l_extendedprice"), F.lit(1.0), F.col("l_quantity")).join(F.broadcast(t.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("tw"))), "l_returnflag")
    return t.join(F.broadcast(g), "l_returnflag").select(*LINE, F.round(F.abs(F.col("l_quantity") * (F.col("l_extendedprice") - F.col("ratio")) / F.col("tw")) / F.col("se"), 6).alias("impact"))


# Cluster tests


@query("""WITH own AS (SELECT l_returnflag, l_suppkey, l_linenumber AS code, count(*) AS o FROM lineitem GROUP BY 1, 2, 3), codes AS (SELECT l_returnflag, code, sum(o) AS c FROM own GROUP BY 1, 2), cl AS (SELECT l_returnflag, l_suppkey, sum(o) AS n FROM own GROUP BY 1, 2),
f AS (SELECT cl.l_returnflag, cl.l_suppkey, n, codes.code, coalesce(o, 0) AS o, c - coalesce(o, 0) + 0.5::DOUBLE AS r FROM cl JOIN codes USING (l_returnflag) LEFT JOIN own ON own.l_returnflag = cl.l_returnflag AND own.l_suppkey = cl.l_suppkey AND own.code = codes.code),
s AS (SELECT *, sum(r) OVER w AS s, count(*) OVER w AS k FROM f WINDOW w AS (PARTITION BY l_returnflag, l_suppkey))
SELECT l_returnflag, l_suppkey, any_value(n)::BIGINT AS n, (any_value(k) - 1)::BIGINT AS df, round(greatest(sum(CASE WHEN o > 0 THEN 2 * o * ln(o / (n * r / s)) ELSE 0 END), 0) / (1 + (any_value(k) + 1) / (6.0::DOUBLE * any_value(n))), 5) AS g FROM s GROUP BY 1, 2""")
def g_statistic(spark, d):
    g = clusters.g_test(table(spark, d, "lineitem"), ["l_returnflag"], "l_suppkey", "l_linenumber")
    return g.select("l_returnflag", "l_suppkey", "n", F.col("df").cast("long").alias("df"), F.round("g", 5).alias("g"))


@query("""WITH r AS (SELECT *, rank() OVER w - 1 AS lt, count(*) OVER w AS le, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity)),
t AS (SELECT *, sum((le - lt)::DOUBLE ** 2 - 1) OVER (PARTITION BY l_returnflag) AS ties FROM r), g AS (SELECT l_returnflag, l_suppkey, count(*) AS n1, any_value(n) - count(*) AS n2, sum((lt + le + 1) / 2.0::DOUBLE) AS r1, any_value(ties) AS ties FROM t GROUP BY 1, 2),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0::DOUBLE AS u1, sqrt(n1 * n2 / 12.0::DOUBLE * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sigma FROM g)
SELECT l_returnflag, l_suppkey, n1, n2, round(u1, 1) AS u1, round((greatest(u1, n1 * n2 - u1) - n1 * n2 / 2.0::DOUBLE - 0.5) / sigma, 5) AS z FROM u""")
def mann_whitney_u(spark, d):
    g = clusters.rank_sums(table(spark, d, "lineitem"), ["l_returnflag"], "l_suppkey", "l_quantity")
    return g.select("l_returnflag", "l_suppkey", "n1", "n2", F.round("u1", 1).alias("u1"), F.round("z", 5).alias("z"))


@query("""WITH o AS (SELECT l_returnflag, l_suppkey, count(*) AS n, sum((l_quantity % 5 = 0)::INT)::BIGINT AS k FROM lineitem GROUP BY 1, 2) SELECT *, (sum(n) OVER w - n)::BIGINT AS rest_n, (sum(k) OVER w - k)::BIGINT AS rest_k, round((sum(k) OVER w - k)::DOUBLE / (sum(n) OVER w - n), 6) AS rest_share FROM o WINDOW w AS (PARTITION BY l_returnflag)""")
def digit_heaping(spark, d):
    return clusters.share_test(table(spark, d, "lineitem"), ["l_returnflag"], "l_suppkey", F.col("l_quantity") % 5 == 0).withColumn("rest_share", F.round("rest_share", 6))


@query("""WITH o AS (SELECT l_linestatus, l_suppkey, count(*) AS n, sum((l_returnflag = 'R')::INT)::BIGINT AS k FROM lineitem GROUP BY 1, 2) SELECT *, (sum(n) OVER w - n)::BIGINT AS rest_n, (sum(k) OVER w - k)::BIGINT AS rest_k, round((sum(k) OVER w - k)::DOUBLE / (sum(n) OVER w - n), 6) AS rest_share FROM o WINDOW w AS (PARTITION BY l_linestatus)""")
def substitution_share(spark, d):
    return clusters.share_test(table(spark, d, "lineitem"), ["l_linestatus"], "l_suppkey", F.col("l_returnflag") == "R").withColumn("rest_share", F.round("rest_share", 6))


@query("""WITH dd AS (SELECT l_returnflag, l_suppkey, l_shipdate, count(*) AS c FROM lineitem GROUP BY 1, 2, 3), s AS (SELECT l_returnflag, l_suppkey, max(c) / sum(c)::DOUBLE AS share FROM dd GROUP BY 1, 2),
r AS (SELECT *, count(*) OVER (PARTITION BY l_returnflag) - 1 AS others, count(*) OVER (PARTITION BY l_returnflag ORDER BY share DESC) - 1 AS ge FROM s) SELECT l_returnflag, l_suppkey, round(share, 6) AS share, others, round(CASE WHEN others >= 5 THEN (ge + 1) / (others + 1)::DOUBLE END, 6) AS p FROM r""")
def busiest_day(spark, d):
    return clusters.busiest_day(table(spark, d, "lineitem"), ["l_returnflag"], "l_suppkey", "l_shipdate").select("l_returnflag", "l_suppkey", r6("share"), "others", r6("p"))


@query("""WITH a AS (SELECT l_suppkey, year(l_shipdate) AS period, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2), s AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY l_suppkey ORDER BY period)) AS st FROM a),
r AS (SELECT *, count(*) OVER b AS earlier, median(v) OVER b AS base, median(st) OVER b AS step FROM s WINDOW b AS (PARTITION BY l_suppkey ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT l_suppkey, period::INTEGER AS period, round(CASE WHEN earlier >= 2 AND step > 0 THEN (v - base) / step END, 4) AS drift FROM r""")
def temporal_drift(spark, d):
    a = table(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("period")).agg(F.avg("l_quantity").alias("v"))
    return clusters.drift(a, ["l_suppkey"], "period", "v").select("l_suppkey", "period", F.round("drift", 4).alias("drift"))


@query("""WITH l AS (SELECT l_suppkey, l_orderkey, l_orderkey * 100 + l_linenumber AS id, l_quantity, l_discount, l_tax, l_returnflag FROM lineitem)
SELECT a.l_suppkey, a.id AS first_id, b.id AS second_id FROM l a JOIN l b ON a.l_suppkey = b.l_suppkey AND a.id < b.id AND a.l_orderkey <> b.l_orderkey WHERE (a.l_quantity = b.l_quantity)::INT + (a.l_discount = b.l_discount)::INT + (a.l_tax = b.l_tax)::INT + (a.l_returnflag = b.l_returnflag)::INT >= 4""")
def near_duplicate_pairs(spark, d):
    l = table(spark, d, "lineitem").withColumn("id", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    return clusters.near_pairs(l, "l_suppkey", "l_orderkey", "id", ["l_quantity", "l_discount", "l_tax", "l_returnflag"], 4, 0.95)


@query(f"""WITH {CASES}, r AS (SELECT case_id, state, p, row_number() OVER (PARTITION BY state ORDER BY p, case_id) AS r, count(*) OVER (PARTITION BY state) AS m FROM cases)
SELECT case_id, round(least(1.0::DOUBLE, min(p * m / r) OVER (PARTITION BY state ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS q FROM r""")
def bh_q_values(spark, d):
    return tails.bh(cases(spark, d), ["state"], "p", ["case_id"]).select("case_id", r6("q"))


@query(f"""WITH {CASES}, c AS (SELECT cluster, least(1.0::DOUBLE, count(*) * min(p)) AS cluster_p, count(*) AS n FROM cases GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY cluster_p, cluster) AS r, count(*) OVER () AS m FROM c)
SELECT cluster, n, round(cluster_p, 6) AS cluster_p, round(least(1.0::DOUBLE, min(cluster_p * m / r) OVER (ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS q FROM r""")
def cluster_combine(spark, d):
    c = cases(spark, d).groupBy("cluster").agg(F.count("*").alias("n"), F.least(F.lit(1.0), F.count("*") * F.min("p")).alias("cluster_p")).withColumn("_all", F.lit(0))
    return tails.bh(c, ["_all"], "cluster_p", ["cluster"]).select("cluster", "n", r6("cluster_p"), r6("q"))


@query(f"WITH {CASES} SELECT state, round(0.5 - atan(avg(tan((0.5 - least(greatest(p, 1e-12), 1 - 1e-12)) * pi()))) / pi(), 5) AS cauchy_p FROM cases GROUP BY 1")
def cauchy_combination(spark, d):
    x = F.tan((0.5 - F.least(F.greatest("p", F.lit(1e-12)), F.lit(1 - 1e-12))) * F.pi())
    return cases(spark, d).groupBy("state").agg(F.round(0.5 - F.atan(F.avg(x)) / F.pi(), 5).alias("cauchy_p"))


@query(f"WITH {CASES} SELECT case_id, round((rank() OVER w + count(*) OVER w) / (2.0::DOUBLE * count(*) OVER (PARTITION BY state)), 6) AS evidence_rank FROM cases WINDOW w AS (PARTITION BY state ORDER BY impact)")
def evidence_rank(spark, d):
    r = tails.ranked(cases(spark, d), ["state"], "impact")
    return r.select("case_id", F.round((F.col("_below") + 1 + F.col("_le")) / (2 * F.col("_n")), 6).alias("evidence_rank"))


@query()
def cluster_p_values(spark, d):
    """Tail probabilities of the cluster statistics, in Arrow batches over one row a cluster."""
    g = g_statistic(spark, d).withColumn("p_mix", special.chi2_sf_col("g", F.col("df").cast("double")))
    u = mann_whitney_u(spark, d).withColumn("p_u", F.least(F.lit(1.0), 2 * special.norm_sf_col("z")))
    h = digit_heaping(spark, d).withColumn("p_digit", special.binom_sf_col(F.col("k").cast("double"), F.col("n").cast("double"), "rest_share"))
    key = ["l_returnflag", "l_suppkey"]
    return g.select(*key, r6("p_mix")).join(u.select(*key, r6("p_u")), key).join(h.select(*key, r6("p_digit")), key)


# Fusion


def _variables(spark, d):
    return cases(spark, d).select("case_id", F.explode(F.array(*[F.lit(v) for v in ("a", "b")])).alias("variable"), "p", "coding_p").select(
        "case_id", "variable", F.when(F.col("variable") == "a", F.col("p")).alias("p_current"), F.col("coding_p").alias("p_history"), F.when(F.col("case_id") % 5 == 0, 1 - F.col("p") / 2).alias("p_model"), F.lit(999.0).alias("n_current"), F.when(F.col("case_id") % 2 == 0, 40.0).otherwise(500.0).alias("n_history"))


_VARS = CASES + """, v AS (SELECT case_id, variable, CASE WHEN variable = 'a' THEN p END AS p1, coding_p AS p2, CASE WHEN case_id % 5 = 0 THEN 1 - p / 2 END AS pm, 999.0::DOUBLE AS n1, CASE WHEN case_id % 2 = 0 THEN 40.0::DOUBLE ELSE 500.0::DOUBLE END AS n2 FROM cases, (VALUES ('a'), ('b')) t(variable)),
f AS (SELECT *, CASE WHEN p1 IS NOT NULL AND p2 IS NOT NULL THEN (p1 + p2) / 2 ELSE coalesce(p1, p2) END AS ref, CASE WHEN p1 IS NOT NULL AND p2 IS NOT NULL THEN (2 / (n1 + 1) + 2 / (n2 + 1)) / 2 WHEN p1 IS NOT NULL THEN 2 / (n1 + 1) WHEN p2 IS NOT NULL THEN 2 / (n2 + 1) END AS flo FROM v),
u AS (SELECT *, ref IS NOT NULL AND NOT coalesce(flo > 0.01, false) AS rt FROM f), k AS (SELECT *, rt OR pm IS NULL AS use, (ref IS NOT NULL AND (rt OR pm IS NULL))::INT + (pm IS NOT NULL)::INT AS k FROM u),
e AS (SELECT *, CASE WHEN use THEN least(coalesce(ref, 2), coalesce(pm, 2)) ELSE pm END AS best, rt OR pm IS NOT NULL AS testable FROM k),
ve AS (SELECT case_id, variable, testable, CASE WHEN k > 0 THEN 1 - (1 - least(greatest(best, 0), 1 - 1e-16)) ** k END AS p FROM e)"""


@query(f"WITH {_VARS} SELECT case_id, variable, testable, round(p, 6) AS p FROM ve")
def variable_evidence(spark, d):
    return fuse.variable_evidence(_variables(spark, d)).select("case_id", "variable", "testable", r6("p"))


@query(f"""WITH {_VARS}, g AS (SELECT case_id, CASE WHEN count(p) FILTER (testable) > 0 THEN count(p) FILTER (testable) ELSE count(p) END AS k, coalesce(min(p) FILTER (testable), min(p)) AS b FROM ve GROUP BY 1)
SELECT case_id, k, round(1 - (1 - least(greatest(b, 0), 1 - 1e-16)) ** k, 6) AS record_p FROM g""")
def record_evidence(spark, d):
    return fuse.record_evidence(fuse.variable_evidence(_variables(spark, d)), ["case_id"], "variable").select("case_id", "k", r6("record_p"))


_TIERS = CASES + """, cand AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY p, case_id) <= 3 AS ok FROM cases WHERE NOT hard AND p <= 0.02), b4 AS (SELECT *, coalesce(sum(ok::INT) OVER (ORDER BY p, case_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM cand),
t1 AS (SELECT c.*, CASE WHEN c.hard THEN 'A' WHEN b4.case_id IS NULL THEN NULL WHEN ok AND bef < 100 THEN 'A' ELSE 'B' END AS t, CASE WHEN c.hard THEN 'RULE' WHEN b4.case_id IS NULL THEN NULL WHEN ok AND bef < 100 THEN 'VALUE' WHEN bef >= 100 THEN 'BUDGET' ELSE 'CAP' END AS r FROM cases c LEFT JOIN b4 USING (case_id)),
cd AS (SELECT case_id, row_number() OVER (ORDER BY coding_p, case_id) AS k FROM t1 WHERE coding_p <= 0.02 AND t IS DISTINCT FROM 'A'),
t2 AS (SELECT t1.*, CASE WHEN k <= 10 THEN 'A' WHEN k IS NOT NULL THEN 'B' ELSE t END AS t_, CASE WHEN k <= 10 THEN 'CODING' WHEN k IS NOT NULL THEN 'CODING_BUDGET' ELSE r END AS r_ FROM t1 LEFT JOIN cd USING (case_id)),
t3 AS (SELECT *, CASE WHEN t_ IS NULL AND soft THEN 'B' ELSE t_ END AS t3, CASE WHEN t_ IS NULL AND soft THEN 'RULE_SOFT' ELSE r_ END AS r3 FROM t2),
nb AS (SELECT case_id, row_number() OVER (ORDER BY p, case_id) <= 200 - (SELECT count(*) FROM t3 WHERE t3 = 'B') AS nxt FROM t3 WHERE t3 IS NULL AND p / 0.02 <= 5),
tiers AS (SELECT t3.*, coalesce(t3, CASE WHEN nxt THEN 'B' ELSE 'NONE' END) AS tier, coalesce(r3, CASE WHEN nxt THEN 'NEXT' END) AS reason FROM t3 LEFT JOIN nb USING (case_id))"""


def _tiers(spark, d):
    return fuse.tiers(cases(spark, d), budget=100, threshold=0.02, cap=3, coding_budget=10)


@query(f"WITH {_TIERS} SELECT case_id, tier, reason FROM tiers")
def queue_tiers(spark, d):
    return _tiers(spark, d).select("case_id", "tier", "reason")


_ORDER = _TIERS + """, queue AS (SELECT *, row_number() OVER (ORDER BY CASE tier WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE 2 END, (NOT hard)::INT, CASE WHEN tier IN ('A', 'B') THEN -impact ELSE 0 END, p, case_id) AS position FROM tiers)"""


def _queue(spark, d):
    return fuse.positions(_tiers(spark, d), "impact")


@query(f"WITH {_ORDER} SELECT case_id, position::BIGINT AS position FROM queue")
def queue_order(spark, d):
    return _queue(spark, d).select("case_id", F.col("position").cast("long").alias("position"))


@query("SELECT l_orderkey, count(*) AS n_violations, string_agg(DISTINCT r, ',' ORDER BY r) AS rules FROM (SELECT l_orderkey, 'flag' AS r FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, 'quantity' FROM lineitem WHERE l_quantity > 45) GROUP BY 1")
def rule_rollup(spark, d):
    own = [{"id": "flag", "type": "allowed_values", "column": "l_returnflag", "values": ["A", "N"]}, {"id": "quantity", "type": "range", "column": "l_quantity", "max": 45}]
    v = rules.evaluate(table(spark, d, "lineitem"), own, LINE)
    return v.groupBy("l_orderkey").agg(F.count("*").alias("n_violations"), F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"))


@query(f"""WITH {_TIERS}, g AS (SELECT cluster, count(*) FILTER (tier = 'A') AS n_a, count(*) FILTER (tier = 'B') AS n_b, least(1.0::DOUBLE, count(*) * min(p)) AS gp FROM tiers GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY gp, cluster) AS r, count(*) OVER () AS m FROM g),
q AS (SELECT *, least(1.0::DOUBLE, min(gp * m / r) OVER (ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM r) SELECT cluster, n_a, n_b, round(q, 6) AS q, CASE WHEN q < 0.01 THEN 'HIGH' WHEN q < 0.05 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM q""")
def group_bands(spark, d):
    g = _tiers(spark, d).groupBy("cluster").agg(F.count_if(F.col("tier") == "A").alias("n_a"), F.count_if(F.col("tier") == "B").alias("n_b"), F.least(F.lit(1.0), F.count("*") * F.min("p")).alias("gp")).withColumn("_all", F.lit(0))
    band = F.when(F.col("q") < 0.01, "HIGH").when(F.col("q") < 0.05, "MEDIUM").otherwise("LOW")
    return tails.bh(g, ["_all"], "gp", ["cluster"]).select("cluster", "n_a", "n_b", r6("q"), band.alias("band"))


@query(f"WITH {CASES} SELECT 'value' AS mechanism, round(avg((p <= 0.02)::INT) / 0.02, 6) AS ratio FROM cases UNION ALL SELECT 'coding', round(avg((coding_p <= 0.02)::INT) / 0.02, 6) FROM cases WHERE coding_p IS NOT NULL")
def calibration(spark, d):
    long = cases(spark, d).select(F.explode(F.array(F.struct(F.lit("value").alias("mechanism"), F.col("p").alias("x")), F.struct(F.lit("coding").alias("mechanism"), F.col("coding_p").alias("x")))).alias("m")).select("m.*").where("x is not null")
    return long.groupBy("mechanism").agg(F.round(F.avg((F.col("x") <= 0.02).cast("int")) / 0.02, 6).alias("ratio"))


# Review


@query(f"WITH {_ORDER} SELECT case_id, position::BIGINT AS position, tier FROM queue WHERE tier IN ('A', 'B') ORDER BY position LIMIT 50 OFFSET 25")
def case_page(spark, d):
    return _queue(spark, d).where(F.col("tier").isin("A", "B")).orderBy("position").offset(25).limit(50).select("case_id", F.col("position").cast("long").alias("position"), "tier")


@query(f"WITH {_ORDER} SELECT case_id, position::BIGINT AS position FROM queue WHERE position = 40")
def case_position(spark, d):
    return _queue(spark, d).where("position = 40").select("case_id", F.col("position").cast("long").alias("position"))


@query(f"WITH {_TIERS} SELECT tier, count(*) AS n, count(*) FILTER (hard) AS n_hard, count(DISTINCT cluster) AS n_clusters FROM tiers GROUP BY ALL")
def overview_bands(spark, d):
    return _tiers(spark, d).groupBy("tier").agg(F.count("*").alias("n"), F.count_if("hard").alias("n_hard"), F.countDistinct("cluster").alias("n_clusters"))


@query(f"WITH {_TIERS} SELECT state, sector, count(*) FILTER (tier = 'A') AS n_a, count(*) AS n FROM tiers GROUP BY ALL HAVING count(*) FILTER (tier = 'A') > 0")
def case_areas(spark, d):
    return _tiers(spark, d).groupBy("state", "sector").agg(F.count_if(F.col("tier") == "A").alias("n_a"), F.count("*").alias("n")).where("n_a > 0")


@query(f"WITH {_ORDER} SELECT cluster, min(position)::BIGINT AS first_position, count(*) AS n FROM queue WHERE tier IN ('A', 'B') GROUP BY 1")
def worklist(spark, d):
    return _queue(spark, d).where(F.col("tier").isin("A", "B")).groupBy("cluster").agg(F.min("position").cast("long").alias("first_position"), F.count("*").alias("n"))


@query(f"WITH {_TIERS} SELECT cluster, case_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY p, case_id) AS place FROM tiers) WHERE place <= 3")
def group_top_patterns(spark, d):
    return _tiers(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy("p", "case_id"))).where("r <= 3").select("cluster", "case_id")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS decision, count(*) AS n FROM events GROUP BY 1")
def latest_decision(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("decision"), F.count("*").alias("n"))


@query("SELECT user_id, event_id, CASE WHEN event_id % 1000 = 7 THEN 'HASH' ELSE 'LINK' END AS fault FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE event_id % 1000 = 7 OR (event_id % 1000 = 500 AND k > 1)")
def audit_verify(spark, d):
    """A hash chain a user over events, stored by audit.chain; then one event in 1,000 is altered and one link in 1,000 is cut."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.col("value").cast("string").alias("value"), "props")
    stored = audit.chain(e, "user_id", "event_id", ["event_type", "value", "props"])
    cut = (F.col("event_id") % 1000 == 500) & (F.col("previous_hash") != "")
    altered = stored.withColumns({"event_type": F.when(F.col("event_id") % 1000 == 7, "altered").otherwise(F.col("event_type")), "previous_hash": F.when(cut, F.repeat(F.lit("0"), F.lit(64))).otherwise(F.col("previous_hash"))})
    return audit.verify(altered, "user_id", "event_id", ["event_type", "value", "props"]).select("user_id", "event_id", "fault")


@query(f"""WITH {_TIERS}, g AS (SELECT tier, count(*) AS n, count(*) FILTER (impact > 250000) AS k FROM tiers GROUP BY 1), s AS (SELECT *, k / n::DOUBLE AS p FROM g)
SELECT tier, n, k, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0::DOUBLE * n * n))) / (1 + 3.8416 / n), 6) AS low, round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0::DOUBLE * n * n))) / (1 + 3.8416 / n), 6) AS high FROM s""")
def wilson_feedback(spark, d):
    g = _tiers(spark, d).groupBy("tier").agg(F.count("*").alias("n"), F.count_if(F.col("impact") > 250000).alias("k"))
    n, p, z2 = F.col("n").cast("double"), F.col("k") / F.col("n"), 3.8416
    half = 1.96 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return g.select("tier", "n", "k", F.round((p + z2 / (2 * n) - half) / (1 + z2 / n), 6).alias("low"), F.round((p + z2 / (2 * n) + half) / (1 + z2 / n), 6).alias("high"))


@query("SELECT o_orderpriority, round(avg((o_totalprice <= 150000)::INT), 6) AS percentile, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 30")
def online_comparison(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.avg((F.col("o_totalprice") <= 150000).cast("int")), 6).alias("percentile"), F.count("*").alias("n")).where("n >= 30")


# Evaluation and gates


@query(f"""WITH {CASES}, r AS (SELECT soft AS positive, row_number() OVER (ORDER BY p, sha256(case_id::VARCHAR)) AS k, count(*) OVER () AS n FROM cases), c AS (SELECT *, sum(positive::INT) OVER (ORDER BY k) AS hits FROM r)
SELECT round(sum((positive AND k <= 0.01 * n)::INT) / ceil(any_value(n) * 0.01), 6) AS precision_1, round(sum((positive AND k <= 0.05 * n)::INT) / sum(positive::INT)::DOUBLE, 6) AS recall_5, round(sum(CASE WHEN positive THEN hits / k::DOUBLE END) / sum(positive::INT), 6) AS average_precision FROM c""")
def ranking_metrics(spark, d):
    c = cases(spark, d).withColumn("h", F.sha2(F.col("case_id").cast("string"), 256))
    pos = F.col("soft").cast("int")
    r = running(c, [F.col("p"), F.col("h")], {"k": F.lit(1), "hits": pos}).withColumns({"k": F.col("k") + 1, "hits": F.col("hits") + pos})
    r = r.join(F.broadcast(c.agg(F.count("*").alias("n"))))
    return r.agg(F.round(F.sum(F.when(F.col("k") <= 0.01 * F.col("n"), pos).otherwise(0)) / F.ceil(F.max("n") * 0.01), 6).alias("precision_1"), F.round(F.sum(F.when(F.col("k") <= 0.05 * F.col("n"), pos).otherwise(0)) / F.sum(pos), 6).alias("recall_5"), F.round(F.sum(F.when(F.col("soft"), F.col("hits") / F.col("k"))) / F.sum(pos), 6).alias("average_precision"))


@query("WITH s AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) SELECT c_nationkey, CASE WHEN (row_number() OVER (ORDER BY n DESC, c_nationkey) - 1) % 4 IN (0, 3) THEN 'A' ELSE 'B' END AS fold FROM s")
def state_folds(spark, d):
    s = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    k = (F.row_number().over(Window.orderBy(F.col("n").desc(), "c_nationkey")) - 1) % 4
    return s.select("c_nationkey", F.when(k.isin(0, 3), "A").otherwise("B").alias("fold"))


@query("SELECT count(*) AS n_rows, count(l_orderkey) AS n_keys, round(avg((l_quantity > 0)::INT), 6) AS assessable, avg((l_quantity > 0)::INT) >= 0.01 AS passed FROM lineitem")
def quality_gate(spark, d):
    share = F.avg((F.col("l_quantity") > 0).cast("int"))
    return table(spark, d, "lineitem").agg(F.count("*").alias("n_rows"), F.count("l_orderkey").alias("n_keys"), F.round(share, 6).alias("assessable"), (share >= 0.01).alias("passed"))


@query("WITH k AS (SELECT o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('7|' || o_orderkey), o_orderkey) AS r FROM orders) SELECT o_orderkey, 'TIMES_TEN' AS error_type, o_totalprice AS original, o_totalprice * 10 AS injected FROM k WHERE r <= 20")
def error_injection(spark, d):
    w = Window.partitionBy("o_orderpriority").orderBy(F.sha2(F.concat(F.lit("7|"), F.col("o_orderkey").cast("string")), 256), "o_orderkey")
    return table(spark, d, "orders").withColumn("r", F.row_number().over(w)).where("r <= 20").select("o_orderkey", F.lit("TIMES_TEN").alias("error_type"), F.col("o_totalprice").alias("original"), (F.col("o_totalprice") * 10).alias("injected"))


@query("""WITH r AS (SELECT o_orderkey, o_orderpriority AS g, abs(o_totalprice - 150000) AS a, o_custkey % 5 = 0 AS cal FROM orders) SELECT t.o_orderkey, round((count(*) FILTER (c.a >= t.a) + 1) / (count(*) + 1)::DOUBLE, 6) AS p FROM r t JOIN r c ON t.g = c.g AND c.cal WHERE NOT t.cal GROUP BY t.o_orderkey""")
def conformal_tail(spark, d):
    r = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("g"), F.abs(F.col("o_totalprice") - 150000).alias("a"), (F.col("o_custkey") % 5 == 0).alias("cal"))
    return tails.out_of_sample(r.where("not cal").drop("cal"), r.where("cal").select("g", "a"), ["g"], "a").select("o_orderkey", F.round("upper", 6).alias("p"))


def _load() -> None:
    """The other modules of plans register their queries here as they are imported."""
    from plumbline.plans import areas, evaluation, fieldwork, ingest, models, review  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
