"""Injected errors and ranking metrics at several depths."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import evaluation
from plumbline.plans.catalog import query, r6
from plumbline.plans.roles import CASES, cases, table

_KINDS = ", ".join(f"'{k}'" for k in evaluation.KINDS)


@query(f"""WITH o AS (SELECT o_orderkey, o_totalprice::DOUBLE AS v, o_orderpriority AS c FROM orders),
f AS (SELECT DISTINCT o_orderkey, sha256('7|' || o_orderkey) AS h FROM o WHERE v > 0 AND c IS NOT NULL ORDER BY h, o_orderkey LIMIT 140),
k AS (SELECT o_orderkey, [{_KINDS}][(row_number() OVER (ORDER BY h, o_orderkey) - 1) // 20 + 1] AS kind FROM f),
codes AS (SELECT c, coalesce(lead(c) OVER (ORDER BY c), min(c) OVER ()) AS other FROM (SELECT DISTINCT c FROM o)),
w AS (SELECT o.*, kind, other, floor(v + 0.5)::BIGINT AS whole FROM o LEFT JOIN k USING (o_orderkey) LEFT JOIN codes USING (c)),
s AS (SELECT *, CASE WHEN length(whole::VARCHAR) >= 3 THEN (substr(whole::VARCHAR, 2, 1) || substr(whole::VARCHAR, 1, 1) || substr(whole::VARCHAR, 3))::DOUBLE END AS swapped FROM w),
t AS (SELECT *, swapped > 0 AND abs(swapped - whole) / whole >= 0.2 AS moves FROM s)
SELECT o_orderkey, CASE kind WHEN 'scale_x10' THEN floor(v * 10) WHEN 'scale_x12' THEN floor(v * 12) WHEN 'scale_x100' THEN floor(v * 100) WHEN 'scale_div10' THEN floor(v / 10 + 0.5)
 WHEN 'digit_transposition' THEN CASE WHEN moves THEN swapped ELSE v END ELSE v END AS o_totalprice,
 CASE WHEN kind = 'code_miscode' THEN other ELSE c END AS o_orderpriority, CASE WHEN kind <> 'digit_transposition' OR moves THEN kind END AS error_type,
 unnest(CASE WHEN kind = 'duplicate_record' THEN [0, 1] ELSE [0] END) AS copy FROM t""")
def injected_kinds(spark, d):
    """All orders with 20 errors of each kind: 20 is the size of the injection, not a limit on rows read or returned."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderpriority")
    return evaluation.inject(o, "o_orderkey", "o_totalprice", "o_orderpriority", per_kind=20)


def _scored(spark, d):
    kind = F.when(F.col("soft"), F.element_at(F.array(F.lit("RULE_BREACH"), F.lit("TIMES_TEN"), F.lit("SWAP")), (F.col("case_id") % 3 + 1).cast("int")))
    return cases(spark, d).select("p", F.sha2(F.col("case_id").cast("string"), 256).alias("h"), "soft", "state", "sector", kind.alias("type"))


_RANKED = f"WITH {CASES}, r AS (SELECT *, CASE WHEN soft THEN ['RULE_BREACH', 'TIMES_TEN', 'SWAP'][case_id % 3 + 1] END AS type, row_number() OVER (ORDER BY p, sha256(case_id::VARCHAR)) AS r, count(*) OVER () AS n FROM cases)"


@query(f"""{_RANKED}, s AS (SELECT share, greatest(1, floor(share * any_value(n) + 0.5))::BIGINT AS k FROM r, (SELECT unnest([{", ".join(f"{s}::DOUBLE" for s in evaluation.SHARES)}]) AS share) GROUP BY share),
t AS (SELECT share, k, count(*) FILTER (soft AND r <= k) AS true_positives, count(*) FILTER (soft) AS p FROM r, s GROUP BY ALL), m AS (SELECT *, true_positives / k::DOUBLE AS a, CASE WHEN p > 0 THEN true_positives / p::DOUBLE ELSE 0 END AS b FROM t)
SELECT share, k, true_positives, round(a, 6) AS precision, round(b, 6) AS recall, round(CASE WHEN a + b > 0 THEN 1.25 * a * b / (0.25 * a + b) ELSE 0 END, 6) AS f0_5 FROM m""")
def ranking_at_shares(spark, d):
    return evaluation.at_shares(_scored(spark, d), [F.col("p"), F.col("h")], "soft").select("share", "k", "true_positives", r6("precision"), r6("recall"), r6("f0_5"))


@query(f"""{_RANKED}, g AS (SELECT 'state' AS subgroup, state AS value, soft, r, n FROM r UNION ALL SELECT 'sector', sector, soft, r, n FROM r UNION ALL SELECT 'type', type, soft, r, n FROM r)
SELECT subgroup, value, count(*) FILTER (soft) AS injected, round(count(*) FILTER (soft AND r <= greatest(1, floor(0.05::DOUBLE * n + 0.5))) / nullif(count(*) FILTER (soft), 0)::DOUBLE, 6) AS recall FROM g WHERE value IS NOT NULL GROUP BY ALL""")
def recall_by_subgroup(spark, d):
    return evaluation.recall_by(_scored(spark, d), [F.col("p"), F.col("h")], "soft", ["state", "sector", "type"]).select("subgroup", "value", "injected", r6("recall"))
