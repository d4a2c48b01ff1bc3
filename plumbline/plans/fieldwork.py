"""Cluster tests that need more than one pass: standardised mix, spread, duration, transitions, dispersion."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import clusters
from plumbline.plans.catalog import query, r6
from plumbline.plans.roles import RECORDS, records, table

CELL = ["l_returnflag"]
_GATE = "CASE WHEN n = 0 THEN 'GROUP_EMPTY' WHEN n < 10 THEN 'GROUP_BELOW_MINIMUM' WHEN ref_n < 30 THEN 'REFERENCE_BELOW_MINIMUM' END"


@query(f"""WITH {RECORDS}, t AS (SELECT l_returnflag, l_suppkey, p_type AS band, l_linenumber AS code, count(*)::DOUBLE AS o FROM records GROUP BY ALL),
cl AS (SELECT l_returnflag, l_suppkey, sum(o) AS n FROM t GROUP BY ALL), ce AS (SELECT l_returnflag, sum(o) AS total, count(DISTINCT code) AS k FROM t GROUP BY 1), cc AS (SELECT l_returnflag, code, sum(o) AS c FROM t GROUP BY ALL),
cb AS (SELECT l_returnflag, band, sum(o) AS b FROM t GROUP BY ALL), cbc AS (SELECT l_returnflag, band, code, sum(o) AS bc FROM t GROUP BY ALL), own AS (SELECT l_returnflag, l_suppkey, code, sum(o) AS oc FROM t GROUP BY ALL), ob AS (SELECT l_returnflag, l_suppkey, band, sum(o) AS nb FROM t GROUP BY ALL),
g AS (SELECT ob.l_returnflag, ob.l_suppkey, n, total, k, nb, ob.band, cc.code, c, b, coalesce(bc, 0) AS bc, coalesce(t.o, 0) AS o, coalesce(oc, 0) AS oc FROM ob JOIN cl USING (l_returnflag, l_suppkey) JOIN ce USING (l_returnflag) JOIN cb USING (l_returnflag, band) JOIN cc USING (l_returnflag)
 LEFT JOIN cbc ON cbc.l_returnflag = ob.l_returnflag AND cbc.band = ob.band AND cbc.code = cc.code LEFT JOIN t ON t.l_returnflag = ob.l_returnflag AND t.l_suppkey = ob.l_suppkey AND t.band = ob.band AND t.code = cc.code LEFT JOIN own ON own.l_returnflag = ob.l_returnflag AND own.l_suppkey = ob.l_suppkey AND own.code = cc.code),
e AS (SELECT l_returnflag, l_suppkey, code, any_value(n) AS n, any_value(total) - any_value(n) AS ref_n, any_value(k) AS k, any_value(oc) AS o, sum(nb * (bc - o + 10 * (c - oc + 0.5) / (total - n + 0.5 * k)) / (b - nb + 10)) AS e FROM g GROUP BY ALL)
SELECT l_returnflag, l_suppkey, any_value(n)::BIGINT AS n, any_value({_GATE}) AS reason, round(CASE WHEN any_value({_GATE}) IS NULL THEN greatest(sum(CASE WHEN o > 0 THEN 2 * o * ln(o / e) ELSE 0 END), 0) / (1 + (any_value(k) + 1) / (6.0::DOUBLE * any_value(n))) END, 5) AS g FROM e GROUP BY 1, 2""")
def standardised_mix(spark, d):
    g = clusters.standardised_mix(records(spark, d), CELL, "l_suppkey", "p_type", "l_linenumber", 10.0)
    return g.select(*CELL, "l_suppkey", "n", "reason", F.round("g", 5).alias("g"))


@query(f"""WITH c AS (SELECT l_returnflag, l_suppkey, count(*) AS n, median(l_extendedprice) AS med FROM lineitem GROUP BY ALL), j AS (SELECT a.l_returnflag, a.l_suppkey, a.n, a.med, r.l_extendedprice AS v, r.l_suppkey = a.l_suppkey AS own FROM c a JOIN lineitem r USING (l_returnflag)),
q AS (SELECT l_returnflag, l_suppkey, any_value(n) AS n, any_value(med) AS med, count(*) FILTER (NOT own) AS ref_n, quantile_cont(v, 0.5) FILTER (NOT own) AS rmed, (quantile_cont(v, 0.75) FILTER (NOT own) - quantile_cont(v, 0.25) FILTER (NOT own)) / 2 AS half FROM j GROUP BY 1, 2),
s AS (SELECT l_returnflag, l_suppkey, any_value(q.n) AS n, any_value(ref_n) AS ref_n, count(*) FILTER (own AND abs(v - q.med) <= half) AS inside, (count(*) FILTER (NOT own AND abs(v - rmed) <= half))::DOUBLE / any_value(ref_n) AS expected FROM j JOIN q USING (l_returnflag, l_suppkey) GROUP BY 1, 2)
SELECT l_returnflag, l_suppkey, n, {_GATE} AS reason, CASE WHEN {_GATE} IS NULL THEN inside END AS inside, round(CASE WHEN {_GATE} IS NULL THEN expected END, 6) AS expected FROM s""")
def reduced_spread(spark, d):
    """Quantiles of "the rest" of a cell come from counts by value less the cluster's own: no copy of the cell a cluster."""
    g = clusters.reduced_spread(table(spark, d, "lineitem"), CELL, "l_suppkey", "l_extendedprice")
    return g.select(*CELL, "l_suppkey", "n", "reason", "inside", r6("expected"))


@query(f"""WITH r AS (SELECT *, rank() OVER w - 1 AS lt, count(*) OVER w AS le, count(*) OVER (PARTITION BY l_returnflag) AS total FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_discount)),
t AS (SELECT *, sum((le - lt)::DOUBLE ** 2 - 1) OVER (PARTITION BY l_returnflag) AS ties FROM r), g AS (SELECT l_returnflag, l_suppkey, count(*) AS n, any_value(total) - count(*) AS ref_n, sum((lt + le + 1) / 2.0::DOUBLE) AS r1, any_value(ties) AS ties FROM t GROUP BY 1, 2),
u AS (SELECT *, n * ref_n - (r1 - n * (n + 1) / 2.0::DOUBLE) AS u2, sqrt(n * ref_n / 12.0::DOUBLE * ((n + ref_n + 1) - ties / ((n + ref_n) * (n + ref_n - 1)))) AS sigma FROM g)
SELECT l_returnflag, l_suppkey, n, {_GATE} AS reason, round(CASE WHEN {_GATE} IS NULL THEN (u2 - n * ref_n / 2.0::DOUBLE - 0.5) / sigma END, 5) AS z FROM u""")
def duration_u(spark, d):
    """One-sided Mann-Whitney: is a cluster's value shorter than the rest of its cell?"""
    g = clusters.rank_sums(table(spark, d, "lineitem"), CELL, "l_suppkey", "l_discount").withColumn("reason", clusters.gate(F.col("n1"), F.col("n2")))
    z = (F.col("u2") - F.col("n1") * F.col("n2") / 2 - 0.5) / F.col("sigma")
    return g.select(*CELL, "l_suppkey", F.col("n1").alias("n"), "reason", F.round(F.when(F.col("reason").isNull(), z), 5).alias("z"))


@query("""WITH own AS (SELECT user_id % 10 AS cell, user_id, event_type AS code, count(*) AS o FROM events GROUP BY ALL), codes AS (SELECT cell, code, sum(o) AS c FROM own GROUP BY 1, 2), cl AS (SELECT cell, user_id, sum(o) AS n FROM own GROUP BY 1, 2), tot AS (SELECT cell, sum(n) AS total FROM cl GROUP BY 1),
f AS (SELECT cl.cell, cl.user_id, n, total - n AS ref_n, coalesce(o, 0) AS o, c - coalesce(o, 0) + 0.5::DOUBLE AS r FROM cl JOIN tot USING (cell) JOIN codes USING (cell) LEFT JOIN own ON own.cell = cl.cell AND own.user_id = cl.user_id AND own.code = codes.code),
s AS (SELECT *, sum(r) OVER w AS s, count(*) OVER w AS k FROM f WINDOW w AS (PARTITION BY cell, user_id))
SELECT user_id, any_value(n)::BIGINT AS n, any_value(""" + _GATE + """) AS reason, round(CASE WHEN any_value(""" + _GATE + """) IS NULL THEN greatest(sum(CASE WHEN o > 0 THEN 2 * o * ln(o / (n * r / s)) ELSE 0 END), 0) / (1 + (any_value(k) + 1) / (6.0::DOUBLE * any_value(n))) END, 5) AS g FROM s GROUP BY user_id""")
def response_mix(spark, d):
    g = clusters.g_test(table(spark, d, "events").withColumn("cell", F.col("user_id") % 10), ["cell"], "user_id", "event_type")
    total = g.groupBy("cell").agg(F.sum("n").alias("total"))
    g = g.join(total, "cell").withColumn("reason", clusters.gate(F.col("n"), F.col("total") - F.col("n")))
    return g.select("user_id", "n", "reason", F.round(F.when(F.col("reason").isNull(), F.col("g")), 5).alias("g"))


_TRANSITIONS = """o AS (SELECT o_orderpriority, o_custkey % 100 AS cluster, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS change FROM orders), c AS (SELECT * FROM o WHERE change IS NOT NULL),
q AS (SELECT o_orderpriority, quantile_cont(change, 0.05) AS lo, quantile_cont(change, 0.95) AS hi FROM c GROUP BY 1), h AS (SELECT o_orderpriority, cluster, count(*) AS n, sum((change < lo OR change > hi)::INT)::BIGINT AS k FROM c JOIN q USING (o_orderpriority) GROUP BY 1, 2),
r AS (SELECT *, (sum(n) OVER (PARTITION BY o_orderpriority) - n)::BIGINT AS ref_n, (sum(k) OVER (PARTITION BY o_orderpriority) - k)::BIGINT AS ref_k FROM h)"""


@query(f"WITH {_TRANSITIONS} SELECT o_orderpriority, cluster, n, k, {_GATE} AS reason, round(CASE WHEN {_GATE} IS NULL THEN ref_k::DOUBLE / ref_n END, 6) AS ref_share FROM r")
def revisit_transitions(spark, d):
    """Share of a cluster's changes in the tails of their group (two-sided exact binomial: special.binom_two_sided)."""
    from pyspark.sql import Window

    from plumbline.functions import tails

    o = table(spark, d, "orders").withColumn("change", F.col("o_totalprice") - F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).where("change is not null").withColumn("cluster", F.col("o_custkey") % 100)
    q = tails.quantiles(o, ["o_orderpriority"], "change", {"lo": 0.05, "hi": 0.95}, spread=True).drop("n")
    s = clusters.share_test(o.join(q, "o_orderpriority"), ["o_orderpriority"], "cluster", (F.col("change") < F.col("lo")) | (F.col("change") > F.col("hi"))).withColumn("reason", clusters.gate(F.col("n"), F.col("rest_n")))
    return s.select("o_orderpriority", "cluster", "n", "k", "reason", F.round(F.when(F.col("reason").isNull(), F.col("rest_share")), 6).alias("ref_share"))


@query("""WITH r AS (SELECT *, rank() OVER w - 1 AS lt, count(*) OVER w AS le, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity)),
t AS (SELECT *, sum((le - lt)::DOUBLE ** 2 - 1) OVER (PARTITION BY l_returnflag) AS ties FROM r), g AS (SELECT l_returnflag, l_suppkey, count(*) AS n1, any_value(n) - count(*) AS n2, sum((lt + le + 1) / 2.0::DOUBLE) AS r1, any_value(ties) AS ties FROM t GROUP BY 1, 2),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0::DOUBLE AS u1, sqrt(n1 * n2 / 12.0::DOUBLE * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sigma FROM g), z AS (SELECT l_returnflag, greatest(0, (greatest(u1, n1 * n2 - u1) - n1 * n2 / 2.0::DOUBLE - 0.5) / sigma) AS z FROM u)
SELECT l_returnflag, count(*) AS n_clusters, round(CASE WHEN count(*) >= 10 THEN greatest(1.0::DOUBLE, median(z * z) / 0.454936) ELSE 1.0::DOUBLE END, 5) AS phi FROM z GROUP BY 1""")
def over_dispersion(spark, d):
    """Dispersion factor of a family of tests from their one-degree chi-square equivalents."""
    g = clusters.rank_sums(table(spark, d, "lineitem"), CELL, "l_suppkey", "l_quantity").withColumn("chi", F.greatest(F.lit(0.0), F.col("z")) ** 2)
    return clusters.dispersion(g, CELL, "chi").select(*CELL, "n_clusters", F.round("phi", 5).alias("phi"))
