"""Area estimates with design errors, screens of their change, and the known-events calendar."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import tails, values
from plumbline.operators import survey
from plumbline.plans.catalog import query, r6
from plumbline.plans.roles import CASES, RECORDS, cases, records, table
from plumbline.sources.scratch import written

KEYS = ["area_level", "flag", "status", "indicator", "period"]
#: A calendar of known events: id, period, flag or null for all.
EVENTS = [("E1", 7992, None), ("E2", 7996, "A")]

_LONG = RECORDS + """, lng AS (SELECT a.area_level, l_returnflag AS flag, CASE WHEN a.area_level = 'national' THEN '' ELSE l_linestatus END AS status, i.indicator, period, p_brand AS stratum, l_suppkey AS psu, l_quantity AS w, CASE i.indicator WHEN 'rate' THEN (l_discount > 0.05)::INT::DOUBLE ELSE l_extendedprice END AS y
 FROM records, (VALUES ('national'), ('state')) a(area_level), (VALUES ('rate'), ('mean')) i(indicator)),
psu AS (SELECT area_level, flag, status, indicator, period, stratum, psu, sum(w * y) AS wy, sum(w) AS wx, count(*) AS n, sum(y) AS sy, sum(y * y) AS syy FROM lng GROUP BY ALL), d AS (SELECT *, sum(wy) OVER d / sum(wx) OVER d AS ratio, sum(wx) OVER d AS sx FROM psu WINDOW d AS (PARTITION BY area_level, flag, status, indicator, period)),
z AS (SELECT *, (wy - ratio * wx) / sx AS z FROM d), c AS (SELECT *, count(*) OVER s AS h, avg(z) OVER s AS mh, avg(z) OVER d AS m FROM z WINDOW s AS (PARTITION BY area_level, flag, status, indicator, period, stratum), d AS (PARTITION BY area_level, flag, status, indicator, period)),
est AS (SELECT area_level, flag, status, indicator, period, any_value(ratio) AS value, CASE WHEN count(*) >= 2 THEN sqrt(sum(CASE WHEN h > 1 THEN h / (h - 1)::DOUBLE * (z - mh) ** 2 ELSE (z - m) ** 2 END)) END AS se, sum(n)::BIGINT AS n,
 CASE indicator WHEN 'rate' THEN sqrt(any_value(ratio) * (1 - any_value(ratio)) / sum(n)) ELSE CASE WHEN sum(n) > 1 THEN sqrt((sum(syy) - sum(sy) * sum(sy) / sum(n)) / (sum(n) - 1)) / sqrt(sum(n)) END END AS srs_se FROM c GROUP BY area_level, flag, status, indicator, period)"""


#: Rows of a task that sums PSUs; each counts for both levels and both indicators.
ROWS_A_TASK = 250_000


def _estimates(spark, d):
    """The rows are written once, narrow. Those of a PSU meet in one exchange, before they are multiplied by levels and indicators."""
    rows = written(records(spark, d).select(F.col("l_returnflag").alias("flag"), "l_linestatus", "period", "p_brand", "l_suppkey", "l_quantity", "l_discount", "l_extendedprice"), "rows")
    levels = F.explode(F.array(*[F.struct(F.lit(a).alias("area_level"), (F.lit("") if a == "national" else F.col("l_linestatus")).alias("status")) for a in ("national", "state")]))
    kinds = F.explode(F.array(F.struct(F.lit("rate").alias("indicator"), (F.col("l_discount") > 0.05).cast("double").alias("y")), F.struct(F.lit("mean").alias("indicator"), F.col("l_extendedprice").alias("y"))))
    long = lambda r: r.select("*", levels.alias("a")).select("*", kinds.alias("i")).select("a.*", "i.*", "flag", "period", "p_brand", "l_suppkey", "l_quantity")
    dealt = rows.repartition(rows.count() // ROWS_A_TASK + 1, "flag", "period", "p_brand", "l_suppkey")
    return survey.estimates(long(rows), KEYS, "p_brand", "l_suppkey", "y", F.col("l_quantity"), F.col("indicator") == "rate", long(dealt))


@query(f"WITH {_LONG} SELECT area_level, flag, status, indicator, period, n, round(value, 4) AS value, round(se, 4) AS se, round(srs_se, 4) AS srs_se, round((se / srs_se) ** 2, 4) AS design_effect FROM est")
def area_estimates(spark, d):
    e = _estimates(spark, d)
    return e.select(*KEYS, "n", F.round("value", 4).alias("value"), F.round("se", 4).alias("se"), F.round("srs_se", 4).alias("srs_se"), F.round((F.col("se") / F.col("srs_se")) ** 2, 4).alias("design_effect"))


_CHANGES = _LONG + """, ch AS (SELECT *, CASE WHEN lag(period) OVER w = period - 1 THEN value - lag(value) OVER w END AS change, CASE WHEN lag(period) OVER w = period - 1 THEN sqrt(se * se + lag(se) OVER w * lag(se) OVER w) END AS cse, lag(period) OVER w = period - 1 AS cons, least(n, lag(n) OVER w) AS least_n, min(period) OVER () AS first FROM est WINDOW w AS (PARTITION BY area_level, flag, status, indicator ORDER BY period)),
rs AS (SELECT *, CASE WHEN period = first THEN 'NO_EARLIER_PERIOD' WHEN NOT coalesce(cons, false) THEN 'PREVIOUS_PERIOD_MISSING' WHEN least_n < 50 THEN 'SAMPLE_TOO_SMALL' WHEN change IS NULL THEN 'UNDEFINED' END AS reason0 FROM ch),
md AS (SELECT *, CASE WHEN reason0 IS NULL THEN median(change) FILTER (reason0 IS NULL) OVER g END AS med, count(*) FILTER (reason0 IS NULL) OVER g AS k FROM rs WINDOW g AS (PARTITION BY area_level, indicator, period)), mm AS (SELECT *, median(abs(change - med)) FILTER (reason0 IS NULL) OVER (PARTITION BY area_level, indicator, period) AS mad FROM md),
fin AS (SELECT *, CASE WHEN reason0 IS NULL AND k >= 3 AND mad > 0 THEN 0.6745 * (change - med) / mad END AS z, change / cse AS over_se, coalesce(reason0, CASE WHEN NOT (k >= 3 AND mad > 0) THEN 'TOO_FEW_DOMAINS' END) AS reason FROM mm)"""


def _changes(spark, d):
    return survey.changes(_estimates(spark, d), ["area_level", "flag", "status", "indicator"], "period", ["area_level", "indicator", "period"], least_n=50, least_domains=3)


@query(f"WITH {_CHANGES} SELECT area_level, flag, status, indicator, period, reason, round(change, 4) + 0.0 AS change, round(z, 4) + 0.0 AS robust_z, round(over_se, 4) + 0.0 AS change_over_se, coalesce(abs(z) >= 1.0 AND abs(over_se) >= 0.5, false) AS notable FROM fin")
def area_changes(spark, d):
    """The screen with thresholds low enough for these tables to have notable rows; 3.5 and 3.0 are the defaults."""
    c = survey.notable(_changes(spark, d), 1.0, 0.5)
    return c.select(*KEYS, "reason", *[(F.round(c, 4) + 0.0).alias(c) for c in ("change", "robust_z", "change_over_se")], "notable")


@query(f"""WITH {_CHANGES}, ev(id, ep, ef) AS (VALUES ('E1', 7992, NULL), ('E2', 7996, 'A')), s AS (SELECT fin.*, b.value AS was, (SELECT min(id) FROM ev WHERE ep = fin.period AND (ef IS NULL OR ef = fin.flag)) AS event, coalesce(abs(z) >= 1.0 AND abs(over_se) >= 0.5, false) AS hit FROM fin LEFT JOIN est b ON b.area_level = fin.area_level AND b.flag = fin.flag AND b.status = fin.status AND b.indicator = fin.indicator AND b.period = fin.period - 4)
SELECT area_level, flag, status, indicator, period, round(value - was, 4) + 0.0 AS same_season_change, event AS known_event, hit AND event IS NOT NULL AS expected, hit AND event IS NULL AS notable FROM s""")
def known_events(spark, d):
    calendar = spark.createDataFrame(EVENTS, "id string, ep int, ef string")
    c = written(survey.notable(_changes(spark, d), 1.0, 0.5), "changes")  # a row a domain and period, used twice
    own = c.alias("c").join(F.broadcast(calendar), (F.col("ep") == F.col("period")) & (F.col("ef").isNull() | (F.col("ef") == F.col("flag"))), "left").groupBy(*[F.col(f"c.{k}") for k in KEYS]).agg(F.first("value").alias("value"), F.first("notable").alias("hit"), F.min("id").alias("known_event"))
    was = own.select(*[k for k in KEYS if k != "period"], (F.col("period") + 4).alias("period"), F.col("value").alias("was"))
    s = own.join(was, KEYS, "left")
    return s.select(*KEYS, (F.round(F.col("value") - F.col("was"), 4) + 0.0).alias("same_season_change"), "known_event", (F.col("hit") & F.col("known_event").isNotNull()).alias("expected"), (F.col("hit") & F.col("known_event").isNull()).alias("notable"))


@query("""WITH r AS (SELECT *, count(*) OVER w AS n, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS below, count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS le, quantile_cont(o_totalprice, 0.05) OVER w AS lo, quantile_cont(o_totalprice, 0.95) OVER w AS hi FROM orders WINDOW w AS (PARTITION BY o_orderpriority)), p AS (SELECT *, (below + le) / (2.0::DOUBLE * n) AS pos FROM r)
SELECT o_orderkey, CASE WHEN o_totalprice < lo THEN 'LOWER_TAIL' WHEN o_totalprice > hi THEN 'UPPER_TAIL' ELSE 'CENTRAL_REFERENCE_RANGE' END AS distribution_position, round(greatest(0.05 - pos, 0), 6) AS lower_distance, round(greatest(pos - 0.95, 0), 6) AS upper_distance FROM p""")
def distribution_position(spark, d):
    r = tails.described(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice", {"lo": 0.05, "hi": 0.95})
    return tails.positions(r, "o_totalprice", "lo", "hi").select("o_orderkey", "distribution_position", r6("lower_distance"), r6("upper_distance"))


@query("""WITH s AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS std, min(l_extendedprice) AS low, max(l_extendedprice) AS high, quantile_cont(l_extendedprice, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q FROM lineitem GROUP BY 1)
SELECT l_returnflag, n, round(mean, 4) AS mean, round(std, 4) AS std, low, high, round(q[1], 4) AS q05, round(q[2], 4) AS q25, round(q[3], 4) AS q50, round(q[4], 4) AS q75, round(q[5], 4) AS q95 FROM s""")
def value_summary(spark, d):
    t = table(spark, d, "lineitem")
    ps = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}
    q = tails.quantiles(t, ["l_returnflag"], "l_extendedprice", ps, spread=True).drop("n")
    v = F.col("l_extendedprice")
    s = t.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_samp(v), 4).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"))
    return s.join(q, "l_returnflag").select("l_returnflag", "n", "mean", "std", "low", "high", *[F.round(k, 4).alias(k) for k in ps])


@query(f"WITH {CASES}, s AS (SELECT state, count(*) AS n, 1000 * avg((p <= 0.02)::INT) AS per_1000 FROM cases GROUP BY 1), b AS (SELECT *, max(per_1000) OVER () / median(per_1000) OVER () AS worst FROM s WHERE n >= 1000) SELECT state, n, round(per_1000, 4) AS per_1000, round(worst, 4) AS worst_over_median FROM b")
def burden_report(spark, d):
    """A row a state of 1,000 rows or more; the last windows are over states only."""
    s = cases(spark, d).groupBy("state").agg(F.count("*").alias("n"), (1000 * F.avg((F.col("p") <= 0.02).cast("int"))).alias("per_1000")).where("n >= 1000")
    worst = s.agg((F.max("per_1000") / F.median("per_1000")).alias("worst"))
    return s.join(F.broadcast(worst)).select("state", "n", F.round("per_1000", 4).alias("per_1000"), F.round("worst", 4).alias("worst_over_median"))


@query("SELECT o_orderkey, ((o_orderkey * 7) % 97 // 5)::INTEGER AS age_band_5, least((o_orderkey * 7) % 97 // 10, 8)::INTEGER AS age_band_10 FROM orders")
def age_bands(spark, d):
    age = (F.col("o_orderkey") * 7) % 97
    return table(spark, d, "orders").select("o_orderkey", values.age_band(age, 5, 100).alias("age_band_5"), values.age_band(age, 10, 8).alias("age_band_10"))
