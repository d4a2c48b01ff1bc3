"""The review layer: the data-driven predicate, decisions, evidence by case, and short texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.plans.catalog import _TIERS, _tiers, query, r6
from plumbline.plans.roles import CASES, cases, table

#: Columns a filter may name, and the rank from which evidence counts as strong.
FILTERS = ("state", "sector", "tier", "reason")
UNUSUAL = 0.95
LIKE = ("case_id", "cluster", "state")


def predicate(filters: dict) -> Column:
    """All of: equality on FILTERS; lane (a member of the comma-joined lanes); strong (impact rank); query (part of LIKE columns, any case)."""
    tests = [F.col(k) == v for k, v in filters.items() if k in FILTERS and v]
    if filters.get("lane"):
        tests.append(F.array_contains(F.split(F.coalesce("lanes", F.lit("")), ","), filters["lane"]))
    if filters.get("strong"):
        tests.append(F.col("impact_rank") >= UNUSUAL)
    if filters.get("query"):
        text = filters["query"].replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        tests.append(reduce(lambda a, b: a | b, [F.col(c).cast("string").ilike(f"%{text}%") for c in LIKE]))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def reviewed(df: DataFrame, decisions: DataFrame, status: str) -> DataFrame:
    """df by its latest decision (case_id, decision): UNREVIEWED, REVIEWED, or one decision. The ids are joined, never listed."""
    if status == "UNREVIEWED":
        return df.join(decisions, "case_id", "left_anti")
    return df.join(decisions if status == "REVIEWED" else decisions.where(F.col("decision") == status), "case_id", "left_semi")


def _decisions(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("case_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("decision"))


_DECIDED = "dec AS (SELECT user_id AS case_id, arg_max(event_type, (ts, event_id)) AS decision FROM events GROUP BY 1)"
_LANES = "concat_ws(',', CASE WHEN hard THEN 'RULE' END, CASE WHEN p <= 0.02 THEN 'VALUE' END, CASE WHEN coding_p <= 0.02 THEN 'CODING' END)"


def _listed(spark, d):
    w = Window.partitionBy("state").orderBy("impact")
    n = F.count("*").over(Window.partitionBy("state"))
    lanes = F.concat_ws(",", F.when(F.col("hard"), "RULE"), F.when(F.col("p") <= 0.02, "VALUE"), F.when(F.col("coding_p") <= 0.02, "CODING"))
    return _tiers(spark, d).withColumns({"lanes": lanes, "impact_rank": (F.rank().over(w) + F.count("*").over(w.rangeBetween(Window.unboundedPreceding, 0))) / (2.0 * n)})


@query(f"""WITH {_TIERS}, l AS (SELECT *, {_LANES} AS lanes, (rank() OVER w + count(*) OVER w) / (2.0::DOUBLE * count(*) OVER (PARTITION BY state)) AS impact_rank FROM tiers WINDOW w AS (PARTITION BY state ORDER BY impact))
SELECT case_id, tier, lanes FROM l WHERE tier <> 'NONE' AND list_contains(string_split(coalesce(lanes, ''), ','), 'VALUE') AND impact_rank >= 0.95 AND (case_id::VARCHAR ILIKE '%1%' OR cluster::VARCHAR ILIKE '%1%' OR state ILIKE '%1%')""")
def review_filter(spark, d):
    return _listed(spark, d).where("tier <> 'NONE'").where(predicate({"lane": "VALUE", "strong": True, "query": "1"})).select("case_id", "tier", "lanes")


@query(f"WITH {CASES}, {_DECIDED} SELECT case_id, state FROM cases WHERE case_id IN (SELECT case_id FROM dec WHERE decision = 'click')")
def reviewed_cases(spark, d):
    return reviewed(cases(spark, d), _decisions(spark, d), "click").select("case_id", "state")


@query(f"WITH {CASES}, {_DECIDED} SELECT case_id, state FROM cases WHERE case_id NOT IN (SELECT case_id FROM dec)")
def unreviewed_cases(spark, d):
    return reviewed(cases(spark, d), _decisions(spark, d), "UNREVIEWED").select("case_id", "state")


@query(f"WITH {CASES}, g AS (SELECT state, sector, cluster, count(*) AS group_n, min(p) AS group_min_p FROM cases GROUP BY ALL HAVING count(*) >= 10) SELECT case_id, group_n, round(group_min_p, 6) AS group_min_p FROM cases LEFT JOIN g USING (state, sector, cluster)")
def case_group_context(spark, d):
    c, keys = cases(spark, d), ["state", "sector", "cluster"]
    g = c.groupBy(*keys).agg(F.count("*").alias("group_n"), F.min("p").alias("group_min_p")).where("group_n >= 10")
    return c.join(g, keys, "left").select("case_id", "group_n", r6("group_min_p"))


def strength(p: Column) -> Column:
    return F.when(p <= 0.001, "very strong").when(p <= 0.01, "strong").when(p <= 0.05, "moderate").otherwise("weak")


_STRENGTH = "CASE WHEN {0} <= 0.001 THEN 'very strong' WHEN {0} <= 0.01 THEN 'strong' WHEN {0} <= 0.05 THEN 'moderate' ELSE 'weak' END"


@query(f"""WITH {_TIERS}, q AS (SELECT * FROM tiers WHERE tier IN ('A', 'B')) SELECT case_id, 'VALUE' AS card, {_STRENGTH.format('p')} AS strength, round(p, 6) AS p FROM q WHERE p <= 0.05 UNION ALL SELECT case_id, 'CODING', {_STRENGTH.format('coding_p')}, round(coding_p, 6) FROM q WHERE coding_p <= 0.05 UNION ALL SELECT case_id, 'RULE', 'very strong', NULL FROM q WHERE hard""")
def evidence_cards(spark, d):
    q = _tiers(spark, d).where(F.col("tier").isin("A", "B"))
    card = lambda when, name, s, p: F.when(when, F.struct(F.lit(name).alias("card"), s.alias("strength"), F.round(p, 6).alias("p")))
    cards = F.array_compact(F.array(card(F.col("p") <= 0.05, "VALUE", strength(F.col("p")), F.col("p")), card(F.col("coding_p") <= 0.05, "CODING", strength(F.col("coding_p")), F.col("coding_p")), card(F.col("hard"), "RULE", F.lit("very strong"), F.lit(None).cast("double"))))
    return q.select("case_id", F.explode(cards).alias("c")).select("case_id", "c.*")


def hint(value: Column, typical: Column) -> Column:
    """A keying slip that would explain the value: the first of these factors that brings it near the typical one."""
    tests = [(name, F.abs(value * f - typical) <= 0.1 * typical) for name, f in (("TEN_TIMES", 0.1), ("HUNDRED_TIMES", 0.01), ("YEAR_FOR_MONTH", 1 / 12), ("TENTH", 10.0))]
    return F.coalesce(*[F.when(t, name) for name, t in tests])


@query(f"""WITH {_TIERS}, t AS (SELECT state, median(impact) AS typical FROM cases GROUP BY 1)
SELECT case_id, round(typical, 4) AS typical, CASE WHEN abs(impact * 0.1::DOUBLE - typical) <= 0.1 * typical THEN 'TEN_TIMES' WHEN abs(impact * 0.01::DOUBLE - typical) <= 0.1 * typical THEN 'HUNDRED_TIMES' WHEN abs(impact * (1 / 12.0::DOUBLE) - typical) <= 0.1 * typical THEN 'YEAR_FOR_MONTH' WHEN abs(impact * 10 - typical) <= 0.1 * typical THEN 'TENTH' END AS hint,
 concat_ws(',', CASE WHEN hard THEN 'rule' END, CASE WHEN p <= 0.05 THEN 'value:' || {_STRENGTH.format('p')} END, CASE WHEN coding_p <= 0.05 THEN 'coding:' || {_STRENGTH.format('coding_p')} END) AS checks FROM tiers JOIN t USING (state) WHERE tier = 'A'""")
def case_story(spark, d):
    """The checks found for each case to be checked now, only from evidence there is, with a keying hint."""
    from plumbline.functions import tails

    typical = tails.quantiles(cases(spark, d), ["state"], "impact", {"typical": 0.5}, spread=True).drop("n")
    q = _tiers(spark, d).where("tier = 'A'").join(typical, "state")
    checks = F.concat_ws(",", F.when(F.col("hard"), "rule"), F.when(F.col("p") <= 0.05, F.concat(F.lit("value:"), strength(F.col("p")))), F.when(F.col("coding_p") <= 0.05, F.concat(F.lit("coding:"), strength(F.col("coding_p")))))
    return q.select("case_id", F.round("typical", 4).alias("typical"), hint(F.col("impact"), F.col("typical")).alias("hint"), checks.alias("checks"))


@query(f"""WITH {_TIERS}, ids AS (SELECT DISTINCT user_id AS case_id FROM events) SELECT case_id, tier || ' ' || coalesce(reason, '-') || ': ' || state || ', cluster ' || cluster AS summary FROM ids JOIN tiers USING (case_id)""")
def row_summaries(spark, d):
    ids = table(spark, d, "events").select(F.col("user_id").alias("case_id")).distinct()
    text = F.concat(F.col("tier"), F.lit(" "), F.coalesce("reason", F.lit("-")), F.lit(": "), F.col("state"), F.lit(", cluster "), F.col("cluster").cast("string"))
    return ids.join(_tiers(spark, d), "case_id").select("case_id", text.alias("summary"))


@query("SELECT o_orderpriority, round(100 * avg((o_totalprice <= 180000)::INT), 4) AS percentile, sum((o_totalprice <= 180000)::INT)::BIGINT AS position, count(*) AS n FROM orders GROUP BY 1")
def weight_percentile(spark, d):
    hit = (F.col("o_totalprice") <= 180000).cast("int")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(100 * F.avg(hit), 4).alias("percentile"), F.sum(hit).alias("position"), F.count("*").alias("n"))


@query("SELECT name, n FROM (SELECT o_orderstatus AS name, count(*) AS n FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1) ORDER BY n DESC, name LIMIT 10")
def top_states(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderpriority").like("1%")).groupBy(F.col("o_orderstatus").alias("name")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "name").limit(10)


# Evaluation


@query(f"WITH {CASES} SELECT case_id, round(-log10(greatest(least(p, coalesce(coding_p, 1)), 1e-300)), 6) + 0.0 AS score_all, round(-log10(greatest(p, 1e-300)), 6) + 0.0 AS score_value, round(CASE WHEN coding_p IS NOT NULL THEN -log10(greatest(coding_p, 1e-300)) END, 6) + 0.0 AS score_coding FROM cases")
def design_scores(spark, d):
    score = lambda c: F.round(-F.log10(F.greatest(c, F.lit(1e-300))), 6) + 0.0
    return cases(spark, d).select("case_id", score(F.least("p", F.coalesce("coding_p", F.lit(1.0)))).alias("score_all"), score(F.col("p")).alias("score_value"), F.when(F.col("coding_p").isNotNull(), score(F.col("coding_p"))).alias("score_coding"))


@query(f"WITH {CASES}, i AS (SELECT *, CASE WHEN soft THEN CASE case_id % 3 WHEN 0 THEN 'RULE_BREACH' WHEN 1 THEN 'TIMES_TEN' ELSE 'SWAP' END END AS injected FROM cases) SELECT injected, count(*) AS n, count(*) FILTER (hard OR injected = 'RULE_BREACH') AS found, round(avg((hard OR injected = 'RULE_BREACH')::INT), 6) AS recall FROM i WHERE injected IS NOT NULL GROUP BY 1")
def rule_recall(spark, d):
    i = cases(spark, d).where("soft").withColumn("injected", F.element_at(F.array(F.lit("RULE_BREACH"), F.lit("TIMES_TEN"), F.lit("SWAP")), (F.col("case_id") % 3 + 1).cast("int")))
    hit = F.col("hard") | (F.col("injected") == "RULE_BREACH")
    return i.groupBy("injected").agg(F.count("*").alias("n"), F.count_if(hit).alias("found"), F.round(F.avg(hit.cast("int")), 6).alias("recall"))


_HITS = """k AS (SELECT greatest(1, round(0.05 * count(*))) AS k FROM cases), ra AS (SELECT *, row_number() OVER (ORDER BY p, sha256(case_id::VARCHAR)) AS ka, row_number() OVER (ORDER BY coalesce(coding_p, 2), sha256(case_id::VARCHAR)) AS kb FROM cases),
h AS (SELECT row_number() OVER (ORDER BY case_id) - 1 AS i, (ka <= k)::INT AS a, (kb <= k)::INT AS b FROM ra, k WHERE soft)"""


@query(f"""WITH {CASES}, {_HITS}, n AS (SELECT count(*) AS n FROM h), dr AS (SELECT r.range AS r, ('0x' || substr(md5(r.range || '|' || s.range), 1, 8))::BIGINT % n AS i FROM range(500) r, n, range((SELECT n FROM n)) s), m AS (SELECT r, avg(a) - avg(b) AS diff FROM dr JOIN h USING (i) GROUP BY 1)
SELECT round((SELECT avg(a) - avg(b) FROM h), 6) AS difference, round(quantile_cont(diff, 0.025), 6) AS low, round(quantile_cont(diff, 0.975), 6) AS high FROM m""")
def bootstrap_difference(spark, d):
    """Recall in the first 5% of one score less another's, with a paired percentile interval: the positives are drawn anew 500
    times, by hash, so both scores share each draw and reruns agree. Only hits of positives are resampled."""
    from plumbline.sources.scratch import numbered, written

    c = written(cases(spark, d).select("case_id", "soft", "p", F.coalesce("coding_p", F.lit(2.0)).alias("c"), F.sha2(F.col("case_id").cast("string"), 256).alias("h")), "scores")
    k = max(1, round(0.05 * c.count()))
    hit = lambda s, name: numbered(c, [F.col(s), F.col("h")], "_k").where("soft").select("case_id", (F.col("_k") <= k).cast("int").alias(name))
    h = numbered(hit("p", "a").join(hit("c", "b"), "case_id"), [F.col("case_id")], "i").select((F.col("i") - 1).alias("i"), "a", "b")
    n = h.count()
    draw = F.conv(F.substring(F.md5(F.concat(F.col("r").cast("string"), F.lit("|"), F.col("s").cast("string"))), 1, 8), 16, 10).cast("long") % n
    draws = spark.range(500).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("s")).select("r", draw.alias("i"))
    m = draws.join(h, "i").groupBy("r").agg((F.avg("a") - F.avg("b")).alias("diff"))
    one = h.agg(F.round(F.avg("a") - F.avg("b"), 6).alias("difference"))
    return one.join(F.broadcast(m.agg(F.round(F.percentile("diff", 0.025), 6).alias("low"), F.round(F.percentile("diff", 0.975), 6).alias("high"))))
