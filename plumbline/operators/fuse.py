"""Fusing evidence into a bounded queue. The greedy queue is a few running sums over ranges; see the docstrings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.tails import sidak
from plumbline.sources.scratch import numbered, running, written


def variable_evidence(df: DataFrame, threshold: float = 0.01) -> DataFrame:
    """p_current, p_history, p_model, n_current, n_history -> p_ref, p, lead.

    The reference mechanism is the mean of the p-values there are; it is dropped where its least possible value (the
    mean of 2 / (n + 1)) exceeds the threshold and the model is there. Šidák over what counts."""
    p1, p2, pm = F.col("p_current"), F.col("p_history"), F.col("p_model")
    floor1, floor2 = 2 / (F.col("n_current") + 1), 2 / (F.col("n_history") + 1)
    mean = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), (a + b) / 2).otherwise(F.coalesce(a, b))
    ref = mean(p1, p2)
    floor = mean(F.when(p1.isNotNull(), floor1), F.when(p2.isNotNull(), floor2))
    testable = ref.isNotNull() & ~F.coalesce(floor > threshold, F.lit(False))
    use_ref = testable | pm.isNull()
    k = F.when(ref.isNotNull() & use_ref, 1).otherwise(0) + F.when(pm.isNotNull(), 1).otherwise(0)
    best = F.least(F.when(use_ref, ref), pm)
    return df.withColumns({"p_ref": ref, "p": F.when(k > 0, sidak(best, k)), "lead": F.when(best == pm, "MODEL").when(best.isNotNull(), "REFERENCE"), "testable": testable | pm.isNotNull()})


def record_evidence(df: DataFrame, unit: list[str], variable: str) -> DataFrame:
    """A record's p: Šidák of its least variable over its testable variables (all assessed ones if none is)."""
    k = F.when(F.count_if(F.col("testable") & F.col("p").isNotNull()) > 0, F.count_if(F.col("testable") & F.col("p").isNotNull())).otherwise(F.count("p"))
    best = F.min(F.when(F.col("p").isNotNull() & F.col("testable"), F.struct("p", variable)))
    every = F.min(F.when(F.col("p").isNotNull(), F.struct("p", variable)))
    g = df.groupBy(*unit).agg(k.alias("k"), F.coalesce(best, every).alias("_b"))
    return g.withColumns({"record_p": sidak(F.col("_b.p"), F.col("k")), "lead_variable": F.col(f"_b.{variable}")}).drop("_b")


def tiers(df: DataFrame, budget: int, threshold: float, cap: int = 10, coding_budget: int = 0, factor: float = 5.0, multiplier: int = 2) -> DataFrame:
    """case_id, cluster, p, coding_p, hard, soft -> tier and reason.

    Hard rules are A. Value candidates (p at most the threshold) in order (p, id): r is the place within the cluster,
    ok = r <= cap, `before` the number of ok candidates earlier; A if ok and before < budget, else B (budget first,
    then cap). Coding candidates not yet A have a budget of their own. Soft rules are B. The next band (ratio at most
    `factor`) fills B up to multiplier * budget."""
    c = df.withColumn("_v", ~F.col("hard") & F.coalesce(F.col("p") <= threshold, F.lit(False)))
    in_cluster = Window.partitionBy("_v", "cluster").orderBy("p", "case_id")
    c = c.withColumn("_ok", F.col("_v") & ((F.row_number().over(in_cluster) <= cap) | F.lit(cap == 0)))
    cand = c.where("_v")
    cand = running(cand, [F.col("p"), F.col("case_id")], {"_before": F.col("_ok").cast("int")})
    value = cand.select("case_id", F.when(F.col("_ok") & (F.col("_before") < budget), "A").otherwise("B").alias("_t"), F.when(F.col("_ok") & (F.col("_before") < budget), "VALUE").when(F.col("_before") >= budget, "BUDGET").otherwise("CAP").alias("_r"))
    t = df.join(value, "case_id", "left").withColumns({"tier": F.when(F.col("hard"), "A").otherwise(F.col("_t")), "reason": F.when(F.col("hard"), "RULE").otherwise(F.col("_r"))}).drop("_t", "_r")
    coding = t.where(F.coalesce(F.col("coding_p") <= threshold, F.lit(False)) & ~F.col("tier").eqNullSafe("A"))
    ranked = numbered(coding.select("case_id", "coding_p"), [F.col("coding_p"), F.col("case_id")], "_k").select("case_id", "_k")
    t = t.join(ranked, "case_id", "left").withColumns({
        "tier": F.when(F.col("_k") <= coding_budget, "A").when(F.col("_k").isNotNull(), "B").otherwise(F.col("tier")),
        "reason": F.when(F.col("_k") <= coding_budget, "CODING").when(F.col("_k").isNotNull(), "CODING_BUDGET").otherwise(F.col("reason"))}).drop("_k")
    t = t.withColumns({"reason": F.when(F.col("tier").isNull() & F.col("soft"), "RULE_SOFT").otherwise(F.col("reason")), "tier": F.when(F.col("tier").isNull() & F.col("soft"), "B").otherwise(F.col("tier"))})
    t = written(t, "tiers")
    in_b = t.agg(F.count_if(F.col("tier") == "B").alias("_in_b"))
    band = t.where(F.col("tier").isNull() & (F.col("p") / threshold <= factor)).select("case_id", "p")
    band = numbered(band, [F.col("p"), F.col("case_id")], "_k").select("case_id", "_k")
    t = t.join(band, "case_id", "left").join(F.broadcast(in_b))
    next_band = F.col("_k") <= F.lit(multiplier * budget) - F.col("_in_b")
    return t.withColumns({"reason": F.when(F.col("tier").isNull() & next_band, "NEXT").otherwise(F.col("reason")), "tier": F.coalesce(F.col("tier"), F.when(next_band, "B"), F.when(F.col("p").isNull(), "NOT_ASSESSABLE"), F.lit("NONE"))}).drop("_k", "_in_b")


def positions(df: DataFrame, impact: str) -> DataFrame:
    """Queue position: tier, rules first, greater impact first (A and B), p, id."""
    tier = F.when(F.col("tier") == "A", 0).when(F.col("tier") == "B", 1).when(F.col("tier") == "NONE", 2).otherwise(3)
    strong = F.when(F.col("tier").isin("A", "B"), -F.col(impact)).otherwise(0.0)
    keyed = df.withColumns({"_t": tier, "_r": (~F.col("hard")).cast("int"), "_s": strong})
    return numbered(keyed, [F.col("_t"), F.col("_r"), F.col("_s"), F.col("p").asc_nulls_last(), F.col("case_id")], "position").drop("_t", "_r", "_s")
