"""Cluster tests against the rest of the cell: reference counts are cell totals less the cluster's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.scratch import beside, met_by, numbered, running, written


def g_test(df: DataFrame, cell: list[str], cluster: str, code: str) -> DataFrame:
    """G with Williams' correction of a cluster's code counts against leave-out shares (+0.5), its degrees of freedom and the largest difference."""
    own = df.groupBy(*cell, cluster, code).agg(F.count("*").alias("_o"))
    codes = written(own.groupBy(*cell, code).agg(F.sum("_o").alias("_c")), "codes")  # a row a code, of known size, so a short list is broadcast
    clusters = own.groupBy(*cell, cluster).agg(F.sum("_o").alias("n"))
    full = clusters.join(codes, cell).join(own, [*cell, cluster, code], "left").withColumn("_o", F.coalesce("_o", F.lit(0)))
    w = Window.partitionBy(*cell, cluster)
    r = full.withColumn("_r", F.col("_c") - F.col("_o") + 0.5).withColumns({"_s": F.sum("_r").over(w), "k": F.count("*").over(w)})
    e = F.col("n") * F.col("_r") / F.col("_s")
    part = F.when(F.col("_o") > 0, 2 * F.col("_o") * F.log(F.col("_o") / e)).otherwise(0.0)
    g = r.withColumn("_d", F.col("_o") / F.col("n") - F.col("_r") / F.col("_s")).groupBy(*cell, cluster).agg(
        F.first("n").alias("n"), F.first("k").alias("k"), F.sum(part).alias("g_raw"), F.max(F.struct(F.abs("_d").alias("a"), F.col(code).alias("c"))).alias("_m"))
    williams = 1 + (F.col("k") + 1) / (6 * F.col("n"))
    return g.withColumns({"g": F.greatest(F.col("g_raw"), F.lit(0.0)) / williams, "df": F.col("k") - 1, "largest": F.col("_m.c")}).drop("_m", "g_raw", "k")


def rank_sums(df: DataFrame, cell: list[str], cluster: str, value: str) -> DataFrame:
    """Mann-Whitney U of a cluster against the rest of its cell, with tie-corrected sigma: one ranking for all clusters.

    A row's rank is that of its value, from counts by value summed over ranges, so no task ranks a cell; NULLs are equal and last."""
    counts = df.groupBy(*cell, value).agg(F.count("*").alias("_c"))
    ran = running(counts, [F.col(c) for c in cell] + [F.col(value).asc_nulls_last()], {"_lt": F.col("_c")}, cell)
    ranks = written(ran.select(*cell, value, "_c", (F.col("_lt") + (F.col("_c") + 1) / 2).alias("_rank")), "ranks")
    c = F.col("_c").cast("double")
    cells = ranks.groupBy(*cell).agg(F.sum("_c").alias("_n"), F.sum(c * (c * c - 1)).alias("_ties"))
    n1, n2, n = F.col("n1"), F.col("n2"), F.col("n1") + F.col("n2")
    met = met_by(df.select(*cell, cluster, value), ranks.drop("_c"), [*cell, value])
    g = beside(met.groupBy(*cell, cluster).agg(F.count("*").alias("n1"), F.sum("_rank").alias("_r1")), cells, cell).withColumn("n2", F.col("_n") - F.col("n1"))
    u1 = F.col("_r1") - n1 * (n1 + 1) / 2
    sigma = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.when(n > 1, F.col("_ties") / (n * (n - 1))).otherwise(0.0)))
    return g.withColumns({"u1": u1, "sigma": sigma}).withColumns({"u2": n1 * n2 - F.col("u1"), "z": F.when(F.col("sigma") > 0, (F.greatest(F.col("u1"), n1 * n2 - F.col("u1")) - n1 * n2 / 2 - 0.5) / F.col("sigma"))}).drop("_n", "_r1", "_ties")


def share_test(df: DataFrame, cell: list[str], cluster: str, hit) -> DataFrame:
    """Hits of a cluster and the share among the rest of its cell (for a one-sided binomial test)."""
    own = df.groupBy(*cell, cluster).agg(F.count("*").alias("n"), F.count_if(hit).alias("k"))
    cells = df.groupBy(*cell).agg(F.count("*").alias("_n"), F.count_if(hit).alias("_k"))
    own = beside(own, cells, cell).withColumns({"rest_n": F.col("_n") - F.col("n"), "rest_k": F.col("_k") - F.col("k")}).drop("_n", "_k")
    return own.withColumn("rest_share", F.when(F.col("rest_n") > 0, F.col("rest_k") / F.col("rest_n")))


def busiest_day(df: DataFrame, cell: list[str], cluster: str, day: str, least_others: int = 5) -> DataFrame:
    """Share of a cluster's rows on its busiest day, and (others at least as high + 1) / (others + 1)."""
    days = df.groupBy(*cell, cluster, day).agg(F.count("*").alias("_c"))
    one = days.groupBy(*cell, cluster).agg((F.max("_c") / F.sum("_c")).alias("share"))
    w = Window.partitionBy(*cell)
    r = one.withColumns({"others": F.count("*").over(w) - 1, "_ge": F.count("*").over(w.orderBy(F.col("share").desc()).rangeBetween(Window.unboundedPreceding, 0)) - 1})
    return r.withColumn("p", F.when(F.col("others") >= least_others, (F.col("_ge") + 1) / (F.col("others") + 1))).drop("_ge")


def near_pairs(df: DataFrame, cluster: str, parent: str, ident: str, items: list[str], common: int, equal: float) -> DataFrame:
    """All pairs within a cluster, of different parents, that agree on nearly all items answered by both.

    Equal answer vectors are grouped first, so only distinct ones are compared. A near pair agrees on `least` items or
    more; of k - least + 1 blocks of items it then agrees on a whole one, so vectors meet by (cluster, block) only and
    no pair is lost. Each pair of vectors is taken at its first equal block. What grows beyond the rows is the output.
    equal * common must be above 0."""
    k = len(items)
    least = next((m for m in range(1, k + 1) if m >= equal * common), k)
    blocks = [items[i :: k - least + 1] for i in range(k - least + 1)]
    own = df.where(F.col(cluster).isNotNull()).select(F.col(cluster).alias("_c"), F.col(parent).alias("_p"), F.col(ident).alias("_i"), F.struct(*items).alias("_v"))
    answered = sum((F.when(F.col(f"_v.{c}").isNotNull(), 1).otherwise(0) for c in items), F.lit(0))
    vectors = own.where(answered >= common).select("_c", "_v").distinct()
    keys = [F.when(F.forall(F.array(*[F.col(f"_v.{c}").isNotNull() for c in block]), lambda x: x), F.xxhash64(*[F.col(f"_v.{c}") for c in block])) for block in blocks if block]
    keyed = vectors.select("_c", "_v", F.posexplode(F.array(*keys)).alias("_b", "_k")).where(F.col("_k").isNotNull())
    both = [F.col(f"_x.{c}").isNotNull() & F.col(f"_y.{c}").isNotNull() for c in items]
    hit = {c: F.coalesce(F.col(f"_x.{c}") == F.col(f"_y.{c}"), F.lit(False)) for c in items}
    n = sum((F.when(x, 1).otherwise(0) for x in both), F.lit(0))
    same = sum((F.when(x, 1).otherwise(0) for x in hit.values()), F.lit(0))
    first = F.coalesce(*[F.when(F.forall(F.array(*[hit[c] for c in block]), lambda x: x), i) for i, block in enumerate(b for b in blocks if b)])
    met = keyed.withColumnRenamed("_v", "_x").join(keyed.withColumnRenamed("_v", "_y"), ["_c", "_b", "_k"])
    near = met.where((F.col("_x") <= F.col("_y")) & (n >= common) & (same >= equal * n) & (first == F.col("_b"))).select("_c", "_x", "_y")
    a = own.select("_c", F.col("_v").alias("_x"), F.col("_p").alias("_pa"), F.col("_i").alias("_ia"))
    b = own.select("_c", F.col("_v").alias("_y"), F.col("_p").alias("_pb"), F.col("_i").alias("_ib"))
    order = F.when(F.col("_x") == F.col("_y"), F.col("_ia") < F.col("_ib")).otherwise(F.col("_ia") != F.col("_ib"))
    pairs = near.join(a, ["_c", "_x"]).join(b, ["_c", "_y"]).where((F.col("_pa") != F.col("_pb")) & order)
    return pairs.select(F.col("_c").alias(cluster), F.least("_ia", "_ib").alias("first_id"), F.greatest("_ia", "_ib").alias("second_id"))


def drift(df: DataFrame, by: list[str], period: str, value: str) -> DataFrame:
    """Change of a value against the median of earlier periods, over the median absolute step; NULL before two earlier periods.

    A series has a value a period, so the lists of earlier values are short."""
    w = Window.partitionBy(*by).orderBy(period)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    r = df.withColumns({"earlier": F.count("*").over(before), "_e": F.array_sort(F.collect_list(value).over(before)), "_s": F.abs(F.col(value) - F.lag(value).over(w))})
    r = r.withColumn("_f", F.array_sort(F.collect_list("_s").over(before)))

    def middle(c: str):
        n = F.size(c)
        return F.when(n > 0, (F.get(c, F.floor((n - 1) / 2).cast("int")) + F.get(c, F.floor(n / 2).cast("int"))) / 2)

    r = r.withColumns({"base": middle("_e"), "step": middle("_f")}).drop("_e", "_f")
    return r.withColumn("drift", F.when((F.col("earlier") >= 2) & (F.col("step") > 0), (F.col(value) - F.col("base")) / F.col("step"))).drop("_s")


def gate(n, ref_n, least: int = 10, ref_least: int = 30):
    """Why a cluster isn't tested; NULL if it is."""
    return F.when(n == 0, "GROUP_EMPTY").when(n < least, "GROUP_BELOW_MINIMUM").when(ref_n < ref_least, "REFERENCE_BELOW_MINIMUM")


def standardised_mix(df: DataFrame, cell: list[str], cluster: str, band: str, code: str, strength: float) -> DataFrame:
    """G of a cluster's codes against those expected from its own bands at the rest of the cell's rates.

    A band's leave-out rate is smoothed with `strength` towards the cell's leave-out mix. All of it is sums over counts by
    (cell, cluster, band, code): the rest of a cell is its total less the cluster's own."""
    t = df.where(F.col(band).isNotNull() & F.col(code).isNotNull()).groupBy(*cell, cluster, band, code).agg(F.count("*").cast("double").alias("_o"))
    total = lambda by, name: t.groupBy(*by).agg(F.sum("_o").alias(name))
    codes = total([*cell, code], "_c")
    per_cell = codes.groupBy(*cell).agg(F.sum("_c").alias("_t"), F.count("*").alias("_k"))
    own_bands = total([*cell, cluster, band], "_nb").join(total([*cell, cluster], "n"), [*cell, cluster]).join(total([*cell, band], "_b"), [*cell, band]).join(per_cell, cell)
    every = own_bands.join(codes, cell).join(total([*cell, band, code], "_bc"), [*cell, band, code], "left").join(t, [*cell, cluster, band, code], "left").join(total([*cell, cluster, code], "_oc"), [*cell, cluster, code], "left").fillna(0.0, ["_bc", "_o", "_oc"])
    prior = (F.col("_c") - F.col("_oc") + 0.5) / (F.col("_t") - F.col("n") + 0.5 * F.col("_k"))
    rate = (F.col("_bc") - F.col("_o") + strength * prior) / (F.col("_b") - F.col("_nb") + strength)
    e = every.groupBy(*cell, cluster, code).agg(F.first("n").alias("n"), F.first("_t").alias("_t"), F.first("_k").alias("_k"), F.first("_oc").alias("_oc"), F.sum(F.col("_nb") * rate).alias("_e"))
    part = F.when(F.col("_oc") > 0, 2 * F.col("_oc") * F.log(F.col("_oc") / F.col("_e"))).otherwise(0.0)
    g = e.groupBy(*cell, cluster).agg(F.first("n").cast("long").alias("n"), F.first("_t").alias("_t"), F.first("_k").alias("_k"), F.sum(part).alias("_g"), F.max(F.struct(F.abs(F.col("_oc") - F.col("_e")).alias("a"), F.col(code).alias("c"))).alias("_m"))
    g = g.withColumn("reason", gate(F.col("n"), F.col("_t") - F.col("n")))
    return g.withColumns({"g": F.when(F.col("reason").isNull(), F.greatest(F.col("_g"), F.lit(0.0)) / (1 + (F.col("_k") + 1) / (6 * F.col("n")))), "df": F.col("_k") - 1, "largest": F.col("_m.c")}).drop("_t", "_k", "_g", "_m")


def reduced_spread(df: DataFrame, cell: list[str], cluster: str, value: str) -> DataFrame:
    """cell, cluster, n, reason, inside, expected: values within half the rest's IQR of the cluster's own median, and the
    share of the rest within as much of its median.

    The k-th value of the rest is the value at place k + j of the cell, where j counts the own values v with (values of
    the cell up to v) - (own values up to v) < k. So every cluster is served by the places of its cell's rows, which
    `numbered` gives without a task for a whole cell; counts in an interval come from running sums at its ends."""
    rows = numbered(df.where(F.col(value).isNotNull()).select(*cell, cluster, F.col(value).cast("double").alias("_v")), [*[F.col(c) for c in cell], F.col("_v")], "_row")
    starts = rows.groupBy(*cell).agg((F.min("_row") - 1).alias("_s"), F.count("*").alias("_n"))
    rows = rows.join(F.broadcast(starts), cell).withColumn("_at", F.col("_row") - F.col("_s"))
    own = Window.partitionBy(*cell, cluster)
    up_to = own.orderBy("_v")
    placed = rows.withColumns({"_le": F.max("_at").over(Window.partitionBy(*cell, "_v")), "_ole": F.count("*").over(up_to.rangeBetween(Window.unboundedPreceding, 0)), "_i": F.row_number().over(up_to), "n": F.count("*").over(own)}).withColumn("ref_n", F.col("_n") - F.col("n"))
    wants, parts = {}, {}
    for name, p in (("q25", 0.25), ("med", 0.5), ("q75", 0.75)):
        at = (F.col("ref_n") - 1) * F.lit(p) + 1
        parts[name] = at - F.floor(at)
        for end, k in (("lo", F.floor(at)), ("hi", F.least(F.floor(at) + 1, F.col("ref_n")))):
            wants[f"{name}_{end}"] = F.max(k) + F.count_if(F.col("_le") - F.col("_ole") < k)
    mid = [F.max(F.when(F.col("_i") == k, F.col("_v"))) for k in (F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2))]
    g = placed.groupBy(*cell, cluster).agg(F.first("n").alias("n"), F.first("ref_n").alias("ref_n"), ((mid[0] + mid[1]) / 2).alias("own_median"), F.array(*[F.struct(F.lit(k).alias("name"), c.alias("_at")) for k, c in wants.items()]).alias("_w"))
    found = g.select(*cell, cluster, F.explode("_w").alias("w")).select(*cell, cluster, "w.name", "w._at").join(rows.select(*cell, "_at", "_v"), [*cell, "_at"])
    wide = found.groupBy(*cell, cluster).agg(*[F.max(F.when(F.col("name") == k, F.col("_v"))).alias(k) for k in wants])
    g = g.drop("_w").join(wide, [*cell, cluster], "left")
    g = g.withColumns({k: F.col(f"{k}_lo") + F.when(part > 0, part * (F.col(f"{k}_hi") - F.col(f"{k}_lo"))).otherwise(0.0) for k, part in parts.items()})
    g = g.withColumn("half", (F.col("q75") - F.col("q25")) / 2).select(*cell, cluster, "n", "ref_n", "own_median", F.col("med").alias("ref_median"), "half")
    # cell rows below the low end (_s 0) and up to the high end (_s 2), among the rows (_s 1)
    near = lambda c, d: F.abs(F.col(c) - F.col(d)) <= F.col("half")
    ends = g.select(*cell, cluster, F.explode(F.array(F.struct((F.col("ref_median") - F.col("half")).alias("_v"), F.lit(0).alias("_s")), F.struct((F.col("ref_median") + F.col("half")).alias("_v"), F.lit(2).alias("_s")))).alias("e")).select(*cell, cluster, "e.*")
    both = rows.select(*cell, F.lit(None).cast(df.schema[cluster].dataType).alias(cluster), "_v", F.lit(1).alias("_s")).unionByName(ends)
    ran = running(both, [*[F.col(c) for c in cell], F.col("_v"), F.col("_s")], {"_upto": (F.col("_s") == 1).cast("long")}).where("_s <> 1")
    cells = ran.groupBy(*cell, cluster).agg((F.max(F.when(F.col("_s") == 2, F.col("_upto"))) - F.max(F.when(F.col("_s") == 0, F.col("_upto")))).alias("_in_cell"))
    own_in = rows.select(*cell, cluster, "_v").join(g, [*cell, cluster]).groupBy(*cell, cluster).agg(F.count_if(near("_v", "own_median")).alias("inside"), F.count_if(near("_v", "ref_median")).alias("_own_in"))
    out = g.join(cells, [*cell, cluster]).join(own_in, [*cell, cluster]).withColumn("expected", (F.col("_in_cell") - F.col("_own_in")) / F.col("ref_n"))
    reason = F.coalesce(gate(F.col("n"), F.col("ref_n")), F.when((F.col("half") <= 0) | (F.col("expected") >= 1), "REFERENCE_HAS_NO_SPREAD"))
    out = out.withColumn("reason", reason)
    return out.withColumns({c: F.when(F.col("reason").isNull(), F.col(c)) for c in ("inside", "expected")}).drop("_in_cell", "_own_in")


def dispersion(df: DataFrame, family: list[str], chi: str, least: int = 10) -> DataFrame:
    """family, n_clusters, phi: median of one-degree chi-square equivalents over its null median, 1 at least; 1 for small families."""
    from plumbline.functions.tails import quantiles

    return quantiles(df, family, chi, {"_m": 0.5}, spread=True).select(*family, F.col("n").alias("n_clusters"), F.when(F.col("n") >= least, F.greatest(F.lit(1.0), F.col("_m") / 0.454936)).otherwise(1.0).alias("phi"))
