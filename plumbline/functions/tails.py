"""Exact finite-sample places and tails from rank windows: one exchange and one sort for all of a group's measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.scratch import met_by, running, written

MAD_SCALE = 0.6744897501960817


def sidak(p: Column, k: Column) -> Column:
    return -F.expm1(k * F.log1p(-F.least(F.greatest(p, F.lit(0.0)), F.lit(1 - 1e-16))))


def ranked(df: DataFrame, by: list[str], value: str, spread: bool = False) -> DataFrame:
    """_below, _le, _n: counts within the group. Rows with a NULL value must be gone.

    spread: counts by value and their running sums over ranges, so that no task holds a whole group; NULL group columns are kept."""
    if spread:
        counts = spread_counts(df, by, value).select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col(value).alias("_gv"), "_below", "_le", "_n")
        same = F.col(value) == F.col("_gv")
        for i, c in enumerate(by):
            same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
        return df.join(counts, same).drop("_gv", *[f"_g{i}" for i in range(len(by))])
    w = Window.partitionBy(*by)
    order = w.orderBy(value)
    return df.withColumns({"_below": F.rank().over(order) - 1, "_le": F.count("*").over(order.rangeBetween(Window.unboundedPreceding, 0)), "_n": F.count("*").over(w)})


def spread_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, _c (rows with it), _below, _le, _n: one row a distinct value of a group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    ran = running(counts, [F.col(c) for c in (*by, value)], {"_below": F.col("_c")}, by, {"_n": "_below"})
    return ran.select(*by, value, "_c", "_below", (F.col("_below") + F.col("_c")).alias("_le"), "_n")


def places(df: DataFrame, by: list[str], value: str, spread: bool = False) -> DataFrame:
    """midrank, loo_percentile, upper, lower, two_sided and direction of each value within its group."""
    r = ranked(df, by, value, spread)
    n, below, le = F.col("_n"), F.col("_below"), F.col("_le")
    upper, lower = (n - below) / n, le / n
    return r.withColumns({
        "n": n, "midrank": (below + le) / (2 * n),
        "loo_percentile": F.when(n > 1, (below + 0.5 * (le - below - 1)) / (n - 1)),
        "upper": upper, "lower": lower, "two_sided": F.least(F.lit(1.0), 2 * F.least(upper, lower)),
        "direction": F.when(upper < lower, "HIGH").when(upper > lower, "LOW").otherwise("CENTRE"),
    }).drop("_below", "_le", "_n")


def quantiles(df: DataFrame, by: list[str], value: str, ps: dict[str, float], spread: bool = False) -> DataFrame:
    """Linear-interpolation quantiles a group, from row numbers: sorted and spilled, never held in a hash map.

    spread: from counts by value, as in ranked."""
    if spread:
        r = spread_counts(df, by, value).select(*by, F.col(value).alias("_v"), F.col("_below").alias("_from"), F.col("_le").alias("_to"), F.col("_n").alias("_m"))
        holds = lambda k: (F.col("_from") < k) & (F.col("_to") >= k)
    else:
        w = Window.partitionBy(*by)
        r = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"), F.row_number().over(w.orderBy(value)).alias("_i"), F.count("*").over(w).alias("_m"))
        holds = lambda k: F.col("_i") == k
    out = {}
    for name, p in ps.items():
        at = (F.col("_m") - 1) * F.lit(p) + 1
        lo, part = F.floor(at), at - F.floor(at)
        below = F.max(F.when(holds(lo), F.col("_v")))
        above = F.max(F.when(holds(lo + 1), F.col("_v")))
        share = F.max(part)
        out[name] = below + F.when(share > 0, share * (above - below)).otherwise(0.0)
    return r.groupBy(*by).agg(F.max("_m").alias("n"), *[c.alias(k) for k, c in out.items()])


def described(df: DataFrame, by: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """places and the quantiles of each row's group, from one exchange and one sort."""
    w = Window.partitionBy(*by)
    r = places(df, by, value).withColumn("_i", F.row_number().over(w.orderBy(value)))
    out = {}
    for name, p in ps.items():
        at = (F.col("n") - 1) * F.lit(p) + 1
        lo, part = F.floor(at), at - F.floor(at)
        below, above = (F.max(F.when(F.col("_i") == k, F.col(value))).over(w) for k in (lo, lo + 1))
        out[name] = below + F.when(part > 0, part * (above - below)).otherwise(0.0)
    return r.withColumns(out).drop("_i")


def with_z(df: DataFrame, value: str) -> DataFrame:
    """robust_z and mad_status from median and mad."""
    z = F.when(F.col("mad") > 0, MAD_SCALE * (F.col(value) - F.col("median")) / F.col("mad")).when(F.col(value) == F.col("median"), 0.0)
    return df.withColumns({"robust_z": z, "mad_status": F.when(z.isNull(), "ZERO_MAD").otherwise("OK")})


def robust(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """median, mad, robust_z, mad_status of each value within its group."""
    mid = df.join(quantiles(df, by, value, {"median": 0.5}).drop("n"), by).withColumn("_d", F.abs(F.col(value) - F.col("median")))
    return with_z(mid.join(quantiles(mid, by, "_d", {"mad": 0.5}).drop("n"), by), value).drop("_d")


#: References of a group in one range of values, and references of a task, each counted once a lag.
RANGE, TASK = 100_000, 400_000


def out_of_sample(targets: DataFrame, reference: DataFrame, by: list[str], value: str) -> DataFrame:
    """Tails of targets against reference rows of the same group, no pairs. n is the reference count. A NULL value has no
    tails and is no reference."""
    return _tails(targets, reference.where(F.col(value).isNotNull()).select(*by, value), by, value)


def earlier(df: DataFrame, by: list[str], period: str, lags: list[int], value: str) -> DataFrame:
    """Tails of each row against the rows of its group that many periods before, as in out_of_sample. A row is moved once,
    whatever the lags: it becomes a reference of later periods in the task where it is a target."""
    own = written(df, "history")
    return _tails(own, own.where(F.col(value).isNotNull()).select(*by, period, value), by, value, period, lags)


def _tails(targets: DataFrame, ref: DataFrame, by: list[str], value: str, period: str | None = None, lags: list[int] | None = None) -> DataFrame:
    """Rows are dealt by group and range of values, so no task holds a large group. Ranges are cut at approximate quantiles of
    the references: where they are cut decides who does the work, not the result. A row a group and range brings the
    references of lower ranges (_ref) and of the group (n); in a range one sort of the union does the rest."""
    from pyspark.ml.feature import Bucketizer

    group, copies = [*by, *([period] if period else [])], len(lags) if lags else 1
    sizes = ref.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.max("_n").alias("most"), F.sum("_n").alias("all")).first()
    k = (sizes["most"] or 0) * copies // RANGE + 1
    cuts = sorted({float(c) for c in ref.agg(F.percentile_approx(F.col(value).cast("double"), [i / k for i in range(1, k)], 20 * k)).first()[0]}) if k > 1 else []
    cuts = [c for c in cuts if abs(c) < float("inf")] or [0.0]
    ranges = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_v", outputCol="_q", handleInvalid="keep")
    last = len(ranges.getSplits()) - 1  # the range of NULL and NaN
    dealt = lambda df: ranges.transform(df.withColumn("_v", F.col(value).cast("double"))).withColumn("_q", F.coalesce(F.col("_q").cast("int"), F.lit(last))).drop("_v")
    per = dealt(ref)
    if lags:
        per = per.groupBy(*group, "_q").agg(F.count("*").alias("_c")).withColumn(period, F.explode(F.array(*[F.col(period) + i for i in lags])))
    per = written(per.groupBy(*group, "_q").agg((F.sum("_c") if lags else F.count("*")).alias("_c")), "ranges")
    every = per.groupBy(*group).agg(F.sum("_c").alias("n")).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(last))))
    below = Window.partitionBy(*group).orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    heads = met_by(every, per, [*group, "_q"], "left").withColumn("_ref", F.coalesce(F.sum("_c").over(below), F.lit(0)))
    heads = heads.select(*group, "_q", "n", "_ref", F.lit(2).alias("_kind"))
    rows = dealt(targets).withColumns({"_kind": F.lit(0), "_ref": F.lit(0).cast("long")}).unionByName(heads, allowMissingColumns=True)
    if not lags:
        rows = rows.unionByName(dealt(ref).withColumns({"_kind": F.lit(1), "_ref": F.lit(1).cast("long")}), allowMissingColumns=True)
    tasks = (sizes["all"] or 0) * copies // TASK + 1
    wide = tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(*([tasks] if wide else []), *by, "_q")
    if lags:
        one = lambda kind, ref, at: F.struct(kind.alias("_kind"), ref.alias("_ref"), at.alias(period))
        own = one(F.col("_kind"), F.col("_ref"), F.col(period))
        later = [one(F.lit(1), F.lit(1).cast("long"), F.col(period) + i) for i in lags]
        rows = rows.withColumn("_x", F.explode(F.when((F.col("_kind") == 0) & F.col(value).isNotNull(), F.array(own, *later)).otherwise(F.array(own)))).withColumns({c: F.col(f"_x.{c}") for c in ("_kind", "_ref", period)}).drop("_x")
    w = Window.partitionBy(*group, "_q")
    order = w.orderBy(F.col(value).asc_nulls_first()).rangeBetween(Window.unboundedPreceding, 0)
    r = rows.withColumns({"_le": F.sum("_ref").over(order), "_eq": F.sum("_ref").over(Window.partitionBy(*group, "_q", value)), "n": F.coalesce(F.max("n").over(order), F.lit(0))}).where("_kind = 0")
    known = F.col(value).isNotNull()
    le, lt, n = F.col("_le"), F.col("_le") - F.col("_eq"), F.col("n")
    upper, lower = F.when(known, (n - lt + 1) / (n + 1)), F.when(known, (le + 1) / (n + 1))
    return r.withColumns({"upper": upper, "lower": lower, "two_sided": F.when(known, F.least(F.lit(1.0), 2 * F.least(upper, lower))), "percentile": F.when(known & (n > 0), (lt + 0.5 * F.col("_eq")) / F.nullif(n, F.lit(0)))}).drop("_ref", "_le", "_eq", "_q", "_kind")


def bh(df: DataFrame, by: list[str], p: str, tie: list[str], out: str = "q") -> DataFrame:
    """Benjamini-Hochberg q-values within a family; NULL p stays NULL and does not count."""
    some = df.where(F.col(p).isNotNull())
    w = Window.partitionBy(*by)
    r = some.withColumns({"_r": F.row_number().over(w.orderBy(p, *tie)), "_m": F.count("*").over(w)}).withColumn("_x", F.col(p) * F.col("_m") / F.col("_r"))
    down = w.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    q = r.withColumn(out, F.least(F.min("_x").over(down), F.lit(1.0))).drop("_r", "_m", "_x")
    return q.unionByName(df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))


def positions(df: DataFrame, value: str, low: str, high: str, p: float = 0.05) -> DataFrame:
    """Where a placed value lies against its group's tail quantiles, and how far its midrank is beyond p and 1 - p."""
    v = F.col(value)
    where = F.when(v < F.col(low), "LOWER_TAIL").when(v > F.col(high), "UPPER_TAIL").otherwise("CENTRAL_REFERENCE_RANGE")
    return df.withColumns({"distribution_position": where, "lower_distance": F.greatest(p - F.col("midrank"), F.lit(0.0)), "upper_distance": F.greatest(F.col("midrank") - (1 - p), F.lit(0.0))})
