"""Adaptive back-off grouping: for each row the first level of dimensions whose group has enough eligible rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.tails import described, places, quantiles, with_z
from plumbline.functions.values import all_present, hash_id
from plumbline.sources.scratch import written


def assign(df: DataFrame, levels: list[list[str]], minimum: int = 30) -> DataFrame:
    """df with level (NULL if none is large enough) and group_size. Sizes count all eligible rows, also those assigned earlier.

    A row with a null in a level's dimensions has no group there and backs off to the next level.
    The rows are counted once, by all dimensions; each level's sizes are sums of those counts, and come back by a join
    that Spark broadcasts if small."""
    every = list(dict.fromkeys(c for dims in levels for c in dims))
    counts = written(df.groupBy(*every).agg(F.count("*").alias("_c")), "sizes")
    out = df
    for i, dims in enumerate(levels):
        sizes = counts.groupBy(*dims).agg(F.sum("_c").alias(f"_n{i}")).where(f"_n{i} >= {int(minimum)}")
        out = out.join(sizes, dims, "left")
    level = F.coalesce(*[F.when(F.col(f"_n{i}") >= minimum, i) for i in range(len(levels))])
    size = F.coalesce(*[F.when(F.col(f"_n{i}") >= minimum, F.col(f"_n{i}")) for i in range(len(levels))])
    return out.withColumns({"level": level, "group_size": size}).select(*df.columns, "level", "group_size")


def issued(assigned: DataFrame, levels: list[list[str]]) -> DataFrame:
    """One row a group in use: group_id, level, group_size and its values."""
    parts = []
    for i, dims in enumerate(levels):
        own = assigned.where(F.col("level") == i).select("level", "group_size", F.concat_ws("|", *dims).alias("group_values")).distinct()
        parts.append(own.withColumn("group_id", hash_id("pg_", F.col("level"), F.col("group_values"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: A coarse group of more rows is ranked over ranges of values, in many tasks.
LARGE = 5_000_000


def evidence(df: DataFrame, levels: list[list[str]], value: str, minimum: int = 30, large: int = LARGE) -> DataFrame:
    """Places, median, MAD and tail quantiles of every assigned row within the full membership of its group.

    At a level all rows of its issued groups are members, also those assigned to finer groups. Assigned rows are written
    once; a level then takes one exchange and two sorts, or, where its largest group has over `large` rows, counts by
    value over ranges."""
    rows = written(assign(df, levels, minimum), "assigned")
    sizes = {r["level"]: r["n"] for r in rows.where("level is not null").groupBy("level").agg(F.max("group_size").alias("n")).collect()}  # a row a level
    ps, parts = {"median": 0.5, "q05": 0.05, "q95": 0.95}, []
    for i, dims in enumerate(levels):
        if i not in sizes and (i or sizes):  # a level without groups; the first gives its columns where no level has any
            continue
        used = rows.where(F.col("level") == i).select(*dims).distinct()
        members = rows.join(used, dims, "left_semi")
        if sizes.get(i, 0) > large:
            own = places(members, dims, value, True).join(quantiles(members, dims, value, ps, True).drop("n"), dims).withColumn("_d", F.abs(F.col(value) - F.col("median")))
            own = written(own, "placed")
            own = own.join(quantiles(own, dims, "_d", {"mad": 0.5}, True).drop("n"), dims)
        else:
            own = described(members, dims, value, ps).withColumn("_d", F.abs(F.col(value) - F.col("median")))
            w = Window.partitionBy(*dims)
            own = own.withColumn("_i", F.row_number().over(w.orderBy("_d")))
            mid = [F.max(F.when(F.col("_i") == k, F.col("_d"))).over(w) for k in (F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2))]
            own = own.withColumn("mad", (mid[0] + mid[1]) / 2).drop("_i")
        parts.append(with_z(own, value).drop("_d").where(F.col("level") == i))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def complete(df: DataFrame, dims: list[str]) -> DataFrame:
    """Rows whose dimensions are all there."""
    return df.where(all_present([F.col(c) for c in dims]))


def reasons(df: DataFrame, levels: list[list[str]], ready, valid, minimum: int = 30) -> DataFrame:
    """df with reason: why a row has no group, the first that holds of not ready, no valid value, no group of the minimum; NULL if it has one.

    Sizes count rows that are ready and valid."""
    own = df.withColumn("_fit", ready & valid)
    met = own.where("_fit")
    assigned = assign(met, levels, minimum)
    met = assigned.select(*df.columns, F.when(F.col("level").isNull(), "NO_CONFIGURED_GROUP_MEETS_MINIMUM").alias("reason"))
    rest = own.where(~F.coalesce(F.col("_fit"), F.lit(False))).select(*df.columns, F.when(~F.coalesce(ready, F.lit(False)), "PREPARED_RECORD_NOT_READY").otherwise("TARGET_VALUE_MISSING_OR_INVALID").alias("reason"))
    return met.unionByName(rest)
