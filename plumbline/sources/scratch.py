"""Tables written to the folder all executors share, and global order without one task for all rows."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a partition of an ordered table.
ROWS_A_PART = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of this machine in local mode, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), f"plumbline-{os.getuid()}")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/plumbline/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordered(df: DataFrame, order: list[Column], tag: str = "ordered") -> DataFrame:
    """df, written, with _part and _at: range partitions in order, and the place in the partition from 0."""
    own = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return written(own, tag).withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")


def _offsets(df: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """_part and of each sum the total of all earlier partitions: one row a partition, so one task orders them."""
    totals = df.groupBy("_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its row number in the order, from 1. The order should be total."""
    own = ordered(df, order)
    return own.join(F.broadcast(_offsets(own, {"n": F.lit(1)})), "_part").withColumn(name, F.col("_o_n") + F.col("_at") + 1).drop("_part", "_at", "_o_n")


def met_by(df: DataFrame, other: DataFrame, by: list[str], how: str = "inner", small: bool = False) -> DataFrame:
    """df with the columns of other, which has a row a group; NULL groups meet too. small: other goes to all tasks."""
    own = other.select(*[F.col(c).alias(f"_by{by.index(c)}") if c in by else F.col(c) for c in other.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)], F.lit(True))
    return df.join(F.broadcast(own) if small else own, same, how).drop(*[f"_by{i}" for i in range(len(by))])


def beside(df: DataFrame, small: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    return met_by(df, small, by, how, small=True)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], by: list[str] | None = None, totals: dict[str, str] | None = None) -> DataFrame:
    """df with the sums over all rows before each in the order.

    by: within groups, whose columns begin the order; totals: name of a group's total -> name of the sum. A group that goes
    on from the range before is the only one of its range with an offset, so there are no more offsets than ranges."""
    own = ordered(df, order)
    if by is None:
        before = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        inside = own.withColumns({f"_i_{n}": F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in sums.items()})
        met = inside.join(F.broadcast(_offsets(own, sums)), "_part")
        return met.withColumns({n: F.col(f"_i_{n}") + F.col(f"_o_{n}") for n in sums}).drop("_part", "_at", *[f"_{k}_{n}" for n in sums for k in "io"])
    per = written(own.groupBy("_part", *by).agg(*[F.sum(c).alias(n) for n, c in sums.items()]), "totals")
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("_part", *by, *[F.sum(n).over(earlier).alias(f"_o_{n}") for n in sums], F.count("*").over(earlier).alias("_k")).where("_k > 0").drop("_k")
    before = Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    inside = own.withColumns({f"_i_{n}": F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in sums.items()})
    met = beside(inside, offsets, ["_part", *by], "left")
    done = met.withColumns({n: F.col(f"_i_{n}") + F.coalesce(F.col(f"_o_{n}"), F.lit(0)) for n in sums}).drop("_part", "_at", *[f"_{k}_{n}" for n in sums for k in "io"])
    if totals:
        done = beside(done, per.groupBy(*by).agg(*[F.sum(n).alias(t) for t, n in totals.items()]), by)
    return done
