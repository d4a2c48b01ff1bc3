"""Checks of deliveries and runs, as aggregates."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.values import all_present


def homogeneity(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, n_values, homogeneous: each field must have one value in a batch."""
    counts = df.agg(*[F.countDistinct(c).alias(c) for c in fields])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n_values")) for c in fields])).alias("x")).select("x.*", (F.col("x.n_values") == 1).alias("homogeneous"))


def overlap(new: DataFrame, earlier: DataFrame, key: str) -> DataFrame:
    """n, n_overlap, share of the new ids that an earlier delivery has."""
    seen = earlier.select(key).distinct().withColumn("_seen", F.lit(1))
    return new.select(key).distinct().join(seen, key, "left").agg(F.count("*").alias("n"), F.count("_seen").alias("n_overlap"), F.coalesce(F.avg(F.coalesce("_seen", F.lit(0))), F.lit(0.0)).alias("share"))


def preflight(parents: DataFrame, parts: list[str], key: str, children: DataFrame, child_key: str, known: DataFrame | None = None, most_orphans: float = 0.5) -> DataFrame:
    """n_rows, n_blank (a key part missing), n_repeated, orphan_share and the verdict: BLOCKED over `most_orphans`, WARNING for any finding."""
    p = parents.agg(F.count("*").alias("n_rows"), F.count_if(~all_present([F.col(c) for c in parts])).alias("n_blank"), (F.count("*") - F.countDistinct(key)).alias("n_repeated"))
    own = (known if known is not None else parents).select(F.col(key).alias("_k")).distinct().withColumn("_found", F.lit(1))
    c = children.join(own, F.col(child_key) == F.col("_k"), "left").agg((1 - F.avg(F.coalesce("_found", F.lit(0)))).alias("orphan_share"))
    verdict = F.when(F.col("orphan_share") > most_orphans, "BLOCKED").when((F.col("n_blank") + F.col("n_repeated") > 0) | (F.col("orphan_share") > 0), "WARNING").otherwise("PASSED")
    return p.join(F.broadcast(c)).withColumn("verdict", verdict)


def latest_run(runs: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return runs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def unique_ids(df: DataFrame, name: str, ids: list[str]) -> DataFrame:
    return df.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.countDistinct(*ids).alias("n_ids")).withColumn("unique_ids", F.col("n_rows") == F.col("n_ids"))


def file_digests(spark: SparkSession, folder: str, most: int = 1 << 30) -> DataFrame:
    """path, length, sha256, bom, nul, too_long of the files of a folder, from Spark's binary source; larger files are named, not read."""
    files = spark.read.format("binaryFile").load(folder)
    content = F.when(F.col("length") <= most, F.col("content"))
    return files.select("path", "length", F.sha2(content, 256).alias("sha256"), (F.hex(F.substring(content, 1, 3)) == "EFBBBF").alias("bom"), (F.instr(content.cast("string"), "\0") > 0).alias("nul"), (F.col("length") > most).alias("too_long"))


def manifest(folder: str) -> dict:
    """Names, sizes and SHA-256 of a run's files, and one digest of them all."""
    files = {str(p.relative_to(folder)): {"size": p.stat().st_size, "sha256": hashlib.sha256(p.read_bytes()).hexdigest()} for p in sorted(Path(folder).rglob("*")) if p.is_file()}
    return {"files": files, "digest": hashlib.sha256(json.dumps(files, sort_keys=True).encode()).hexdigest()}


def changed(folder: str, before: dict) -> list[str]:
    """Files that are missing, new or different from a manifest."""
    now = manifest(folder)["files"]
    return sorted(k for k in now.keys() | before["files"].keys() if now.get(k) != before["files"].get(k))
