"""Reading deliveries by contract, and the sinks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractError(ValueError):
    pass


@dataclass(frozen=True)
class Contract:
    """columns: concept -> header; required concepts; key: concepts of the composite key; whitelist: further headers a delivery
    must have; count: documented number of columns; types: header -> Spark type."""

    columns: dict[str, str]
    required: tuple[str, ...]
    key: tuple[str, ...] = ()
    count: int | None = None
    whitelist: frozenset[str] = field(default_factory=frozenset)
    types: dict[str, str] = field(default_factory=dict)

    def check(self, headers: list[str]) -> list[tuple[str, str]]:
        """(severity, message) of every deviation."""
        out = [("failure", f"missing {c}: {self.columns[c]}") for c in self.required if self.columns[c] not in headers]
        if self.count is not None and len(headers) != self.count:
            out.append(("warning", f"{len(headers)} columns, documented {self.count}"))
        out += [("failure", f"missing whitelisted column {h}") for h in sorted(self.whitelist) if h not in headers]
        if self.whitelist:
            out += [("warning", f"unknown column {h}") for h in headers if h not in self.whitelist and h not in self.columns.values()]
        return out


def read_csv(spark: SparkSession, path: str, headers: list[str], strict: bool = False) -> DataFrame:
    """All columns as text: "01" stays "01", blank stays blank (""), never inferred. strict fails on ragged rows."""
    schema = T.StructType([T.StructField(h, T.StringType()) for h in headers])
    raw = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("enforceSchema", False).csv(path)
    return raw.select(*[F.coalesce(F.col(h), F.lit("")).alias(h) for h in headers])


def conform(df: DataFrame, contract: Contract) -> DataFrame:
    """Concept columns under their own names; fails where a required one is missing or two headers mean one concept."""
    failures = [m for s, m in contract.check(df.columns) if s == "failure"]
    failures += [f"{h} is {df.schema[h].dataType.simpleString()}, not {t}" for h, t in contract.types.items() if h in df.columns and df.schema[h].dataType.simpleString() != t]
    if failures:
        raise ContractError("; ".join(failures))
    taken = {c: h for c, h in contract.columns.items() if h in df.columns}
    if clash := [c for c, h in taken.items() if c != h and c in df.columns]:
        raise ContractError(f"both names present for {clash}")
    return df.select(*[F.col(h).alias(c) for c, h in taken.items()])


def read_parquet(spark: SparkSession, path: str, columns: list[str], optional: list[str] = (), where=None) -> DataFrame:
    """Only the columns asked for, with the filter pushed to the scan; missing optional columns are NULL."""
    df = spark.read.parquet(path)
    if missing := [c for c in columns if c not in df.columns]:
        raise ContractError(f"missing columns {missing}")
    df = df if where is None else df.where(where)
    return df.select(*columns, *[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in optional])


def code_list(df: DataFrame, parts: list[str], width: int = 2) -> DataFrame:
    """Distinct zero-padded code tuples."""
    pad = lambda c: F.when(F.length(F.trim(c)) < width, F.lpad(F.trim(c), width, "0")).otherwise(F.trim(c))
    return df.select(*[pad(F.col(p).cast("string")).alias(p) for p in parts]).distinct()


def content_digest(df: DataFrame) -> DataFrame:
    """Row count and an order-independent sum of row hashes."""
    return df.agg(F.count("*").alias("n_rows"), F.sum(F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")).alias("digest"))


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """An immutable stage: refuses to replace one."""
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def load_releases(releases: dict[str, tuple[DataFrame, dict[str, str]]], concepts: list[str]) -> DataFrame:
    """Releases with their own headers (concept -> header) in one table of the concepts asked for, and the release; only those columns are read."""
    out = None
    for name, (df, headers) in releases.items():
        if missing := [c for c in concepts if headers.get(c) not in df.columns]:
            raise ContractError(f"{name}: missing {missing}")
        own = df.select(F.lit(name).alias("release"), *[F.col(headers[c]).alias(c) for c in concepts])
        out = own if out is None else out.unionByName(own)
    return out


def write_ordered_csv(df: DataFrame, order: list, path: str) -> None:
    """The rows in order with their position, in files whose names follow the order."""
    from plumbline.sources.scratch import numbered

    own = numbered(df, order, "position")
    own.repartitionByRange("position").sortWithinPartitions("position").write.mode("errorifexists").option("header", True).csv(path)


def snapshot(df: DataFrame, path: str) -> dict:
    """Writes a reference table once and returns its row count and content digest."""
    write_stage(df, path)
    found = content_digest(df.sparkSession.read.parquet(path)).first()
    return {"n_rows": found["n_rows"], "digest": str(found["digest"])}
