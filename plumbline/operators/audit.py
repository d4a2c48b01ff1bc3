"""Append-only decisions: a hash chain a key, its verification, and the checks of a new decision."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DECISIONS = {"CONFIRMED_ERROR": True, "NOT_AN_ERROR": True, "REFERRED": False, "NEEDS_CHECK": False}
SEPARATOR = "\x1f"


def body(fields: list[str]) -> Column:
    return F.concat_ws(SEPARATOR, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields])


def chain(df: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """df with previous_hash ("" at the start) and event_hash: SHA-256 of the hash before and the event's fields.

    Appending is serial by nature: the events of one key are folded in one task, in order. Keys are dealt over tasks."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("previous_hash", T.StringType()), T.StructField("event_hash", T.StringType())])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        last, before, own = "", [], []
        for text in pdf.pop("_body"):
            before.append(last)
            last = hashlib.sha256(f"{last}{SEPARATOR}{text}".encode()).hexdigest()
            own.append(last)
        return pdf.assign(previous_hash=before, event_hash=own)

    return df.withColumn("_body", body(fields)).groupBy(key).applyInPandas(fold, schema)


def verify(df: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """The events whose stored link is not the hash stored before (LINK), or whose hash is not theirs (HASH): checked in parallel."""
    before = F.coalesce(F.lag("event_hash").over(Window.partitionBy(key).orderBy(order)), F.lit(""))
    own = F.sha2(F.concat(F.col("previous_hash"), F.lit(SEPARATOR), body(fields)), 256)
    fault = F.when(F.col("previous_hash") != before, "LINK").when(F.col("event_hash") != own, "HASH")
    return df.withColumn("fault", fault).where("fault is not null")


def refusals(new: dict, latest: dict | None) -> list[str]:
    """Why a decision can't be appended: unknown, without its reason, or made against an older state of the case."""
    out = []
    if new.get("decision") not in DECISIONS:
        out.append("UNKNOWN_DECISION")
    elif DECISIONS[new["decision"]] and not (new.get("reason") or "").strip():
        out.append("REASON_REQUIRED")
    if (latest or {}).get("event_hash", "") != new.get("seen_hash", ""):
        out.append("CHANGED_SINCE_READ")
    return out
