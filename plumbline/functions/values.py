"""Column expressions for text, codes, numbers and periods. All are built-in expressions, so they stay in codegen."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def clean(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def finite(c: Column) -> Column:
    """A number, or NULL for text that is none, NaN and infinities."""
    text = F.trim(c.cast("string"))
    value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def month(c: Column) -> Column:
    """"01" and "1.0" become "1"; other text and fractions stay."""
    text, number = clean(c), finite(c)
    return F.when(number.isNotNull() & (number == F.floor(number)), number.cast("bigint").cast("string")).otherwise(text)


def composite_key(parts: Iterable[Column]) -> Column:
    return F.concat_ws("|", *[clean(p) for p in parts])


def all_present(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, [clean(p) != "" for p in parts])


def major_group(c: Column) -> Column:
    """Three digits: the first; four or five: the first two; one or two: padded to two; else empty."""
    t = clean(c)
    return F.when(t.rlike(r"^\d{3}$"), F.substring(t, 1, 1)).when(t.rlike(r"^\d{4,5}$"), F.substring(t, 1, 2)).when(t.rlike(r"^\d{1,2}$"), F.lpad(t, 2, "0")).otherwise("")


def applicability(status: Column, applies: Iterable[str], zero: Iterable[str]) -> Column:
    return F.when(status.isin(*applies), "APPLICABLE").when(status.isin(*zero), "ZERO_BY_DEFINITION").otherwise("NOT_APPLICABLE")


def final_weight(multiplier: Column, nss: Column, nsc: Column, redesigned: Column) -> Column:
    """multiplier / 100, or / 200 where the two sample counts of the old design differ; NULL if a part is missing."""
    return F.when(redesigned, multiplier / 100).when(nss.isNull() | nsc.isNull(), None).when(nss == nsc, multiplier / 100).otherwise(multiplier / 200)


def quarter_index(c: Column) -> Column:
    return (F.year(c) * 4 + F.quarter(c)).cast("int")


def age_band(c: Column, width: int, top: int) -> Column:
    return F.least(F.greatest(F.floor(c / width), F.lit(0)), F.lit(top)).cast("int")


def hash_id(prefix: str, *parts: Column, length: int = 24) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, length))


def hash_number(c: Column) -> Column:
    """The first 64 bits of SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(c.cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_bucket(c: Column, k: int) -> Column:
    """A stable bucket: hash_number modulo k."""
    return (hash_number(c) % F.lit(k)).cast("int")


def hmac_sha256(c: Column, key: str) -> Column:
    """HMAC-SHA-256 of a text, in hex, from two rounds of SHA-256."""
    raw = key.encode() if len(key.encode()) <= 64 else hashlib.sha256(key.encode()).digest()
    pads = [F.lit(bytearray(b ^ x for b in raw.ljust(64, b"\0"))) for x in (0x36, 0x5C)]
    inner = F.sha2(F.concat(pads[0], F.encode(c, "UTF-8")), 256)
    return F.sha2(F.concat(pads[1], F.unhex(inner)), 256)
