"""Evaluation: errors put into known rows, and how well a ranking finds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.scratch import numbered, written

#: Kinds of injected error, in the order in which they take rows.
KINDS = ("scale_x10", "scale_div10", "digit_transposition", "scale_x12", "scale_x100", "code_miscode", "duplicate_record")
SHARES = (0.005, 0.01, 0.02, 0.05)


def transposed(value: Column) -> Column:
    """The whole number with its first two digits swapped; null where that changes it by less than a fifth, or under three digits."""
    whole = F.floor(value + 0.5).cast("long")
    text = whole.cast("string")
    swapped = F.concat(F.substring(text, 2, 1), F.substring(text, 1, 1), F.substring(text, 3, 30)).try_cast("double")
    return F.when((F.length(text) >= 3) & (swapped > 0) & (F.abs(swapped - whole) / whole >= 0.2), swapped)


def inject(rows: DataFrame, key: str, value: str, code: str, per_kind: int = 300, seed: int = 7) -> DataFrame:
    """All rows with error_type (null: as they were) and copy (1: an added duplicate). value must be double.

    The rows altered are the `per_kind` least of a seeded hash of the key for each kind in turn, so no row has two kinds
    and reruns agree; they are a bounded number, picked as a top-k and broadcast. A miscoded row takes the next code of those in use.
    Edge cases: a null key, value or code, or a value of 0 or less, is never picked; repeated keys are altered alike;
    with too few rows the last kinds get none."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256)
    able = rows.where(F.col(key).isNotNull() & (F.col(value) > 0) & F.col(code).isNotNull())
    first = able.select(F.col(key).alias("_key"), hashed.alias("_h")).distinct().orderBy("_h", "_key").limit(per_kind * len(KINDS))
    at = F.floor((F.row_number().over(Window.orderBy("_h", "_key")) - 1) / per_kind).cast("int")  # over the picked rows only
    kinds = first.select("_key", F.element_at(F.array(*map(F.lit, KINDS)), at + 1).alias("_kind"))
    codes = able.select(F.col(code).alias("_code")).distinct()
    ring = Window.orderBy("_code")  # over the codes of one column
    after = codes.select("_code", F.coalesce(F.lead("_code").over(ring), F.first("_code").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_next"))
    met = rows.join(F.broadcast(kinds), F.col(key) == F.col("_key"), "left").join(F.broadcast(after), F.col(code) == F.col("_code"), "left")
    kind, v = F.col("_kind"), F.col(value)
    moved = transposed(v)
    new = F.when(kind == "scale_x10", F.floor(v * 10)).when(kind == "scale_x12", F.floor(v * 12)).when(kind == "scale_x100", F.floor(v * 100)).when(kind == "scale_div10", F.floor(v / 10 + 0.5)).when(kind == "digit_transposition", F.coalesce(moved, v)).otherwise(v)
    done = met.withColumns({
        value: new.cast("double"),
        code: F.when(kind == "code_miscode", F.col("_next")).otherwise(F.col(code)),
        "error_type": F.when((kind != "digit_transposition") | moved.isNotNull(), kind),
        "copy": F.explode(F.when(kind == "duplicate_record", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
    })
    return done.select(*rows.columns, "error_type", "copy")


def at_shares(scored: DataFrame, order: list[Column], positive: str, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """share, k, true_positives, precision, recall and F0.5 of the first k rows. The order must be total; without positives recall and F0.5 are 0."""
    own = written(numbered(scored, order, "_r").select("_r", positive), "ranks")
    n = own.count()
    ks = [max(1, int(s * n + 0.5)) for s in shares]
    hits = own.agg(F.count_if(positive).alias("p"), *[F.count_if(F.col(positive) & (F.col("_r") <= k)).alias(f"h{i}") for i, k in enumerate(ks)])
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.lit(k).cast("long").alias("k"), F.col(f"h{i}").alias("true_positives")) for i, (s, k) in enumerate(zip(shares, ks, strict=True))]))
    precision, recall = F.col("true_positives") / F.col("k"), F.when(F.col("p") > 0, F.col("true_positives") / F.col("p")).otherwise(0.0)
    out = hits.select("p", each.alias("e")).select("p", "e.*").withColumns({"precision": precision, "recall": recall})
    f = F.when(F.col("precision") + F.col("recall") > 0, 1.25 * F.col("precision") * F.col("recall") / (0.25 * F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.withColumn("f0_5", f).drop("p")


def recall_by(scored: DataFrame, order: list[Column], positive: str, groups: list[str], share: float = 0.05) -> DataFrame:
    """subgroup, value, injected and recall in the first share of all rows; recall is null where a value has no positives. Null values are left out."""
    own = written(numbered(scored, order, "_r").select("_r", positive, *groups), "ranks")
    k = max(1, int(share * own.count() + 0.5))
    one = own.select("_r", positive, F.explode(F.array(*[F.struct(F.lit(g).alias("subgroup"), F.col(g).cast("string").alias("value")) for g in groups])).alias("g")).select("_r", positive, "g.*").where("value is not null")
    found = one.groupBy("subgroup", "value").agg(F.count_if(positive).alias("injected"), F.count_if(F.col(positive) & (F.col("_r") <= k)).alias("found"))
    return found.select("subgroup", "value", "injected", F.when(F.col("injected") > 0, F.col("found") / F.col("injected")).alias("recall"))
