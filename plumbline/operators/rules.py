"""Declarative rules compiled to columns. A rule is a dict with id, type and the type's fields.

Rule types: unique, allowed_values, range, required_when, absent_when, value_when, not_value_when, arithmetic,
lower_bound_sum, exists_exactly, count_matches, references, within_period. A rule whose columns are absent is not
applicable. All row rules are evaluated in one pass as an array of violated ids."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.values import clean, finite

EPS = 1e-9


def present(c: str) -> Column:
    return clean(F.col(c)) != ""


def texts(values: list) -> list[str]:
    return [str(v) for v in values]


def matches(c: str, values: list) -> Column:
    """As text; values given as numbers also match any text of the same number ("01" is not "1", but it is 1)."""
    numbers = [float(v) for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]
    text = clean(F.col(c)).isin(*texts(values))
    return F.coalesce(text | finite(F.col(c)).isin(*numbers), text) if numbers else text


def same_code(c: str, values: list) -> Column:
    return clean(F.col(c)).isin(*texts(values))


def condition(when: dict | None) -> Column:
    """{column: {in, not_in, min, max}}, all of them; NULL is false."""
    tests = [F.lit(True)]
    for c, spec in (when or {}).items():
        if "in" in spec:
            tests.append(same_code(c, spec["in"]))
        if "not_in" in spec:
            tests.append(present(c) & ~same_code(c, spec["not_in"]))
        if "min" in spec:
            tests.append(finite(F.col(c)) >= spec["min"])
        if "max" in spec:
            tests.append(finite(F.col(c)) <= spec["max"])
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def total(terms: list[dict]) -> Column:
    one = lambda t: F.when(condition(t.get("when")), F.coalesce(finite(F.col(t["column"])), F.lit(0.0)) * t.get("factor", 1.0)).otherwise(0.0)
    return reduce(lambda a, b: a + b, [one(t) for t in terms])


def columns_of(rule: dict) -> set[str]:
    own = set(rule.get("fields", [])) | set(rule.get("when", {})) | {rule[k] for k in ("column", "target", "count", "declared", "period") if isinstance(rule.get(k), str)}
    return own | {t["column"] for t in rule.get("terms", [])} | {c for t in rule.get("terms", []) for c in t.get("when", {})}


def violated(rule: dict) -> Column:
    kind, c = rule["type"], rule.get("column")
    when = condition(rule.get("when"))
    match kind:
        case "unique":
            test = F.count("*").over(Window.partitionBy(*rule["fields"])) > 1
        case "allowed_values":
            test = present(c) & ~clean(F.col(c)).isin(*rule["values"])
        case "range":
            v = finite(F.col(c))
            low = v < rule["min"] if "min" in rule else F.lit(False)
            test = when & (low | (v > rule["max"] if "max" in rule else F.lit(False)))
        case "required_when":
            test = when & ~present(c)
        case "absent_when":
            test = when & present(c)
        case "value_when":
            test = when & present(c) & ~matches(c, rule["values"])
        case "not_value_when":
            test = when & present(c) & matches(c, rule["values"])
        case "arithmetic":
            test = when & (F.abs(finite(F.col(rule["target"])) - total(rule["terms"])) > rule.get("tolerance", 0) + EPS)
        case "lower_bound_sum":
            test = when & (F.coalesce(finite(F.col(rule["target"])), F.lit(0.0)) < total(rule["terms"]) - rule.get("tolerance", 0) - EPS)
        case "exists_exactly":
            test = F.col(rule["count"]) != rule["value"]
        case "count_matches":
            test = F.col(rule["count"]) != finite(F.col(rule["declared"]))
        case "within_period":
            # an unknown period or a month that is no number passes
            month = finite(F.substring(clean(F.col(c)), 3, 2))
            test = present(c) & reduce(lambda a, b: a | b, [(clean(F.col(rule["period"])) == p) & ~month.isin(*map(float, m)) for p, m in rule["months"].items()])
        case _:
            raise ValueError(f"unknown rule type {kind}")
    return F.coalesce(test, F.lit(False))


def in_force(rule: dict, period: str | None = None, inactive: bool = True) -> bool:
    """Active and approved (or all rules are asked for), and of the design period if it names any."""
    return (inactive or (rule.get("active", True) and rule.get("status", "approved") == "approved")) and (period is None or not rule.get("periods") or period in rule["periods"])


def evaluate(df: DataFrame, rules: list[dict], unit: list[str], period: str | None = None, inactive: bool = True) -> DataFrame:
    """unit, rule_id, severity, observed (JSON of the rule's columns): a row a violated rule."""
    fit = [r for r in rules if in_force(r, period, inactive) and columns_of(r) <= set(df.columns)]
    if not fit:
        return df.select(*unit, F.lit("").alias("rule_id"), F.lit("").alias("severity"), F.lit("").alias("observed")).where(F.lit(False))
    hit = lambda r: F.when(violated(r), F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r.get("severity", "error")).alias("severity"), F.to_json(F.struct(*[F.col(c) for c in sorted(columns_of(r))])).alias("observed")))
    marked = df.select(*unit, F.array_compact(F.array(*[hit(r) for r in fit])).alias("_hits"))
    return marked.select(*unit, F.explode("_hits").alias("v")).select(*unit, "v.*")


def padded(c: str, width: int) -> Column:
    text = clean(F.col(c))
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def references(df: DataFrame, codes: DataFrame, parts: list[str], unit: list[str], widths: list[int] | None = None) -> DataFrame:
    """Units whose codes, all present, are not in the list. Both sides are padded with zeros to the widths (2 each)."""
    sizes = widths or [2] * len(parts)
    full = df.where(reduce(lambda a, b: a & b, [present(p) for p in parts])).withColumns({f"_c{i}": padded(p, w) for i, (p, w) in enumerate(zip(parts, sizes, strict=True))})
    listed = codes.select(*[padded(p, w).alias(f"_c{i}") for i, (p, w) in enumerate(zip(parts, sizes, strict=True))]).distinct()
    return full.join(listed, [f"_c{i}" for i in range(len(parts))], "left_anti").select(*unit)


#: Fields every stored rule must have, and those a rule type must name.
METADATA = ("id", "type", "title", "owner", "status", "version")
NEEDS = {"unique": ("fields",), "allowed_values": ("column", "values"), "range": ("column",), "required_when": ("column", "when"), "absent_when": ("column", "when"), "value_when": ("column", "values", "when"), "not_value_when": ("column", "values", "when"), "arithmetic": ("target", "terms"), "lower_bound_sum": ("target", "terms"), "exists_exactly": ("count", "value"), "count_matches": ("count", "declared"), "references": ("fields", "code_list"), "within_period": ("column", "period", "months")}


def problems(rule: dict) -> list[str]:
    """What is wrong with a rule as stored: metadata, type, fields of the type, and its own test cases."""
    out = [f"no {k}" for k in METADATA if not rule.get(k)]
    if rule.get("type") not in NEEDS:
        return [*out, f"unknown type {rule.get('type')}"]
    out += [f"{rule['type']} needs {k}" for k in NEEDS[rule["type"]] if k not in rule]
    if rule["type"] == "range" and not {"min", "max"} & set(rule):
        out.append("range needs min or max")
    if {c.get("expect") for c in rule.get("tests", [])} != {"violates", "passes"}:
        out.append("needs a case that violates and one that passes")
    return out


def load(path: str) -> tuple[list[dict], str]:
    """Rules of a YAML or JSON file, or of all such files of a folder in name order, and the SHA-256 of their contents.

    Fails on problems and on ids given twice."""
    files = sorted(p for p in Path(path).iterdir() if p.suffix in (".yaml", ".yml", ".json")) if Path(path).is_dir() else [Path(path)]
    digest, rules = hashlib.sha256(), []
    for p in files:
        data = p.read_bytes()
        digest.update(p.name.encode() + b"\0" + data + b"\0")
        if p.suffix == ".json":
            rules += json.loads(data)["rules"]
        else:
            import yaml

            rules += yaml.safe_load(data)["rules"]
    wrong = [f"{r.get('id')}: {m}" for r in rules for m in problems(r)]
    wrong += [f"{i}: given twice" for i, n in Counter(r.get("id") for r in rules).items() if n > 1]
    if wrong:
        raise ValueError("; ".join(wrong))
    return rules, digest.hexdigest()


def check_record(spark, rules: list[dict], record: dict, unit: list[str]) -> list[dict]:
    """Online validation: the rules one record violates, and those that don't apply to it."""
    df = spark.createDataFrame([[None if v is None else str(v) for v in record.values()]], ", ".join(f"`{k}` string" for k in record))
    hit = {r["rule_id"] for r in evaluate(df, rules, unit, inactive=False).collect()}
    return [{"rule_id": r["id"], "status": "NOT_APPLICABLE" if not columns_of(r) <= set(record) else "VIOLATED" if r["id"] in hit else "PASSED"} for r in rules if in_force(r, None, False)]


def child_counts(parents: DataFrame, children: DataFrame, key: str, child_key: str, counts: dict[str, Column]) -> DataFrame:
    """parents with counts of their children, 0 where there are none."""
    agg = children.groupBy(F.col(child_key).alias("_k")).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    met = parents.join(agg, F.col(key) == F.col("_k"), "left").drop("_k")
    return met.withColumns({n: F.coalesce(n, F.lit(0)) for n in counts})


def dry_run(df: DataFrame, rules: list[dict], unit: list[str]) -> DataFrame:
    """Every rule: applicable, and distinct units that violate it."""
    spark = df.sparkSession
    named = spark.createDataFrame([(r["id"], columns_of(r) <= set(df.columns)) for r in rules], "rule_id string, applicable boolean")
    found = evaluate(df, rules, unit).groupBy("rule_id").agg(F.countDistinct(F.struct(*unit)).alias("n_units"))
    return named.join(found, "rule_id", "left").withColumn("n_units", F.coalesce("n_units", F.lit(0)))


def self_test(spark, rule: dict) -> bool:
    """Runs the rule's own cases: {"record": {...}, "expect": "violates" or "passes"}; at least one of each is asked for."""
    cases = rule.get("tests", [])
    if {c["expect"] for c in cases} != {"violates", "passes"}:
        return False
    names = sorted(columns_of(rule))
    df = spark.createDataFrame([(i, *[c["record"].get(n) for n in names]) for i, c in enumerate(cases)], "_i int, " + ", ".join(f"`{n}` string" for n in names))
    got = {r["_i"] for r in evaluate(df, [rule], ["_i"]).collect()}
    return got == {i for i, c in enumerate(cases) if c["expect"] == "violates"}
