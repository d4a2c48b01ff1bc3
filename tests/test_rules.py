"""Stored rules, their conditions, and online validation."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import values
from plumbline.operators import audit, rules

RULE = {"id": "R1", "type": "value_when", "title": "t", "owner": "o", "status": "approved", "version": 1, "column": "code", "values": ["01"], "when": {"kind": {"in": ["1"]}}, "tests": [{"record": {"code": "1", "kind": "1"}, "expect": "violates"}, {"record": {"code": "01", "kind": "1"}, "expect": "passes"}]}


def found(spark, rule, rows, names):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} string" for n in names))
    return sorted(r["i"] for r in rules.evaluate(df, [rule | {"id": "x"}], ["i"]).collect())


def test_codes_are_text_unless_given_as_numbers(spark):
    rows = [("1", "1"), ("01", "1"), ("1.0", "1"), ("x", "1"), ("1", "01"), ("", "1")]
    assert found(spark, RULE, rows, ["code", "kind"]) == [0, 2, 3]
    assert found(spark, RULE | {"values": [1]}, rows, ["code", "kind"]) == [3]
    assert found(spark, {"type": "not_value_when", "column": "code", "values": ["01"], "when": {"kind": {"not_in": ["01"]}}}, rows, ["code", "kind"]) == [1]


def test_unknown_periods_and_months_pass(spark):
    rule = {"type": "within_period", "column": "day", "period": "q", "months": {"Q1": ["01", "02"]}}
    assert found(spark, rule, [("05011999", "Q1"), ("05031999", "Q1"), ("05031999", "Q9"), ("05XX1999", "Q1"), ("", "Q1")], ["day", "q"]) == [1]


def test_references_pad_both_sides(spark):
    df = spark.createDataFrame([(1, "7"), (2, "07"), (3, "8"), (4, "")], "i int, c string")
    codes = spark.createDataFrame([("7",), ("09",)], "c string")
    assert [r["i"] for r in rules.references(df, codes, ["c"], ["i"]).collect()] == [3]


@pytest.mark.parametrize("suffix", [".yaml", ".json"])
def test_load(spark, tmp_path, suffix):
    import yaml

    write = json.dumps if suffix == ".json" else yaml.safe_dump
    (tmp_path / f"a{suffix}").write_text(write({"rules": [RULE]}))
    got, digest = rules.load(str(tmp_path))
    assert got == [RULE] and len(digest) == 64 and rules.self_test(spark, got[0])
    (tmp_path / f"b{suffix}").write_text(write({"rules": [RULE, {"id": "R2", "type": "range"}]}))
    with pytest.raises(ValueError, match="R2: no title.*R1: given twice"):
        rules.load(str(tmp_path))


def test_only_rules_in_force_apply(spark):
    draft = RULE | {"id": "D", "status": "draft"}
    old = RULE | {"id": "O", "periods": ["old"]}
    df = spark.createDataFrame([(1, "1", "1")], "i int, code string, kind string")
    assert {r["rule_id"] for r in rules.evaluate(df, [RULE, draft, old], ["i"], period="new", inactive=False).collect()} == {"R1"}
    assert {r["rule_id"] for r in rules.evaluate(df, [RULE, draft, old], ["i"]).collect()} == {"R1", "D", "O"}
    got = rules.check_record(spark, [RULE, draft, RULE | {"id": "N", "column": "nowhere"}], {"i": 1, "code": "1", "kind": "1"}, ["i"])
    assert {r["rule_id"]: r["status"] for r in got} == {"R1": "VIOLATED", "N": "NOT_APPLICABLE"}


def test_keyed_hash_is_hmac(spark):
    import hashlib
    import hmac

    for key in ("k", "x" * 100):
        got = spark.createDataFrame([("é1",), ("",)], "c string").select("c", values.hmac_sha256(F.col("c"), key).alias("h")).collect()
        assert all(r["h"] == hmac.new(key.encode(), r["c"].encode(), hashlib.sha256).hexdigest() for r in got)


def test_chain_and_refusals(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "a")], "k int, o int, x string")
    stored = audit.chain(df, "k", "o", ["x"])
    assert audit.verify(stored, "k", "o", ["x"]).count() == 0
    cut = stored.where("not (k = 1 and o = 2)")
    assert [(r["k"], r["o"], r["fault"]) for r in audit.verify(cut, "k", "o", ["x"]).collect()] == [(1, 3, "LINK")]
    assert audit.refusals({"decision": "CONFIRMED_ERROR", "reason": " ", "seen_hash": "a"}, {"event_hash": "b"}) == ["REASON_REQUIRED", "CHANGED_SINCE_READ"]
    assert audit.refusals({"decision": "REFERRED"}, None) == [] and audit.refusals({"decision": "x"}, None) == ["UNKNOWN_DECISION"]
