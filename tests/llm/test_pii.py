"""Base spans against the plain patterns of their definition, linear time, and the judged candidates."""

import hashlib
import random
import re
import time

import pytest

from plumbline.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def passes(kind, s):
    digits = re.sub(r"[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def plain_spans(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PLAIN.items()) for m in p.finditer(text) if passes(k, m.group())]
    return [(s, k, e) for s, _, e, k in sorted(found)]


def test_base_spans_equal_plain_patterns():
    rng = random.Random(6)
    bits = ["a.b", "@", "x-y", ".", "org", " ", "-", "+", "1", "25", "255", "256", "000", "4111111111111111", "(555)", "é", "\n", "10.0.0.1", "+1 (555) 123-4567", "a@b.c", "٣"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_query_equals_plain_patterns(spark):
    from plumbline.llm import queries

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.op7_candidate_boosting(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want, own = plain_spans(r["text"] or ""), got.pop(r["doc_id"])
        assert own["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in want).encode()).hexdigest()
        assert [own[f"n_{k}"] for k in PLAIN] == [sum(k == x for _, x, _ in want) for k in PLAIN]
        assert {f"{k}:{s}:{e}" for s, k, e in want} <= set(filter(None, own["spans"].split(",")))
    assert not got


@pytest.mark.parametrize("text", ["a" * 1_000_000 + " @", "1" * 1_000_000, "1." * 500_000, "0" * 5000 + ".1.1.1", "1 " * 500_000, "+1" + " " * 1_000_000, "+1" * 400_000, "a@" * 400_000, "a@b.c " * 100_000, "A" * 1_000_000, "f" * 1_000_000 + "1", "token=" + "x" * 1_000_000, "a at b" * 200_000, "(" * 1_000_000, "sk_" * 300_000])
def test_long_runs_take_linear_time(text):
    began = time.time()
    pii.spans(text)
    assert time.time() - began < 25


def test_every_generator_reaches_the_judge_whatever_else_the_text_holds():
    for s in ("sk_abcdefghijklmnopqrst", "ghp_abcdefghijklmnopqrstuv", "AKIAABCDEFGHIJKLMN", "name (at) host (dot) org", "name at host dot org", "DE12 3456 7890 1234 5678 90", "123-45-6789", "555 123 4567", "password=hunter2x"):
        for text in (f"plain words {s} more words", f"see 3 @ {s} more words"):
            assert any(s.endswith(text[a:b]) for a, _, b in pii.candidates(text)), text


def test_best_of_overlapping_candidates_stays():
    text = 'mail a.b@c.org key token = "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e" end'
    base, every = pii.spans(text)
    assert [k for _, k, _ in base] == ["email"] and [k for _, k, _ in every] == ["email", "secret"]
    assert pii.redact(text, every) == 'mail [email] key token = "[secret]" end'
    taken = pii.Taken([(2, "x", 5), (4, "y", 8)])
    assert [taken.free(*x) for x in ((0, 2), (1, 3), (7, 9), (8, 9))] == [True, False, False, True]


def test_edges(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "x@y.org")]
    got = sorted((str(r["doc_id"]), r["n_email"], r["spans"], r["redacted"]) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect())
    assert got == [("1", 0, "", ""), ("2", 0, "", ""), ("2", 0, "", ""), ("None", 1, "email:0:7", "[email]")]
