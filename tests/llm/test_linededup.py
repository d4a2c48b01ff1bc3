"""Line dedup against brute force: a line goes if it lies in a run of WINDOW words that begins earlier too, without overlap."""

import random
import re
import time

import pytest

from plumbline.llm import linededup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window=50):
    lines = [[(p, x, len(WORD.findall(x))) for p, x in enumerate(t.split("\n")) if WORD.search(x)] for t in texts]
    runs, first = [], {}
    for d, own in enumerate(lines):
        for s in range(len(own)):
            for e in range(s, len(own)):
                if sum(x[2] for x in own[s : e + 1]) >= window:
                    run = tuple(x[1] for x in own[s : e + 1])
                    first.setdefault(run, (d, s, e))
                    runs.append((d, s, e, run))
    gone = [set() for _ in texts]
    for d, s, e, run in runs:
        at, _, end = first[run]
        if at != d or s > end:
            gone[d].update(range(s, e + 1))
    out = []
    for d, t in enumerate(texts):
        drop = {lines[d][k][0] for k in gone[d]}
        for k in gone[d]:
            if k + 1 in gone[d]:
                drop.update(range(lines[d][k][0], lines[d][k + 1][0]))
        out.append("\n".join(x for p, x in enumerate(t.split("\n")) if p not in drop))
    return out


def run(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in linededup.dedup(df, **more).orderBy("doc_id").collect()]


def test_equals_brute_force(spark):
    rng = random.Random(8)
    line = lambda: " ".join(rng.choice("abcdefghij") for _ in range(rng.choice([1, 3, 7, 13, 26, 52])))
    pool = [line() for _ in range(9)]
    texts = []
    for _ in range(160):
        parts = []
        for _ in range(rng.choice([1, 3, 8])):
            parts += rng.choice([[rng.choice(pool)], [line()], pool[rng.randrange(6) :][: rng.randrange(1, 5)], [""], [" \t"], ["x\ty  z"] * rng.choice([1, 20])])
        texts.append("\n".join(parts))
    assert run(spark, texts) == brute(texts)


def test_run_behind_an_earlier_frequent_line(spark):
    """The first document shares only part of the run; the two later ones share all of it."""
    rng = random.Random(1)
    for _ in range(3):
        lines = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(13)) for _ in range(4)]
        texts = ["\n".join([*lines[1:3], "only here"]), "\n".join(["a", *lines, "b"]), "\n".join(["c", *lines, "d"])]
        assert run(spark, texts) == [*texts[:2], "c\nd"]


def test_equal_lines_take_linear_time(spark):
    text = "\n".join(["some line of seven words or so"] * 20_000)
    began = time.time()
    got = run(spark, [text, "other"])
    assert got[1] == "other" and got[0].count("\n") == 7
    assert time.time() - began < 60


@pytest.mark.parametrize("text", [None, "", "\n\n", "short text"])
def test_short_texts_stay(spark, text):
    assert run(spark, [text, text]) == [text, text]


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, "a"), (1, text, "b"), (2, text, "c"), (None, text, "d")], "doc_id long, text string, hs string")
    got = sorted((str(r["doc_id"]), r["text"] == text, r["hs"], r["_n_removed"]) for r in linededup.dedup(df).collect())
    assert got == [("1", False, "a", 1), ("1", False, "b", 1), ("2", False, "c", 1), ("None", True, "d", 0)]
