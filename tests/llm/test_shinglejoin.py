"""Classes by 5-word shingles against brute force, and the pipeline's stage."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import shinglejoin, simhash


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def like(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def brute(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or like(sets[i], sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(texts))}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(400)}"
    common = [word() for _ in range(12)]
    out = [["a", "b"], ["a", "b"], [], ["A", "b"], ["a", "b", "c", "d", "e"]]
    for _ in range(12):
        base = [word() for _ in range(rng.choice([30, 80, 150, 505]))] + common
        out.append(base)
        for _ in range(rng.choice([1, 3, 25])):
            copy = list(rng.choice(out[-3:]) if rng.random() < 0.3 else base)
            for _ in range(rng.choice([1, 2, 3, 6])):
                if copy:
                    copy[rng.randrange(len(copy))] = word()
            out.append(copy)
    return [" ".join(t) for t in out]


@pytest.mark.parametrize("small", [2, 8])
def test_classes_equal_brute_force(spark, texts, small):
    want = brute(texts)
    assert 10 < len(set(want.values())) < len(texts) - 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in shinglejoin.classes(df, small=small).collect()} == want


def test_covering_fingerprints_link_and_are_checked(spark, texts):
    """Links of op5's operator unite sets without prefixes, if exactly similar; whatever the fingerprints are, no pair is lost."""
    base = [f"w{i}" for i in range(4000)]
    near = [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in range(0, 4000, 100)]
    slim = spark.createDataFrame(list(enumerate([*texts, " ".join(base), *near])), "_id long, _text string")
    prints = shinglejoin.written(shinglejoin.prefixes(slim), "prefixes")
    distinct = prints.groupBy("sh").agg(F.min("_id").alias("least"), *[F.first(c).alias(c) for c in ("fp", "n", "bits", "prefix")])
    prints_of = {r["sh"]: r["fp"] for r in distinct.collect()}
    pairs = [(r["a"], r["b"]) for r in shinglejoin.covered(distinct).collect()]
    assert pairs and all(((prints_of[a] ^ prints_of[b]) & (1 << 64) - 1).bit_count() <= simhash.RADIUS for a, b in pairs)
    bare = shinglejoin.written(distinct.withColumn("prefix", F.array().cast("array<long>")), "bare")
    assert len({r["root"] for r in shinglejoin.similar(slim, bare).collect()}) < shinglejoin.similar(slim, bare).count()
    want = brute([r["_text"] for r in slim.orderBy("_id").collect()])
    equal = shinglejoin.written(distinct.withColumn("fp", F.lit(0).cast("long")), "equal")
    roots = {r["node"]: r["root"] for r in shinglejoin.similar(slim, equal).collect()}
    mine = {r["_id"]: roots.get(r["sh"], r["sh"]) for r in prints.collect()}
    assert all((mine[i] == mine[j]) == (want[i] == want[j]) for i in want for j in want if j < i)


def test_stage_removes_near_copies(spark):
    import corpus_pipeline

    base = [f"word{i}" for i in range(200)]
    one, three = list(base), list(base)
    one[50] = "other"
    for i in (20, 90, 160):
        three[i] = "other"
    far = [w if i % 10 else "far" for i, w in enumerate(base)]
    df = spark.createDataFrame(list(enumerate(map(" ".join, (base, one, three, far)))), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == [0, 3]
