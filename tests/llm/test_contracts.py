"""The contract's columns against brute force over whole tables, and defined results for odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from plumbline.llm import mixing, phrases, queries, simhash, sstable
from plumbline.llm.tokens import BYTE_BPE, tokenizer, tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op1(spark, texts):
    t, start = tokenizer(tokenizer_path(BYTE_BPE)), 0
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op1_sstable(spark, SF).collect()}
    for k in sorted(texts):
        ids = [*t.encode(texts[k], add_special_tokens=False).ids, 0]
        assert got.pop(k) == (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
    assert not got


def test_op2_base(spark, texts):
    words = {k: [*WORD.findall(t.translate(LOWER)), None] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in texts}
    c = Counter(w for k, ws in words.items() if not held[k] for w in ws)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in queries.op2_log_bilinear(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for k, ws in words.items():
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(ws), sum(w in c for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_op3(spark, texts):
    ids = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in queries.op3_phrases(spark, SF).collect()}
    prints = {}
    for i, k in enumerate(ids):
        t, nxt = texts[k], texts[ids[(i + 1) % len(ids)]]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        r = got.pop(k)
        own, other, next_ = (phrases.fingerprint_arrays([phrases.points(x)])[0] for x in (t, edited, nxt))
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == phrases.hexed([own])[0] and r["edited_fingerprint"] == phrases.hexed([other])[0]
        assert r["near_edited"] == pytest.approx(float(phrases.likeness(own, other))) and r["near_next"] == pytest.approx(float(phrases.likeness(own, next_)))
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    assert not got


def test_op4_targets_are_met_and_reruns_agree(spark, texts):
    one, two = (sorted(map(tuple, queries.op4_mixing(spark, SF).collect())) for _ in range(2))
    assert one == two and len(one) == len(texts)
    by_target = {}
    for k, size, whole, target, taken in one:
        assert size == len(WORD.findall(texts[k])) and 0 <= taken <= 2 * size
        got = by_target.setdefault((whole, target), [0, 0])
        got[0], got[1] = got[0] + taken, max(got[1], size)
    assert all(abs(taken - target) <= most for (_, target), (taken, most) in by_target.items())


def test_op5_from_texts_to_components(spark, texts):
    import pyarrow as pa

    prints = {k: int(simhash.simhash_texts(pa.array([t]))[0]) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op5_covering_simhash(spark, SF).collect()}
    assert got == {k: (f"{prints[k]:016x}", find(k)) for k in texts}


def test_op8_base_columns(spark, texts):
    got = {r["doc_id"]: r for r in queries.op8_fertility(spark, SF).collect()}
    for k, t in texts.items():
        ws, r = WORD.findall(t), got.pop(k)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = Counter(zip(ws, ws[1:], ws[2:], strict=False))
        inside = {i + j for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for j in range(3)}
        failed = len(ws) < 50 or 100 * len(inside) > 50 * len(ws)
        want = (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside), failed)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (failed and r["kept"])
    assert not got


def test_values_of_odd_rows(spark):
    rows = [(2, None, "a"), (1, "x y", "a"), (1, "x y", "b"), (None, "z", None), (3, "", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((str(r["doc_id"]), r["start"], r["n_tokens"]) for r in sstable.round_trip(df).collect())
    assert got == [("1", 2, 3), ("1", 5, 3), ("2", 8, 1), ("3", 9, 1), ("None", 0, 2)]
    mixed = sorted((str(r["doc_id"]), str(r["source"]), r["size"], r["source_size"], r["taken"]) for r in mixing.mix(df).collect())
    assert [x[:4] for x in mixed] == [("1", "a", 2, 2), ("1", "b", 2, 2), ("2", "a", 0, 2), ("3", "a", 0, 2), ("None", "None", 1, 1)]
    near = {(str(r["doc_id"]), r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert near[("2", "0" * 16)] == near[("3", "0" * 16)] == 2 and len(near) == 4


def test_ties_in_the_mix_are_drawn_one_by_one(spark):
    df = spark.createDataFrame([(7, "a b c d", "s")] * 10 + [(8, "a b c d", "t")] * 90, "doc_id long, text string, source string")
    got = mixing.mix(df).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 4 for r in got) and len(got) == 2


def test_every_stage_of_the_pipeline_works_on_what_the_last_kept(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert out.columns == docs.columns and {r["doc_id"] for r in rows} <= set(seen)
        if name == "quality_rules":
            good = {r["doc_id"] for r in queries.op8_fertility(spark, SF).where("kept").collect()}
            assert {r["doc_id"] for r in rows} == good
        if name == "line_dedup":
            assert all(r["n_chars"] == len(r["text"]) for r in rows) and len(rows) == docs.count()
        if name == "near_dedup":
            texts = [r["text"] for r in rows]
            assert len(set(texts)) == len(texts)
        if name == "mix_sources":
            want = {r["doc_id"]: r["epochs"] + r["drawn"] for r in mixing.mix(docs).collect()}
            assert Counter(r["doc_id"] for r in rows) == {k: n for k, n in want.items() if n}
        docs = spark.createDataFrame(rows, docs.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    fill = Counter()
    for r in pieces:
        fill[r["sequence_id"]] += r["length"]
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.collect()} and max(fill.values()) <= 2048
