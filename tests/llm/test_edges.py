"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator and stage."""

import pytest

from plumbline.llm import htmltree, linededup, lm, mixing, packing, phrases, pii, quality, simhash, sstable

SMALL = lm.Settings(words=20, buckets=8, dim=4, rounds=2, dictionary=50)
OPERATORS = {
    "op1": lambda d: sstable.round_trip(d), "op2": lambda d: lm.score_corpus(d, settings=SMALL), "op3": lambda d: phrases.compare_next(d), "op4": lambda d: mixing.mix(d),
    "op5": lambda d: simhash.near_duplicates(d), "op6": lambda d: packing.pack(d), "op7": lambda d: pii.find(d), "op8": lambda d: quality.quality_report(d), "op10": lambda d: linededup.dedup(d),
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, row long, start long, kept boolean, gone array<int>"
LONG = "the quick brown fox " * 5000


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", " \n\t ", LONG, "a b c d", "a b c d", "Mail x@y.org or +1 (555) 123-4567 now", "one\ntwo\n\nthree"]
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else f"s{i % 2}", len(t or ""), 1, 2, 3, 4, True, [0]) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "no id", "en", "s0", 5, 1, 2, 3, 4, True, [0]), (6, "same id", "en", "s1", 7, 1, 2, 3, 4, True, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(docs, name):
    got = OPERATORS[name](docs).collect()
    assert len(got) == docs.count() or (name == "op6" and len(got) > docs.count())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_pages(spark):
    page = "<html><body><nav><a>menu</a></nav><div class='cookie notice'>x</div><article><h1>T</h1><p>A &amp; b<br>c<p>d <b>e</b><div class='comments'><p>no</p></div></article><footer>f</footer>"
    rows = [(1, "http://h/x", page, 1), (1, "http://h/x", page, 1), (2, None, None, 1), (3, "odd", "plain <b>text", 1), (4, "http://h/y", "<p class='unclosed", 1)]
    got = {r["page_id"]: r["text"] for r in htmltree.extract(spark.createDataFrame(rows, "page_id long, url string, html string, low long")).collect()}
    assert got == {1: "T\nA & b\nc\nd e", 2: "", 3: "plain text", 4: ""}
    assert htmltree.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_repeated_menu_is_found_by_the_style_tree(spark):
    rows = [(i, "http://h/x", f"<div class='top'><p>home news</p></div><div class='story'><p>story {i} {i * 7}</p></div>") for i in range(20)]
    assert {r["text"] for r in htmltree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {f"story {i} {i * 7}" for i in range(20)}


def test_stages(spark, docs):
    import corpus_pipeline

    names = docs.columns
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == names
        assert stage(spark, empty, "").count() == 0
    assert simhash.keep_one(docs).where("text = 'a b c d'").count() == 1
