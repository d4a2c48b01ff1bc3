"""Lengths with few documents take the band of the nearest length."""

import pytest

from plumbline.llm import quality

SCHEMA = "doc_id long, lang string, n_words long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double"


@pytest.mark.parametrize("lang", ["en", "xx", None])
def test_rare_lengths_are_judged(spark, lang):
    rows = [(i, "en", 400, 0, 600, 4.0, 0.0, 7.0) for i in range(60)]
    rows += [(100, lang, 9000, 0, 12000, 4.0, 0.0, 6.2), (101, lang, 9000, 0, 12000, 4.0, 0.0, 7.2), (102, lang, 9000, 0, 12000, 4.0, 0.5, 7.2), (103, lang, 60, 0, 70, 9.0, 0.0, 7.0)]
    got = {r["doc_id"]: r["kept"] for r in quality.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i in (0, 100, 101, 102, 103)] == [True, False, True, False, False]
