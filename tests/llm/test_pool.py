"""The bounded pool of words gives the same ids as filling each word alone, whatever its limit."""

import random

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm.common import Pool


@pytest.mark.parametrize("limit", [0, 3, 10, 500_000])
def test_pool_equals_direct_fill(limit):
    sent = []

    def own(word):
        return [ord(c) for c in word]

    def fill(words):
        sent.extend(words.to_pylist())
        found = [own(w) for w in words.to_pylist()]
        return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)

    pool, rng = Pool(fill, "<u4", limit), random.Random(limit)
    for _ in range(60):
        words = list({"".join(rng.choices("abc", k=rng.randrange(4))) for _ in range(rng.randrange(12))})
        codes = np.array([rng.randrange(len(words)) for _ in range(20)] if words else [], np.int64)
        ids, n = pool.take(pa.array(words, pa.string()), codes)
        assert ids.tolist() == [i for c in codes for i in own(words[c])] and n.tolist() == [len(words[c]) for c in codes]
        assert len(pool.words) <= limit
    assert (len(sent) == len(set(sent))) == (limit == 500_000)
