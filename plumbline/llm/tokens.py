"""Whole texts to token ids with the public tokenizers, a distinct chunk at a time.

Both vocabularies split a text at white space before they merge, so the ids of a text are those of its chunks in
order; each distinct chunk of a batch is encoded once by the library. A chunk never ends inside a run of white space,
which is what makes the cut exact (tests compare it with whole-text encoding). Words of the second vocabulary are
encoded many to a string, with a mark between them whose one id no other word can yield."""

from __future__ import annotations

import re
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from plumbline.llm.common import Pool, coded, gather, words_of

BYTE_BPE, WORD_BPE, END = "byte_bpe_50k.json", "word_bpe_49k.json", 0
MARK = "♥"
CUT = "￿"
SPACES = r"[\s\x0b\x1c-\x1f\x{85}\pZ]"
_SPACE, _LINE = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"(?<=\S)\n(?=\S)")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


def _one_by_one(path: str, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    found = [e.ids for e in tokenizer(path).encode_batch_fast(chunks, add_special_tokens=False)]
    return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))


def _many_to_a_string(path: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same for words without white space; those with the mark in them are encoded alone."""
    odd = pc.match_substring(words, MARK).to_numpy(zero_copy_only=False)
    plain = words.filter(pa.array(~odd)).to_pylist()
    texts = [" ".join([f"{w} {MARK}" for w in plain[i : i + 256]]) for i in range(0, len(plain), 256)]
    ids, _ = _one_by_one(path, texts)
    stops = np.flatnonzero(ids == tokenizer(path).encode(MARK, add_special_tokens=False).ids[0])
    if len(stops) != len(plain):
        return _one_by_one(path, words.to_pylist())
    ids, n = np.delete(ids, stops), np.diff(stops, prepend=-1) - 1
    if odd.any():
        own, own_n = _one_by_one(path, words.filter(pa.array(odd)).to_pylist())
        ids, n = np.concatenate((ids, own)), np.concatenate((n, own_n))
        return gather(ids, n, np.argsort(np.concatenate((np.flatnonzero(~odd), np.flatnonzero(odd)))))
    return ids, n


@cache
def _chunks(path: str, by_word: bool) -> Pool:
    return Pool((lambda w: _many_to_a_string(path, w)) if by_word else (lambda c: _one_by_one(path, c.to_pylist())), "<u4")


def _cut(col: pa.Array) -> pa.Array:
    """The texts with CUT at every place where byte-level pre-tokenisation surely ends a token."""
    runs = pc.match_substring_regex(col, SPACES + SPACES).to_numpy(zero_copy_only=False)
    if not runs.any():
        return pc.replace_substring(pc.replace_substring(col, " ", CUT + " "), "\n", CUT + "\n" + CUT)
    plain = _cut(pc.if_else(pa.array(~runs), col, ""))
    slow = [_LINE.sub(CUT + "\n" + CUT, _SPACE.sub(CUT + " ", t)) if r else "" for t, r in zip(col.to_pylist(), runs, strict=True)]
    return pc.if_else(pa.array(runs), pa.array(slow, pa.string()), plain)


def encode(col: pa.Array, path: str, by_word: bool) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts as uint32, n + 1 offsets). by_word: white space is dropped and case ignored, as word_bpe does."""
    if by_word:
        flat, at = words_of(pc.ascii_lower(col))
    elif pc.any(pc.match_substring(col, CUT)).as_py():
        ids = [e.ids for e in tokenizer(path).encode_batch_fast(col.to_pylist(), add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.uint32), np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
    else:
        lists = pc.split_pattern(_cut(col), CUT)
        flat, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        at = at - at[0]
    codes, chunks = coded(flat)
    ids, n = _chunks(path, by_word).take(chunks, codes)
    return ids, np.concatenate(([0], np.cumsum(n)))[at]
