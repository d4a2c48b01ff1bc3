"""Document fingerprints by locally consistent parsing.

Level 0 is the text's code points. On each level runs of equal names become one name; deterministic coin tossing then
gives every name a label under 6 from its neighbours to the left (the lowest bit in which two names differ, and that
bit, four times over); phrases begin at local maxima of the labels, and a phrase is named by a hash of its names. A
cut depends on a bounded neighbourhood, so equal substrings have equal phrases inside, wherever they stand. The
fingerprint holds, for `SLOTS` hash functions, the least hash over the phrase names of two levels (phrases of about 9
and 27 characters): 16 bits a slot. Likeness is the share of equal slots, corrected for chance.

Edge cases: null is empty text; all empty texts have one fingerprint (all ones) and likeness 1; repeated rows and
equal ids are ordered by the text's checksum; a table of one row is its own next document; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from plumbline.llm.common import as_string, slices, written

#: level -> slots: level 2 has phrases of about 9 characters, level 3 of about 27
SLOTS = {2: 24, 3: 40}
COINS = 4
N_SLOTS = sum(SLOTS.values())
_rng = np.random.default_rng(20240229)
ODD, PLUS = (_rng.integers(0, 1 << 63, N_SLOTS, np.uint64) * np.uint64(2) + np.uint64(1), _rng.integers(0, 1 << 63, N_SLOTS, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def next_level(a: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of a, and a mask of those that begin a text; first masks the names that begin one."""
    new = first.copy()
    new[1:] |= a[1:] != a[:-1]
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(a))).astype(np.uint64)
    a, first = np.where(run > 1, mix(a[at] + run * np.uint64(0x9E3779B97F4A7C15)), a[at]), first[at]
    label = a
    for _ in range(COINS):
        one = label.dtype.type(1)
        before = np.empty_like(label)
        before[0], before[1:] = label[0] ^ one, label[:-1]
        before[first] = label[first] ^ one
        differ = label ^ before
        bit = np.bitwise_count((differ & (~differ + one)) - one)
        label = (bit << np.uint8(1)) | ((label >> bit) & one).astype(np.uint8)  # under 128 from the first toss on
    up = np.empty(len(label), bool)
    up[0], up[1:] = True, label[1:] > label[:-1]
    down = np.empty(len(label), bool)
    down[-1], down[:-1] = True, label[:-1] > label[1:]
    ends = np.append(first[1:], True)
    start = first | (up & (down | ends))
    at = np.flatnonzero(start)
    place = np.arange(len(a)) - np.repeat(at, np.diff(np.append(at, len(a))))
    names = mix(np.add.reduceat(mix(a + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)), at))
    return names, first[at]


def fingerprint_arrays(texts: list[np.ndarray]) -> np.ndarray:
    """(n, N_SLOTS) uint16 for code-point arrays."""
    out = np.full((len(texts), N_SLOTS), 0xFFFF, np.uint16)
    full = [i for i, t in enumerate(texts) if len(t)]
    if not full:
        return out
    a = np.concatenate([texts[i] for i in full]).astype(np.uint64)
    first = np.zeros(len(a), bool)
    first[np.concatenate(([0], np.cumsum([len(texts[i]) for i in full[:-1]]))).astype(np.int64)] = True
    slot = 0
    for level in range(1, max(SLOTS) + 1):
        a, first = next_level(a, first)
        starts = np.flatnonzero(first)
        for _ in range(SLOTS.get(level, 0)):
            least = np.minimum.reduceat(a * ODD[slot] + PLUS[slot], starts)  # names are well mixed, so a multiplication orders them anew
            out[full, slot] = (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
            slot += 1
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    chance = 2.0**-16
    return np.clip(((a == b).mean(axis=-1) - chance) / (1 - chance), 0.0, 1.0)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def hexed(prints: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in prints]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every text: one pass, no shuffle."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text", 4 << 20):
                got = fingerprint_arrays([points(t) for t in as_string(part.column("_text")).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("_key"), pa.array(hexed(got))], ["_key", "fingerprint"])

    return docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).mapInArrow(run, f"_key {kind}, fingerprint string").withColumnRenamed("_key", key)


FOUND = ["n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
FOUND_TYPES = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
FOUND_SCHEMA = "n_chars long, edited binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def compared(texts: list[str]) -> list[list]:
    """FOUND's columns for all texts but the last, each against the one after it."""
    own = [points(t) for t in texts]
    n = len(texts) - 1
    cut = [len(own[i]) // 3 for i in range(n)]
    edited = [np.concatenate((own[i][: len(own[i]) - c], own[i + 1][:c])) for i, c in enumerate(cut)]
    prints = fingerprint_arrays(own + edited)
    mine, theirs = prints[: n + 1], prints[n + 1 :]
    sha = [hashlib.sha256(e.astype("<u4").tobytes().decode("utf-32-le").encode()).digest() for e in edited]
    return [[len(x) for x in own[:n]], sha, [r.astype(">u2").tobytes() for r in mine[:n]], [r.astype(">u2").tobytes() for r in theirs], likeness(mine[:n], theirs).tolist(), likeness(mine[:n], mine[1:]).tolist()]


def compare_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text with its edited text: one range shuffle of the texts by descending key.

    A task meets the next document of all its rows but the last; the first and last text of each task are kept and
    the last ones are matched with the first of the following task, which is one row a task."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"_key {kind}, part int, head string, tail string, {FOUND_SCHEMA}"
    names = ["_key", "part", "head", "tail", *FOUND]

    def rows(keys, part, head, tail, found):
        return pa.RecordBatch.from_arrays([keys, pa.array([part] * len(keys), pa.int32()), pa.array(head, pa.string()), pa.array(tail, pa.string()), *(pa.array(c, t) for c, t in zip(found, FOUND_TYPES, strict=True))], names)

    def run(batches):
        part, held_key, held, begun = TaskContext.get().partitionId(), None, None, False
        for batch in batches:
            for piece in slices(batch, "_text", 4 << 20):
                texts, keys = as_string(piece.column("_text")).to_pylist(), piece.column("_key")
                if held is not None:
                    texts, keys = [held, *texts], pa.concat_arrays([held_key, keys])
                n = len(texts) - 1
                if n:
                    head = [None] * n
                    if not begun:
                        head[0], begun = texts[0], True
                    yield rows(keys.slice(0, n), part, head, [None] * n, compared(texts))
                held_key, held = keys.slice(n, 1), texts[n]
        if held is not None:
            yield rows(held_key, part, [None if begun else held], [held], [[None]] * 6)

    slim = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    order = [F.col("_key").desc_nulls_last(), F.xxhash64("_text").asc()]
    done = written(slim.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), "phrases")
    heads = done.where("head is not null").select(F.col("part").alias("at"), F.col("head").alias("after"))
    w = Window.orderBy("at")  # a row a task
    ring = heads.select("at", F.coalesce(F.lead("at").over(w), F.min("at").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next_at"))
    tails = done.where("tail is not null").select("_key", "part", "tail")
    joined = tails.join(ring, tails["part"] == ring["at"]).drop("at").join(heads, F.col("next_at") == heads["at"]).select("_key", "tail", "after")

    def last(batches):
        for batch in batches:
            for i in range(len(batch)):
                yield pa.RecordBatch.from_arrays([batch.column("_key").slice(i, 1), *(pa.array(c, t) for c, t in zip(compared([batch.column("tail")[i].as_py(), batch.column("after")[i].as_py()]), FOUND_TYPES, strict=True))], ["_key", *FOUND])

    both = done.where("tail is null").select("_key", *FOUND).unionByName(joined.mapInArrow(last, f"_key {kind}, {FOUND_SCHEMA}"))
    hexa = lambda c: F.lower(F.hex(c)).alias(c)
    return both.select(F.col("_key").alias(key), "n_chars", F.lower(F.hex("edited")).alias("edited_sha256"), hexa("fingerprint"), hexa("edited_fingerprint"), "near_edited", "near_next")
