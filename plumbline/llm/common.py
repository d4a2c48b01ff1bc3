"""Shared pieces of the corpus operators: the shared folder, written tables, and Arrow word arrays."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.scratch import shared_dir, written  # noqa: F401

#: Words are runs of anything but ASCII white space (space and \t \n \v \f \r).
WORD_REGEX = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/plumbline/{tag}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col):
    return F.translate(col, UPPER, LOWER)


def as_string(col: pa.Array) -> pa.Array:
    """Nulls become empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        return pa.array([""] * len(col), pa.string())
    return pc.fill_null(col, "")


def words_of(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and for n texts n + 1 offsets into them."""
    lists = pc.ascii_split_whitespace(col)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    keep = pc.greater(pc.binary_length(flat), 0)
    if pc.all(keep).as_py() is False:
        mask = keep.to_numpy(zero_copy_only=False)
        offsets = np.concatenate(([0], np.cumsum(mask)))[offsets]
        flat = flat.filter(keep)
    return flat, offsets.astype(np.int64)


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(codes, distinct values) of an Arrow array."""
    enc = flat.dictionary_encode()
    return enc.indices.to_numpy(zero_copy_only=False).astype(np.int64), enc.dictionary


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over [offsets[i], offsets[i + 1])."""
    out = np.add.reduceat(np.append(values, values.dtype.type(0)), offsets[:-1]) if len(offsets) > 1 else values[:0]
    return np.where(np.diff(offsets) > 0, out, 0)


def gather(pool: np.ndarray, lens: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs `rows` of a pool whose runs have lengths `lens`, one after another; also the length of each."""
    starts, n = np.cumsum(lens) - lens, lens[rows]
    ends = np.cumsum(n)
    index = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64) + np.repeat(starts[rows] - (ends - n), n)
    return pool[index], n


class Pool:
    """Ids of words, found in batches by `fill` (distinct words -> all their ids in order, and how many each has).

    All are kept, until `limit` are held and the pool starts anew, so it never grows with the corpus. A batch of more new
    words than fit keeps the ones seen twice in it, if those fit."""

    def __init__(self, fill: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], dtype: str, limit: int = 500_000):
        self.fill, self.limit, self.dtype = fill, limit, np.dtype(dtype)
        self._empty()

    def _empty(self) -> None:
        self.words, self.ids, self.lens = pa.array([], pa.string()), np.zeros(0, self.dtype), np.zeros(0, np.int64)

    def take(self, words: pa.Array, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words[c] for all codes c in order; also the count of ids of each."""
        at = pc.index_in(words, value_set=self.words)
        new = at.is_null().to_numpy(zero_copy_only=False)
        row = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        row[new] = len(self.words) + np.arange(int(new.sum()))
        missing = words.filter(pa.array(new))
        fresh, fresh_n = self.fill(missing) if len(missing) else (self.ids[:0], self.lens[:0])
        pool, lens = np.concatenate((self.ids, fresh)), np.concatenate((self.lens, fresh_n))
        out = gather(pool, lens, row[codes])
        keep = np.flatnonzero(new)
        if len(self.words) + len(keep) > self.limit:
            keep = np.flatnonzero(new & (np.bincount(codes, minlength=len(words)) > 1))
        if len(self.words) + len(keep) > self.limit:
            self._empty()
        elif len(keep):
            ids, n = gather(pool, lens, row[keep])
            self.words = pa.concat_arrays([self.words, words.take(pa.array(keep))])
            self.ids, self.lens = np.concatenate((self.ids, ids)), np.concatenate((self.lens, n))
        return out


def give_back() -> None:
    """Returns freed memory to the system: a worker lives through many tasks and stages, and its peak would stay with it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, text: str, limit: int = 4 << 20):
    """Cuts a batch into parts of about `limit` bytes of text (one row at least), so that memory follows neither rows nor text."""
    lens = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(lens)
    at = 0
    while at < len(lens):
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end
    give_back()
