"""SimHash near-duplicate classes by covering locality-sensitive hashing.

Every bit position gets a vector of radius + 1 bits; for each non-zero vector v there is a table whose mask holds the
bits whose vector has an odd product with v. For any `radius` positions some v is orthogonal to all their vectors, so
its mask avoids them: a pair within the radius agrees on at least one whole mask (Pagh's covering construction).

Work is done on distinct fingerprints, so copies never multiply. In a bucket of up to `small` members all pairs are
compared. A member of a larger bucket is never paired with the others there: it is entered under itself and its 64
one-bit neighbours, and any two fingerprints within two bits share such an entry, while an entry has at most 65
fingerprints. Both ways are exact, so no link is lost. Links are contracted by repeated hooking of every node to its
least neighbour in a random order, with each round written to the shared folder.

Edge cases: null or empty text has fingerprint zero and is linked like any other; fewer than 3 words make one shingle
of the whole sequence; repeated rows share a class; rows with a null doc_id keep their class, whose id is the least
doc_id that is not null (null if there is none); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import as_string, coded, slices, words_of, written

BITS, RADIUS, SEED, SMALL = 64, 2, 42, 8


def masks(radius: int = RADIUS) -> list[int]:
    """The 2^(radius+1) - 1 bit masks. Positions take the non-zero vectors in turn, which keeps the masks of one size."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(BITS) if (v & (i % n + 1)).bit_count() & 1) for v in range(1, n + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def majority(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The fingerprints of the runs of hashes between bounds: a bit is set that is set in over half of a run; no hashes give zero."""
    n = np.diff(bounds)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, bounds[:-1][some], axis=0, dtype=np.int32)
        over = (2 * counts > n[some, None]).astype(np.uint8)
        out[some] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def simhash_texts(col: pa.Array) -> np.ndarray:
    """The fingerprints of an Arrow array of texts without nulls, as unsigned 64-bit integers."""
    from xxhash import xxh64_intdigest

    flat, offsets = words_of(pc.ascii_lower(col))
    words = flat.cast(pa.binary()).to_pylist()
    hashes, bounds = [], np.zeros(len(col) + 1, np.int64)
    for i in range(len(col)):
        w = words[offsets[i] : offsets[i + 1]]
        if len(w) >= 3:
            hashes += [xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(w, w[1:], w[2:], strict=False))]
        elif w:
            hashes.append(xxh64_intdigest(b" ".join(w), SEED))
        bounds[i + 1] = len(hashes)
    return majority(np.array(hashes, np.uint64), bounds)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp long): one pass over the whole texts."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text", 2 << 20):
                fp = simhash_texts(as_string(part.column("_text"))).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], ["_key", "fp"])

    slim = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    return slim.mapInArrow(run, f"_key {kind}, fp long").withColumnRenamed("_key", key)


def links(distinct: DataFrame, radius: int = RADIUS, small: int = SMALL) -> DataFrame:
    """Links (a, b) whose connected components over `distinct` (fp) are those of all pairs within the radius.

    Entries of large buckets are linked to their least fingerprint, which is within two bits of each of them."""
    rows = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks(radius)])).alias("mask", "value"))
    sizes = rows.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1")
    sized = rows.join(sizes, ["mask", "value"])
    few = sized.where(F.col("n") <= small).groupBy("mask", "value").agg(F.collect_list("fp").alias("fps"))  # at most `small` items
    left = few.select("fps", F.explode("fps").alias("a"))
    pairs = left.select("a", F.explode("fps").alias("b")).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    many = sized.where(F.col("n") > small).select("fp").distinct()
    if radius != 2:
        raise ValueError("large buckets are resolved by one-bit neighbours, which is exact for a radius of 2")
    near = many.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(BITS)])).alias("entry"))
    # all members of an entry are within one bit of it, so within two of each other: a star is enough
    hub = near.groupBy("entry").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    star = near.join(hub.drop("n"), "entry").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(star).distinct()


#: So few links are contracted at once in one task.
LAST = 10_000


def _united(pdf: pd.DataFrame) -> pd.DataFrame:
    """The least node of its component for every node of the links."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return pd.DataFrame({"a": list(up), "root": [find(x) for x in up]}, dtype="int64")


def components(edges: DataFrame, max_rounds: int = 50, last: int = LAST) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is one node of the component. Contracts by least-neighbour hooking.

    Each round maps every node to the least of itself and its neighbours, follows that map once more, renames the
    links and drops those that became loops. Nodes are ordered by a hash that changes with the round, so that about a
    third of the nodes are left after each round, whatever the shape. At most `last` links are left to one task. The maps of all rounds are composed at the end.
    Each is written, so a lost executor costs a reread."""
    spark = edges.sparkSession
    now = written(edges.select("a", "b").where("a <> b"), "links")
    maps = []
    for round_no in range(max_rounds):
        left = now.count()
        if not left:
            break
        if left <= last:
            maps.append(written(now.groupBy().applyInPandas(_united, "a long, root long"), "hooks"))
            break
        rank = lambda c: F.struct(F.xxhash64(F.lit(round_no), c).alias("h"), F.col(c).alias("x"))  # noqa: B023, E731
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select("a", F.least(F.col("m"), rank("a")).getField("x").alias("up"))
        over = hook.select(F.col("a").alias("up"), F.col("up").alias("up2"))
        step = written(hook.join(over, "up").select("a", F.col("up2").alias("root")), "hooks")
        maps.append(step)
        renamed = now.join(step, "a").select(F.col("root").alias("x"), F.col("b").alias("a")).join(step, "a").select("x", F.col("root").alias("y"))
        now = written(renamed.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not maps:
        return spark.createDataFrame([], "node long, root long")
    out = maps[-1].select(F.col("a").alias("node"), "root")
    for step in reversed(maps[:-1]):
        far = out.withColumnRenamed("root", "far")
        out = step.join(far, step["root"] == far["node"], "left").select(step["a"].alias("node"), F.coalesce("far", step["root"]).alias("root"))
    return out


def classes(prints: DataFrame, key: str = "doc_id", radius: int = RADIUS, small: int = SMALL) -> DataFrame:
    """(key, fp, component_id) for written fingerprints: one row a document with its class."""
    least = written(prints.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    roots = components(links(least.select("fp"), radius, small))
    named = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    per_fp = written(named.join(ids, "root").select("fp", "component_id"), "classes")
    return prints.join(per_fp, "fp").select(key, "fp", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    found = classes(written(fingerprints(docs, key, text), "prints"), key, radius)
    return found.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One document of each class: the one with the least (doc_id, checksum of the text). Repeated rows keep one copy."""
    slim = docs.select(F.struct(F.col(key).alias("k"), F.xxhash64(text).alias("h")).alias("_id"), F.col(text).cast("string").alias("_text"))
    return chosen_rows(docs, classes(written(fingerprints(slim, "_id", "_text"), "prints"), "_id", radius), key, text)


def chosen_rows(docs: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """The documents whose (key, checksum of the text) is a component_id of `found`; one copy of each."""
    chosen = found.select(F.col("component_id").alias("c")).distinct().select(F.xxhash64(F.coalesce(F.col("c.k").cast("string"), F.lit(""))).alias("_a"), F.col("c.k").isNull().alias("_b"), F.col("c.h").alias("_c"), F.col("c.k").alias("_k"))
    # the merge leaves rows of one (id, checksum) together, so repeated rows are dropped without another shuffle
    own = docs.withColumns({"_a": F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), "_b": F.col(key).isNull(), "_c": F.xxhash64(text)})
    met = own.join(chosen.hint("merge"), ["_a", "_b", "_c"]).where(F.col(key).eqNullSafe(F.col("_k")))
    return met.dropDuplicates(["_a", "_b", "_c"]).select(*docs.columns)
