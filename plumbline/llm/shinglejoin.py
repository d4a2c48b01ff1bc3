"""Near-duplicate classes by word shingles: pairs whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

First come the links of op5's operator: each set has a SimHash fingerprint, fingerprints link by covering masks
(`simhash.links`), and the sets of a link or of one fingerprint are checked exactly. A similarity bounds no distance of
fingerprints, so the sets still apart are compared by prefix filtering, which loses no pair: with all shingles in one
order, two sets of similarity s share one of the first n - ceil(s n) + 1 shingles of each. The order puts shingles of
crowded hash slots last, so common lines rarely stand in a prefix; any order gives the same pairs. Each set also has a
bitmap of parities, about a bit a member, whose differing bits are never more than the sets' differing members, so a
pair with too many is no pair. The longer of two bitmaps is folded to the size of the other. All other pairs are checked
on the whole sets.

Work is done on distinct sets, so copies never multiply. In a bucket (the sets with one shingle in their prefix) of up
to `small` members all pairs not yet in one component are checked. The members of a larger one are checked against its
least member first, and then only those still in different components, in blocks of bounded size that give as rows only
the pairs their bitmaps allow. So a large class costs a star; a large bucket of unlike sets costs comparisons of its
blocks, not rows. Shingles and sets are known by 64-bit hashes.

Edge cases: null or empty text has the empty set, which is like itself only; fewer than 5 words make one shingle of
the whole sequence; case is ignored (ASCII); repeated rows share a class; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import as_string, coded, slices, words_of, written
from plumbline.llm.simhash import chosen_rows, components, links, majority

WORDS, SEED, SMALL, SLOTS, MAP_BITS, BLOCK = 5, 42, 8, 1 << 18, 512, 512
#: Similarity as a fraction, so that no limit is rounded.
OVER, UNDER = 4, 5
#: Up to so many set hashes go to every task.
MAX_BROADCAST = 200_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sets_of(col: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, as unsigned 64-bit integers."""
    from xxhash import xxh64_intdigest

    flat, at = words_of(pc.ascii_lower(col))
    codes, words = coded(flat)
    own = np.fromiter((xxh64_intdigest(w, SEED) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))[codes]

    def shingles(h: np.ndarray, n: int) -> np.ndarray:
        out = np.full(max(len(h) - n + 1, 0), n, np.uint64)
        for i in range(n):
            out = _mixed(out * FACTOR + h[i : i + len(out)])
        return out

    every = shingles(own, WORDS)
    return [np.unique(every[a : b - WORDS + 1] if b - a >= WORDS else shingles(own[a:b], b - a) if b > a else every[:0]) for a, b in zip(at[:-1], at[1:], strict=True)]


def set_hash(own: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(own.tobytes(), SEED)
    return h - (1 << 64) if h >> 63 else h


def parities(own: np.ndarray) -> np.ndarray:
    size = max(MAP_BITS, 1 << max(len(own) - 1, 0).bit_length())
    odd = np.bincount(((own >> np.uint64(24)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    at = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)))


def crowded(slim: DataFrame) -> dict[int, int]:
    """Counts of the hash slots with over twice the average number of texts."""

    def run(batches):
        n = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in slices(batch, "_text"):
                for own in sets_of(as_string(part.column("_text"))):
                    n[(own & np.uint64(SLOTS - 1)).astype(np.int64)] += 1
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["slot", "n"])

    found = written(slim.select("_text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")), "slots")
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return {r["slot"]: r["n"] for r in found.where(F.col("n") * SLOTS > 2 * total).collect()}  # under half of SLOTS


def prefixes(slim: DataFrame) -> DataFrame:
    """_id, sh (hash of the set), fp (fingerprint), n, bits (parities), prefix of every row."""
    slots = crowded(slim)
    shared = slim.sparkSession.sparkContext.broadcast((np.fromiter(slots, np.int64, len(slots)), np.fromiter(slots.values(), np.int64, len(slots))))
    kind = slim.schema["_id"].dataType.simpleString()

    def run(batches):
        rank = np.zeros(SLOTS, np.int64)
        rank[shared.value[0]] = shared.value[1]
        for batch in batches:
            for part in slices(batch, "_text"):
                sets = sets_of(as_string(part.column("_text")))
                heads = [own[np.argsort(rank[(own & np.uint64(SLOTS - 1)).astype(np.int64)], kind="stable")[: len(own) + (-OVER * len(own)) // UNDER + 1]] for own in sets]
                fp = majority(np.concatenate([np.zeros(0, np.uint64), *sets]), np.cumsum([0, *map(len, sets)])).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(map(set_hash, sets), pa.int64()), pa.array(fp), pa.array([len(s) for s in sets], pa.int32()), _lists([parities(s) for s in sets]), _lists(heads)], ["_id", "sh", "fp", "n", "bits", "prefix"])

    return slim.select("_id", "_text").mapInArrow(run, f"_id {kind}, sh long, fp long, n int, bits array<long>, prefix array<long>")


def sets_by_hash(slim: DataFrame, need: DataFrame) -> DataFrame:
    """sh, items of the sets in need (_id, sh), which is written."""
    few = need.count() <= MAX_BROADCAST
    own = slim.join(F.broadcast(need.select(F.xxhash64("_id").alias("_n")).distinct()), F.xxhash64("_id") == F.col("_n"), "left_semi") if few else slim

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                sets = sets_of(as_string(part.column("_text")))
                yield pa.RecordBatch.from_arrays([pa.array(map(set_hash, sets), pa.int64()), _lists(sets)], ["sh", "items"])

    found = own.select("_text").mapInArrow(run, "sh long, items array<long>")
    return found.join(F.broadcast(need) if few else need, "sh", "left_semi").dropDuplicates(["sh"])


def checked(pairs: DataFrame, slim: DataFrame, distinct: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar enough: by their bitmaps, then by their whole sets."""
    side = lambda c: distinct.select(F.col("sh").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"m{c}"))
    half = lambda c, i: F.slice(c, 1 + i * F.floor(F.size(c) / 2).cast("int"), F.floor(F.size(c) / 2).cast("int"))
    # similar sets are within a fifth in size, so their bitmaps are within one doubling
    folded = lambda c, d: F.when(F.size(c) > F.size(d), F.zip_with(half(c, 0), half(c, 1), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(c))
    differ = F.aggregate(F.zip_with(folded("ma", "mb"), folded("mb", "ma"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    may = written(pairs.join(side("a"), "a").join(side("b"), "b").where((OVER + UNDER) * differ <= (UNDER - OVER) * (F.col("na") + F.col("nb"))).select("a", "b"), "may")
    need = written(may.select(F.explode(F.array("a", "b")).alias("sh")).distinct().join(distinct.select("sh", F.col("least").alias("_id")), "sh"), "need")
    sets = written(sets_by_hash(slim, need), "sets")
    met = may.join(sets.select(F.col("sh").alias("b"), F.col("items").alias("y")), "b").join(sets.select(F.col("sh").alias("a"), F.col("items").alias("x")), "a")
    both = F.size(F.array_intersect("x", "y"))
    return written(met.where((OVER + UNDER) * both >= OVER * (F.size("x") + F.size("y"))).select("a", "b"), "similar")


def _between(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs (a, b) of two blocks of a bucket (or within one) whose bitmaps allow them, unless an earlier bucket holds both."""
    sh, n, root, mine = (pdf[c].to_numpy() for c in ("sh", "n", "root", "mine"))
    t, whole = int(pdf["t"].iloc[0]), int(pdf["i"].iloc[0]) == int(pdf["j"].iloc[0])
    bits = [np.asarray(x, np.int64).view(np.uint64) for x in pdf["bits"]]
    early = [[x for x in ts if x < t] for ts in pdf["ts"]]
    column = {x: k for k, x in enumerate(sorted({x for ts in early for x in ts}))}
    holds = np.zeros((len(pdf), max(len(column), 1)), bool)
    for k, ts in enumerate(early):
        holds[k, [column[x] for x in ts]] = True
    size, found = np.array([len(x) for x in bits]), []
    for la in np.unique(size):
        x = np.flatnonzero(size == la)
        for lb in (la, 2 * la):  # similar sets are within a fifth in size, so their bitmaps are within one doubling
            y = np.flatnonzero(size == lb)
            if not len(y):
                continue
            right = np.stack([bits[k] for k in y])
            right = right if la == lb else right[:, :la] ^ right[:, la:]
            step = max(1, (1 << 22) // (len(y) * int(la)))
            for at in range(0, len(x), step):
                own = x[at : at + step]
                differ = np.bitwise_count(np.stack([bits[k] for k in own])[:, None, :] ^ right[None]).sum(2, dtype=np.int64)
                p, q = n[own].astype(np.int64)[:, None], n[y].astype(np.int64)[None]
                ok = ((OVER + UNDER) * differ <= (UNDER - OVER) * (p + q)) & (UNDER * p >= OVER * q) & (UNDER * q >= OVER * p) & (root[own][:, None] != root[y][None])
                if la == lb:
                    ok &= sh[own][:, None] < sh[y][None]
                if not whole:
                    ok &= mine[own][:, None] != mine[y][None]
                u, v = np.nonzero(ok)
                u, v = own[u], y[v]
                for c in range(0, len(u), 8192):
                    first = ~(holds[u[c : c + 8192]] & holds[v[c : c + 8192]]).any(1)
                    found.append(np.stack((sh[u[c : c + 8192]][first], sh[v[c : c + 8192]][first]), axis=1))
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *found])
    return pd.DataFrame({"a": pairs.min(1), "b": pairs.max(1)})


def crossed(left: DataFrame, distinct: DataFrame) -> DataFrame:
    """(a, b): members of different roots in a large bucket (t, m, sh, n, root) that their bitmaps allow.

    A bucket is cut into blocks of about `BLOCK` sets and each pair of blocks is compared in one bounded group, so only
    pairs that may be similar become rows, each at the first bucket that holds both."""
    own = left.groupBy("sh").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.collect_set("t").alias("ts")).join(distinct.select("sh", "bits"), "sh")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = left.select("t", "sh", blocks.alias("k")).withColumn("mine", F.pmod(F.xxhash64("sh"), F.col("k")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("t", "sh", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    return met.join(own, "sh").groupBy("t", "i", "j").applyInPandas(_between, "a long, b long")


def _near(a: str, b: str):
    return (UNDER * F.col(a) >= OVER * F.col(b)) & (UNDER * F.col(b) >= OVER * F.col(a))


def covered(distinct: DataFrame) -> DataFrame:
    """(a, b): sets of sizes that allow the similarity whose fingerprints are equal or linked by covering masks, as stars around the least set of a fingerprint."""
    hubs = written(distinct.groupBy("fp").agg(F.min(F.struct("sh", "n")).alias("h")), "fingerprints")
    hub = lambda c: hubs.select(F.col("fp").alias(c), F.col("h").alias(f"h{c}"))
    linked = links(hubs.select("fp")).join(hub("a"), "a").join(hub("b"), "b").where(_near("ha.n", "hb.n")).select(F.col("ha.sh").alias("a"), F.col("hb.sh").alias("b"))
    same = distinct.select("fp", "sh", "n").join(hubs, "fp").where((F.col("sh") != F.col("h.sh")) & _near("n", "h.n")).select(F.col("h.sh").alias("a"), F.col("sh").alias("b"))
    return linked.unionByName(same)


def similar(slim: DataFrame, distinct: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, root): the components of similar sets. distinct (sh, least, fp, n, bits, prefix) must be written."""
    first = checked(written(covered(distinct), "covered"), slim, distinct)
    w = Window.partitionBy("t")
    known = distinct.select("sh", "n", "prefix").join(components(first), F.col("sh") == F.col("node"), "left").withColumn("root", F.coalesce("root", "sh"))
    rows = known.select("sh", "n", "root", F.explode("prefix").alias("t"))
    met = written(rows.withColumns({"m": F.count("*").over(w), "hub": F.min(F.struct("sh", "n", "root")).over(w)}).where("m > 1"), "buckets")
    few = met.where(F.col("m") <= small).groupBy("t").agg(F.collect_list(F.struct("sh", "n", "root")).alias("l"))  # at most `small` items
    pairs = few.select("l", F.explode("l").alias("p")).select("p", F.explode("l").alias("q")).where((F.col("p.sh") < F.col("q.sh")) & (F.col("p.root") != F.col("q.root")) & _near("p.n", "q.n")).select(F.col("p.sh").alias("a"), F.col("q.sh").alias("b"))
    many = met.where(F.col("m") > small)
    star = many.where((F.col("root") != F.col("hub.root")) & _near("n", "hub.n")).select(F.col("hub.sh").alias("a"), F.col("sh").alias("b"))
    found = first.unionByName(checked(written(pairs.unionByName(star).distinct(), "pairs"), slim, distinct))
    roots = components(found)
    if not many.take(1):
        return roots
    named = written(many.select("t", "sh", "n").join(roots.select(F.col("node").alias("sh"), "root"), "sh", "left").withColumn("root", F.coalesce("root", "sh")), "named")
    mixed = named.groupBy("t").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("t", "m")
    cross = crossed(named.join(mixed, "t"), distinct)
    more = checked(written(cross.distinct(), "cross"), slim, distinct)
    return components(found.unionByName(more)) if more.take(1) else roots


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", small: int = SMALL) -> DataFrame:
    """(key, component_id): component_id is the least key of the class."""
    slim = docs.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("_text"))
    prints = written(prefixes(slim), "prefixes")
    distinct = written(prints.groupBy("sh").agg(F.min("_id").alias("least"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("prefix").alias("prefix")), "distinct")
    named = distinct.select("sh", "least").join(similar(slim, distinct, small), F.col("sh") == F.col("node"), "left").select("sh", "least", F.coalesce("root", "sh").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.select("_id", "sh").join(named.join(ids, "root").select("sh", "component_id"), "sh").select(F.col("_id").alias(key), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class: the one with the least (doc_id, checksum of the text). Repeated rows keep one copy."""
    slim = docs.select(F.struct(F.col(key).alias("k"), F.xxhash64(text).alias("h")).alias("_id"), F.col(text).cast("string").alias("_text"))
    return chosen_rows(docs, classes(slim, "_id", "_text"), key, text)
