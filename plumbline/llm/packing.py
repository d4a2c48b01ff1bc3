"""Packing token pieces into few sequences: a grouping genetic algorithm on islands.

Documents are encoded and only those longer than the capacity are cut. Full pieces are sequences of their own. The
other pieces are dealt at random (by checksum of their number) into groups of about `group` pieces; each group is a bin-packing
problem of bounded size, solved on `islands` islands. A solution is a set of bins. A population of `POPULATION` starts with best
fit over the decreasing order and over random orders. Crossover injects well-filled bins of one parent into the other
(one to half of them), drops the bins that hold an injected piece, opens the worst ones, and best-fits the displaced
pieces, largest first. Mutation empties a few bins and best-fits their pieces in random order. Children replace the
worst, by Falkenauer's measure. Every group is evolved: an island stops when a child was made and its best solution
meets the lower bound (which proves it), or after `PATIENCE` children in a row without a bin fewer, however large the
group is. Then every island's elite moves to the next island of its ring; groups that are proven take no part in later
rounds. `report` gives crossovers and bounds of each group.

A group leaves at most about one loose bin, so dealing costs less than one sequence in thousands.

Edge cases: null text is empty and makes one piece with the end id; repeated rows and equal keys are packed like any
other; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from plumbline.llm.common import as_string, slices, written
from plumbline.llm.tokens import END, WORD_BPE, encode, tokenizer_path

CAPACITY, GROUP, ISLANDS, ROUNDS, POPULATION, WELL_FILLED = 2048, 20_000, 2, 3, 6, 0.995
#: An island rests for a round after so many crossovers in a row without a bin fewer, whatever the size of its group.
PATIENCE = 1_500


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, by_word: bool = True, with_ids: bool = False) -> DataFrame:
    """item (a number of its own), key, piece, start, length, ids_crc32, and the ids if asked for: one pass over the whole texts."""
    vocabulary = tokenizer or tokenizer_path(WORD_BPE)
    kind = docs.schema[key].dataType.simpleString()
    names = ["item", "_key", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches):
        item = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "_text"):
                ids, at = encode(as_string(part.column("_text")), vocabulary, by_word)
                rows = []
                for i in range(len(part)):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(END)).astype("<u4")
                    for p, s in enumerate(range(0, len(own), capacity)):
                        cut = own[s : s + capacity]
                        rows.append((item, i, p, s, len(cut), zlib.crc32(cut.tobytes()), cut.astype(np.int32))[: 6 + with_ids])
                        item += 1
                cols = list(zip(*rows, strict=True))
                keys = part.column("_key").take(pa.array(cols[1], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), keys, pa.array(cols[2], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[3:6]), *(pa.array(list(c), pa.list_(pa.int32())) for c in cols[6:])], names)

    slim = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    return slim.mapInArrow(run, f"item long, _key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The greater of the volume bound and Martello and Toth's bound over all thresholds."""
    hist = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    count, volume = np.cumsum(hist), np.cumsum(hist * np.arange(capacity + 1))
    best = -(-int(volume[-1]) // capacity)
    half = capacity // 2
    for k in range(0, half + 1):
        big = int(count[-1] - count[capacity - k])
        middle, middle_volume = int(count[capacity - k] - count[half]), int(volume[capacity - k] - volume[half])
        small = int(volume[half] - (volume[k - 1] if k else 0))
        best = max(best, big + middle + max(0, -(-(small - (middle * capacity - middle_volume)) // capacity)))
    return best


def best_fit(fills: np.ndarray, lengths: list[int], capacity: int) -> list[int]:
    """The bin of each item: the fullest with room, else a new one. Bins are found by room in a bit set, so a step costs no search."""
    by_room: dict[int, list[int]] = {}
    rooms, bins, out = 0, len(fills), []
    some = np.flatnonzero(capacity - fills >= min(lengths, default=0))
    for b, room in zip(some.tolist(), (capacity - fills[some]).tolist(), strict=True):
        by_room.setdefault(room, []).append(b)
        rooms |= 1 << room
    for s in lengths:
        above = rooms >> s
        if above:
            room = s + (above & -above).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = bins, capacity
            bins += 1
        out.append(b)
        by_room.setdefault(room - s, []).append(b)
        rooms |= 1 << (room - s)
    return out


class Solution:
    """The bin of each item, and the fill of each bin."""

    def __init__(self, which: np.ndarray, fills: np.ndarray, capacity: int):
        self.which, self.fills = which, fills
        # fewer bins first, then fuller ones (Falkenauer's measure): lower is better
        self.quality = len(fills), -int((fills * fills).sum()) / capacity**2

    @classmethod
    def of(cls, bins: list[list[int]], lengths: np.ndarray, capacity: int) -> Solution:
        which = np.zeros(len(lengths), np.int64)
        for b, x in enumerate(bins):
            which[x] = b
        return cls(which, np.bincount(which, lengths, len(bins)).astype(np.int64), capacity)

    @classmethod
    def refitted(cls, which: np.ndarray, fills: np.ndarray, loose: np.ndarray, lengths: np.ndarray, capacity: int) -> Solution:
        """The loose items best-fitted in their order into bins of these fills."""
        which[loose] = best_fit(fills, lengths[loose].tolist(), capacity)
        more = np.bincount(which[loose], lengths[loose], len(fills)).astype(np.int64)
        more[: len(fills)] += fills
        return cls(which, more, capacity)

    def bins(self) -> list[list[int]]:
        order = np.argsort(self.which, kind="stable")
        return [x.tolist() for x in np.split(order, np.cumsum(np.bincount(self.which, minlength=len(self.fills)))[:-1])] if len(order) else []


def crossed(a: Solution, b: Solution, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> Solution:
    """b with some of a's well-filled bins injected, from one to half; displaced items are best-fitted, largest first."""
    good = np.flatnonzero(a.fills >= min(WELL_FILLED * capacity, int(a.fills.max())))
    taken = good[rng.random(len(good)) < 0.5 ** rng.uniform(1, 1 + np.log2(len(good)))]
    take = np.zeros(len(a.fills), bool)
    take[taken if len(taken) else good[rng.integers(len(good))]] = True
    inside = take[a.which]
    gone = np.zeros(len(b.fills), bool)
    gone[b.which[inside]] = True
    whole = np.flatnonzero(~gone)
    if len(whole):  # at least the worst one is opened: its items get another chance
        opened = whole[b.fills[whole] < 0.9 * capacity]
        gone[opened if len(opened) else whole[np.argmin(b.fills[whole])]] = True
    which = np.where(inside, (np.cumsum(take) - 1)[a.which], (np.cumsum(~gone) - 1 + int(take.sum()))[b.which])
    loose = np.flatnonzero(gone[b.which] & ~inside)
    return Solution.refitted(which, np.concatenate((a.fills[take], b.fills[~gone])), loose[np.argsort(-lengths[loose], kind="stable")], lengths, capacity)


def mutated(a: Solution, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> Solution:
    """The worst bin and two to eight others emptied; their items are best-fitted in random order."""
    gone = np.zeros(len(a.fills), bool)
    gone[rng.integers(0, len(gone), rng.integers(2, 9))] = True
    gone[np.argmin(a.fills)] = True
    loose = np.flatnonzero(gone[a.which])
    return Solution.refitted((np.cumsum(~gone) - 1)[a.which], a.fills[~gone], rng.permutation(loose), lengths, capacity)


def crossover(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """`crossed` on lists of bins."""
    lengths = np.array(sizes, np.int64)
    return crossed(Solution.of(a, lengths, capacity), Solution.of(b, lengths, capacity), lengths, capacity, rng).bins()


def fit(order: np.ndarray, lengths: np.ndarray, capacity: int) -> Solution:
    return Solution.refitted(np.zeros(len(lengths), np.int64), np.zeros(0, np.int64), order, lengths, capacity)


def fitted(order: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    return fit(np.array(order, np.int64), np.array(sizes, np.int64), capacity).bins()


def evolve(sizes: list[int], start: list[list[list[int]]], capacity: int, seed: int, patience: int = PATIENCE) -> tuple[list[list[int]], int, int]:
    """(best solution, crossovers, lower bound). start: the elites that have come; without any, best fit in decreasing and random orders."""
    rng, lengths = np.random.default_rng(seed), np.array(sizes, np.int64)
    bound = lower_bound(lengths, capacity)
    born = [Solution.of(x, lengths, capacity) for x in start] or [fit(np.argsort(-lengths, kind="stable"), lengths, capacity)]
    while len(born) < POPULATION:
        born.append(fit(rng.permutation(len(lengths)), lengths, capacity))
    people, made, still = sorted(born, key=lambda p: p.quality), 0, 0
    while not made or (people[0].quality[0] > bound and still < patience):
        i, j = rng.choice(len(people), 2, replace=False)
        child = mutated(crossed(people[i], people[j], lengths, capacity, rng), lengths, capacity, rng)
        made += 1
        still = 0 if child.quality[0] < people[0].quality[0] else still + 1
        if all(child.quality != p.quality for p in people):  # equal measures would fill the population with one solution
            people = sorted([*people, child], key=lambda p: p.quality)[: len(people)]
    return people[0].bins(), made, bound


FOUND = "grp long, island long, origin long, item long, length long, bin long, n_bins long, crossovers long, bound long"


def _island(pdf: pd.DataFrame, capacity: int, round_no: int) -> pd.DataFrame:
    """One group on one island: the rows of each earlier solution (`origin`) are a member of the population."""
    pdf = pdf.sort_values(["origin", "item"])
    group, island = int(pdf["grp"].iloc[0]), int(pdf["island"].iloc[0])
    parts = [p for _, p in pdf.groupby("origin")]
    base = parts[0]
    items, sizes = base["item"].to_numpy(), base["length"].astype(int).tolist()
    start = []
    if round_no:
        for p in parts:
            bins: dict[int, list[int]] = {}
            for n, b in enumerate(p["bin"].tolist()):
                bins.setdefault(b, []).append(n)
            start.append(list(bins.values()))
    won, made, bound = evolve(sizes, start, capacity, (group * 31 + island) * 7 + round_no)
    which = np.zeros(len(items), np.int64)
    for b, x in enumerate(won):
        which[x] = b
    return pd.DataFrame({"grp": group, "island": island, "origin": island, "item": items, "length": sizes, "bin": which, "n_bins": len(won), "crossovers": made, "bound": bound})


def _on_island(capacity: int, round_no: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _island(pdf, capacity, round_no)

    return run


def solved(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP, islands: int = ISLANDS, rounds: int = ROUNDS) -> list[DataFrame]:
    """The written solutions (FOUND) of each round. A group goes to the next round while none of its islands has met its bound."""
    short = cut.where(F.col("length") < capacity).select("item", "length")
    n_groups = max(1, -(-short.count() // group))
    dealt = short.withColumn("grp", F.pmod(F.xxhash64("item"), F.lit(n_groups)))
    now = dealt.select("grp", F.explode(F.array(*[F.lit(i).cast("long") for i in range(islands)])).alias("island"), F.lit(0).cast("long").alias("origin"), "item", "length", F.lit(0).cast("long").alias("bin"))
    done = []
    for r in range(rounds):
        done.append(written(now.groupBy("grp", "island").applyInPandas(_on_island(capacity, r), FOUND), "islands"))
        open_ = done[-1].groupBy("grp").agg(F.min("n_bins").alias("b"), F.min("bound").alias("l")).where("b > l").select("grp")
        if r + 1 == rounds or not open_.take(1):
            break
        left = done[-1].join(open_, "grp").select("grp", "island", "origin", "item", "length", "bin")
        now = left.unionByName(left.withColumn("island", (F.col("island") + 1) % islands)) if islands > 1 else left
    return done


def report(done: list[DataFrame]) -> DataFrame:
    """A row a group: pieces, bins, its lower bound, crossovers on all islands, and rounds it took part in."""
    one = [d.groupBy("grp", "island").agg(F.count("*").alias("pieces"), F.first("n_bins").alias("n_bins"), F.first("bound").alias("bound"), F.first("crossovers").alias("crossovers")).withColumn("round", F.lit(r)) for r, d in enumerate(done)]
    every = one[0]
    for d in one[1:]:
        every = every.unionByName(d)
    return every.groupBy("grp").agg(F.max("pieces").alias("pieces"), F.min("n_bins").alias("n_bins"), F.max("bound").alias("bound"), F.sum("crossovers").alias("crossovers"), (F.max("round") + 1).alias("rounds"))


def packed(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP, islands: int = ISLANDS, rounds: int = ROUNDS) -> DataFrame:
    """(item, sequence_id, offset) for written pieces: full pieces alone, the rest packed."""
    every = None
    for r, d in enumerate(solved(cut, capacity, group, islands, rounds)):
        d = d.select("grp", "island", "item", "length", "bin", "n_bins", F.lit(r).alias("round"))
        every = d if every is None else every.unionByName(d)
    best = every.groupBy("grp").agg(F.min(F.struct("n_bins", "round", "island")).alias("b")).select("grp", F.col("b.round").alias("round"), F.col("b.island").alias("island"))
    chosen = every.join(best, ["grp", "round", "island"])
    place = Window.partitionBy("grp", "bin").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    rest = chosen.select("item", (F.col("grp") * (2 * group) + F.col("bin")).alias("sequence_id"), F.coalesce(F.sum("length").over(place), F.lit(0)).alias("offset"))
    alone = cut.where(F.col("length") >= capacity).select("item", (-F.col("item") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return rest.unionByName(alone)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, group: int = GROUP, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row a piece: key, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    cut = written(pieces(docs, key, text, capacity, tokenizer, with_ids=with_ids), "pieces")
    return cut.join(packed(cut, capacity, group), "item").drop("item").withColumnRenamed("_key", key)
