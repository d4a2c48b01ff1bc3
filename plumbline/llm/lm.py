"""Log-bilinear language model trained with noise-contrastive estimation, beside a smoothed unigram base.

Words are counted over the whole training part. The model predicts units: the end token, the most frequent words, and
buckets of all other words by their last two characters; inside a bucket a word has its smoothed share, so every word,
seen or not, has a normalised probability. The score of unit w after u2 u1 is q_w . (C1 r_u1 + C2 r_u2) + b_w. All
training documents are used once: in each of `rounds` rounds every task trains on its own rows of that round from the
same parameters, and the results are averaged, weighted by tokens, in a grouped sum. With E1 = exp(r C1 q' + b) and
E2 = exp(r C2 q'), the normaliser of every context is an entry of E1 E2', one matrix product; a token's log
probability is then three table entries.

The counts of the `dictionary` most frequent words go to every task; its size is a parameter and does not grow. Rarer
words of a document are looked up by a join.

Edge cases: null or empty text is one end token; a null doc_id is held out (its id text is taken as empty); repeated
rows are scored and counted each; an empty table, or one with no training rows, gives scores from the smoothing alone;
other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from plumbline.llm.common import as_string, coded, slices, sums, words_of, written

ALPHA = 0.1
END_WORD = ""


@dataclass(frozen=True)
class Settings:
    words: int = 1535
    buckets: int = 512
    dim: int = 32
    rounds: int = 3
    noise: int = 64
    batch: int = 2048
    rate: float = 0.1
    dictionary: int = 200_000
    seed: int = 7

    @property
    def units(self) -> int:
        return 1 + self.words + self.buckets


def held_out(key: str):
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(10)) == 0


def bucket_col(word, n: int):
    return F.pmod(F.crc32(F.right(word, F.lit(2))), F.lit(n))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over the column _text, with the end token as the empty word: counted by batch first, then summed."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                flat, _ = words_of(pc.ascii_lower(as_string(part.column("_text"))))
                got = pc.value_counts(flat)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([got.field(0), pa.array([END_WORD])]), pa.concat_arrays([got.field(1), pa.array([len(part)], pa.int64())])], ["word", "c"])

    return texts.select("_text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """At most `most` words with all words of the same or a higher count class (eighths of octaves), most frequent first; ties by word."""
    step = F.floor(8 * F.log2("c")).cast("int")
    total, least = 0, None
    for r in sorted(counts.groupBy(step.alias("s")).count().collect(), reverse=True):  # at most 8 rows an octave
        total += r["count"]
        if total > most:
            break
        least = r["s"]
    if least is None:
        return []
    return sorted(((r["word"], r["c"]) for r in counts.where(step >= least).collect()), key=lambda x: (-x[1], x[0]))  # at most `most`


class Lexicon:
    """Units and smoothed counts of words: the frequent ones exactly, the rest by bucket only."""

    def __init__(self, known: list[tuple[str, int]], buckets: dict[int, tuple[int, int]], s: Settings):
        tops = [w for w, _ in known if w != END_WORD][: s.words]
        self.count = dict(known)
        self.unit = {w: i + 1 for i, w in enumerate(tops)} | {END_WORD: 0}
        self.s = s
        top_count = np.array([self.count.get(END_WORD, 0), *[self.count[w] for w in tops], *[0] * (s.words - len(tops))], float)
        self.inside = np.concatenate((np.zeros(1 + s.words), [math.log10(n + ALPHA * (v + 1)) for n, v in (buckets.get(b, (0, 0)) for b in range(s.buckets))]))
        mass = np.concatenate((top_count, [buckets.get(b, (0, 0))[0] for b in range(s.buckets)])) + ALPHA
        self.prior = mass / mass.sum()
        self._suffix: dict[str, int] = {}

    def bucket(self, word: str) -> int:
        tail = word[-2:]
        if (b := self._suffix.get(tail)) is None:
            if len(self._suffix) > 200_000:
                self._suffix.clear()
            b = self._suffix[tail] = 1 + self.s.words + zlib.crc32(tail.encode()) % self.s.buckets
        return b

    def units_of(self, words: list[str]) -> np.ndarray:
        own, bucket = self.unit, self.bucket
        return np.fromiter((u if (u := own.get(w)) is not None else bucket(w) for w in words), np.int32, len(words))


def with_ends(units: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units with an end token after each text, the two units before each (the end token before the start), and the new offsets."""
    n = len(at) - 1
    ends = at[1:] + np.arange(n)
    out = np.zeros(len(units) + n, np.int32)
    mask = np.ones(len(out), bool)
    mask[ends] = False
    out[mask] = units
    starts = at[:-1] + np.arange(n)
    one = np.concatenate(([0], out[:-1])).astype(np.int32)
    one[starts] = 0
    two = np.concatenate(([0], one[:-1])).astype(np.int32)
    two[starts] = 0
    return out, one, two, np.concatenate((starts, [len(out)]))


def initial(lexicon: Lexicon, s: Settings) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(s.seed)
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return {"r": small(s.units, s.dim), "q": small(s.units, s.dim), "c1": np.eye(s.dim, dtype=np.float32), "c2": np.eye(s.dim, dtype=np.float32), "b": np.log(lexicon.prior).astype(np.float32)}


def train(p: dict[str, np.ndarray], w: np.ndarray, u1: np.ndarray, u2: np.ndarray, log_noise: np.ndarray, draw, s: Settings, squares: dict[str, np.ndarray]) -> None:
    """One pass of NCE over the tokens, in place. Noise units are shared by a batch; AdaGrad steps."""

    def step(name: str, grad: np.ndarray, rows=None) -> None:
        if rows is None:
            squares[name] += grad * grad
            p[name] += s.rate * grad / np.sqrt(squares[name])
        else:
            squares[name][rows] += grad * grad
            p[name][rows] += s.rate * grad / np.sqrt(squares[name][rows])

    def gather(index: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(index, kind="stable")
        own = index[order]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        return own[first], np.add.reduceat(grad[order], first, axis=0)

    log_k = np.float32(math.log(s.noise))
    for a in range(0, len(w), s.batch):
        x, y, z = w[a : a + s.batch], u1[a : a + s.batch], u2[a : a + s.batch]
        n = draw(s.noise)
        ry, rz, qx, qn = p["r"][y], p["r"][z], p["q"][x], p["q"][n]
        h = ry @ p["c1"] + rz @ p["c2"]
        good = 1 / (1 + np.exp(np.clip((h * qx).sum(1) + p["b"][x] - log_noise[x] - log_k, -30, 30)))
        bad = -1 / (1 + np.exp(np.clip(-(h @ qn.T + p["b"][n] - log_noise[n] - log_k), -30, 30)))
        gh = good[:, None] * qx + bad @ qn
        step("q", *reversed(gather(np.concatenate((x, n)), np.concatenate((good[:, None] * h, bad.T @ h)))))
        step("b", *reversed(gather(np.concatenate((x, n)), np.concatenate((good, bad.sum(0))))))
        step("r", *reversed(gather(np.concatenate((y, z)), np.concatenate((gh @ p["c1"].T, gh @ p["c2"].T)))))
        step("c1", ry.T @ gh)
        step("c2", rz.T @ gh)


NAMES = ("r", "q", "c1", "c2", "b")


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in NAMES])


def shaped(values: np.ndarray, s: Settings) -> dict[str, np.ndarray]:
    shapes, out, at = {"r": (s.units, s.dim), "q": (s.units, s.dim), "c1": (s.dim, s.dim), "c2": (s.dim, s.dim), "b": (s.units,)}, {}, 0
    for k in NAMES:
        n = math.prod(shapes[k])
        out[k] = values[at : at + n].astype(np.float32).reshape(shapes[k])
        at += n
    return out


def train_round(texts: DataFrame, p: dict[str, np.ndarray], lexicon, s: Settings) -> dict[str, np.ndarray]:
    """Parameters after one round over _text: averaged over tasks by tokens, in a grouped sum with a row a parameter."""
    spark = texts.sparkSession
    start = spark.sparkContext.broadcast(flat(p))

    def run(batches):
        lex, own = lexicon.value, shaped(start.value.copy(), s)
        squares = {k: np.full(v.shape, 1.0, np.float32) for k, v in own.items()}
        rng = np.random.default_rng([s.seed, TaskContext.get().partitionId()])
        total, log_noise, tokens = np.cumsum(lex.prior), np.log(lex.prior).astype(np.float32), 0
        draw = lambda k: np.minimum(np.searchsorted(total, rng.random(k)), s.units - 1)
        for batch in batches:
            for part in slices(batch, "_text"):
                words, at = words_of(pc.ascii_lower(as_string(part.column("_text"))))
                codes, distinct = coded(words)
                w, u1, u2, _ = with_ends(lex.units_of(distinct.to_pylist())[codes], at)
                train(own, w, u1, u2, log_noise, draw, s, squares)
                tokens += len(w)
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([flat(own)], pa.list_(pa.float32())), pa.array([tokens], pa.int64())], ["values", "tokens"])

    found = texts.select("_text").mapInArrow(run, "values array<float>, tokens long").select("tokens", F.posexplode("values").alias("i", "v"))
    rows = found.groupBy("i").agg((F.sum(F.col("v").cast("double") * F.col("tokens")) / F.sum("tokens")).alias("v")).toPandas()  # a row a parameter
    start.destroy()
    return shaped(rows.sort_values("i")["v"].to_numpy(), s) if len(rows) else p


def tables(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Natural-log tables a[u1, w], b[u2, w], z[u1, u2]: log P(w | u2 u1) = a + b - z."""
    a = (p["r"] @ p["c1"]) @ p["q"].T + p["b"]
    b = (p["r"] @ p["c2"]) @ p["q"].T
    am, bm = a.max(1), b.max(1)
    z = np.log((np.exp(a - am[:, None]).astype(np.float64)) @ np.exp(b - bm[:, None]).T.astype(np.float64)) + am[:, None] + bm[None, :]
    return a.astype(np.float32), b.astype(np.float32), z.astype(np.float32)


def score_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings | None = None) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    s, spark = settings or Settings(), docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(F.col(key).alias("_key"), held_out(key).alias("held_out"), F.col(text).cast("string").alias("_text"))
    learn = slim.where(~F.col("held_out"))
    counts = written(count_words(learn), "counts").where("c > 0")
    n_train, vocabulary = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    known = frequent(counts, s.dictionary)
    tops = spark.createDataFrame([(w,) for w in [w for w, _ in known if w != END_WORD][: s.words] + [END_WORD]], "word string")
    rest = counts.join(F.broadcast(tops), "word", "left_anti").groupBy(bucket_col("word", s.buckets).alias("bucket")).agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    lex = Lexicon(known, {r["bucket"]: (r["n"], r["v"]) for r in rest.collect()}, s)  # a row a bucket
    shared = spark.sparkContext.broadcast(lex)
    p = initial(lex, s)
    slot = F.pmod(F.floor(F.crc32(F.coalesce(F.col("_key").cast("string"), F.lit(""))) / 10), F.lit(s.rounds))
    for r in range(s.rounds):
        p = train_round(learn.where(slot == r), p, shared, s)
    model = spark.sparkContext.broadcast(tables(p))
    base = math.log10(n_train + ALPHA * (vocabulary + 1))

    def run(batches):
        lex, (ta, tb, tz) = shared.value, model.value
        row = TaskContext.get().partitionId() << 33
        end_log = math.log10(lex.count.get(END_WORD, 0) + ALPHA)
        end_known = END_WORD in lex.count
        for batch in batches:
            for part in slices(batch, "_text"):
                flat_words, at = words_of(pc.ascii_lower(as_string(part.column("_text"))))
                codes, distinct = coded(flat_words)
                words = distinct.to_pylist()
                unit = lex.units_of(words)
                c = np.fromiter((lex.count.get(w, -1) for w in words), np.int64, len(words))
                rare, log_c = c < 0, np.where(c < 0, 0.0, np.log10(np.maximum(c, 0) + ALPHA))
                single = unit <= s.words
                w, u1, u2, ends = with_ends(unit[codes], at)
                model_log = sums((ta[u1, w] + tb[u2, w] - tz[u1, u2]).astype(np.float64) / math.log(10), ends)
                inside = sums(np.where(single, 0.0, log_c - lex.inside[unit])[codes], at)
                n, is_rare = np.diff(at) + 1, rare[codes]
                bounds = np.concatenate(([0], np.cumsum(is_rare)))[at].astype(np.int32)
                rares = pa.ListArray.from_arrays(pa.array(bounds), flat_words.filter(pa.array(is_rare)))
                known_n = np.diff(at) - np.diff(bounds) + end_known
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(part))), part.column("_key"), part.column("held_out"), pa.array(n), pa.array(known_n.astype(np.int64)), pa.array(sums(log_c[codes], at) + end_log - n * base), pa.array(model_log + inside), rares], ["row", "_key", "held_out", "n_tokens", "n_known", "base_score", "score", "rares"])
                row += len(part)

    part = written(slim.mapInArrow(run, f"row long, _key {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rares array<string>"), "scores")
    looked = part.select("row", F.explode("rares").alias("word")).groupBy("row", "word").agg(F.count("*").alias("k")).join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    more = looked.groupBy("row").agg(F.sum(F.col("k") * F.log10(c + ALPHA)).alias("more"), F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("seen"))
    add = F.coalesce("more", F.lit(0.0))
    return part.drop("rares").join(more, "row", "left").select(F.col("_key").alias(key), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base_score") + add).alias("base_score"), (F.col("score") + add).alias("score"))
