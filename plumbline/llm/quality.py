"""Quality rules by tokeniser fertility.

A public sentence-piece vocabulary measures each text: characters per token, the share of tokens that fall back to
single bytes, and the entropy of its tokens. A text is rejected when a measure lies outside the band of its language
and length (entropy grows with length, so bands are kept for each power of two of the token count). Bands come from
the whole corpus: for each language and length the median and the median absolute deviation (MAD) of the measure over
all texts that pass the base rules; the band is median +- `width` MADs, never narrower than the `FLOORS`. Where fewer
than `min_docs` such texts exist, the band over all languages at that length holds, and if that is as thin, the band of
the nearest length that has one, of the language if it has any (of two as near, the shorter). Only where no length has
`min_docs` such texts in all is there no band.

Edge cases: null or empty text has no words and fails the base rules; a null language is a language of its own;
repeated rows are measured alike and all returned; an empty table gives an empty result; columns that clash with the
result's names are dropped unless they are the two inputs.
"""

from __future__ import annotations

from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Pool, as_string, coded, slices, sums, words_of, written

TOKENIZER = "piece_bpe_32k.model"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "[#*$%&|<>]"
#: measure -> (quantum of its histogram, least half-width of its band)
FLOORS = {"chars_per_token": (0.01, 0.35), "byte_share": (0.001, 0.02), "entropy": (0.02, 0.5)}
WIDTH, MIN_DOCS = 6.0, 50
MEASURES = tuple(FLOORS)
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double"


@cache
def _pieces(path: str | None) -> Pool:
    """word -> its piece ids as 16-bit integers, with 32768 added where the piece is a byte."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    is_byte = np.array([32768 * model.is_byte(i) for i in range(model.get_piece_size())], np.uint16)

    def fill(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = model.encode(words.to_pylist(), num_threads=1)
        ids = np.fromiter(chain.from_iterable(found), np.uint16)
        return ids + is_byte[ids], np.fromiter(map(len, found), np.int64, len(found))

    return Pool(fill, "<u2")


def _repeated(codes: np.ndarray, offsets: np.ndarray, n_codes: int) -> np.ndarray:
    """For each text, its words that lie in a 3-word window found twice or more in it."""
    out = np.zeros(len(offsets) - 1, np.int64)
    if len(codes) < 4:
        return out
    if n_codes < 1 << 21:
        keys = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    else:
        pair = np.unique((codes[:-1] << 32) | codes[1:], return_inverse=True)[1]
        keys = (pair[:-1].astype(np.int64) << 32) | codes[2:]
    for i in np.flatnonzero(np.diff(offsets) > 3):
        own = keys[offsets[i] : offsets[i + 1] - 2]
        ordered = np.sort(own)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            hit = np.isin(own, twice)
            cover = np.zeros(len(own) + 2, bool)
            for k in range(3):
                cover[k : k + len(own)] |= hit
            out[i] = cover.sum()
    return out


def measure_texts(col: pa.Array, path: str | None = None) -> dict[str, np.ndarray]:
    """The columns of SCHEMA for an Arrow array of texts without nulls."""
    flat, offsets = words_of(col)
    codes, words = coded(flat)
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    marks = pc.count_substring_regex(words, SYMBOLS).to_numpy(zero_copy_only=False).astype(np.int64)
    n_words, n_chars = np.diff(offsets), sums(chars[codes], offsets)

    lists = pc.split_pattern(col, "\n")
    at = lists.offsets.to_numpy().astype(np.int64)
    lines, distinct = coded(lists.flatten())
    worded = pc.match_substring_regex(distinct, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(col)), np.diff(at - at[0]))
    has = worded[lines] if len(distinct) else np.zeros(0, bool)
    first = np.unique((doc[has] << 32) | lines[has]) >> 32
    n_dup = np.bincount(doc[has], minlength=len(col)) - np.bincount(first, minlength=len(col))

    ids, n = _pieces(path).take(words, codes)
    ends = np.concatenate(([0], np.cumsum(n)))[offsets]
    n_tokens = np.diff(ends)
    n_byte = sums((ids >> 15).astype(np.int64), ends)
    entropy = np.zeros(len(col))
    for i in np.flatnonzero(n_tokens > 1):
        count = np.unique(ids[ends[i] : ends[i + 1]], return_counts=True)[1]
        entropy[i] = np.log2(n_tokens[i]) - (count * np.log2(count)).sum() / n_tokens[i]
    some = np.maximum(n_tokens, 1)
    return {
        "n_words": n_words, "word_chars": n_chars, "n_symbols": sums(marks[codes], offsets), "n_dup_lines": n_dup.astype(np.int64),
        "n_repeat_words": _repeated(codes, offsets, len(words)), "n_tokens": n_tokens, "chars_per_token": n_chars / some, "byte_share": n_byte / some, "entropy": entropy,
    }


def measured(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """docs with the columns of SCHEMA; one pass over the whole texts, no shuffle."""
    names = {f.split()[0] for f in SCHEMA.split(", ")}
    base = docs.drop(*[c for c in docs.columns if c.lower() in names])
    fields = [f.name for f in base.schema]

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                got = measure_texts(as_string(part.column(text)), path)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(v) for v in got.values())], [*fields, *got])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", " + SCHEMA
    return base.mapInArrow(run, schema)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def octave():
    return F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))).cast("int")


def bands(features: DataFrame, lang: str = "lang", width: float = WIDTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row a language and octave of length, and one an octave with `all_languages` true: count and the band (lo, hi) of each measure.

    Medians are exact over histograms whose steps are the quanta of FLOORS, so a language's group holds a bounded
    number of bins whatever its share of the rows."""
    good = features.where(~base_failed())
    bins = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.round(F.col(m) / q).cast("long").alias("b")) for m, (q, _) in FLOORS.items()]))
    hist = good.select(F.col(lang).alias("lang"), octave().alias("octave"), bins.alias("x")).groupBy("lang", "octave", "x.m", "x.b").agg(F.count("*").alias("n"))
    every = hist.groupBy("octave", "m", "b").agg(F.sum("n").alias("n")).withColumns({"lang": F.lit(None).cast("string"), "all_languages": F.lit(True)})
    both = hist.withColumn("all_languages", F.lit(False)).unionByName(every)
    keys = ["all_languages", "lang", "octave", "m"]

    def median(df: DataFrame, value: str, out: str) -> DataFrame:
        w = Window.partitionBy(*keys)
        ran = df.withColumns({"_c": F.sum("n").over(w.orderBy(value)), "_t": F.sum("n").over(w)})
        return ran.withColumn(out, F.min(F.when(2 * F.col("_c") >= F.col("_t"), F.col(value))).over(w)).drop("_c")

    mid = median(both, "b", "med").withColumn("dev", F.abs(F.col("b") - F.col("med")))
    mad = median(mid.drop("_t"), "dev", "mad")
    one = mad.groupBy(*keys).agg(F.first("med").alias("med"), F.first("mad").alias("mad"), F.first("_t").alias("n"))
    quantum, floor = (F.create_map(*[F.lit(x) for m, v in FLOORS.items() for x in (m, v[i])])[F.col("m")] for i in (0, 1))
    half = F.greatest(F.lit(width) * F.col("mad") * quantum, floor)
    one = one.select(*keys, "n", (F.col("med") * quantum - half).alias("lo"), (F.col("med") * quantum + half).alias("hi"))
    picked = [F.max(F.when(F.col("m") == m, F.col(c))).alias(f"{m}_{c}") for m in MEASURES for c in ("lo", "hi")]
    return one.groupBy("all_languages", "lang", "octave").agg(F.max("n").alias("n_docs"), *picked).where(F.col("n_docs") >= min_docs)


def outside():
    """True where a measure leaves its band: odd characters a token, too many bytes, too little entropy."""
    return (F.col("chars_per_token") < F.col("chars_per_token_lo")) | (F.col("chars_per_token") > F.col("chars_per_token_hi")) | (F.col("byte_share") > F.col("byte_share_hi")) | (F.col("entropy") < F.col("entropy_lo"))


#: Bands are a row a language and octave; beyond this many Spark chooses the join.
MAX_BROADCAST_BANDS = 50_000


#: Octaves of all token counts there can be in one text.
OCTAVES = 32


def nearest(some: DataFrame, by: list[str], limits: list[str]) -> DataFrame:
    """by, at (every octave), and x: the band of the nearest octave with its distance `far`."""
    every = some.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(OCTAVES - 1))))
    return every.groupBy(*by, "at").agg(F.min(F.struct(F.abs(F.col("octave") - F.col("at")).alias("far"), "octave", *limits)).alias("x"))


def judged(features: DataFrame, lang: str = "lang") -> DataFrame:
    """features with base_failed and kept. features must be cheap to read twice (written)."""
    limits = [f"{m}_{c}" for m in MEASURES for c in ("lo", "hi")]
    known = written(bands(features, lang), "bands")
    hint = F.broadcast if known.count() * OCTAVES <= MAX_BROADCAST_BANDS else (lambda df: df)
    own = nearest(known.where(~F.col("all_languages")), ["lang"], limits).select(F.col("lang").alias("_l"), F.col("at").alias("_o"), F.col("x").alias("_own"))
    every = nearest(known.where("all_languages"), [], limits).select(F.col("at").alias("_e"), F.col("x").alias("_all"))
    joined = features.join(hint(own), F.col(lang).eqNullSafe(F.col("_l")) & (octave() == F.col("_o")), "left").join(hint(every), octave() == F.col("_e"), "left")
    band = F.when(F.col("_own.far") == 0, F.col("_own")).when(F.col("_all.far") == 0, F.col("_all")).otherwise(F.coalesce("_own", "_all"))
    filled = joined.withColumn("_band", band).withColumns({c: F.col(f"_band.{c}") for c in limits}).withColumn("base_failed", base_failed())
    return filled.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(outside(), F.lit(False))).select(*features.columns, "base_failed", "kept")


def quality_report(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", path: str | None = None) -> DataFrame:
    """One row a document: its measures, base_failed and kept."""
    slim = docs.select(F.col(key), F.col(lang).cast("string").alias(lang) if lang in docs.columns else F.lit(None).cast("string").alias(lang), F.col(text).cast("string").alias(text))
    return judged(written(measured(slim, text, path).drop(text), "quality"), lang)


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", path: str | None = None) -> DataFrame:
    """The documents that pass, with their own columns. Verdicts meet the rows by (key, checksum of the text), so repeated keys stay right."""
    slim = docs.select(F.col(key).alias("_k"), F.xxhash64(text).alias("_h"), F.col(lang).cast("string").alias("_lang"), F.col(text).cast("string").alias("_text"))
    verdict = judged(written(measured(slim, "_text", path).drop("_text"), "quality"), "_lang").where("kept").select("_k", "_h").distinct().hint("merge")
    return docs.join(verdict, docs[key].eqNullSafe(F.col("_k")) & (F.xxhash64(docs[text]) == F.col("_h")), "left_semi")
