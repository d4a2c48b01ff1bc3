"""Line dedup by winnowing over line hashes, in DataFrame functions only.

Lines are the \\n-separated parts of a text; only lines with a word count. From every line on, the shortest run of lines
with `grain` words is a gram and the shortest run with `window` words a window. In each window the last of the grams
with the least hash is its fingerprint (winnowing). It depends on the window's lines alone, so wherever a window stands,
it selects the same fingerprint. Places are joined by fingerprint; one that no other place shares is done. Around a
shared fingerprint the match is followed both ways: the windows that selected it, and the shortest runs of `window`
words that end at each line, are compared whole, by a hash of their lines. A run's first place in the corpus, in
(doc_id, checksum, line) order, stays; at every later place that doesn't overlap it, its lines are deleted.

So exactly these lines go: those in a run of whole lines, of `window` words or more, that begins at an earlier place too
and doesn't overlap it. Every such run is a union of the windows inside it, and every repeated window has its
fingerprint shared, so none is missed, whatever else the places share. A blank line between two deleted lines goes as
well. Nothing is paired: each window meets the first place of its hash, so n copies give n rows.

Only hashes of lines are shuffled until the texts meet the flags of their lines.

Edge cases: null text stays null and has no lines; texts of under `window` words lose nothing; rows with the same doc_id
and text are one document, so all of them keep or lose the same lines; a null doc_id sorts first; an empty table gives an
empty result; other columns are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WORD_REGEX, written

WINDOW, GRAIN = 50, 25


def reach(run: str, words: int) -> str:
    """SQL: how many items at the head of `run` hold `words` words, null if all of them hold fewer. A line has one word at least."""
    return f"aggregate({run}, named_struct('s', 0, 'm', 0), (a, x) -> if(a.s >= {words}, a, named_struct('s', a.s + x, 'm', a.m + 1)), a -> if(a.s >= {words}, a.m, null))"


def line_hashes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_key, _th, n (lines), and of each line with a word its place, hash and words (pos, hs, ns): one row a distinct document that has any."""
    slim = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).where("_text is not null")
    lines = F.split(F.col("_text"), "\n", -1)
    every = F.transform(lines, lambda x, i: F.struct(i.alias("p"), F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(WORD_REGEX)).alias("w")))
    counted = slim.select("_key", F.xxhash64("_text").alias("_th"), every.alias("ls"))
    worded = counted.select("_key", "_th", F.size("ls").alias("n"), F.filter("ls", lambda x: x.w > 0).alias("ls")).where("size(ls) > 0")
    return worded.select("_key", "_th", "n", F.col("ls.p").alias("pos"), F.col("ls.h").alias("hs"), F.col("ls.w").alias("ns")).dropDuplicates(["_key", "_th"])


def windows(hashed: DataFrame, window: int = WINDOW, grain: int = GRAIN) -> DataFrame:
    """hashed with wl and bl (lines of the window that begins, and that ends, at each line), gs (gram hashes) and sel (the window's fingerprint's line)."""
    own = hashed.where(f"aggregate(ns, 0, (a, x) -> a + x) >= {window}")
    lens = own.selectExpr(
        "*", f"transform(sequence(0, size(ns) - 1), i -> {reach(f'slice(ns, i + 1, {grain})', grain)}) as kl", f"transform(sequence(0, size(ns) - 1), i -> {reach(f'slice(ns, i + 1, {window})', window)}) as wl",
        f"transform(sequence(0, size(ns) - 1), i -> {reach(f'reverse(slice(ns, greatest(i + 2 - {window}, 1), least({window}, i + 1)))', window)}) as bl")
    named = lens.selectExpr("*", "transform(kl, (m, i) -> if(m is null, null, xxhash64(slice(hs, i + 1, m)))) as gs")
    # of a window's grams that end inside it: least hash, last place
    better = "x is not null and a.n + kl[i + a.n] <= w and (a.g is null or x <= a.g)"
    sel = f"""transform(wl, (w, i) -> if(w is null, null, aggregate(slice(gs, i + 1, w), named_struct('n', 0, 'g', cast(null as bigint), 'p', -1),
        (a, x) -> named_struct('n', a.n + 1, 'g', if({better}, x, a.g), 'p', if({better}, i + a.n, a.p)), a -> a.p)))"""
    return named.selectExpr("_key", "_th", "n", "pos", "hs", "wl", "bl", "gs", f"{sel} as sel")


def fingerprints(made: DataFrame) -> DataFrame:
    """_key, _th, p, g: every selected gram."""
    return made.selectExpr("_key", "_th", "inline(transform(array_distinct(array_compact(sel)), p -> named_struct('p', p, 'g', gs[p])))")


def flags(places: str, size: str, at: str, rest: str) -> str:
    """SQL: an array of `size` booleans, `at` at the ascending places and `rest` elsewhere; its cost is its length."""
    return f"concat(array_repeat({rest}, {places}[0]), flatten(transform({places}, (x, k) -> concat(array({at}), array_repeat({rest}, coalesce(get({places}, k + 1), {size}) - x - 1)))))"


def same_document(a: DataFrame, b: DataFrame, left: str = "inner") -> DataFrame:
    """a joined with b (its key columns under the names _k and _t) by document; keys may be null."""
    return a.join(b, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_th") == F.col("_t")), left).drop("_k", "_t")


def repeated(hashed: DataFrame, window: int = WINDOW, grain: int = GRAIN) -> DataFrame:
    """_key, _th, keep (a boolean a line of the text) of every document that loses lines. hashed must be written."""
    made = written(windows(hashed, window, grain), "windows")
    prints = fingerprints(made)
    shared = prints.groupBy("g").agg(F.count("*").alias("m")).where("m > 1").select("g")
    places = prints.join(shared, "g").groupBy("_key", "_th").agg(F.array_sort(F.collect_list("p")).alias("ps")).withColumnsRenamed({"_key": "_k", "_th": "_t"})
    marked = same_document(made, places).selectExpr("*", f"{flags('ps', 'size(hs)', 'true', 'false')} as hit")
    ahead = "transform(filter(sequence(0, size(hs) - 1), i -> sel[i] is not null and hit[sel[i]]), i -> named_struct('s', i, 'e', i + wl[i] - 1))"
    back = "transform(filter(sequence(0, size(hs) - 1), j -> bl[j] is not null and hit[sel[j - bl[j] + 1]] and j - bl[j] + wl[j - bl[j] + 1] < j), j -> named_struct('s', j - bl[j] + 1, 'e', j))"
    runs = marked.selectExpr("_key", "_th", f"inline(transform(concat({ahead}, {back}), x -> named_struct('s', x.s, 'e', x.e, 'w', xxhash64(slice(hs, x.s + 1, x.e - x.s + 1)))))")
    runs = written(runs, "runs")
    first = runs.groupBy("w").agg(F.min(F.struct(F.col("_key").alias("k"), F.col("_th").alias("t"), "s", "e")).alias("f"), F.count("*").alias("m")).where("m > 1").drop("m")
    own = F.col("_key").eqNullSafe(F.col("f.k")) & (F.col("_th") == F.col("f.t"))
    later = runs.join(first, "w").where(~own | (F.col("s") > F.col("f.e")))
    lost = later.groupBy("_key", "_th").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("rs")).withColumnsRenamed({"_key": "_k", "_th": "_t"})
    met = same_document(made.select("_key", "_th", "n", "pos"), lost)
    # the part of each run beyond the one before it
    part = "transform(rs, (r, k) -> if(k > 0 and rs[k - 1].e >= r.e, array(), sequence(if(k > 0, greatest(r.s, rs[k - 1].e + 1), r.s), r.e)))"
    gone = met.selectExpr("_key", "_th", "n", "pos", f"array_sort(array_distinct(flatten({part}))) as ks")
    # in lines of the text; blank ones between two lines that go
    inside = gone.selectExpr("_key", "_th", "n", "flatten(transform(ks, (k, i) -> if(get(ks, i + 1) = k + 1, sequence(pos[k], pos[k + 1] - 1), array(pos[k])))) as ps")
    return inside.selectExpr("_key", "_th", "size(ps) as n_gone", f"{flags('ps', 'n', 'false', 'true')} as keep")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, grain: int = GRAIN) -> DataFrame:
    """docs with later repeated runs of lines deleted from the text; beside all columns: _n_lines and _n_removed."""
    hashed = written(line_hashes(docs, key, text), "lines")
    found = written(repeated(hashed, window, grain), "gone")
    # texts are merged with their flags at every size: a plan that broadcasts them while they are few would not hold later
    met = docs.join(found.select(F.col("_key").alias("_gone_k"), F.col("_th").alias("_gone_t"), F.col("keep").alias("_keep"), F.col("n_gone").alias("_gone_n")).hint("merge"), docs[key].eqNullSafe(F.col("_gone_k")) & (F.xxhash64(docs[text].cast("string")) == F.col("_gone_t")), "left")
    lines = F.split(F.col(text).cast("string"), "\n", -1)
    left = F.when(F.col("_keep").isNull(), F.col(text)).otherwise(F.array_join(F.filter(lines, lambda x, i: F.get("_keep", i)), "\n"))
    n_lines = F.coalesce(F.when(F.col(text).isNotNull(), F.size(lines)), F.lit(0)).cast("long")
    counted = met.withColumns({"_n_lines": n_lines, "_n_removed": F.coalesce("_gone_n", F.lit(0)).cast("long")})
    return counted.withColumn(text, left).drop("_gone_k", "_gone_t", "_gone_n", "_keep")
