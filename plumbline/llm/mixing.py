"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources in code point order (null last) take the weights 5, 2, 1, 5, ... and share `share` of all words. A source's
target stops at `most` times its size and the excess is shared again by weight, which is water filling: the level is
found in one pass over the sources, least room a weight first. Complete epochs of a source come first; what is left
of its target is drawn without replacement: a document's key is an exponential variate divided by its quality weight,
documents are ordered by key, and their sizes are summed until the target is met (the last one is taken if more than
half of it fits).

The running sums need no source in one task: keys are cut into bins, sizes are summed by (source, bin), and only the
one bin of each source in which its target falls is ordered row by row. The number of bins follows the row count,
without a limit, so that bin holds about `BIN_ROWS` rows at every size. Targets are found over one row a source.

Edge cases: null or empty text has size 0 and quality 1; a null source is a source of its own; repeated rows have
equal keys and are drawn one by one; a null id is drawn by its text; an empty table gives an empty result; result
names win over clashing columns, which are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WORD_REGEX, written

SHARE, MOST, WEIGHTS, SEED, BIN_ROWS = 1.5, 2, (5, 2, 1), 11, 20_000
MARKS = "#*$%&|<>"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """1 for plain words, less with every symbol a word: 1 / (1 + symbols / words)."""
    marks = F.length(text) - F.length(F.translate(text, MARKS, ""))
    return F.when(size > 0, size / (size + marks)).otherwise(F.lit(1.0))


def uniform(key: Column, text: Column, seed: int) -> Column:
    """In (0, 1), from the first 52 bits of an MD5 of seed and id (of the text where the id is null)."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), text, F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size -> also target, epochs, rest. One row a source, so its windows are over sources only."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    named = sizes.withColumn("weight", cycle).withColumn("room", F.col("source_size") * most)
    order = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("room").over(before), F.lit(0))
    level = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    ranked = named.withColumn("level", level).withColumn("place", F.row_number().over(order))
    fits = ranked.withColumn("open", F.col("level") * F.col("weight") <= F.col("room"))
    final = fits.withColumn("best", F.min(F.when(F.col("open"), F.struct("place", "level"))).over(whole))
    target = F.when(F.col("place") >= F.col("best.place"), F.least(F.col("best.level") * F.col("weight"), F.col("room").cast("double"))).otherwise(F.col("room").cast("double"))
    out = final.withColumn("target", target).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    return out.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).select("source", "source_size", "target", "epochs", "rest")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = SHARE, most: int = MOST, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, source, size, source_size, target, epochs, drawn (0 or 1) and taken of every document, and the carried columns."""
    size = n_words(F.col("_text"))
    base = docs.select(F.col(key).alias("_key"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("_text"), *[F.col(c).alias(f"_c_{c}") for c in carry])
    keyed = base.withColumn("size", size).withColumn("_e", -F.log(uniform(F.col("_key"), F.col("_text"), seed)) / quality(F.col("_text"), F.col("size"))).withColumn("_tie", F.xxhash64("_text")).drop("_text")
    rows = written(keyed, "sized")
    n_bins = max(64, rows.count() // BIN_ROWS)
    rows = rows.withColumn("_bin", F.least(F.floor((1 - F.exp(-F.col("_e"))) * n_bins), F.lit(n_bins - 1)).cast("int"))
    by_bin = rows.groupBy("source", "_bin").agg(F.sum("size").alias("n"))
    plan = targets(by_bin.groupBy("source").agg(F.sum("n").alias("source_size")), share, most)
    ran = by_bin.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("_bin")))
    edge = ran.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source"))).where(F.col("b.upto") >= F.col("p.rest")).groupBy("b.source").agg(F.min(F.struct("b._bin", (F.col("b.upto") - F.col("b.n")).alias("before"))).alias("e"))
    plan = written(plan.alias("p").join(edge.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source")), "left").select("p.*", F.col("e.e._bin").alias("edge"), F.col("e.e.before").alias("before")), "plan")
    hint = F.broadcast(plan) if plan.count() <= 10_000 else plan
    met = rows.alias("r").join(hint.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).select("r.*", *[f"p.{c}" for c in plan.columns if c != "source"])
    inside = met.where(F.col("_bin") == F.col("edge"))
    order = Window.partitionBy("source").orderBy("_e", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    drawn = inside.withColumn("drawn", (2 * so_far + F.col("size") <= 2 * F.col("rest")).cast("int"))
    others = met.where(~F.col("_bin").eqNullSafe(F.col("edge"))).withColumn("drawn", (F.col("_bin") < F.col("edge")).cast("int"))
    both = drawn.unionByName(others).withColumn("drawn", F.when(F.col("rest") > 0, F.col("drawn")).otherwise(0))
    return both.select(F.col("_key").alias(key), "source", "size", "source_size", "target", "epochs", "drawn", ((F.col("epochs") + F.col("drawn")) * F.col("size")).alias("taken"), *[F.col(f"_c_{c}").alias(c) for c in carry])


def take_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns (which are written once beside their sizes)."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key), F.col(text), F.col(source))
    found = mix(whole, key, text, source, seed=seed, carry=("row",))
    times = (F.col("epochs") + F.col("drawn")).cast("int")
    return found.where(times > 0).select("row", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")


#: The same in SQL for documents (DuckDB).
ORACLE = f"""
WITH sized AS (
  SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         length(text) - length(translate(text, '{MARKS}', '')) AS marks
  FROM documents),
keyed AS (
  SELECT *, -ln((('0x' || substr(md5('{SEED}|' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
            / (CASE WHEN size > 0 THEN size::DOUBLE / (size + marks) ELSE 1.0 END) AS e
  FROM sized),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, 2 * source_size AS room, row_number() OVER o AS place,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM sources WINDOW o AS (ORDER BY 2 * source_size / weight, source NULLS LAST)),
best AS (SELECT place AS first_open, level AS final FROM ranked WHERE level * weight <= room ORDER BY place LIMIT 1),
plan AS (
  SELECT source, source_size,
         (CASE WHEN place >= first_open THEN least(final * weight, room) ELSE room END)::DOUBLE AS target
  FROM ranked, best),
run AS (
  SELECT k.doc_id, k.size, p.source_size, p.target,
         CASE WHEN p.source_size > 0 THEN floor(p.target / p.source_size) ELSE 0 END AS epochs,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far
  FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
       ((epochs + CASE WHEN target - epochs * source_size > 0 AND 2 * so_far + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM run
"""
