"""Mixing sources to target weights.

Rows get hash-random keys; within each source they are sorted by key over ranges of the key (its leading
hex digits), sizes are summed per range, and prefix sums over the ranges and then within each range place
every row on its source's line of words. The line is cut at the source's budget: whole epochs first, then
the rows below the cut; the row on the cut gives the words that are left. No source is ever in one task:
a range holds some thousand rows, and per source only one sum for each range is gathered.

Cases: a null text has size 0, a text of any length its whole size; a null source is a source of its own, last
in order; rows without doc_id get their key from the text. Rows that repeat a doc_id share a key and are
ordered by size. Columns of docs stay, but for those named as results. Sources without
words get target 0. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import WORD_SQL, Rows, cut

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
ROWS_A_RANGE = 4096
SEED = "mix-1"


def targets(sized: DataFrame, weights=WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """One row per source: source, source_size, target. A target that would exceed ``most_epochs`` times
    its source's size stops there, and the rest is shared again by weight: the level to which all other
    sources rise is found by one ordered pass over the sources (one row each)."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight).withColumn("cap", most_epochs * F.col("source_size"))
    order = [F.col("cap") / F.col("weight"), F.col("rank")]
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rest = W.orderBy(*order).rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    levels = capped.withColumn("total", F.sum("source_size").over(everything)).withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    )
    fits = F.col("level") <= F.col("cap") / F.col("weight")
    level = F.min_by(F.when(fits, F.col("level")), F.when(fits, F.struct(F.col("cap") / F.col("weight"), F.col("rank")))).over(everything)
    return levels.withColumn("found", level).select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("found")).alias("target")
    )


def mix(docs: DataFrame, weights=WEIGHTS, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target and taken."""
    rows = Rows(docs, ("doc_id", "source", "text"))
    sized = _sized(rows, seed)
    figures = _figures(sized, weights)
    return rows.df.join(figures, "rid").select(*rows.back(FIGURES), *FIGURES)


def _sized(rows: Rows, seed: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(rows.col("text"), F.lit(WORD_SQL)), F.lit(0)).cast("long")
    # rows without an id are spread by their texts
    unnamed = F.concat(F.lit("text "), F.md5(F.coalesce(rows.col("text"), F.lit("")).cast("binary")))
    name = F.concat(F.coalesce(rows.col("doc_id").cast("string"), unnamed), F.lit("/" + seed))
    return cut(rows.df.select("rid", rows.col("source").alias("source"), size.alias("size"), F.md5(name.cast("binary")).alias("key")))


def _figures(sized: DataFrame, weights) -> DataFrame:
    n = sized.count()
    digits = max(1, math.ceil(math.log(max(n, 1) / ROWS_A_RANGE, 16)) if n > ROWS_A_RANGE else 1)
    ranged = sized.withColumn("range", F.substring("key", 1, digits))
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    earlier = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
    budget = F.round("target").cast("long")
    plan = targets(sized, weights).withColumn("whole", F.expr("try_divide(round(target), source_size)").cast("long"))
    plan = plan.withColumn("whole", F.coalesce("whole", F.lit(0))).withColumn("part", budget - F.col("whole") * F.col("source_size"))
    # the source's figures travel with its ranges, so that no join has a whole source under one key
    o, p = offsets.alias("o"), plan.alias("p")
    ranges = o.join(p, F.col("o.source").eqNullSafe(F.col("p.source"))).select(
        F.col("o.source").alias("r_source"), F.col("o.range").alias("r_range"), "offset", "source_size", "target", "whole", "part"
    )
    placed = ranged.join(ranges, ranged["source"].eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range")))
    within = W.partitionBy("r_source", "r_range").orderBy("key", "size", "rid").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0))
    taken = F.col("whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - start))
    return placed.select("rid", "size", "source_size", "target", taken.cast("long").alias("taken"))


FIGURES = ("size", "source_size", "target", "taken")


def resample(docs: DataFrame, weights=WEIGHTS, seed: str = SEED) -> DataFrame:
    """The mixed rows themselves, with the columns of docs: each document as often as whole epochs take
    it, and once more where at least half of its words lie below the cut."""
    rows = Rows(docs, ("doc_id", "source", "text"))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + F.lit(0.5))).otherwise(0).cast("int")
    drawn = _figures(_sized(rows, seed), weights).select("rid", times.alias("times")).where("times > 0")
    copies = rows.df.join(drawn, "rid").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return copies.select(*rows.back())


def digest(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "source", "text")).select("doc_id", *FIGURES)


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, ''))) || '/mix-1') AS key
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rk FROM per),
capped AS (SELECT *, [5, 2, 1][rk % 3 + 1] AS weight, 3 * source_size AS cap FROM ranked),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
            / (sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS lvl
  FROM capped),
found AS (SELECT first(lvl ORDER BY cap / weight, rk) AS lvl FROM levels WHERE lvl <= cap / weight),
plan AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * found.lvl) AS target
  FROM levels, found),
cuts AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS whole
  FROM plan),
placed AS (
  SELECT s.doc_id, s.size, c.source_size, c.target, c.whole, round(c.target)::BIGINT - c.whole * c.source_size AS part,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, part - start)))::BIGINT AS taken
FROM placed
"""
