"""Mixing sources to target weights with a time-varying curriculum.

Each source has a target number of words and a schedule: its weight rises or falls linearly over the
training time from 0 to 1. The integral of the schedule is the source's cumulative demand for words;
a document that stands at word x of its source's stream is due when the demand reaches x, so the
inverse of the integral gives its training position. A source's stream is its documents in hash
order, pass after pass, up to its target. Documents are then sorted by range of position.

All of it is DataFrame operations. The sizes are summed per source and hash range (a small table),
so targets, starts and positions need one pass each over the rows and never a whole source in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoloom.llm.common import WORD_PATTERN, bucket_starts, bucket_sums, running_totals, spread, write_table

#: Weights of the sources by code point (null last), repeating.
WEIGHTS = (5, 2, 1)
#: How much a source's schedule falls (above 0) or rises (below) around its mean, repeating.
RAMPS = (0.5, 0.0, -0.5)
#: Words of the mix in halves of all words: 150 percent.
HALVES = 3
#: A source is taken this many times at most.
MAX_PASSES = 2


def _rows(docs: DataFrame) -> DataFrame:
    size = F.size(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD_PATTERN), F.lit(0))).cast("long")
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("source")))
    # The row itself is one column, so no name of its own can clash with those beside it.
    return docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.hash(F.col("text")).alias("_text"), key.alias("_key"), spread(F.col("doc_id")).alias("_order"), size.alias("_size"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(_key, _source_size, _target, _ramp) from (_key, source_size), one row per source.

    Water filling: by ascending 2 * size / weight, a source is full if the level reached by sharing
    what is left over the weights that are left is at or above its own ratio; the level of the
    first that is not full holds for it and all after it. A source without words has target 0.
    """
    by_name = Window.orderBy(F.col("_key").startswith("n"), "_key")
    at = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    pick = lambda values: F.get(F.array(*map(F.lit, values)), at)
    named = sizes.select("_key", "source_size", pick(WEIGHTS).cast("long").alias("w"), pick(RAMPS).alias("ramp"))
    named = named.withColumn("cap", F.col("source_size") * MAX_PASSES).withColumn("ratio", F.col("cap") / F.col("w"))
    by_ratio = Window.orderBy("ratio", "_key")
    ahead, rest, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) * HALVES / F.lit(2.0) - F.coalesce(F.sum("cap").over(ahead), F.lit(0))
    level = named.withColumn("level", left / F.sum("w").over(rest)).withColumn("full", F.col("level") >= F.col("ratio"))
    final = F.min(F.when(~F.col("full"), F.struct("ratio", "_key", "level"))).over(whole)["level"]
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("final") * F.col("w"))
    return level.withColumn("final", final).select("_key", F.col("source_size").alias("_source_size"), target.alias("_target"), F.col("ramp").alias("_ramp"))


def due(share: Column, ramp: Column) -> Column:
    """When a source's demand reaches this share of its target: the inverse of (1 + ramp) t - ramp t^2."""
    b = ramp + 1.0
    return F.when(ramp == 0.0, share).otherwise((b - F.sqrt(F.greatest(b * b - ramp * share * 4.0, F.lit(0.0)))) / (ramp * 2.0))


def _assigned(rows: DataFrame) -> DataFrame:
    """``rows`` with _source_size, _target, _taken and _starts (the passes' positions, null where not taken)."""
    sums = write_table(bucket_sums(rows, F.col("_size")), "source-sums")
    targets = source_targets(sums.groupBy("_key").agg(F.sum("_sum").alias("source_size")))
    starts = bucket_starts(sums).join(targets, "_key")
    ties = [F.col("doc_id"), F.col("_size"), F.col("_text")]
    laid = running_totals(rows, starts, F.col("_size"), ties, "_before")
    whole = F.floor("_target").cast("long")
    part = lambda p: F.greatest(F.least(whole - F.col("_before") - F.col("_source_size") * p, F.col("_size")), F.lit(0).cast("long"))
    start = lambda p: F.when(part(p) > 0, due((F.col("_before") + F.col("_source_size") * p) / F.col("_target"), F.col("_ramp")))
    passes = range(MAX_PASSES)
    taken = sum((part(p) for p in passes), F.lit(0).cast("long"))
    return laid.withColumn("_taken", taken).withColumn("_starts", F.array(*[start(p) for p in passes]))


def mix_plan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, position, again.

    taken counts the words that the mix takes of the document, repeats included: its share of the
    first floor(target) words of its source's stream, so a source takes floor(target) words exactly
    and a document twice its size at most. position and again are when its first and second pass
    begin (null: not taken). Rows are sorted by range of position, untaken ones last. Null texts
    have size 0; a null source is a source of its own; rows with equal ids lie next to each other.
    Words are counted once: the narrow table is written before it is read again. Other columns do
    not matter; an empty table gives an empty result.
    """
    rows = write_table(_rows(docs).select("doc_id", "_text", "_key", "_order", "_size"), "mix-sizes")
    plan = _assigned(rows).select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"), F.get("_starts", F.lit(0)).alias("position"), F.get("_starts", F.lit(1)).alias("again"))
    return plan.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs``, one copy for each pass that takes words of them, by position.

    The document at the end of a source's target, of which the mix takes a part, is kept whole.
    Documents without words are in no mix. Columns are those of ``docs``.
    """
    taken = _assigned(_rows(docs)).select("row", "doc_id", F.explode(F.array_compact("_starts")).alias("_position"))
    return taken.repartitionByRange("_position", "doc_id").sortWithinPartitions("_position", "doc_id").select("row.*")


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for the registered query, positions rounded."""
    # The share of its demand that a source's schedule has reached, turned into the time at which it does.
    due = "CASE WHEN ramp = 0 THEN {0} ELSE ((ramp + 1) - sqrt(greatest((ramp + 1) * (ramp + 1) - ramp * {0} * 4, 0))) / (ramp * 2) END"
    return rf"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END AS k,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h FROM {table}),
s AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY k),
o AS (SELECT *, (row_number() OVER (ORDER BY starts_with(k, 'n'), k) - 1) % 3 + 1 AS i FROM s),
n AS (SELECT k, source_size, [5, 2, 1][i] AS w, CAST([0.5, 0.0, -0.5][i] AS DOUBLE) AS ramp FROM o),
c AS (SELECT *, 2 * source_size AS cap, 2 * source_size / w AS ratio FROM n),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 3 / 2 - CAST(coalesce(sum(cap) OVER (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
                / CAST(sum(w) OVER (ORDER BY ratio, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM c),
t AS (SELECT k, source_size, ramp, CASE WHEN level >= ratio THEN CAST(cap AS DOUBLE)
             ELSE (SELECT arg_min(level, ratio) FROM (SELECT level, ratio, k FROM l WHERE level < ratio ORDER BY ratio, k LIMIT 1)) * w END AS target FROM l),
r AS (SELECT doc_id, size, source_size, target, ramp, CAST(floor(target) AS BIGINT) AS whole,
             CAST(coalesce(sum(size) OVER (PARTITION BY d.k ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM d JOIN t USING (k)),
p AS (SELECT *, greatest(least(whole - before, size), 0) AS first, greatest(least(whole - before - source_size, size), 0) AS second,
             CASE WHEN target > 0 THEN before / target END AS share, CASE WHEN target > 0 THEN (before + source_size) / target END AS share_again FROM r)
SELECT doc_id, size, source_size, target, first + second AS taken,
       CASE WHEN first > 0 THEN round({due.format("share")}, 9) + 0 END AS position, CASE WHEN second > 0 THEN round({due.format("share_again")}, 9) + 0 END AS again
FROM p"""
