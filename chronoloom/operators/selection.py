"""Positioned pairs, and their selection by time: recency, coverage, balanced and uniform bins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoloom.functions.binning import half_open_bin, right_closed_bin
from chronoloom.functions.order import shuffle_key

#: The columns of a positioned pair.
PAIR = ["person_id", "window_index", "start_date", "end_date", "instruction", "response", "evidence", "relative_position", "source_file"]


def relative_position(evidence: Column, start: Column, end: Column) -> Column:
    """Where a date lies between start (0) and end (1), by whole days; null if the window has no duration."""
    span = F.datediff(end, start)
    return F.when(span != 0, F.greatest(F.least(F.datediff(evidence, start) / span, F.lit(1.0)), F.lit(0.0)))


def positioned(pairs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Pairs whose evidence lies within their window, with relative_position.

    ``keep`` names further columns to keep. Rows with an error, an unparseable or missing evidence date, or a window without duration go.
    """
    known = pairs.where("error IS NULL AND evidence IS NOT NULL AND datediff(end_date, start_date) <> 0")
    inside = known.where(F.col("evidence").between(F.col("start_date"), F.col("end_date")))
    return inside.withColumn("relative_position", relative_position(F.col("evidence"), F.col("start_date"), F.col("end_date"))).select(*(keep or []), *PAIR)


def _same_row(names: list[str]) -> Column:
    test = F.lit(True)
    for n in names:
        test = test & F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}"))
    return test


def minus_equal_rows(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``rows`` less all that equal a row of ``chosen`` in every column; equal rows go together."""
    return rows.alias("l").join(chosen.select(*rows.columns).alias("r"), _same_row(rows.columns), "left_anti")


def _order(key: str, seed: int) -> Column:
    return shuffle_key(key, seed=seed)


def one_per_source(rows: DataFrame, key: str, seed: int, source: str = "source_file") -> DataFrame:
    """One row of each source, the first by random order."""
    rank = Window.partitionBy(source).orderBy(_order(key, seed), key)
    return rows.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").drop("_rank")


def cover_and_fill(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """One row per source (all of them, even beyond n), then others at random up to n in all.

    What fills differs in value from what covers. ``key`` is a stable row id.
    """
    cover = one_per_source(rows, key, seed)
    values = [c for c in rows.columns if c != key]
    rest = rows.alias("l").join(cover.select(*values).alias("r"), _same_row(values), "left_anti")
    both = cover.withColumn("_fill", F.lit(0)).unionByName(rest.withColumn("_fill", F.lit(1)))
    first = both.orderBy("_fill", _order(key, seed + 1), key).limit(n).where("_fill = 1")
    return cover.unionByName(first.drop("_fill"))


def require_at_least(rows: DataFrame, n: int, what: str) -> DataFrame:
    """``rows``; raises if there are fewer than n. Stops counting at n."""
    found = rows.limit(n).count()
    if found < n:
        raise ValueError(f"{what}: {found} rows qualify, {n} are needed")
    return rows


def recent(rows: DataFrame, n: int, key: str, threshold: float = 0.75, seed: int = 0, cohort: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """Pairs in the last part of their window, covering every source, filled to n.

    ``cohort`` (person_id) restricts the persons; an empty cohort restricts nothing.
    """
    late = rows.where(F.col("relative_position") >= threshold)
    if cohort is not None and not cohort.isEmpty():
        late = late.join(cohort.select("person_id").distinct(), "person_id", "left_semi")
    if strict:
        late = require_at_least(late, n, f"positions from {threshold}")
    return cover_and_fill(late, n, key, seed)


def whole_span(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """Pairs from anywhere in their windows, covering every source, filled to n."""
    return cover_and_fill(rows, n, key, seed)


def both_edges(rows: DataFrame, n: int, key: str, width: float = 0.1, seed: int = 0) -> DataFrame:
    """Pairs near either end of their window, covering every source, filled to n."""
    return cover_and_fill(rows.where((F.col("relative_position") <= width) | (F.col("relative_position") >= 1 - width)), n, key, seed)


def per_bin(rows: DataFrame, quota: int, key: str, seed: int = 0, bins: int = 10) -> DataFrame:
    """At most ``quota`` rows of each half-open bin, at random; adds ``bin``."""
    binned = rows.withColumn("bin", half_open_bin(F.col("relative_position"), bins))
    rank = Window.partitionBy("bin").orderBy(_order(key, seed), key)
    return binned.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= quota).drop("_rank")


def _least_filled(bins: int, quota: int):
    """Each source in turn takes its bin that has the fewest rows so far, the first it holds if tied."""

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fill = [0] * bins
        for part in parts:
            taken = []
            for source, held in zip(part["source_file"], part["held"]):
                open_bins = [b for b in dict.fromkeys(held) if fill[b] < quota]
                if open_bins:
                    b = min(open_bins, key=lambda x: fill[x])
                    fill[b] += 1
                    taken.append((source, b))
            yield pd.DataFrame(taken, columns=["source_file", "bin"])
            if min(fill) >= quota:
                return  # no later source can add anything

    return fold


def balanced_with_coverage(rows: DataFrame, n: int, key: str, seed: int = 0, bins: int = 10) -> DataFrame:
    """n // bins rows of each bin: first one from each source, from its least filled bin, then at random.

    The first pass depends on its own earlier choices. It reads only (source, its bins), in random
    order, in one task that stops as soon as every bin is full: of all sources that hold the same bins
    only the first, no more than are wanted in all. Rows themselves never pass through it.
    """
    quota = n // bins
    binned = rows.withColumn("bin", half_open_bin(F.col("relative_position"), bins)).withColumn("_order", _order(key, seed))
    firsts = binned.groupBy("source_file", "bin").agg(F.min(F.struct("_order", F.col(key))).alias("at"))
    held = firsts.groupBy("source_file").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "bin"))), lambda x: x["bin"]).alias("held"))
    # Of sources that hold the same bins in the same order, one that gains nothing finds them all full, and so do
    # those behind it: the first of each such list, as many as rows are wanted and one more, decide. Tasks cut their
    # part to these before any row moves.
    alike = Window.partitionBy("held").orderBy(shuffle_key("source_file", seed=seed), "source_file")
    held = held.withColumn("_turn", F.row_number().over(alike)).where(F.col("_turn") <= quota * bins + 1).drop("_turn")
    ordered = held.repartition(1).sortWithinPartitions(shuffle_key("source_file", seed=seed), "source_file")
    turns = ordered.mapInPandas(_least_filled(bins, quota), "source_file string, bin int")
    rank = Window.partitionBy("source_file", "bin").orderBy("_order", key)
    cover = binned.join(turns, ["source_file", "bin"]).withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").select(*binned.columns)
    values = [c for c in rows.columns if c != key]
    rest = binned.alias("l").join(cover.select(*values).alias("r"), _same_row(values), "left_anti")
    both = cover.withColumn("_fill", F.lit(0)).unionByName(rest.withColumn("_fill", F.lit(1)))
    place = Window.partitionBy("bin").orderBy("_fill", "_order", key)
    return both.withColumn("_rank", F.row_number().over(place)).where(F.col("_rank") <= quota).drop("_rank", "_fill", "_order")


def bin_histogram(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, percent) of the right-closed bins, empty ones included."""
    counted = rows.groupBy(right_closed_bin(F.col("relative_position"), bins).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = every.join(counted, F.col("bin") == F.col("b"), "left").select("bin", F.coalesce("c", F.lit(0).cast("long")).alias("n"))
    total = Window.partitionBy(F.lit(0))
    return full.withColumn("percent", F.coalesce(F.try_divide(F.col("n") * 100.0, F.sum("n").over(total)), F.lit(0.0)))


def uniformity(histogram: DataFrame) -> DataFrame:
    """(cv, least): the counts' population deviation by their mean (infinite without any), and the least count."""
    mean = F.avg("n")
    return histogram.agg(F.when(F.coalesce(mean, F.lit(0.0)) == 0, F.lit(float("inf"))).otherwise(F.stddev_pop("n") / mean).alias("cv"), F.min("n").alias("least"))


def uniform_bins(rows: DataFrame, quota: int | None, key: str, seed: int = 0, bins: int = 10) -> DataFrame:
    """The most uniform of repeated samples: ``quota`` rows of each right-closed bin, persons spread.

    A first pass lets persons in random order give each bin one row until it has its quota; a second
    fills bins up with any of their rows. Bins do not affect each other, so a bin's first pass is
    the first row of each of its persons in that order, and both passes are one rank. Every repeat
    fills every bin to the lesser of its rows and the quota: all repeats have the same coefficient
    of variation, the strict comparison keeps the first, and only that one is computed. Without a
    quota it is the least count of a bin; an empty bin is then an error.
    """
    if quota is None:
        quota = uniformity(bin_histogram(rows, bins)).first().least
        if not quota:
            raise ValueError("a bin has no rows, so no quota follows from the bins")
    binned = rows.withColumn("bin", right_closed_bin(F.col("relative_position"), bins)).where("bin IS NOT NULL").withColumn("_order", _order(key, seed))
    own = Window.partitionBy("person_id", "bin").orderBy("_order", key)
    turn = Window.partitionBy("bin").orderBy(F.col("_own") > 1, F.when(F.col("_own") == 1, shuffle_key("person_id", seed=seed)).otherwise(F.col("_order")), key)
    ranked = binned.withColumn("_own", F.row_number().over(own)).withColumn("_rank", F.row_number().over(turn))
    return ranked.where(F.col("_rank") <= quota).drop("_own", "_rank", "_order")


def nested_by_window(rows: DataFrame) -> DataFrame:
    """One row per (person_id, window_index): its dates and its pairs as an array, in a fixed order."""
    pair = F.struct("instruction", "response", F.date_format("evidence", "MM/dd/yyyy").alias("evidence"))
    return rows.groupBy("person_id", "window_index").agg(F.min("start_date").alias("start_date"), F.min("end_date").alias("end_date"), F.array_sort(F.collect_list(pair)).alias("response_data"))


def sampling_log(total: DataFrame, chosen: DataFrame, kind: str, bins: int | None = None) -> DataFrame:
    """(selection_type, total_pairs, sampled_pairs, persons): what a selection did.

    With ``bins``, also ``distribution``: a line for each half-open bin with its bounds and pairs, empty ones included.
    """
    counts = total.agg(F.count(F.lit(1)).alias("total_pairs"))
    held = []
    if bins:
        own = half_open_bin(F.col("relative_position"), bins)
        lines = [F.concat(F.lit(f"Bin {b / bins:.1f}-{(b + 1) / bins:.1f}: "), F.count_if(own == b).cast("string"), F.lit(" pairs")) for b in range(bins)]
        held = [F.concat_ws("\n", *lines).alias("distribution")]
    kept = chosen.agg(F.count(F.lit(1)).alias("sampled_pairs"), F.count_distinct("person_id").alias("persons"), *held)
    return counts.crossJoin(kept).select(F.lit(kind).alias("selection_type"), "total_pairs", *kept.columns)
