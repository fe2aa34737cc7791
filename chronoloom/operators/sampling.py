"""Cohort and stratified samples, splits, and resampling; all random choices are hash orders."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoloom.functions.order import shuffle_key


def iid_sample(rows: DataFrame, entity: str, n: int, seed: int = 0) -> DataFrame:
    """n distinct entities at random."""
    return rows.select(entity).where(F.col(entity).isNotNull()).distinct().orderBy(shuffle_key(entity, seed=seed), entity).limit(n)


def valid_label(label: Column, sentinel: str = "unknown") -> Column:
    """Neither null nor blank nor the sentinel, whatever its case."""
    return label.isNotNull() & (F.lower(label) != sentinel) & (F.trim(label) != "")


def top_groups(rows: DataFrame, group: str, k: int) -> DataFrame:
    """The k largest groups: (group, num)."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("num")).orderBy(F.desc("num"), group).limit(k)


def stratified_sample(visits: DataFrame, providers: DataFrame, n: int, strata: int = 200, seed: int = 0, key: str = "visit_id", stratum: str = "specialty", sentinel: str = "Unknown") -> DataFrame:
    """About n visits over the largest strata: equally many at random from each, then n in all.

    Visits get their provider's stratum; visits without one, or with the sentinel, go.
    """
    quota = (n - 1) // strata + 1
    known = visits.join(providers, "provider_id", "left").where(F.col(stratum).isNotNull() & (F.col(stratum) != sentinel))
    large = top_groups(known, stratum, strata).select(stratum)
    rank = Window.partitionBy(stratum).orderBy(shuffle_key(key, seed=seed), key)
    ranked = known.join(large, stratum).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= quota)
    return ranked.orderBy(shuffle_key(key, seed=f"{seed}-all"), key).limit(n)


def latest_valid_label(people: DataFrame, visits: DataFrame, providers: DataFrame, label: str = "specialty", default: str = "Unknown") -> DataFrame:
    """Each person's most recent visit with a valid label: (person_id, visit_id, label); the default where none is.

    All persons in one join instead of a lookup for each.
    """
    known = visits.join(providers, "provider_id").where(valid_label(F.col(label)))
    last = known.groupBy("person_id").agg(F.max(F.struct("visit_date", "visit_id", label)).alias("last"))
    joined = people.select("person_id").distinct().join(last, "person_id", "left")
    return joined.select("person_id", F.coalesce(F.col("last.visit_id").cast("string"), F.lit(default)).alias("visit_id"), F.coalesce(f"last.{label}", F.lit(default)).alias(label))


def exact_per_person(rows: DataFrame, total: int, k: int, key: str, seed: int = 0) -> DataFrame:
    """Exactly k rows from each of total // k persons that have k; raises if there are too few such persons."""
    people = rows.groupBy("person_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    wanted = total // k
    chosen = people.orderBy(shuffle_key("person_id", seed=seed), "person_id").limit(wanted)
    if chosen.count() < wanted:
        raise ValueError(f"fewer than {wanted} persons have {k} rows")
    rank = Window.partitionBy("person_id").orderBy(shuffle_key(key, seed=seed), key)
    own = rows.join(chosen.select("person_id"), "person_id", "left_semi")
    return own.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).drop("rank")


def split(rows: DataFrame, key: str, train: float = 0.8, held_out: float = 0.2, seed: int = 42) -> DataFrame:
    """``rows`` with partition 'train' or 'test' (null beyond both): the first int(train * n) in random order, then int(held_out * n).

    Positions come from a range-partitioned count: no task sorts all rows.
    """
    ordered = rows.withColumn("_order", shuffle_key(key, seed=seed))
    positions = global_positions(ordered, ["_order", key])
    total = rows.agg(F.count(F.lit(1)).alias("_n"))
    first, second = F.floor(F.col("_n") * train), F.floor(F.col("_n") * held_out)
    part = F.when(F.col("_position") < first, "train").when(F.col("_position") < first + second, "test")
    return positions.crossJoin(F.broadcast(total)).withColumn("partition", part).drop("_order", "_position", "_n")


def global_positions(rows: DataFrame, order: list[str], prefix: int = 3) -> DataFrame:
    """``rows`` with ``_position``, their rank from 0 by ``order``, whose first column is a hex digest.

    The digest's first characters cut the rows into 16 ** prefix ranges; the counts of the ranges
    give each its start and a window numbers within one.
    """
    cut = rows.withColumn("_cut", F.substring(order[0], 1, prefix))
    before = Window.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("_cut").agg(F.count(F.lit(1)).alias("_c")).withColumn("_start", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    own = Window.partitionBy("_cut").orderBy(*order)
    return cut.withColumn("_rank", F.row_number().over(own) - 1).join(starts, "_cut").withColumn("_position", F.col("_start") + F.col("_rank")).drop("_cut", "_start", "_rank")


def nested_samples(rows: DataFrame, sizes: list[int], key: str, seed: int = 0) -> DataFrame:
    """For each size (size, row): the first rows in one random order; a size beyond all rows takes all."""
    top = rows.orderBy(shuffle_key(key, seed=seed), key).limit(max(sizes))
    numbered = global_positions(top.withColumn("_order", shuffle_key(key, seed=seed)), ["_order", key])
    each = F.explode(F.array(*map(F.lit, sorted(sizes))))
    return numbered.withColumn("size", each).where(F.col("_position") < F.col("size")).drop("_order", "_position")


#: Hashes of a replicate that are held at once.
HASHES = 1 << 16


def _replicate_means(seed: int):
    """The means of the replicates from ``first`` to before ``end`` of values that occur so many times, as a user function."""

    @F.arrow_udf("array<double>")
    def means(values: pa.Array, counts: pa.Array, first: pa.Array, end: pa.Array) -> pa.Array:
        return pa.array([_drawn_means(seed, np.array(v.as_py()), np.array(c.as_py()), a.as_py(), b.as_py()) for v, c, a, b in zip(values, counts, first, end)], pa.list_(pa.float64()))

    return means


def _drawn_means(seed: int, values: np.ndarray, counts: np.ndarray, first: int, end: int) -> list[float]:
    own, n = np.repeat(values, counts), int(counts.sum())
    hashes = -(-n // 4)
    sums = np.zeros(end - first)
    for start in range(0, hashes, HASHES):
        places = [b"%d" % i for i in range(start, min(start + HASHES, hashes))]
        for b in range(first, end):
            known = b"%d|%d|" % (seed, b)
            numbers = np.frombuffer(b"".join([md5(known + p).digest() for p in places]), ">u4")[: n - 4 * start]
            sums[b - first] += own[numbers.astype(np.int64) % n].sum()
    return (sums / n).tolist()


def bootstrap(values: DataFrame, value: str, group: list[str], replicates: int = 10_000, seed: int = 0, low: float = 0.025, high: float = 0.975, block: int = 100) -> DataFrame:
    """(group, n, mean, lower, upper, half_width): bootstrap interval of the mean.

    A replicate draws n values with replacement; draw i of replicate b takes the value whose number
    is the i % 4th part of a hash of (seed, b, i // 4), modulo n. The different values of a group are counted, and these
    counts go to one task for every ``block`` replicates, which draws by vectors; replicates x n rows never exist.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    listed = F.sort_array(F.collect_list(F.struct("_x", "_c")))
    mean = (F.sum(F.col("_x") * F.col("_c")) / F.sum("_c")).alias("mean")
    held = counts.groupBy(*group).agg(listed.alias("_v"), F.sum("_c").alias("n"), mean)
    blocks = -(-replicates // block)
    each = held.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    each = each.repartition(blocks, *group, "_block")  # a stated number: adaptive execution would put such small rows in one task
    first = F.col("_block") * block
    drawn = _replicate_means(seed)(F.col("_v._x"), F.col("_v._c"), first, F.least(first + block, F.lit(replicates)))
    ci = each.select(*group, "n", "mean", F.explode(drawn).alias("_m"))
    ci = ci.groupBy(*group).agg(F.min("n").alias("n"), F.percentile("_m", F.array(F.lit(low), F.lit(high))).alias("_p"), F.max("mean").alias("mean"))
    lower, upper = F.get("_p", F.lit(0)), F.get("_p", F.lit(1))
    return ci.select(*group, "n", "mean", lower.alias("lower"), upper.alias("upper"), ((upper - lower) / 2).alias("half_width"))
