"""What the training-data operators share: words, scratch tables, numbering without one large task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a run of anything but these six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN), F.lit(0))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="chronoloom-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str, **options: int) -> DataFrame:
    """``df``, written to the shared folder and read again; ``options`` are those of Parquet's writer.

    Cuts the lineage: what reads the result neither repeats the work nor depends on the disks of
    executors. Unlike a local checkpoint it survives their loss.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_table(spark: SparkSession, path: str) -> None:
    """Deletes a table below the shared folder that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Hash ranges into which a group is cut for running totals.
BUCKETS = 1024


def spread(key: Column) -> Column:
    """A long, spread evenly over all longs, from the md5 of ``key``; DuckDB can compute it too."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 15)
    return (F.conv(digits, 16, 10).cast("long") - F.lit(1 << 59)) * F.lit(16)


def bucket_of(order: Column, buckets: int = BUCKETS) -> Column:
    """Which of ``buckets`` equal ranges of the longs ``order`` lies in; ascending with ``order``."""
    return F.shiftright((F.shiftright(order, 32) + F.lit(1 << 31)) * F.lit(buckets), 32).cast("int")


def bucket_sums(rows: DataFrame, value: Column) -> DataFrame:
    """(_key, _bucket, _sum): ``value`` summed for each ``_key`` and bucket of ``_order``."""
    return rows.groupBy("_key", bucket_of(F.col("_order")).alias("_bucket")).agg(F.sum(value).alias("_sum"))


def bucket_starts(sums: DataFrame) -> DataFrame:
    """``sums`` with ``_start``: the sum over the earlier buckets of the same key."""
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0)))


def running_totals(rows: DataFrame, starts: DataFrame, value: Column, ties: list[Column], total: str) -> DataFrame:
    """``rows`` with ``total``: the sum of ``value`` over the earlier rows of the same ``_key``.

    Rows are ordered by ``_order`` (see ``spread``) and ``ties``. A key may hold a third of all
    rows, so no task sees a whole key: ``starts`` (see ``bucket_starts``; one row per key and bucket
    at most) gives each bucket's start, and a window within the bucket adds the rest. Window and
    join both want rows hashed by key and bucket, so rows move once. ``_key`` may not be null.
    """
    inside = Window.partitionBy("_key", "_bucket").orderBy("_order", *ties).rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("_bucket", bucket_of(F.col("_order"))).withColumn("_within", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return within.join(starts, ["_key", "_bucket"]).withColumn(total, F.col("_start") + F.col("_within")).drop("_start", "_within", "_bucket", "_sum")


#: Words of 64 bits in the filter of ``thinned``; bounds what is broadcast.
FILTER_WORDS = 1 << 18


def maybe_among(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, name: str = "_maybe") -> DataFrame:
    """``rows`` with the boolean ``name``: true for every row whose ``key`` is among ``wanted``, and for some others.

    The filter has FILTER_WORDS words at most, whatever the tables, and is broadcast. The more keys
    are wanted, the more others pass. Keys are compared by hash.
    """
    word = lambda k: F.pmod(F.shiftrightunsigned(F.xxhash64(k), 6), F.lit(FILTER_WORDS))
    bit = lambda k: F.xxhash64(k).bitwiseAND(63).cast("int")
    bits = wanted.groupBy(word(wanted_key).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(wanted_key))).alias("_bits"))
    found = rows.join(F.broadcast(bits), word(key) == F.col("_word"), "left")
    held = F.call_function("shiftrightunsigned", F.col("_bits"), bit(key)).bitwiseAND(1) == 1
    return found.withColumn(name, F.coalesce(held, F.lit(False))).drop("_word", "_bits")


def thinned(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not among ``wanted`` (see ``maybe_among``): it spares a join that decides the moving of rows which can't match."""
    return maybe_among(rows, key, wanted, wanted_key).where("_maybe").drop("_maybe")
