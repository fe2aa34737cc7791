"""Resumable work: batch passes over what is left, and a stream that commits each result once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from chronoloom.operators.dedup import unprocessed
from chronoloom.streaming.manifest import Results


def done_so_far(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Results committed below ``path``, or an empty table of the columns of ``like``."""
    return Results(spark, path, like).done()


def failed_so_far(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Failures that were kept beside the results."""
    return Results(spark, path, like).failed()


def resume(rows: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], path: str) -> int:
    """Works on the rows whose key has no result below ``path`` and commits theirs; returns how many were left.

    Where results have an ``error``, rows with one are no results: they are tried again the next
    time. Work is done once, written, and counts with the manifest that names it (see ``Results``).
    """
    return Results(rows.sparkSession, path, work(rows.limit(0))).add(rows, key, work)


def repeat_until_done(rows: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], path: str, passes: int = 30) -> int:
    """Passes of ``resume`` until nothing is left; returns how many rows still are after the last pass."""
    for _ in range(passes):
        if resume(rows, key, work, path) == 0:
            return 0
    return unprocessed(rows, done_so_far(rows.sparkSession, path, work(rows.limit(0))), key).count()


def stream_results(source: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, event_time: str | None = None, expiry: str = "1 day") -> StreamingQuery:
    """A stream that commits one result for each key it meets.

    With ``event_time`` the stream remembers the keys of ``expiry`` only, by the watermark of that
    column; without, it remembers every key. Either way a batch works only on keys without a
    committed result, and its attempt bears the batch's number, so a batch that is repeated after a
    failure changes nothing if it was committed and is done again if it was not.
    """
    spark = source.sparkSession
    shape = work(spark.createDataFrame([], source.schema))

    def write(batch: DataFrame, number: int) -> None:
        results = Results(batch.sparkSession, path, shape)
        version, name = results.version(), f"batch-{number}"
        if name in results.attempts(version):
            return
        left = unprocessed(batch, results.done(version), key)
        results.commit(results.write(work(left), name), key, version)

    once = source.withWatermark(event_time, expiry).dropDuplicatesWithinWatermark([key]) if event_time else source.dropDuplicates([key])
    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
