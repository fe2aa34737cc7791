import threading

import pytest
from pyspark.sql import functions as F

from chronoloom.streaming import incremental
from chronoloom.streaming.manifest import Lost, Results, latest_failures

SHAPE = "k long, response string, error string"


def rows(spark, *found):
    return spark.createDataFrame([(k, None if e else f"r{k}", e) for k, e in found], SHAPE)


@pytest.fixture()
def results(spark, tmp_path):
    return Results(spark, f"file://{tmp_path}/r", rows(spark))


def work(todo):
    return todo.select("k", F.concat(F.lit("r"), F.col("k").cast("string")).alias("response"), F.when(F.col("k") % 10 == 9, F.lit("bad")).alias("error"))


def keys(frame):
    return sorted(r.k for r in frame.collect())


def test_failures_are_kept_and_tried_again(spark, results):
    todo = spark.range(20).withColumnRenamed("id", "k")
    assert results.done().count() == 0 and results.version() == 0
    assert results.add(todo, "k", work) == 20
    assert keys(results.done()) == [k for k in range(20) if k % 10 != 9] and keys(results.failed()) == [9, 19]
    assert {r.k: r.error for r in latest_failures(results, "k").collect()} == {9: "bad", 19: "bad"}
    fixed = lambda t: work(t).withColumn("error", F.lit(None).cast("string"))
    assert results.add(todo, "k", fixed) == 2 and results.add(todo, "k", fixed) == 0
    assert keys(results.done()) == list(range(20)) and latest_failures(results, "k").count() == 0


def test_a_crash_before_the_commit_leaves_neither_doubles_nor_gaps(spark, results):
    todo = spark.range(12).withColumnRenamed("id", "k")
    # Both halves are worked out and written, the second run ends before its manifest.
    results.add(todo.where("k < 6"), "k", work)
    results.write(work(todo.where("k >= 6")))
    assert keys(results.done()) == list(range(6))
    assert results.add(todo, "k", work) == 6
    assert keys(results.done()) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 11] and keys(results.failed()) == [9]
    assert results.sweep() == 1 and results.sweep() == 0 and results.done().count() == 11


def test_two_runs_at_once_give_each_key_once(spark, results):
    first = results.write(rows(spark, (1, None), (2, None), (3, "x")))
    second = results.write(rows(spark, (2, None), (3, None), (4, None)))
    results.commit(first, "k", 0)
    results.commit(second, "k", 0)  # both began from nothing
    assert keys(results.done()) == [1, 2, 3, 4] and results.version() == 2
    results.commit(first, "k", 2)
    assert results.version() == 2
    with pytest.raises(Lost):
        results.publish(2, [])


def test_threads_race(spark, results):
    todo = spark.range(30).withColumnRenamed("id", "k")
    failures = []

    def run(low):
        try:
            results.add(todo.where(f"k >= {low} AND k < {low + 20}"), "k", lambda t: work(t).withColumn("error", F.lit(None).cast("string")))
        except Exception as failure:
            failures.append(failure)

    threads = [threading.Thread(target=run, args=(low,)) for low in (0, 5, 10)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failures and keys(results.done()) == list(range(30))


def test_stream_with_keys_that_expire(spark, tmp_path):
    source = lambda: spark.readStream.schema("k long, at timestamp").parquet(str(tmp_path / "in"))
    day = lambda k, d: (k, d)
    write = lambda found: spark.createDataFrame(found, "k long, d string").select("k", F.to_timestamp("d").alias("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    work = lambda t: t.select("k", F.col("at").cast("string").alias("v"))
    run = lambda: incremental.stream_results(source(), "k", work, str(tmp_path / "out"), str(tmp_path / "cp"), "at", "1 day").awaitTermination()
    write([day(1, "2020-01-01"), day(1, "2020-01-01"), day(2, "2020-01-01")])
    run()
    write([day(3, "2020-03-01"), day(2, "2020-03-01")])  # the state knows 2 no longer, the results do
    run()
    run()
    got = incremental.done_so_far(spark, str(tmp_path / "out"), spark.createDataFrame([], "k long, v string"))
    assert keys(got) == [1, 2, 3]
