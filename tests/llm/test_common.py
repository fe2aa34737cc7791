from pyspark.sql import functions as F


from chronoloom.llm import common


def test_running_totals_equal_a_plain_sum(spark):
    rows = spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "cold").otherwise("hot").alias("_key"), (F.col("id") % 11).alias("v"), common.spread(F.col("id")).alias("_order"))
    starts = common.bucket_starts(common.bucket_sums(rows, F.col("v")))
    got = common.running_totals(rows, starts, F.col("v"), [F.col("k")], "total").collect()
    assert len(got) == 5000
    for key in ("hot", "cold"):
        total = 0
        for r in sorted((r for r in got if r._key == key), key=lambda r: (r._order, r.k)):
            assert r.total == total
            total += r.v


def test_buckets_ascend_and_cover(spark):
    edge = [-(1 << 63), -1, 0, 1, (1 << 63) - 1]
    rows = spark.createDataFrame([(e,) for e in edge], "x long").select("x", common.bucket_of(F.col("x"), 16).alias("b")).orderBy("x").collect()
    assert [r.b for r in rows] == [0, 7, 8, 8, 15]


def test_written_tables_keep_types(spark):
    rows = spark.createDataFrame([(1, None), (None, "x")], "a long, b string")
    back = common.write_table(rows, "t")
    assert back.dtypes == rows.dtypes and sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    assert common.write_table(rows.limit(0), "t").count() == 0


def test_scratch_folder_comes_from_the_session(spark):
    assert common.scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_let_computes_once(spark):
    assert spark.range(1).select(common.let(F.lit(3), lambda x: x * x + x)).first()[0] == 12
    assert spark.range(1).select(F.size(common.words_of(F.lit("a b \x0bc\td\n")))).first()[0] == 3
    assert spark.range(1).select(F.size(common.words_of(F.lit(None).cast("string")))).first()[0] == 0


def test_thinning_keeps_what_is_wanted(spark):
    rows, wanted = spark.range(20_000).withColumn("v", F.col("id") % 7), spark.range(0, 20_000, 50)
    left = common.thinned(rows, F.col("id"), wanted, F.col("id"))
    ids = {r.id for r in left.collect()}
    assert left.columns == rows.columns and {r.id for r in wanted.collect()} <= ids and len(ids) < 2000
    assert common.thinned(rows, F.col("id"), wanted.limit(0), F.col("id")).count() == 0


def test_tables_of_blocks_are_read_a_few_blocks_at_a_time(spark):
    import pyarrow.parquet as pq

    from chronoloom.llm.blocks import WIDE_ROWS

    wide = spark.range(0, 40, numPartitions=1).select("id", F.transform(F.sequence(F.lit(1), F.lit(1 << 17)), lambda x: F.xxhash64(x, "id")).alias("items"))
    table = common.write_table(wide, "wide", **WIDE_ROWS)
    (file,) = table.inputFiles()
    held = pq.ParquetFile(file.removeprefix("file:").replace("///", "/")).metadata
    sizes = [held.row_group(i).total_byte_size for i in range(held.num_row_groups)]
    assert held.num_rows == 40 and held.num_row_groups > 3 and max(sizes) < 1 << 24
    assert table.agg(F.sum("id"), F.sum(F.size("items"))).first()[:] == (780, 40 << 17)
