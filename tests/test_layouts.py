import os

import pytest
from pyspark.sql import functions as F

from chronoloom.sources import catalog, datasource, readers, writers

PLUGIN = """
def rows(config, split, part, parts):
    for k in range(config["n"]):
        if k % parts == part:
            yield {"k": k, "who": f"{split}-{part}"} if k % 2 else (k, f"{split}-{part}")

def broken(config, split, part, parts):
    yield 1 / 0
"""


@pytest.fixture()
def plugin(tmp_path, spark):
    path = tmp_path / "own.py"
    path.write_text(PLUGIN)
    datasource.register(spark)
    return str(path)


def test_a_users_file_is_read_in_parts(spark, plugin):
    read = spark.read.format("plugin").schema("k long, who string").option("config", '{"n": 20}').option("parts", 4)
    rows = read.option("file", plugin).option("split", "test").load()  # options stay with the reader
    got = {r.k: r.who for r in rows.collect()}
    assert got == {k: f"test-{k % 4}" for k in range(20)} and rows.rdd.getNumPartitions() == 4
    assert read.option("file", f"{plugin}:rows").load().where("who = 'test-1'").count() == 5
    for bad in ("own.txt", f"{plugin}:none", "missing.py"):
        with pytest.raises(Exception):
            read.option("file", bad).load().collect()
    with pytest.raises(Exception, match="division"):
        read.option("file", f"{plugin}:broken").load().collect()


def test_a_file_for_each_record(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").cast("string").alias("person_id"), (F.col("id") % 2).alias("window_index"), F.lit("é\n").alias("text")).repartition(5)
    path = str(tmp_path / "out")
    writers.write_record_files(rows, path)
    names = {f for f in os.listdir(path) if not f.startswith((".", "_"))}
    assert names == {f"{k}_{k % 2}.json" for k in range(40)} and os.path.exists(f"{path}/_SUCCESS")
    writers.write_record_files(rows.where("person_id = '7'").withColumn("text", F.lit("new")), path)
    back = readers.read_jsonl(spark, path, "person_id string, window_index int, text string")
    assert back.count() == 40 and back.where("text = 'new'").count() == 1
    writers.write_xml_files(spark.createDataFrame([(1, "<a><b/></a>"), (2, "<a")], "person_id long, text string"), str(tmp_path / "xml"))
    assert [(r.patient_id, r.text) for r in readers.read_numbered_xml(spark, str(tmp_path / "xml")).collect()] == [(1, "<a>\n  <b />\n</a>")]


def test_a_failed_job_leaves_no_drafts(spark, tmp_path):
    path = str(tmp_path / "out")
    bad = spark.createDataFrame([(f"f{k}", "x") for k in range(6)] + [("a/b", "x")], "name string, value string").repartition(3)
    with pytest.raises(Exception, match="no file name"):
        writers.write_files(bad, path)
    left = [f for f in os.listdir(path) if f.startswith("_")] if os.path.exists(path) else []
    assert left == [] or left == ["_drafts"] or not any("SUCCESS" in f for f in left)


def test_xml_or_empty(spark, tmp_path):
    writers.write_files(spark.createDataFrame([("a.xml", "<?xml version='1.0'?>\n<!-- c --><r>é<b/></r>"), ("b.xml", "<r>"), ("c.xml", " ")], "name string, value string"), str(tmp_path / "x"))
    assert {r.file: r.text for r in readers.read_xml_or_empty(spark, str(tmp_path / "x")).collect()} == {"a.xml": "<r>é<b /></r>", "b.xml": "", "c.xml": ""}


@pytest.fixture(scope="module")
def laid_out(spark):
    visits = spark.range(500).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("visit_id"), (F.col("id") % 40).alias("person_id"), (F.col("id") % 23).alias("provider_id"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 90).cast("int")).alias("visit_date"))
    providers = spark.range(20).select(F.col("id").alias("provider_id"), F.when(F.col("id") == 3, "Unknown").when(F.col("id") == 4, " ").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("specialty"))
    catalog.lay_out(visits, providers.unionByName(providers.limit(2)), "laid", buckets=4)
    yield visits, providers
    catalog.drop(spark, "laid")


def test_the_join_of_laid_out_tables_moves_nothing(spark, laid_out):
    assert catalog.buckets_of(spark, "laid_visits") == catalog.buckets_of(spark, "laid_providers") == 4
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        known = catalog.cohort(spark, catalog.KNOWN, "laid")
        known.collect()
        assert catalog.moved(known) == 0
        visits, providers = laid_out
        plain = visits.join(providers.where("specialty NOT IN ('Unknown', ' ')"), "provider_id").select("visit_id", "person_id", "visit_date", "specialty")
        assert sorted(map(tuple, known.collect())) == sorted(map(tuple, plain.collect()))
        assert catalog.moved(plain) > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_cohort_queries(spark, laid_out):
    largest = catalog.cohort(spark, catalog.LARGEST, "laid", strata=3).collect()
    assert len(largest) == 3 and largest[0].n >= largest[1].n >= largest[2].n
    chosen = catalog.cohort(spark, catalog.STRATIFIED, "laid", strata=3, quota=7, seed="x").collect()
    assert len(chosen) == 21 and {r.specialty for r in chosen} == {r.specialty for r in largest}
    import datetime

    latest = catalog.cohort(spark, catalog.LATEST, "laid", day=datetime.date(2020, 2, 1)).collect()
    assert 0 < len(latest) <= 40 and len({r.person_id for r in latest}) == len(latest)
