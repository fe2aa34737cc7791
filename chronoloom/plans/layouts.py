"""Queries of batch sampling, tables laid out by key, and data sources, with their SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions import text as tx
from chronoloom.functions.order import shuffle_sql
from chronoloom.operators import markup, training
from chronoloom.plans import records
from chronoloom.plans.files import _folder
from chronoloom.plans.tables import QA_SQL, VISITS_SQL, providers, qa_pairs, table, visits
from chronoloom.sources import catalog, datasource, readers, writers

#: Rows of a batch, and replicas that batches are dealt to.
SIZE, REPLICAS = 16, 3
PLUGIN = os.path.join(os.path.dirname(os.path.abspath(__file__)), "own_rows.py")


def _batches(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return training.length_batches(docs, tx.token_count(F.col("text")), "doc_id", SIZE, REPLICAS, **how)


def length_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir)


def shuffled_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir, shuffled=True)


def learning_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate at which each document is learned, by its batch's step."""
    found = training.scheduled(_batches(spark, sf_dir), 3, 1e-3, 1e-5)
    return found.select("doc_id", "replica", "step", F.round("rate", 12).alias("rate"))


def laid_out_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of the largest specialties, by SQL over bucketed tables of the catalog."""
    prefix = f"cohort_{uuid.uuid4().hex}"
    catalog.lay_out(visits(spark, sf_dir), providers(spark, sf_dir), prefix, buckets=8)
    path = _folder(spark, "sample")
    catalog.cohort(spark, catalog.STRATIFIED, prefix, strata=5, quota=20, seed="0").write.parquet(path)
    catalog.drop(spark, prefix)
    return spark.read.parquet(path)


def plugin_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs from a user's file as a data source, in parts."""
    path = _folder(spark, "pairs")
    qa_pairs(spark, sf_dir).select("pair_id", "instruction", "response").repartition(6).write.parquet(path)
    datasource.register(spark)
    reader = spark.read.format("plugin").schema("pair_id string, words long, split string")
    read = lambda split: reader.option("file", f"{PLUGIN}:pairs").option("config", f'{{"path": "{path}"}}').option("split", split).option("parts", 4).load()
    return read("train").unionByName(read("test"))


def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file <person>_<window>.json a record, read back by name."""
    people = records._timelines(spark, sf_dir).select(F.col("person_id").cast("string").alias("person_id"), (F.col("person_id") % 3).cast("int").alias("window_index"), F.md5("text").alias("instruction"))
    path = _folder(spark, "records")
    pairs = F.array(F.struct("instruction", F.lit("r").alias("response")))
    writers.write_record_files(people.select("person_id", "window_index", pairs.alias("response_data")), path)
    back, _ = readers.read_json_files(spark, path)
    return back.select("file", "person_id", "window_index", F.get("response_data", F.lit(0))["instruction"].alias("instruction"))


def numbered_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XML files by the number in their name; others are passed over."""
    people = records._timelines(spark, sf_dir)
    path = _folder(spark, "numbered")
    name = F.when(F.col("person_id") % 4 == 0, F.lit("other_")).otherwise(F.lit("EHR_"))
    writers.write_files(people.select(F.concat(name, F.col("person_id").cast("string"), F.lit(".xml")).alias("name"), F.col("text").alias("value")), path)
    return readers.read_numbered_xml(spark, path).select("patient_id", F.md5("text").alias("text"))


def xml_or_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XML files, of which every third is cut short and so becomes ''."""
    people = records._timelines(spark, sf_dir)
    path = _folder(spark, "broken")
    value = F.when(F.col("person_id") % 3 == 0, F.expr("left(text, length(text) - 3)")).otherwise(F.concat(F.lit("<?xml version='1.0'?>\n"), F.col("text")))
    writers.write_files(people.select(F.concat(F.col("person_id").cast("string"), F.lit(".xml")).alias("name"), value.alias("value")), path)
    return readers.read_xml_or_empty(spark, path).select(F.split_part("file", F.lit("."), F.lit(1)).cast("long").alias("person_id"), F.md5("text").alias("text"))


def templated_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each person's pretty record in a template that was read from a file."""
    template = readers.read_template(os.path.join(os.path.dirname(PLUGIN), "template.txt"))
    people = records._timelines(spark, sf_dir).withColumn("pretty", markup.pretty_xml(F.col("text")))
    return people.select("person_id", F.md5(tx.fill(template, ehr=F.col("pretty"), question=F.col("person_id"))).alias("prompt"))


QUERIES = {f.__name__: f for f in (length_batches, shuffled_batches, learning_rates, laid_out_sample, plugin_rows, record_files, numbered_xml, xml_or_empty, templated_prompts)}

_BATCHES = rf"""WITH d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS n FROM documents),
o AS (SELECT doc_id, row_number() OVER (ORDER BY n, {shuffle_sql('doc_id')}, doc_id) - 1 AS i, count(*) OVER () AS total FROM d),
b AS (SELECT doc_id, i // {SIZE} AS batch, CAST(i % {SIZE} AS INTEGER) AS place, total // {SIZE} // {REPLICAS} * {REPLICAS} AS batches FROM o),
k AS (SELECT * FROM b WHERE batch < batches),
t AS (SELECT batch, row_number() OVER (ORDER BY {shuffle_sql('batch', seed='batch 0')}, batch) - 1 AS turn FROM (SELECT DISTINCT batch FROM k))"""
_PRETTY = """'<ehr>' || chr(10) || string_agg('  ' || replace(replace(replace(x, '><', '>' || chr(10) || '    <'), chr(10) || '    </visit>', chr(10) || '  </visit>'), '/>', ' />') || chr(10), '' ORDER BY day) || '</ehr>'"""

ORACLES = {
    "length_batches": f"{_BATCHES} SELECT CAST(batch % {REPLICAS} AS INTEGER) AS replica, batch // {REPLICAS} AS step, batch, place, doc_id FROM k",
    "shuffled_batches": f"{_BATCHES} SELECT CAST(turn % {REPLICAS} AS INTEGER) AS replica, turn // {REPLICAS} AS step, batch, place, doc_id FROM k JOIN t USING (batch)",
    "learning_rates": f"""{_BATCHES}, s AS (SELECT doc_id, CAST(batch % {REPLICAS} AS INTEGER) AS replica, batch // {REPLICAS} AS step, max(batch // {REPLICAS}) OVER () AS last FROM k)
SELECT doc_id, replica, step, round(CASE WHEN step < 3 THEN 1e-3 * step / 3 ELSE 1e-5 + (1e-3 - 1e-5) * (cos(pi() * (step - 3) / greatest(1, last - 3)) + 1) / 2 END, 12) AS rate FROM s""",
    "laid_out_sample": f"""WITH {VISITS_SQL}, k AS (SELECT visit_id, person_id, specialty FROM v JOIN p USING (provider_id) WHERE lower(trim(specialty)) NOT IN ('', 'unknown')),
g AS (SELECT specialty FROM k GROUP BY specialty ORDER BY count(*) DESC, specialty LIMIT 5)
SELECT visit_id, person_id, specialty FROM k JOIN g USING (specialty) QUALIFY row_number() OVER (PARTITION BY specialty ORDER BY md5(visit_id || '|0'), visit_id) <= 20""",
    "plugin_rows": rf"""WITH {QA_SQL}, w AS (SELECT pair_id, CAST(coalesce(len(regexp_extract_all(instruction, '[^ \t\n\x0B\f\r]+')), 0) AS BIGINT) AS words FROM qa)
SELECT pair_id, words, CASE WHEN words % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM w""",
    "record_files": f"""{records._XML} SELECT person_id || '_' || person_id % 3 || '.json' AS file, CAST(person_id AS VARCHAR) AS person_id, CAST(person_id % 3 AS INTEGER) AS window_index, md5('<ehr>' || string_agg(text, '' ORDER BY day) || '</ehr>') AS instruction
FROM t GROUP BY person_id""",
    "numbered_xml": f"{records._XML} SELECT person_id AS patient_id, md5('<ehr>' || string_agg(text, '' ORDER BY day) || '</ehr>') AS text FROM t WHERE person_id % 4 <> 0 GROUP BY person_id",
    "xml_or_empty": f"{records._XML} SELECT person_id, md5(CASE WHEN person_id % 3 = 0 THEN '' ELSE '<ehr>' || replace(string_agg(text, '' ORDER BY day), '/>', ' />') || '</ehr>' END) AS text FROM t GROUP BY person_id",
    "templated_prompts": f"{records._XML}, v AS (SELECT person_id, day, text AS x FROM t) SELECT person_id, md5('Record:' || chr(10) || {_PRETTY} || chr(10) || 'Question {{1}}: ' || person_id || chr(10)) AS prompt FROM v GROUP BY person_id",
}
