"""The driver's tables in the roles that the operators expect, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as generated pairs: a user's events span a window, each event is a piece of evidence."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("person_id"), F.to_date("ts").alias("evidence"), "event_type", "props")
    spans = events.groupBy("person_id").agg(F.min("evidence").alias("start_date"), F.max("evidence").alias("end_date"))
    kind = F.col("event_type")
    return events.join(spans, "person_id").select(
        "event_id", "person_id", F.lit(0).alias("window_index"), "start_date", "end_date", kind.alias("instruction"), F.col("props").alias("response"), "evidence",
        F.lit(None).cast("string").alias("error"), F.concat_ws("_", F.col("person_id").cast("string"), kind).alias("source_file"),
    )


#: Positioned pairs (with event_id) in SQL.
FACTS_SQL = """e AS (SELECT event_id, user_id AS person_id, CAST(ts AS DATE) AS evidence, event_type, props FROM events),
sp AS (SELECT person_id, min(evidence) AS start_date, max(evidence) AS end_date FROM e GROUP BY person_id),
facts AS (SELECT event_id, person_id, 0 AS window_index, start_date, end_date, event_type AS instruction, props AS response, evidence,
                 greatest(least(date_diff('day', start_date, evidence) / CAST(date_diff('day', start_date, end_date) AS DOUBLE), 1.0), 0.0) AS relative_position,
                 person_id || '_' || event_type AS source_file
          FROM e JOIN sp USING (person_id) WHERE start_date <> end_date)"""


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as visits of customers to suppliers."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("visit_date"))
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(key.alias("visit_id"), F.col("o_custkey").alias("person_id"), F.col("l_suppkey").alias("provider_id"), "visit_date")


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as providers whose specialty is their nation; CANADA plays the part of 'Unknown'."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    named = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return named.select(F.col("s_suppkey").alias("provider_id"), F.when(F.col("n_name") == "CANADA", F.lit("Unknown")).otherwise(F.col("n_name")).alias("specialty"))


VISITS_SQL = """v AS (SELECT l_orderkey || '-' || l_linenumber AS visit_id, o_custkey AS person_id, l_suppkey AS provider_id, CAST(o_orderdate AS DATE) AS visit_date
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT s_suppkey AS provider_id, CASE WHEN n_name = 'CANADA' THEN 'Unknown' ELSE n_name END AS specialty
          FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey)"""


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as timelines: a turn is a visit."""
    turns = table(spark, sf_dir, "conversations")
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.col("turn").cast("int"))
    return turns.select(F.col("conv_id").alias("person_id"), F.col("turn").alias("visit"), day.alias("visit_date"), F.coalesce("text", F.lit("")).alias("text"))


#: Timelines in SQL, with the count of tokens n.
TIMELINE_SQL = r"""t AS (SELECT conv_id AS person_id, turn AS visit, DATE '2020-01-01' + CAST(turn AS INTEGER) AS visit_date, coalesce(text, '') AS text,
          CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS n FROM conversations)"""


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent user and assistant turns as (pair_id, person_id, instruction, response)."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    asked, told = turns.where("role = 'user'").alias("q"), turns.where("role = 'assistant'").alias("a")
    both = asked.join(told, (F.col("q.conv_id") == F.col("a.conv_id")) & (F.col("q.turn") + 1 == F.col("a.turn")))
    return both.select(F.concat_ws("-", F.col("q.conv_id").cast("string"), F.col("q.turn").cast("string")).alias("pair_id"), F.col("q.conv_id").alias("person_id"), F.col("q.text").alias("instruction"), F.col("a.text").alias("response"))


QA_SQL = """qa AS (SELECT q.conv_id || '-' || q.turn AS pair_id, q.conv_id AS person_id, q.text AS instruction, a.text AS response
          FROM conversations q JOIN conversations a ON q.conv_id = a.conv_id AND q.turn + 1 = a.turn WHERE q.role = 'user' AND a.role = 'assistant')"""
