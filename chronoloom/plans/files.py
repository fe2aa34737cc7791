"""Queries that write and read files, or resume and stream, below the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.text import verdict
from chronoloom.operators import calls, dedup, judge, selection
from chronoloom.plans.tables import QA_SQL, qa_pairs, table
from chronoloom.plans.temporal import ORACLES as TEMPORAL
from chronoloom.plans.temporal import _facts
from chronoloom.sources import readers, writers
from chronoloom.sources.scratch import scratch_folder as _folder
from chronoloom.streaming import incremental


def windows_as_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations appended as windowed timelines in two portions, and read back."""
    turns = table(spark, sf_dir, "conversations").select(F.concat(F.lit("u"), F.col("conv_id").cast("string")).alias("uid"), F.col("conv_id").cast("string").alias("person_id"), F.col("turn").cast("int").alias("window_index"), F.coalesce("text", F.lit("")).alias("text"))
    path = _folder(spark, "windows")
    writers.append_windows(turns.where("window_index % 2 = 0"), path, fresh=True)
    writers.append_windows(turns.where("window_index % 2 = 1"), path)
    back = readers.read_jsonl(spark, path, readers.WINDOWED)
    return back.select("uid", "person_id", "window_index", F.md5("text").alias("text"))


def merged_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One timeline per person from JSON lines that repeat persons: the first by file and position."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("uid"), (F.col("conv_id") % 40).cast("string").alias("person_id"), F.lit("x").alias("text"))
    path = _folder(spark, "timelines")
    turns.repartition(8, "person_id").sortWithinPartitions("uid").write.json(path)  # a person's lines are in one file
    return dedup.keep_first(readers.read_jsonl(spark, path), "person_id", ["file", "position"]).select("uid", "person_id")


def responses_by_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected pairs nested by person and window, written as JSON by person, read and counted."""
    nested = selection.nested_by_window(_facts(spark, sf_dir))
    path = _folder(spark, "responses")
    writers.write_responses(nested, path)
    back = spark.read.schema(f"person_id long, window_index int, response_data {readers.PAIRS}").json(path)
    return back.select("person_id", "window_index", F.size(dedup.valid_pairs(F.col("response_data"))).cast("long").alias("pairs"))


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with newlines, quotes and commas through CSV."""
    pairs = qa_pairs(spark, sf_dir).select("pair_id", F.concat(F.lit('a "q", '), F.col("instruction"), F.lit("\nend")).alias("question"))
    path = _folder(spark, "csv")
    writers.write_csv(pairs, path)
    return readers.read_csv(spark, path, ["pair_id", "question"]).select("pair_id", F.md5("question").alias("question"))


def resumed_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a model, half of them from an earlier run."""
    prompts = qa_pairs(spark, sf_dir).select("pair_id", F.coalesce("instruction", F.lit("")).alias("prompt"))
    path = _folder(spark, "replies")
    work = lambda rows: calls.generate(rows, "pair_id", calls.Registry().get("stub")).select("pair_id", "response")
    incremental.resume(prompts.where("length(prompt) % 2 = 0"), "pair_id", work, path)
    incremental.repeat_until_done(prompts, "pair_id", work, path)
    scored = incremental.done_so_far(spark, path, work(prompts.limit(0))).withColumn("s", judge.repaired_scores(F.col("response")))
    return scored.select("pair_id", "s.correctness", "s.completeness", verdict(F.col("response")).alias("verdict"))


def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream whose batches append each event's day once."""
    shape = table(spark, sf_dir, "events").schema
    path = _folder(spark, "stream")
    source = spark.readStream.schema(shape).option("pathGlobFilter", "*.parquet").parquet(_as_folder(spark, sf_dir)).withColumn("ts", F.col("ts").cast("timestamp"))
    work = lambda rows: rows.select("event_id", F.to_date("ts").cast("string").alias("day"))
    incremental.stream_results(source, "event_id", work, path, _folder(spark, "offsets"), event_time="ts", expiry="2 days").awaitTermination()
    return incremental.done_so_far(spark, path, work(table(spark, sf_dir, "events").limit(0))).select("event_id", "day")


def _as_folder(spark: SparkSession, sf_dir: str) -> str:
    """The events below a folder of their own, as a file source watches folders."""
    path = _folder(spark, "events")
    table(spark, sf_dir, "events").write.parquet(path)
    return path


QUERIES = {f.__name__: f for f in (windows_as_jsonl, merged_timelines, responses_by_person, csv_round_trip, resumed_generation, streamed_events)}

ORACLES = {
    "windows_as_jsonl": "SELECT 'u' || conv_id AS uid, CAST(conv_id AS VARCHAR) AS person_id, CAST(turn AS INTEGER) AS window_index, md5(coalesce(text, '')) AS text FROM conversations",
    "merged_timelines": "SELECT min(conv_id || '-' || turn) AS uid, CAST(conv_id % 40 AS VARCHAR) AS person_id FROM conversations GROUP BY conv_id % 40",
    "responses_by_person": TEMPORAL["position_facts"].rpartition("SELECT")[0] + "SELECT person_id, window_index, count(*) AS pairs FROM facts GROUP BY ALL",
    "csv_round_trip": f"""WITH {QA_SQL} SELECT pair_id, md5('a "q", ' || instruction || chr(10) || 'end') AS question FROM qa""",
    "resumed_generation": f"""WITH {QA_SQL}, n AS (SELECT pair_id, CAST('0x' || substr(md5(coalesce(instruction, '')), 1, 8) AS BIGINT) AS n FROM qa)
SELECT pair_id, CAST(n % 2 AS DOUBLE) AS correctness, CAST(n // 2 % 2 AS DOUBLE) AS completeness, ['win', 'loss', 'tie'][n % 3 + 1] AS verdict FROM n""",
    "streamed_events": "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events",
}
