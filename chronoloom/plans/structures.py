"""Queries of node tables, filters on nested markup, and subword tokenizers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions import text as tx
from chronoloom.operators import trees, windows
from chronoloom.plans.tables import table, timeline

#: Two levels of elements and attributes' values decide: encounters and their groups go, small codes go, whole visits of one kind go.
NESTED = {"@parent": "visit", "@exclude_children": ["enc", "grp"], "visit": {"kind": {"$ne": 2}}, "code": {"value": {"$gte": 20}}}
LAST_NOTES = {"@parent": "visit", "@include_children": ["NOTE"], "@last": 2}


def nested_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one XML record per user: visits hold encounters by type, these a group of codes with even ids and the other codes; notes stand behind the encounters."""
    day = F.to_date("ts")
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("person_id"), day.alias("day"), "event_type", F.floor(F.coalesce("value", F.lit(0.0))).cast("long").alias("v"))
    made = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    code, note = made('<code id="', F.col("event_id"), '" value="', F.col("v"), '"/>'), made('<note id="', F.col("event_id"), '">seen &amp; noted</note>')
    rows = events.select("person_id", "day", "event_type", "event_id", (F.col("event_id") % 3 == 0).alias("note"), (F.col("event_id") % 2 == 0).alias("grouped"), code.alias("code"), note.alias("text"))
    told = lambda test, what: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("event_id", F.col(what).alias("x"))))), lambda e: e["x"]), "")
    kinds = rows.groupBy("person_id", "day", "event_type").agg(
        told(~F.col("note") & F.col("grouped"), "code").alias("in_group"), told(~F.col("note") & ~F.col("grouped"), "code").alias("beside"), F.collect_list(F.when(F.col("note"), F.struct("event_id", F.col("text").alias("x")))).alias("notes")
    )
    group = F.when(F.col("in_group") != "", made("<grp>", F.col("in_group"), "</grp>")).otherwise(F.lit(""))
    enc = F.when((F.col("in_group") != "") | (F.col("beside") != ""), made('<enc type="', F.col("event_type"), '">', group, F.col("beside"), "</enc>")).otherwise(F.lit(""))
    days = kinds.groupBy("person_id", "day").agg(F.array_sort(F.collect_list(F.struct("event_type", enc.alias("x")))).alias("e"), F.array_sort(F.flatten(F.collect_list("notes"))).alias("n"))
    text = lambda rows: F.array_join(F.transform(rows, lambda e: e["x"]), "")
    visit = made('<visit start="', F.date_format("day", "MM/dd/yyyy"), ' 10:00" kind="', F.dayofmonth("day") % 3, '">', text(F.col("e")), text(F.col("n")), "</visit>")
    lines = days.groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("day", visit.alias("x")))).alias("v"))
    return lines.select("person_id", made("<ehr>", text(F.col("v")), "</ehr>").alias("text"))


def nested_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trees.filter_trees(nested_timelines(spark, sf_dir), NESTED)
    return found.select("person_id", F.col("visit").cast("long").alias("visit"), F.md5("text").alias("text"))


def notes_of_last_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trees.filter_trees(nested_timelines(spark, sf_dir), LAST_NOTES)
    return found.select("person_id", F.col("visit").cast("long").alias("visit"), F.md5("text").alias("text"))


def nodes_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes below each person's encounters, at any depth, and how deep nodes lie."""
    rows = trees.node_rows(nested_timelines(spark, sf_dir))
    codes = trees.below(rows, "person_id", F.col("tag") == "enc", F.col("tag") == "code").groupBy("person_id").agg(F.count(F.lit(1)).alias("codes"))
    deep = rows.groupBy("person_id").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").cast("long").alias("deepest"), F.sum(F.col("last") - F.col("node")).cast("long").alias("below"))
    return deep.join(codes, "person_id", "left").select("person_id", "nodes", "deepest", "below", F.coalesce("codes", F.lit(0)).cast("long").alias("codes"))


def subword_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as ids and back, and whether counts tell the ids."""
    bpe = tx.tokenizer_named("bpe")
    coded = table(spark, sf_dir, "documents").select("doc_id", bpe.ids(F.col("text")).alias("ids"), bpe.count(F.col("text")).alias("n"))
    return coded.select("doc_id", F.md5(bpe.text(F.col("ids"))).alias("text"), (F.size("ids") == F.col("n")).alias("counted"))


def subword_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timelines packed by subwords: every visit is in a window, and a window of several visits fits."""
    packed = windows.pack_windows(timeline(spark, sf_dir), 300, 0.0, tokenizer="bpe")
    fits = F.bool_and((F.col("visit_tokens") <= 300) | (F.col("visits") == 1))
    return packed.groupBy("person_id").agg(F.sum("visits").alias("visits"), fits.alias("fits"), F.min("start_date").cast("string").alias("start_date"), F.max("end_date").cast("string").alias("end_date"))


QUERIES = {f.__name__: f for f in (nested_filter, notes_of_last_visits, nodes_below, subword_round_trip, subword_windows)}

_EVENTS = """WITH e AS (SELECT event_id, user_id AS person_id, CAST(ts AS DATE) AS day, event_type, CAST(floor(coalesce(value, 0)) AS BIGINT) AS v, event_id % 3 = 0 AS note, event_id % 2 = 0 AS grouped FROM events),
d AS (SELECT DISTINCT person_id, day FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY day) - 1 AS visit FROM d)"""
_CODE, _NOTE = """'<code id="' || event_id || '" value="' || v || '"/>'""", """'<note id="' || event_id || '">seen &amp; noted</note>'"""
_START = """'<visit start="' || strftime(day, '%m/%d/%Y') || ' 10:00" kind="' || day(day) % 3 || '">'"""

ORACLES = {
    # Notes keep their place; codes follow by the encounter that they stood in, those beside its group first.
    "nested_filter": f"""{_EVENTS}, k AS (SELECT person_id, day, string_agg(CASE WHEN note THEN {_NOTE} ELSE {_CODE} END, '' ORDER BY note DESC, CASE WHEN note THEN '' ELSE event_type END, NOT note AND grouped, event_id) AS x
FROM e WHERE (note OR v >= 20) AND day(day) % 3 <> 2 GROUP BY person_id, day)
SELECT person_id, visit, md5({_START} || x || '</visit>') AS text FROM k JOIN n USING (person_id, day)""",
    "notes_of_last_visits": f"""{_EVENTS}, k AS (SELECT person_id, day, string_agg({_NOTE}, '' ORDER BY event_id) AS x FROM e WHERE note GROUP BY person_id, day)
SELECT person_id, visit, md5({_START} || x || '</visit>') AS text FROM k JOIN n USING (person_id, day) QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY day DESC) <= 2""",
    # Below each node: its descendants, so every node counts once for each node above it.
    "nodes_below": f"""{_EVENTS}, k AS (SELECT person_id, count(*) AS events, count(*) FILTER (NOT note) AS codes, count(*) FILTER (NOT note AND grouped) AS grouped, count(*) FILTER (note) AS notes,
count(DISTINCT (day, event_type)) FILTER (NOT note) AS encs, count(DISTINCT (day, event_type)) FILTER (NOT note AND grouped) AS grps, count(DISTINCT day) AS days FROM e GROUP BY person_id)
SELECT person_id, 1 + days + encs + grps + events AS nodes, CAST(CASE WHEN grouped > 0 THEN 4 WHEN codes > 0 THEN 3 ELSE 2 END AS BIGINT) AS deepest,
CAST(days + 2 * (encs + notes) + 3 * (grps + codes - grouped) + 4 * grouped AS BIGINT) AS below, codes FROM k""",
    "subword_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS text, true AS counted FROM documents",
    "subword_windows": """SELECT conv_id AS person_id, CAST(count(*) AS BIGINT) AS visits, true AS fits, CAST(DATE '2020-01-01' + CAST(min(turn) AS INTEGER) AS VARCHAR) AS start_date, CAST(DATE '2020-01-01' + CAST(max(turn) AS INTEGER) AS VARCHAR) AS end_date
FROM conversations GROUP BY conv_id""",
}
