"""Queries of context windows and truncation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import windows
from chronoloom.plans.tables import TIMELINE_SQL, table, timeline

#: Token budget of the queries.
BUDGET = 120


def _text_dates(rows: DataFrame) -> DataFrame:
    """Dates as text, and long texts as their digest."""
    changed = {c: F.col(c).cast("string") for c, kind in rows.dtypes if kind == "date"}
    return rows.withColumns(changed | ({"text": F.md5("text")} if "text" in rows.columns else {}))


def pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_dates(windows.pack_windows(timeline(spark, sf_dir), BUDGET))


def pack_windows_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_dates(windows.pack_windows(timeline(spark, sf_dir), BUDGET, 0.0))


def eval_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_dates(windows.newest_that_fit(timeline(spark, sf_dir), BUDGET * 2))


def last_five_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_dates(windows.context_windows(timeline(spark, sf_dir), "last_five"))


def full_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_dates(windows.context_windows(timeline(spark, sf_dir), "full"))


def suffix_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.trailing_children(timeline(spark, sf_dir), BUDGET)


def trim_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("what came last").alias("instruction"))
    cut = windows.tail_truncate(docs, 300, 64, "Read the record and answer")
    return cut.select("doc_id", F.col("budget").cast("long").alias("budget"), F.md5("kept").alias("kept"))


QUERIES = {f.__name__: f for f in (pack_windows, pack_windows_all, eval_window, last_five_window, full_window, suffix_fit, trim_tail)}

#: A window as a record: newest visit first, each on a line.
_RECORD = "'<patient>' || chr(10) || string_agg(text || chr(10), '' ORDER BY visit {}) || '</patient>'"
_TOKENS = r"CAST(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS BIGINT)"
#: Walks each timeline from its newest visit back, carrying the open window and its sum.
_PACKED = f"""WITH RECURSIVE {TIMELINE_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY visit DESC) AS i FROM t),
w AS (SELECT person_id, visit, visit_date, text, n, i, 0 AS window_index, n AS total FROM o WHERE i = 1
      UNION ALL
      SELECT o.person_id, o.visit, o.visit_date, o.text, o.n, o.i,
             CASE WHEN w.total + o.n > {BUDGET} THEN w.window_index + 1 ELSE w.window_index END,
             CASE WHEN w.total + o.n > {BUDGET} THEN o.n ELSE w.total + o.n END
      FROM w JOIN o ON o.person_id = w.person_id AND o.i = w.i + 1),
g AS (SELECT person_id, window_index, count(*) AS visits, CAST(sum(n) AS BIGINT) AS visit_tokens, CAST(min(visit_date) AS VARCHAR) AS start_date, CAST(max(visit_date) AS VARCHAR) AS end_date,
             {_RECORD.format("DESC")} AS text, max(window_index) OVER (PARTITION BY person_id) AS last
      FROM w GROUP BY person_id, window_index)
SELECT person_id, window_index, visits, visit_tokens, start_date, end_date, md5(text) AS text, {_TOKENS} AS tokens, {_TOKENS} * 100.0::DOUBLE / {BUDGET} AS percent_full FROM g"""

_FIT = "SELECT *, CAST(sum(n) OVER (PARTITION BY person_id ORDER BY visit DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total, row_number() OVER (PARTITION BY person_id ORDER BY visit DESC) AS i FROM t"
_ONE = "person_id, count(*) AS visits, CAST(min(visit_date) AS VARCHAR) AS start_date, CAST(max(visit_date) AS VARCHAR) AS end_date"
_WHOLE = f"SELECT person_id, visits, start_date, end_date, md5(text) AS text, {_TOKENS} AS tokens, 100.0::DOUBLE AS percent_full, 0 AS window_index FROM g"

ORACLES = {
    "pack_windows": f"{_PACKED} WHERE window_index < last OR last = 0 OR visit_tokens >= {BUDGET * 0.5}",
    "pack_windows_all": _PACKED,
    "eval_window": f"""WITH {TIMELINE_SQL}, s AS ({_FIT}) SELECT {_ONE}, CAST(sum(n) AS BIGINT) AS tokens, md5({_RECORD.format("DESC")}) AS text, CAST(sum(n) AS BIGINT) * 100.0::DOUBLE / {BUDGET * 2} AS percent_full
FROM s WHERE total <= {BUDGET * 2} GROUP BY person_id HAVING count(*) >= 3""",
    "last_five_window": f"WITH {TIMELINE_SQL}, s AS ({_FIT}), g AS (SELECT {_ONE}, {_RECORD.format('')} AS text FROM s WHERE i <= 5 GROUP BY person_id) {_WHOLE}",
    "full_window": f"WITH {TIMELINE_SQL}, g AS (SELECT {_ONE}, {_RECORD.format('')} AS text FROM t GROUP BY person_id) {_WHOLE}",
    "suffix_fit": f"WITH {TIMELINE_SQL}, s AS ({_FIT}) SELECT person_id, visit, n, total AS kept_tokens FROM s WHERE total <= {BUDGET}",
    "trim_tail": r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents)
SELECT doc_id, CAST(300 - 64 - 5 - 3 AS BIGINT) AS budget, md5(array_to_string(w[greatest(len(w) - 228, 0) + 1:], ' ')) AS kept FROM d""",
}
