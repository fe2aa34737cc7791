"""Queries of temporal selection and sampling, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.binning import edges_sql
from chronoloom.functions.order import shuffle_sql
from chronoloom.operators import sampling, selection
from chronoloom.plans.tables import FACTS_SQL, VISITS_SQL, providers, raw_pairs, table, visits

N = 500


def _dates_as_text(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("string") for c, kind in rows.dtypes if kind == "date"})


_KEEP = ["event_id", "person_id", "source_file", "relative_position"]


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.positioned(raw_pairs(spark, sf_dir), keep=["event_id"])


def position_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates_as_text(selection.positioned(raw_pairs(spark, sf_dir)))


def temporal_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.per_bin(_facts(spark, sf_dir), 50, "event_id").select(*_KEEP, "bin")


def recency_last25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.recent(_facts(spark, sf_dir), N, "event_id", strict=False).select(*_KEEP)


def recency_last10_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    cohort = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("person_id"))
    return selection.recent(_facts(spark, sf_dir), N, "event_id", 0.9, cohort=cohort, strict=False).select(*_KEEP)


def span_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.whole_span(_facts(spark, sf_dir), N * 2, "event_id").select(*_KEEP)


def edge_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.both_edges(_facts(spark, sf_dir), N, "event_id").select(*_KEEP)


def balanced_with_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.balanced_with_coverage(_facts(spark, sf_dir), N, "event_id").select(*_KEEP, "bin")


def uniform_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.uniform_bins(_facts(spark, sf_dir), 30, "event_id").select(*_KEEP, "bin")


def bin_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.bin_histogram(_facts(spark, sf_dir))


def bin_uniformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selection.uniformity(selection.bin_histogram(_facts(spark, sf_dir)))
    return found.select(F.round("cv", 9).alias("cv"), "least")


def nested_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = selection.nested_by_window(_facts(spark, sf_dir))
    flat = F.array_join(F.transform("response_data", lambda p: F.concat_ws("~", p["instruction"], p["response"], p["evidence"])), ";")
    return _dates_as_text(nested).select("person_id", "window_index", "start_date", "end_date", F.size("response_data").cast("long").alias("pairs"), F.md5(flat).alias("digest"))


def selection_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir)
    return selection.sampling_log(facts, selection.per_bin(facts, 50, "event_id"), "balanced_100", bins=10)


def selection_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir)
    late, early = facts.where("relative_position >= 0.9").select("person_id"), facts.where("relative_position <= 0.1").select("person_id")
    return late.intersect(early)


def value_equal_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir).select(*selection.PAIR)
    return selection.minus_equal_rows(facts, facts.where("relative_position >= 0.75")).groupBy("person_id").agg(F.count(F.lit(1)).alias("n"))


def iid_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.iid_sample(table(spark, sf_dir, "orders"), "o_custkey", 200)


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sampling.stratified_sample(visits(spark, sf_dir), providers(spark, sf_dir), 200, 20)
    return found.select("visit_id", "person_id", "specialty", F.col("rank").cast("int").alias("rank"))


def top_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = visits(spark, sf_dir).join(providers(spark, sf_dir), "provider_id", "left").where(sampling.valid_label(F.col("specialty")))
    return sampling.top_groups(known, "specialty", 10)


def latest_valid_specialty(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"))
    return sampling.latest_valid_label(people, visits(spark, sf_dir), providers(spark, sf_dir))


def exact_k_per_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.exact_per_person(_facts(spark, sf_dir), 100, 4, "event_id").select("event_id", "person_id")


def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return sampling.split(orders, "o_orderkey").select("o_orderkey", "partition")


def nested_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return sampling.nested_samples(orders, [10, 100, 1000], "o_orderkey").select("size", "o_orderkey")


QUERIES = {f.__name__: f for f in (
    position_facts, temporal_balanced, recency_last25, recency_last10_cohort, span_coverage, edge_coverage, balanced_with_coverage, uniform_benchmark, bin_histogram, bin_uniformity,
    nested_save, selection_log, selection_overlap, value_equal_antijoin, iid_sample, stratified_sample, top_strata, latest_valid_specialty, exact_k_per_person, train_test_split, nested_sizes,
)}

_PAIR = ", ".join(selection.PAIR)
_TEXT = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" if c.endswith("_date") or c == "evidence" else c for c in selection.PAIR)
_COLS = ", ".join(_KEEP)


def _cover(where: str, n: int, seed: int = 0) -> str:
    same = " AND ".join(f"f.{c} IS NOT DISTINCT FROM c.{c}" for c in selection.PAIR)
    return f"""WITH {FACTS_SQL},
f AS (SELECT * FROM facts WHERE {where}),
c AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY {shuffle_sql('event_id', seed=seed)}, event_id) = 1),
r AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM c WHERE {same})),
b AS (SELECT *, 0 AS fill FROM c UNION ALL SELECT *, 1 AS fill FROM r),
o AS (SELECT * FROM b ORDER BY fill, {shuffle_sql('event_id', seed=seed + 1)}, event_id LIMIT {n})
SELECT {_COLS} FROM c UNION ALL SELECT {_COLS} FROM o WHERE fill = 1"""


_HALF, _RIGHT = edges_sql("relative_position", 10, ">="), edges_sql("relative_position", 10, ">")
_HISTOGRAM = f"""WITH {FACTS_SQL},
c AS (SELECT {_RIGHT} AS bin, count(*) AS n FROM facts GROUP BY 1),
h AS (SELECT CAST(r.range AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(10) r LEFT JOIN c ON c.bin = r.range)"""

_SAME = " AND ".join(f"f.{c} IS NOT DISTINCT FROM c.{c}" for c in selection.PAIR)
#: Sources take their turns one after the other; ``fill`` counts the rows of each bin so far.
_BALANCED = f"""WITH RECURSIVE {FACTS_SQL},
f AS (SELECT *, {_HALF} AS bin, {shuffle_sql('event_id')} AS o FROM facts),
firsts AS (SELECT source_file, bin, min((o, event_id)) AS place FROM f GROUP BY ALL),
held AS (SELECT source_file, list(bin ORDER BY place) AS held FROM firsts GROUP BY source_file),
turn AS (SELECT *, row_number() OVER (ORDER BY {shuffle_sql('source_file')}, source_file) AS i FROM held),
walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS source_file, CAST(NULL AS INTEGER) AS bin, [0 FOR x IN range(10)] AS fill
         UNION ALL
         SELECT i, source_file, bin, [CASE WHEN j - 1 = bin THEN fill[j] + 1 ELSE fill[j] END FOR j IN range(1, 11)]
         FROM (SELECT turn.i, turn.source_file, fill, [b FOR b IN turn.held IF fill[b + 1] < {N // 10}] AS open,
                      open[list_position([fill[b + 1] FOR b IN open], list_min([fill[b + 1] FOR b IN open]))] AS bin
               FROM walk JOIN turn ON turn.i = walk.i + 1 WHERE list_min(fill) < {N // 10})),
c AS (SELECT f.* FROM f JOIN walk USING (source_file, bin) QUALIFY row_number() OVER (PARTITION BY source_file, bin ORDER BY o, event_id) = 1),
r AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM c WHERE {_SAME})),
b AS (SELECT *, 0 AS late FROM c UNION ALL SELECT *, 1 AS late FROM r)
SELECT {_COLS}, bin FROM b QUALIFY row_number() OVER (PARTITION BY bin ORDER BY late, o, event_id) <= {N // 10}"""

ORACLES = {
    "balanced_with_coverage": _BALANCED,
    "position_facts": f"WITH {FACTS_SQL} SELECT {_TEXT} FROM facts",
    "temporal_balanced": f"WITH {FACTS_SQL}, b AS (SELECT *, {_HALF} AS bin FROM facts) SELECT {_COLS}, bin FROM b QUALIFY row_number() OVER (PARTITION BY bin ORDER BY {shuffle_sql('event_id')}, event_id) <= 50",
    "recency_last25": _cover("relative_position >= 0.75", N),
    "recency_last10_cohort": _cover("relative_position >= 0.9 AND person_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')", N),
    "span_coverage": _cover("true", N * 2),
    "edge_coverage": _cover("relative_position <= 0.1 OR relative_position >= 0.9", N),
    "uniform_benchmark": f"""WITH {FACTS_SQL},
b AS (SELECT *, {_RIGHT} AS bin, {shuffle_sql('event_id')} AS o FROM facts),
w AS (SELECT *, row_number() OVER (PARTITION BY person_id, bin ORDER BY o, event_id) AS own FROM b)
SELECT {_COLS}, bin FROM w QUALIFY row_number() OVER (PARTITION BY bin ORDER BY own > 1, CASE WHEN own = 1 THEN {shuffle_sql('person_id')} ELSE o END, event_id) <= 30""",
    "bin_histogram": f"{_HISTOGRAM} SELECT bin, n, n * 100.0::DOUBLE / sum(n) OVER () AS percent FROM h",
    "bin_uniformity": f"{_HISTOGRAM} SELECT round(stddev_pop(n) / avg(n), 9) AS cv, min(n) AS least FROM h",
    "nested_save": f"""WITH {FACTS_SQL},
p AS (SELECT *, instruction || '~' || response || '~' || strftime(evidence, '%m/%d/%Y') AS x, strftime(evidence, '%m/%d/%Y') AS d FROM facts)
SELECT person_id, window_index, CAST(min(start_date) AS VARCHAR) AS start_date, CAST(min(end_date) AS VARCHAR) AS end_date, count(*) AS pairs, md5(string_agg(x, ';' ORDER BY instruction, response, d)) AS digest
FROM p GROUP BY person_id, window_index""",
    "selection_log": f"""WITH {FACTS_SQL}, b AS (SELECT *, {_HALF} AS bin FROM facts),
s AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY bin ORDER BY {shuffle_sql('event_id')}, event_id) <= 50)
SELECT 'balanced_100' AS selection_type, (SELECT count(*) FROM facts) AS total_pairs, count(*) AS sampled_pairs, count(DISTINCT person_id) AS persons,
concat_ws(chr(10), {", ".join(f"'Bin {b / 10:.1f}-{(b + 1) / 10:.1f}: ' || count(*) FILTER (bin = {b}) || ' pairs'" for b in range(10))}) AS distribution FROM s""",
    "selection_overlap": f"WITH {FACTS_SQL} SELECT person_id FROM facts WHERE relative_position >= 0.9 INTERSECT SELECT person_id FROM facts WHERE relative_position <= 0.1",
    "value_equal_antijoin": f"WITH {FACTS_SQL} SELECT person_id, count(*) AS n FROM facts WHERE relative_position < 0.75 GROUP BY person_id",
    "iid_sample": f"SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) ORDER BY {shuffle_sql('o_custkey')}, o_custkey LIMIT 200",
    "stratified_sample": f"""WITH {VISITS_SQL},
k AS (SELECT visit_id, person_id, specialty FROM v LEFT JOIN p USING (provider_id) WHERE specialty IS NOT NULL AND specialty <> 'Unknown'),
g AS (SELECT specialty FROM k GROUP BY specialty ORDER BY count(*) DESC, specialty LIMIT 20),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY specialty ORDER BY {shuffle_sql('visit_id')}, visit_id) AS INTEGER) AS rank FROM k JOIN g USING (specialty))
SELECT visit_id, person_id, specialty, rank FROM r WHERE rank <= 10 ORDER BY {shuffle_sql('visit_id', seed='0-all')}, visit_id LIMIT 200""",
    "top_strata": f"""WITH {VISITS_SQL} SELECT specialty, count(*) AS num FROM v LEFT JOIN p USING (provider_id) WHERE lower(specialty) <> 'unknown' AND trim(specialty) <> ''
GROUP BY specialty ORDER BY num DESC, specialty LIMIT 10""",
    "latest_valid_specialty": f"""WITH {VISITS_SQL},
r AS (SELECT * FROM v JOIN p USING (provider_id) WHERE lower(specialty) <> 'unknown' AND trim(specialty) <> ''
      QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY visit_date DESC, visit_id DESC, specialty DESC) = 1)
SELECT c_custkey AS person_id, coalesce(visit_id, 'Unknown') AS visit_id, coalesce(specialty, 'Unknown') AS specialty FROM customer LEFT JOIN r ON c_custkey = person_id""",
    "exact_k_per_person": f"""WITH {FACTS_SQL},
g AS (SELECT person_id FROM facts GROUP BY person_id HAVING count(*) >= 4 ORDER BY {shuffle_sql('person_id')}, person_id LIMIT 25)
SELECT event_id, person_id FROM facts SEMI JOIN g USING (person_id) QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY {shuffle_sql('event_id')}, event_id) <= 4""",
    "train_test_split": f"""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY {shuffle_sql('o_orderkey', seed=42)}, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN i < floor(n * 0.8::DOUBLE) THEN 'train' WHEN i < floor(n * 0.8::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'test' END AS partition FROM o""",
    "nested_sizes": f"""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY {shuffle_sql('o_orderkey')}, o_orderkey) AS i FROM orders)
SELECT s.size, o_orderkey FROM o JOIN (VALUES (10), (100), (1000)) s(size) ON i <= s.size""",
}
