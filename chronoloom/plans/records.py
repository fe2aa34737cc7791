"""Queries of text parsing, markup, model calls and training rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions import text as tx
from chronoloom.functions.binning import half_open_bin
from chronoloom.functions.order import shuffle_sql
from chronoloom.operators import calls, compose, dedup, judge, markup, retrieval, selection, training
from chronoloom.plans.tables import FACTS_SQL, QA_SQL, qa_pairs, table
from chronoloom.plans.temporal import _facts

TEMPLATE = "Context: {context} Question: {question} (100% of it)"


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and answer turns written the ways that generated text writes them."""
    pairs = qa_pairs(spark, sf_dir).select("pair_id", *[F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9 ]+", " ")).alias(c) for c in ("instruction", "response")])
    q, a = F.concat(F.lit("say "), F.col("instruction")), F.concat(F.lit("well "), F.col("response"))
    form = F.crc32(F.col("pair_id").cast("binary")) % 3
    said = lambda ask, tell: F.concat(F.lit(ask), q, F.lit(tell), a)
    written = F.when(form == 0, said("Instruction: ", "\r\nResponse: ")).when(form == 1, said("**Instruction 1:** ", "\n\n**Response 1:** ")).otherwise(said("Question: ", "\nAnswer: "))
    return pairs.select("pair_id", F.concat(written, F.lit("\n\nSAFETY_HAZARD none")).alias("content"))


def parse_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _generated(spark, sf_dir).select("pair_id", F.explode(tx.parse_pairs(F.col("content"))).alias("p"))
    return parsed.select("pair_id", "p.instruction", "p.response")


def sanitized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = qa_pairs(spark, sf_dir)
    raw = F.concat(F.lit(" *SAFETY_HAZARD "), F.coalesce("instruction", F.lit("")), F.lit("\n\n**"), F.coalesce("response", F.lit("")), F.lit("**\r\nend \n"))
    return pairs.select("pair_id", F.md5(tx.plain(tx.unix_newlines(tx.without_safety_block(raw)))).alias("digest"))


def prompt_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = qa_pairs(spark, sf_dir)
    filled = tx.fill(TEMPLATE, context=F.col("response"), question=F.col("instruction"))
    return pairs.select("pair_id", F.md5(filled).alias("prompt"), tx.token_count(filled).cast("long").alias("tokens"))


def guarded_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = qa_pairs(spark, sf_dir)
    contexts = pairs.select("pair_id", F.col("response").alias("context"))
    made = retrieval.prompts(pairs.select("pair_id", F.coalesce("instruction", F.lit("")).alias("instruction")), contexts.fillna(""), "pair_id", TEMPLATE)
    return made.select("pair_id", F.md5("prompt").alias("prompt"))


def visit_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    written = F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "M/d/yyyy H:mm")).when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm")).when(F.col("event_id") % 4 == 2, F.date_format("ts", "MM/dd/yyyy hh:mm a")).otherwise(F.lit("13/40/2020 10:00"))
    return events.select("event_id", tx.visit_date(written).cast("string").alias("day"), F.date_format(tx.visit_time(written), "yyyy-MM-dd HH:mm").alias("minute"))


def evidence_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    written = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "MM/dd/yyyy")).otherwise(F.concat(F.date_format("ts", "MM/dd/yyyy"), F.lit(" 12:00 AM")))
    return events.select("event_id", tx.evidence_date(written).cast("string").alias("day"))


def _props(name: str) -> Column:
    return F.get_json_object("props", f"$.{name}")


def nested_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", tx.score(_props("k")).alias("score"), _props("missing").alias("missing"))


def _timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as one XML timeline per user: a visit per day, with codes and notes."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("person_id"), F.to_date("ts").alias("day"), "event_type", "value")
    code = F.concat(F.lit('<code id="'), F.col("event_id").cast("string"), F.lit('" value="'), F.floor(F.coalesce("value", F.lit(0.0))).cast("long").cast("string"), F.lit('" type="'), F.col("event_type"), F.lit('"/>'))
    note = F.concat(F.lit('<note id="'), F.col("event_id").cast("string"), F.lit('" type="'), F.col("event_type"), F.lit('">seen &amp; noted</note>'))
    element = F.when(F.col("event_id") % 3 == 0, note).otherwise(code)
    days = events.select("person_id", "day", "event_id", element.alias("x")).groupBy("person_id", "day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "x"))), lambda e: e["x"]), "").alias("x"))
    visit = F.concat(F.lit('<visit start="'), F.date_format("day", "MM/dd/yyyy"), F.lit(' 10:00">'), F.col("x"), F.lit("</visit>"))
    lines = days.select("person_id", F.struct("day", visit.alias("v")).alias("v")).groupBy("person_id").agg(F.array_sort(F.collect_list("v")).alias("v"))
    return lines.select("person_id", F.concat(F.lit("<ehr>"), F.array_join(F.transform("v", lambda v: v["v"]), ""), F.lit("</ehr>")).alias("text"))


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _timelines(spark, sf_dir).select("person_id", F.posexplode(markup.visit_strings(F.col("text"))).alias("visit", "markup"))
    return cut.select("person_id", "visit", tx.visit_date(markup.start_attribute(F.col("markup"))).cast("string").alias("day"), markup.events_of(F.col("markup")).alias("events"))


def visits_from_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visits(spark, sf_dir).select("person_id", F.col("visit").cast("long").alias("visit"), "day", F.size("events").cast("long").alias("events"))


def _event_ids(visits: DataFrame) -> DataFrame:
    return visits.select("person_id", F.explode("events").alias("e")).select("person_id", F.try_element_at("e.attributes", F.lit("id")).cast("long").alias("event_id"), F.col("e.tag").alias("tag"))


def notes_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_ids(markup.filter_preset(_visits(spark, sf_dir), notes_only=True))


def codes_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_ids(markup.filter_preset(_visits(spark, sf_dir), codes_only=True))


def attribute_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    conditions = {"value": {"$gte": 20, "$lt": 60}, "type": {"$nin": ["error", "view"]}}
    return _event_ids(markup.filter_visits(_visits(spark, sf_dir), conditions=conditions))


def first_two_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = markup.filter_visits(_visits(spark, sf_dir), include=["CO"], first=2)
    return kept.select("person_id", "day", F.size("events").cast("long").alias("events"))


def removed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _timelines(spark, sf_dir).withColumn("text", markup.remove_nodes(F.col("text"), "note"))
    return out.select("person_id", F.regexp_count("text", F.lit("<note")).cast("long").alias("notes"), F.regexp_count("text", F.lit("<code")).cast("long").alias("codes"))


def promoted_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _timelines(spark, sf_dir).withColumn("text", markup.remove_nodes(F.col("text"), "visit", True))
    return out.select("person_id", F.regexp_count("text", F.lit("<visit")).cast("long").alias("visits"), F.regexp_count("text", F.lit("<(?:code|note)")).cast("long").alias("events"))


def stub_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = qa_pairs(spark, sf_dir).select("pair_id", F.coalesce("instruction", F.lit("")).alias("prompt"))
    replies = calls.generate_batches(prompts, "pair_id", lambda: lambda texts: [calls.stub_model(t) for t in texts], size=16, in_flight=2)
    scored = replies.withColumn("s", judge.repaired_scores(F.col("response")))
    return scored.select("pair_id", "s.correctness", "s.completeness", tx.verdict(F.col("response")).alias("verdict"))


def masked_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = qa_pairs(spark, sf_dir).select("pair_id", training.masked_example(F.coalesce("instruction", F.lit("")), F.coalesce("response", F.lit(""))).alias("e"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return pairs.select("pair_id", F.size("e.input_ids").cast("long").alias("length"), total(F.col("e.input_ids")).alias("ids"), total(F.col("e.labels")).alias("labels"), total(F.col("e.attention_mask")).alias("mask"))


def training_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("sum up").alias("instruction"), F.col("text").alias("input"), F.lit("done so").alias("output"))
    rows = training.training_rows(docs, "Do {instruction} with {input}", 64)
    return rows.select("id", F.size("example.input_ids").cast("long").alias("length"), F.size(F.filter("example.labels", lambda x: x != training.IGNORED)).cast("long").alias("learned"))


def epoch_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("epoch"), F.col("l_discount").alias("loss"))
    return training.epoch_figures(steps).select("epoch", F.round("loss", 9).alias("loss"), F.round("perplexity", 9).alias("perplexity"))


def call_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = training.throughput(table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("seconds")))
    return found.select("samples", F.round("total_seconds", 6).alias("total_seconds"), F.round("seconds_per_sample", 9).alias("seconds_per_sample"))


def held_out_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.dataset_part(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "validation")


def instruction_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = selection.nested_by_window(_facts(spark, sf_dir))
    return dedup.instruction_ids(nested).select("person_id", "instruction_id", F.col("position").cast("long").alias("position"), "item.instruction", "item.evidence")


def reference_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = "transform(response_data, p -> named_struct('instruction', p.instruction, 'response', p.response, 'evidence', p.evidence, 'error', CAST(NULL AS STRING)))"
    nested = selection.nested_by_window(_facts(spark, sf_dir)).withColumn("response_data", F.expr(data))
    return dedup.reference_rows(nested).select("instruction_id", "filename", "question", "clinician_response", "evidence", "annotator_num")


def _instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _timelines(spark, sf_dir).select("person_id")
    return asked.select(F.col("person_id").alias("instruction_id"), "person_id", F.concat(F.lit("type=\"purchase\">seen &amp; person "), F.col("person_id").cast("string")).alias("instruction"))


def rag_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of the most relevant visits; those of the 13th of a month have a start time that can't be read."""
    odd = _timelines(spark, sf_dir).withColumn("text", F.regexp_replace("text", r'start="(\d\d)/13/(\d{4})', 'start="$1/43/$2'))
    made = compose.pack_prompts(_instructions(spark, sf_dir), odd, "{ehr} {question}", 400, retrieve=True)
    return made.select("instruction_id", F.md5("prompt").alias("prompt"))


def packed_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = compose.pack_prompts(_instructions(spark, sf_dir), _timelines(spark, sf_dir), "{ehr} {question}", 400)
    return made.select("instruction_id", tx.token_count(F.col("prompt")).cast("long").alias("tokens"), F.md5("prompt").alias("prompt"))


def evaluation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = compose.evaluation_windows(_timelines(spark, sf_dir), 120, "{ehr} {ehr}")
    dates = [F.col(c).cast("string").alias(c) for c in ("start_date", "end_date")]
    return made.select("person_id", "visits", "tokens", *dates, F.md5("text").alias("text"), "percent_full", F.md5("prompt").alias("prompt"))


def value_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.col("l_discount") * 10
    return table(spark, sf_dir, "lineitem").groupBy(half_open_bin(share).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    parse_pairs, sanitized_text, prompt_fill, guarded_prompts, visit_dates, evidence_dates, nested_scores, visits_from_markup, notes_only, codes_only, attribute_filter, first_two_visits,
    removed_nodes, promoted_children, stub_generation, masked_labels, training_examples, epoch_figures, call_throughput, held_out_part, value_bins,
    instruction_ids, reference_answers, rag_prompts, packed_prompts, evaluation_windows,
)}

_CLEAN = "trim(regexp_replace(coalesce({}, ''), '[^A-Za-z0-9 ]+', ' ', 'g'))"
_SAID = f"WITH {QA_SQL}, s AS (SELECT pair_id, trim('say ' || {_CLEAN.format('instruction')}) AS q, trim('well ' || {_CLEAN.format('response')}) AS a, 'say ' || {_CLEAN.format('instruction')} AS q0, 'well ' || {_CLEAN.format('response')} AS a0 FROM qa)"
_FILLED = "'Context: ' || coalesce(response, '') || ' Question: ' || coalesce(instruction, '') || ' (100% of it)'"
_VISITS = """WITH e AS (SELECT event_id, user_id AS person_id, CAST(ts AS DATE) AS day, event_type, CAST(floor(coalesce(value, 0)) AS BIGINT) AS v, event_id % 3 = 0 AS note FROM events)"""
#: The timelines' visits as XML, with their tokens.
_XML = rf"""{_VISITS},
x AS (SELECT person_id, day, event_id, CASE WHEN note THEN '<note id="' || event_id || '" type="' || event_type || '">seen &amp; noted</note>'
                                            ELSE '<code id="' || event_id || '" value="' || v || '" type="' || event_type || '"/>' END AS x FROM e),
d AS (SELECT person_id, day, '<visit start="' || strftime(day, '%m/%d/%Y') || ' 10:00">' || string_agg(x, '' ORDER BY event_id) || '</visit>' AS text FROM x GROUP BY person_id, day),
t AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY day) - 1 AS visit, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS n FROM d)"""
_ASKED = "q AS (SELECT DISTINCT person_id, 'type=\"purchase\">seen &amp; person ' || person_id AS instruction FROM t)"
_IDS = r"[CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % 32000 for t in regexp_extract_all(coalesce({}, ''), '[^ \t\n\x0B\f\r]+')]"

_IDS_SQL = f"""WITH {FACTS_SQL}, d AS (SELECT person_id, instruction, response, strftime(evidence, '%m/%d/%Y') AS evidence FROM facts),
n AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY instruction, response, evidence) - 1 AS position FROM d),
i AS (SELECT *, CAST('0x' || substr(md5(CAST(person_id AS VARCHAR)), 1, 8) AS BIGINT) % 8000000 + 1000000 + position AS instruction_id FROM n)"""

def _relevant(budget: int, source: str = "t", readable: str = "true") -> str:
    """The SQL of each person's visits most relevant to the instruction, up to a budget, as words in order of time (k), beside the instructions (q)."""
    return rf"""{_XML}, {_ASKED},
w AS (SELECT person_id, visit, day, text, n, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS w FROM {source}),
sz AS (SELECT person_id, count(*) AS docs, avg(n) AS mean FROM w GROUP BY person_id),
tf AS (SELECT person_id, visit, term, count(*) AS tf FROM (SELECT person_id, visit, unnest(w) AS term FROM w) GROUP BY ALL),
df AS (SELECT person_id, term, count(*) AS df FROM tf GROUP BY ALL),
ri AS (SELECT person_id, term, ln(docs - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM df JOIN sz USING (person_id)),
fl AS (SELECT person_id, avg(idf) * 0.25 AS floor FROM ri GROUP BY person_id),
i AS (SELECT person_id, term, CASE WHEN idf < 0 THEN floor ELSE idf END AS idf FROM ri JOIN fl USING (person_id)),
a AS (SELECT person_id, unnest(regexp_extract_all(instruction, '[^ \t\n\x0B\f\r]+')) AS term FROM q),
h AS (SELECT person_id, visit, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))) AS score FROM a JOIN i USING (person_id, term) JOIN tf USING (person_id, term) JOIN w USING (person_id, visit) JOIN sz USING (person_id) GROUP BY ALL),
s AS (SELECT w.*, coalesce(score, 0.0) AS score FROM w LEFT JOIN h USING (person_id, visit)),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY person_id ORDER BY round(score, 9) DESC, visit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s WHERE {readable}),
k AS (SELECT person_id, regexp_extract_all(string_agg(text, chr(10) ORDER BY day, visit), '[^ \t\n\x0B\f\r]+') AS kept FROM b WHERE before <= {budget} GROUP BY person_id)"""


ORACLES = {
    "parse_pairs": f"{_SAID} SELECT pair_id, q AS instruction, a AS response FROM s",
    "sanitized_text": rf"""WITH {QA_SQL}, h AS (SELECT pair_id, ' *SAFETY_HAZARD ' || coalesce(instruction, '') || chr(10) || chr(10) || '**' || coalesce(response, '') || '**' || chr(13) || chr(10) || 'end ' || chr(10) AS x FROM qa),
c AS (SELECT pair_id, ' *' || substr(x, position(chr(10) || chr(10) IN x)) AS x FROM h)
SELECT pair_id, md5(regexp_replace(replace(replace(replace(x, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '*', ''), '^\s+|\s+$', '', 'g')) AS digest FROM c""",
    "prompt_fill": rf"WITH {QA_SQL}, f AS (SELECT pair_id, {_FILLED} AS p FROM qa) SELECT pair_id, md5(p) AS prompt, CAST(len(regexp_extract_all(p, '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS tokens FROM f",
    "guarded_prompts": f"WITH {QA_SQL} SELECT pair_id, md5({_FILLED}) AS prompt FROM qa",
    "visit_dates": """SELECT event_id, CASE WHEN event_id % 4 < 3 THEN strftime(ts, '%Y-%m-%d') END AS day,
       CASE WHEN event_id % 4 IN (0, 2) THEN strftime(ts, '%Y-%m-%d %H:%M') END AS minute FROM events""",
    "evidence_dates": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') END AS day FROM events",
    "nested_scores": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS missing FROM events",
    "visits_from_markup": f"{_VISITS}, d AS (SELECT person_id, day, count(*) AS events FROM e GROUP BY ALL) SELECT person_id, row_number() OVER (PARTITION BY person_id ORDER BY day) - 1 AS visit, CAST(day AS VARCHAR) AS day, events FROM d",
    "notes_only": f"{_VISITS} SELECT person_id, event_id, 'note' AS tag FROM e WHERE note",
    "codes_only": f"{_VISITS} SELECT person_id, event_id, 'code' AS tag FROM e WHERE NOT note",
    "attribute_filter": f"{_VISITS} SELECT person_id, event_id, 'code' AS tag FROM e WHERE NOT note AND v >= 20 AND v < 60 AND event_type NOT IN ('error', 'view')",
    "first_two_visits": f"{_VISITS}, d AS (SELECT person_id, day, count(*) AS events FROM e WHERE NOT note GROUP BY ALL) SELECT person_id, CAST(day AS VARCHAR) AS day, events FROM d QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY day) <= 2",
    "removed_nodes": f"{_VISITS} SELECT person_id, CAST(0 AS BIGINT) AS notes, count(*) FILTER (NOT note) AS codes FROM e GROUP BY person_id",
    "promoted_children": f"{_VISITS} SELECT person_id, CAST(0 AS BIGINT) AS visits, count(*) AS events FROM e GROUP BY person_id",
    "stub_generation": f"""WITH {QA_SQL}, n AS (SELECT pair_id, CAST('0x' || substr(md5(coalesce(instruction, '')), 1, 8) AS BIGINT) AS n FROM qa)
SELECT pair_id, CAST(n % 2 AS DOUBLE) AS correctness, CAST(n // 2 % 2 AS DOUBLE) AS completeness, ['win', 'loss', 'tie'][n % 3 + 1] AS verdict FROM n""",
    "masked_labels": f"""WITH {QA_SQL}, i AS (SELECT pair_id, {_IDS.format('instruction')} AS p, {_IDS.format('response')} AS a FROM qa)
SELECT pair_id, CAST(len(p) + len(a) AS BIGINT) AS length, CAST(coalesce(list_sum(p), 0) + coalesce(list_sum(a), 0) AS BIGINT) AS ids,
       CAST(len(p) * -100 + coalesce(list_sum(a), 0) AS BIGINT) AS labels, CAST(len(p) + len(a) AS BIGINT) AS mask FROM i""",
    "training_examples": r"""WITH d AS (SELECT doc_id AS id, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS n FROM documents)
SELECT id, CAST(2 + 2 + least(n, 64 - 4 - 2 - 2) + 2 AS BIGINT) AS length, CAST(2 AS BIGINT) AS learned FROM d""",
    "epoch_figures": "SELECT l_linenumber AS epoch, round(avg(l_discount), 9) AS loss, round(exp(avg(l_discount)), 9) AS perplexity FROM lineitem GROUP BY l_linenumber",
    "call_throughput": "SELECT count(*) AS samples, round(sum(l_quantity), 6) AS total_seconds, round(avg(l_quantity), 9) AS seconds_per_sample FROM lineitem",
    "held_out_part": f"""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY {shuffle_sql('o_orderkey', seed=42)}, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT o_orderkey FROM o WHERE i >= floor(n * 0.8::DOUBLE) AND i < floor(n * 0.8::DOUBLE) + floor(n * 0.2::DOUBLE)""",
    "instruction_ids": f"""{_IDS_SQL} SELECT person_id, instruction_id, position, instruction, evidence FROM i""",
    "reference_answers": f"""{_IDS_SQL} SELECT instruction_id, 'EHR_' || person_id || '.xml' AS filename, instruction AS question, response AS clinician_response, evidence, 'Annotator_1' AS annotator_num FROM i WHERE instruction <> '' AND response <> ''""",
    # 400 less 256 for the answer, 2 for the template and 4 for the instruction are left for the record.
    "packed_prompts": rf"""{_XML}, {_ASKED}, w AS (SELECT person_id, regexp_extract_all(string_agg(text, chr(10) ORDER BY day), '[^ \t\n\x0B\f\r]+') AS w FROM t GROUP BY person_id)
SELECT person_id AS instruction_id, CAST(least(len(w), 138) + 4 AS BIGINT) AS tokens, md5(array_to_string(w[greatest(len(w) - 138, 0) + 1:], ' ') || ' ' || instruction) AS prompt FROM w JOIN q USING (person_id)""",
    "evaluation_windows": f"""{_XML}, s AS (SELECT *, sum(n) OVER (PARTITION BY person_id ORDER BY day DESC ROWS UNBOUNDED PRECEDING) AS total FROM t),
g AS (SELECT person_id, count(*) AS visits, CAST(sum(n) AS BIGINT) AS tokens, CAST(min(day) AS VARCHAR) AS start_date, CAST(max(day) AS VARCHAR) AS end_date,
             '<patient>' || chr(10) || string_agg(text || chr(10), '' ORDER BY visit DESC) || '</patient>' AS text FROM s WHERE total <= 120 GROUP BY person_id HAVING count(*) >= 3)
SELECT person_id, visits, tokens, start_date, end_date, md5(text) AS text, tokens * 100.0::DOUBLE / 120 AS percent_full, md5(text || ' ' || text) AS prompt FROM g""",
    # 400 less 256 for the answer, 2 for the template and 4 for the instruction are left for the visits.
    "rag_prompts": _relevant(138, r"""(SELECT * REPLACE (regexp_replace(text, 'start="(\d\d)/13/(\d{4})', 'start="\1/43/\2') AS text) FROM t)""", "day(day) <> 13") + r"""
SELECT person_id AS instruction_id, md5(coalesce(array_to_string(kept[greatest(len(kept) - 138, 0) + 1:], ' '), '') || ' ' || instruction) AS prompt FROM q LEFT JOIN k USING (person_id)""",
    "value_bins": "SELECT " + " + ".join(f"CAST(l_discount * 10 >= {i * 0.1!r}::DOUBLE AS INTEGER)" for i in range(1, 10)) + " AS bin, count(*) AS n FROM lineitem GROUP BY bin",
}
