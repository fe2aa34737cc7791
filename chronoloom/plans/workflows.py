"""Queries of whole workflow steps, of files of several kinds, and of small table operations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions import text as tx
from chronoloom.functions.order import shuffle_sql
from chronoloom.operators import calls, compose, dedup, judge, markup, metrics, retrieval, sampling, selection, windows
from chronoloom.plans import files, packing, records, temporal
from chronoloom.plans.tables import FACTS_SQL, QA_SQL, qa_pairs, table, timeline
from chronoloom.sources import readers, writers

JUDGE = "Record {ehr} asked {instruction} said {response} right {reference}"
#: Tokens of the judge's context, of which the record gets what the rest leaves.
CONTEXT = 160


def _stub() -> calls.Model:
    return calls.stub_model


def _fails_at_first() -> calls.Model:
    """A model that is busy the first time it is asked something."""
    asked: set[str] = set()

    def model(prompt: str) -> str:
        if prompt not in asked:
            asked.add(prompt)
            raise calls.Transient("busy")
        return calls.stub_model(prompt)

    return model


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = records._timelines(spark, sf_dir).select("person_id")
    number = F.col("person_id").cast("string")
    return people.select(F.col("person_id").alias("instruction_id"), F.concat(number, F.lit(".xml")).alias("filename"), F.concat(F.lit("what of "), number).alias("instruction"), F.lit("a b").alias("reference_answer"), F.lit("Annotator_1").alias("annotator_num"))


def judged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References judged with the visits that fit; every third response is null, every fifth is missing."""
    people = records._timelines(spark, sf_dir)
    known = people.select(F.concat(F.col("person_id").cast("string"), F.lit(".xml")).alias("filename"), "text")
    said = F.when(F.col("person_id") % 3 != 0, F.concat(F.lit("answer "), F.col("person_id").cast("string")))
    answers = people.where("person_id % 5 <> 0").select(F.col("person_id").alias("instruction_id"), said.alias("model_response"), F.lit(0).alias("position"))
    scored = compose.judge_all(_references(spark, sf_dir), answers, JUDGE, _stub, files._folder(spark, "judged"), records=known, context=CONTEXT)
    return scored.select("instruction_id", "scores.correctness", "scores.completeness")


def compared_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = _references(spark, sf_dir).select("instruction_id", F.col("filename").alias("model_response"), F.lit(0).alias("position"))
    rates = compose.compare_models(_references(spark, sf_dir), answers, answers.withColumn("model_response", F.lit("none")), "{ans1} or {ans2}", _stub, files._folder(spark, "compared"))
    return rates.select("win", "loss", "tie", "total", F.round("win_rate", 9).alias("win_rate"))


def _scored(replies: DataFrame, *keys: str) -> DataFrame:
    return replies.withColumn("s", judge.repaired_scores(F.col("response"))).select(*keys, "s.correctness", "s.completeness")


def generated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = records._timelines(spark, sf_dir)
    persona = people.where("person_id % 2 = 0").select("person_id", F.lit("heart").alias("specialty"))
    return _scored(compose.generate_pairs(people, "Read {ehr} as {specialty}", "last_five", _stub, persona=persona), "person_id", "window_index", "tokens")


def evaluation_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(compose.evaluation_generation(records._timelines(spark, sf_dir), 120, "Sum up {ehr}", _stub), "person_id", "tokens")


def retried_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that are busy at first, tried again after a wait that grows up to a limit."""
    prompts = qa_pairs(spark, sf_dir).select("pair_id", F.coalesce("instruction", F.lit("")).alias("prompt"))
    return _scored(calls.generate(prompts, "pair_id", _fails_at_first, in_flight=8, seconds=60, rate=100_000, attempts=3, delay=0.001), "pair_id")


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned pairs nested as response files hold them, every seventh person's without any pair."""
    data = "transform(response_data, p -> named_struct('instruction', p.instruction, 'response', p.response, 'evidence', p.evidence, 'error', CAST(NULL AS STRING)))"
    nested = selection.nested_by_window(temporal._facts(spark, sf_dir)).withColumn("response_data", F.expr(data))
    emptied = F.when(F.col("person_id") % 7 != 0, F.col("response_data"))
    name = F.concat(F.col("person_id").cast("string"), F.lit("_gen_"), F.col("window_index").cast("string"), F.lit(".json"))
    return nested.withColumn("response_data", emptied).withColumn("file", name)


def inference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = compose.inference_prompts(_responses(spark, sf_dir), records._timelines(spark, sf_dir), 256 + 60, "{ehr} Q {question}")
    return made.select("instruction_id", "patient_id", "instruction", F.md5("prompt").alias("prompt"), tx.token_count(F.col("ehr")).cast("long").alias("ehr_tokens"), "context_length", "generation_length")


def _window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = records._timelines(spark, sf_dir)
    return people.select(F.concat(F.lit("u"), F.col("person_id").cast("string")).alias("uid"), F.col("person_id").cast("string").alias("person_id"), F.lit(0).alias("window_index"), F.md5("text").alias("text"), F.lit(0).alias("position"))


def _text_files(spark: SparkSession, sf_dir: str, prefix: str = "") -> DataFrame:
    """Generated texts as files of persons; every fifth has no pair."""
    texts = records._generated(spark, sf_dir)
    person, turn = F.split_part("pair_id", F.lit("-"), F.lit(1)), F.split_part("pair_id", F.lit("-"), F.lit(2))
    content = F.when(turn.cast("int") % 5 == 4, F.lit("nothing to tell")).otherwise(F.col("content"))
    return texts.select(F.concat(F.lit(prefix), person, F.lit("_turn"), turn, F.lit("_0.txt")).alias("file"), content.alias("content"))


def file_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of generated texts and of response files, by the file's person (none is known for texts)."""
    rows, _ = compose.training_rows_from_files(_text_files(spark, sf_dir), _responses(spark, sf_dir), _window_rows(spark, sf_dir))
    return rows.groupBy("patient_id").agg(F.count(F.lit(1)).alias("pairs"), F.max("input").alias("input"), F.count_distinct("output").alias("outputs"), F.count("input").alias("placed"))


def retrieved_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training examples whose input is what of a person's record is relevant."""
    pairs = records._instructions(spark, sf_dir).join(records._timelines(spark, sf_dir).withColumnRenamed("text", "input"), "person_id").withColumn("output", F.lit("done so"))
    rows = compose.tuning_examples(pairs.drop("instruction_id"), "Do {instruction} with {input}", 100, "train", "person_id", retrieve=True)
    return rows.select("person_id", F.size("example.input_ids").cast("long").alias("length"), F.aggregate("example.input_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"))


def training_rows_by_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose windowed timeline is found by uid and window, and the files without a pair."""
    named = _responses(spark, sf_dir).withColumn("file", F.concat(F.lit("u"), F.col("file")))
    texts = _text_files(spark, sf_dir, "u")
    rows, empty = compose.training_rows_from_files(texts, named, _window_rows(spark, sf_dir), owner="uid")
    found = rows.groupBy(F.col("patient_id").alias("file")).agg(F.max("input").alias("input"))
    return found.where("file IS NOT NULL").unionByName(empty.select("file", F.lit("rejected").alias("input")))


def selections_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = compose.select_all(temporal._facts(spark, sf_dir), temporal.N, "event_id", strict=False)
    named = [rows.select(F.lit(name).alias("selection"), "event_id") for name, rows in chosen.items()]
    return named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3])


def first_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first persons of a JSONL folder, by id."""
    path = files._folder(spark, "persons")
    writers.append_windows(_window_rows(spark, sf_dir), path, fresh=True)
    return readers.read_jsonl(spark, path, readers.WINDOWED, limit=25).select("uid", "person_id", "text")


def json_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON record per file, every fourth broken: records by their person, rejects counted."""
    people = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    data = F.to_json(F.struct(F.col("n_nationkey").cast("string").alias("person_id"), F.lit(0).alias("window_index"), F.array(F.struct(F.col("n_name").alias("instruction"), F.lit("r").alias("response"))).alias("response_data")))
    path = files._folder(spark, "records")
    text = F.when(F.col("n_nationkey") % 4 == 0, F.substring(data, 1, 20)).otherwise(data)
    people.select("n_nationkey", text.alias("value")).repartition(8, "n_nationkey").write.partitionBy("n_nationkey").option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)
    good, bad = readers.read_json_files(spark, path)
    told = good.select(F.col("person_id").alias("person"), F.get("response_data", F.lit(0))["instruction"].alias("instruction"), F.lit(1).cast("long").alias("n"))
    return told.unionByName(bad.agg(F.lit("rejected").alias("person"), F.lit(None).cast("string").alias("instruction"), F.count(F.lit(1)).alias("n")))


def xml_by_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indented XML, a document a person, written and read back without its indents."""
    path = files._folder(spark, "xml")
    writers.write_xml(records._timelines(spark, sf_dir), path)
    back = readers.read_xml(spark, path)
    flat = F.regexp_replace(F.regexp_replace("text", r"\n\s*", ""), " />", "/>")
    return back.select(F.col("person_id").cast("long").alias("person_id"), F.md5(flat).alias("text"))


def whole_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files read whole: how often each content occurs."""
    path = files._folder(spark, "texts")
    said = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("Instruction: q "), F.col("n_name"), F.lit("\nResponse: a")).alias("value"))
    said.repartition(8, "n_nationkey").write.partitionBy("n_nationkey").text(path)
    return readers.read_texts(spark, path).select(F.explode(tx.parse_pairs(F.col("content"))).alias("p")).select("p.instruction", "p.response")


def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows as files that each hold an array, written and read."""
    path = files._folder(spark, "arrays")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("instruction"), F.coalesce("lang", F.lit("")).alias("input"), F.md5(F.coalesce("text", F.lit(""))).alias("output"), F.lit('say "x", [y]\n').alias("patient_id"))
    writers.write_json_arrays(rows.repartition(3), path)
    return readers.read_json_array(spark, path).select("instruction", "input", "output", F.length("patient_id").cast("long").alias("length"))


def quarantined_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files._folder(spark, "quarantine")
    kept = writers.quarantine(_responses(spark, sf_dir).select("file", "response_data"), "response_data", path)
    held = spark.read.schema("file string").json(path)
    return kept.select("file", F.lit("kept").alias("place")).unionByName(held.select("file", F.lit("quarantine").alias("place")))


def written_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two writes to one target the first stays."""
    path = files._folder(spark, "once")
    nations = table(spark, sf_dir, "nation").select("n_nationkey")
    writers.write_once(nations.where("n_nationkey < 10"), path)
    writers.write_once(nations, path)
    return spark.read.schema("n_nationkey int").json(path)


def csv_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder, summed each and put together."""
    path = files._folder(spark, "csvs")
    for n in range(3):
        writers.write_csv(table(spark, sf_dir, "nation").where(f"n_nationkey % 3 = {n}").select("n_nationkey", F.lit(n).alias("part")).coalesce(1), f"{path}/{n}")
    rows = readers.read_csv(spark, f"{path}/*", ["n_nationkey"])
    each = rows.groupBy("file", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n_nationkey").cast("long")).alias("total"))
    return each.select(F.col("part").cast("int").alias("part"), "n", "total")


def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 > 0, F.col("event_id")).alias("a"), F.col("event_type").alias("b"), F.when(F.col("event_id") % 7 == 0, F.col("value")).alias("c"))
    return metrics.null_counts(events, ["a", "b", "c"])


def means_with_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    means = lines.groupBy("l_returnflag").agg(F.avg("l_linenumber").alias("line"), F.avg("l_quantity").alias("quantity"))
    ends = [lines.agg(F.lit(n).alias("metric"), F.min(c).cast("double").alias("lower"), F.max(c).cast("double").alias("upper")) for n, c in (("line", "l_linenumber"), ("quantity", "l_quantity"))]
    return metrics.with_interval_row(means, ends[0].unionByName(ends[1]), "l_returnflag")


def persons_over_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files._folder(spark, "ids")
    people = _window_rows(spark, sf_dir).withColumn("person_id", F.col("person_id").cast("long"))
    for name, test in (("a", "person_id % 2 = 0"), ("b", "person_id % 3 = 0")):
        people.where(test).select("person_id").write.json(f"{path}/{name}")
    return dedup.persons_over(*[spark.read.schema("person_id long").json(f"{path}/{name}") for name in "ab"])


def wrapped_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What windows measure as records, by another tokenizer than the default."""
    packed = windows.pack_windows(timeline(spark, sf_dir), 120, tokenizer="words")
    return packed.select("person_id", "window_index", "visit_tokens", "tokens", F.round("percent_full", 6).alias("percent_full"))


def windows_by_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows measured by another tokenizer, and truncation by a cheap one first."""
    events = timeline(spark, sf_dir)
    kept = windows.trailing_children(events, 400, tokenizer="quarters")
    return kept.select("person_id", "visit", "n", "kept_tokens")


def two_pass_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("what came last").alias("instruction"))
    cut = windows.tail_truncate(docs, 300, 64, "Read the record and answer", first="whitespace")
    return cut.select("doc_id", F.md5("kept").alias("kept"))


def answers_by_either_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = qa_pairs(spark, sf_dir)
    half = F.length("pair_id") % 2 == 0
    item = F.struct(F.when(half, F.col("instruction")).alias("output"), F.col("response").alias("response"))
    return pairs.select("pair_id", F.md5(dedup.answer_of(item)).alias("answer"))


def start_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = records._timelines(spark, sf_dir).select("person_id", F.posexplode(markup.visit_strings(F.col("text"))).alias("visit", "markup"))
    changed = F.when(F.col("visit") % 3 == 1, F.replace("markup", F.lit(" 10:00"), F.lit(" 3:05 PM"))).when(F.col("visit") % 3 == 2, F.lit("<visit/>")).otherwise(F.col("markup"))
    return cut.select("person_id", F.col("visit").cast("long").alias("visit"), F.date_format(retrieval.start_time(changed), "yyyy-MM-dd HH:mm").alias("minute"))


def small_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path-safe context names, tokens left of a context, a metric's reported value."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    mode = F.when(F.col("n_nationkey") % 2 == 0, (F.col("n_nationkey") * 100).cast("string")).otherwise(F.concat(F.lit("last five/"), F.col("n_name")))
    reported = F.create_map(F.lit("score"), F.col("n_nationkey") * 1.5, F.lit("f1"), F.lit(0.5))
    return nations.select("n_nationkey", tx.context_name(mode).alias("name"), tx.available_tokens(F.lit(300), F.col("n_nationkey") * 10, F.lit(20)).cast("long").alias("room"), metrics.result_value(reported, "chrf").alias("chrf"))


def attribute_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each comparison of the attribute filter in turn."""
    visits = records._visits(spark, sf_dir)
    tests = {"$eq": {"value": {"$eq": 50}}, "$ne": {"value": {"$ne": 50}}, "$gt": {"value": {"$gt": 50}}, "$lte": {"value": {"$lte": 50}}, "$in": {"type": {"$in": ["view", "error"]}}, "unknown": {"value": {"$near": 1}}, "exists": {"value": {}}}
    found = [markup.filter_visits(visits, conditions=c).select(F.lit(name).alias("test"), F.explode("events").alias("e")).groupBy("test").agg(F.count(F.lit(1)).alias("n"), F.sum(F.try_element_at("e.attributes", F.lit("id")).cast("long")).alias("ids")) for name, c in tests.items()]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def last_two_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = markup.filter_visits(records._visits(spark, sf_dir), include=["CO"], last=2)
    return kept.select("person_id", "day", F.size("events").cast("long").alias("events"))


def promoted_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of removed nodes stand at the end of the parent, in their order."""
    out = records._timelines(spark, sf_dir).withColumn("text", markup.remove_nodes(F.col("text"), "visit", True))
    return out.select("person_id", F.md5("text").alias("text"))


def guarded_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recent selection where enough rows qualify; error records are left out."""
    facts = temporal.raw_pairs(spark, sf_dir).withColumn("error", F.when(F.col("event_id") % 5 == 0, F.lit("bad")))
    return selection.recent(selection.positioned(facts, keep=["event_id"]), 20, "event_id", 0.5).select("event_id", "source_file")


def bins_of_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set of bins that each person's rows lie in."""
    binned = selection.per_bin(temporal._facts(spark, sf_dir), 50, "event_id")
    return binned.groupBy("person_id").agg(F.array_join(F.array_sort(F.collect_set("bin")), ",").alias("bins"))


def run_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoloom.operators import training

    steps = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("epoch"), F.col("l_discount").alias("loss"))
    found = training.run_figures(training.epoch_figures(steps))
    return found.select(*[F.round(c, 9).alias(c) for c in ("avg_loss", "avg_perplexity", "best_loss")])


def split_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a lookup by key would lose."""
    return dedup.rejects(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


def bootstrap_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("value"))
    return sampling.bootstrap(values, "value", ["region"], 1000).select("region", "n", *[F.round(c, 9).alias(c) for c in ("mean", "lower", "upper")])


QUERIES = {f.__name__: f for f in (
    judged_answers, compared_answers, generated_windows, evaluation_answers, retried_calls, inference_rows, file_training_rows, retrieved_examples, training_rows_by_uid, selections_by_name, first_persons,
    json_record_files, xml_by_person, whole_text_files, json_arrays, quarantined_files, written_once, csv_folder, null_counts, means_with_interval, persons_over_folders, wrapped_windows,
    windows_by_tokenizer, two_pass_truncation, answers_by_either_name, start_times, small_scalars, attribute_operators, last_two_visits, promoted_order, guarded_selection, bins_of_persons,
    run_averages, split_rejects, bootstrap_by_group,
)}

_N = lambda prompt: f"CAST('0x' || substr(md5({prompt}), 1, 8) AS BIGINT)"
_SCORES = "CAST(n % 2 AS DOUBLE) AS correctness, CAST(n // 2 % 2 AS DOUBLE) AS completeness"
_WORDS = r"regexp_extract_all({}, '[^ \t\n\x0B\f\r]+')"
_DIGEST = f"""{records._XML}, p AS (SELECT person_id, '<ehr>' || string_agg(text, '' ORDER BY day) || '</ehr>' AS text FROM t GROUP BY person_id)"""
_NEWEST = "sum(n) OVER (PARTITION BY person_id ORDER BY day DESC ROWS UNBOUNDED PRECEDING)"
_RESPONSES = f"""{records._IDS_SQL}, rp AS (SELECT *, person_id % 7 <> 0 AS told FROM i)"""

ORACLES = {
    # What is left of the context: the template's four words, the instruction's three, the response's two (three if there is none), the answer's two.
    "judged_answers": f"""{records._XML}, a AS (SELECT DISTINCT person_id, CASE WHEN person_id % 3 <> 0 THEN 'answer ' || person_id ELSE '[No response provided]' END AS said FROM t WHERE person_id % 5 <> 0),
x2 AS (SELECT person_id, day, replace(text, '/>', ' />') AS text FROM t), t2 AS (SELECT *, len({_WORDS.format("text")}) AS n FROM x2),
s AS (SELECT *, {_NEWEST} AS total FROM t2 JOIN a USING (person_id)),
k AS (SELECT person_id, said, coalesce('<ehr>' || string_agg(text, '' ORDER BY day) FILTER (total <= greatest({CONTEXT} - 4 - 3 - 2 - CASE WHEN person_id % 3 <> 0 THEN 2 ELSE 3 END, 100)) || '</ehr>', '<ehr />') AS kept FROM s GROUP BY person_id, said),
n AS (SELECT person_id, {_N("'Record ' || kept || ' asked what of ' || person_id || ' said ' || said || ' right a b'")} AS n FROM k)
SELECT person_id AS instruction_id, {_SCORES} FROM n""",
    "compared_answers": f"""{records._XML}, a AS (SELECT DISTINCT person_id || '.xml' AS x FROM t),
v AS (SELECT {_N("x || ' or none'")} % 3 AS v, false AS swapped FROM a UNION ALL SELECT {_N("'none or ' || x")} % 3, true FROM a),
c AS (SELECT count(*) FILTER (v = CASE WHEN swapped THEN 1 ELSE 0 END) AS win, count(*) FILTER (v = CASE WHEN swapped THEN 0 ELSE 1 END) AS loss, count(*) FILTER (v = 2) AS tie, count(*) AS total FROM v)
SELECT win, loss, tie, total, round(win / total::DOUBLE, 9) AS win_rate FROM c""",
    "generated_windows": f"""{records._XML}, l AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY day DESC) <= 5),
w AS (SELECT person_id, '<ehr>' || string_agg(text, '' ORDER BY day) || '</ehr>' AS text FROM l GROUP BY person_id),
n AS (SELECT person_id, {packing._TOKENS} AS tokens, {_N("'Read ' || text || ' as ' || CASE WHEN person_id % 2 = 0 THEN 'heart' ELSE 'Unknown' END")} AS n FROM w)
SELECT person_id, 0 AS window_index, tokens, {_SCORES} FROM n""",
    "evaluation_answers": f"""{records._XML}, s AS (SELECT *, {_NEWEST} AS total FROM t),
w AS (SELECT person_id, CAST(sum(n) AS BIGINT) AS tokens, {packing._RECORD.format("DESC")} AS text FROM s WHERE total <= 120 GROUP BY person_id HAVING count(*) >= 3),
n AS (SELECT person_id, tokens, {_N("'Sum up ' || text")} AS n FROM w)
SELECT person_id, tokens, {_SCORES} FROM n""",
    "retried_calls": f"""WITH {QA_SQL}, n AS (SELECT pair_id, {_N("coalesce(instruction, '')")} AS n FROM qa) SELECT pair_id, {_SCORES} FROM n""",
    "selections_by_name": " UNION ALL ".join(f"SELECT '{name}' AS selection, event_id FROM ({sql})" for name, sql in (
        ("last_25", temporal._cover("relative_position >= 0.75", temporal.N)), ("span_100", temporal._cover("true", temporal.N)), ("balanced_100", temporal._BALANCED), ("last_10", temporal._cover("relative_position >= 0.9", temporal.N)),
    )),
    "file_training_rows": f"""WITH p AS ({_DIGEST} SELECT * FROM p), r AS ({_RESPONSES} SELECT * FROM rp WHERE told AND instruction IS NOT NULL AND response IS NOT NULL)
SELECT r.person_id || '_gen_0.json' AS patient_id, count(*) AS pairs, max(md5(text)) AS input, count(DISTINCT response) AS outputs, count(text) AS placed FROM r LEFT JOIN p USING (person_id) GROUP BY 1
UNION ALL SELECT NULL, count(*), max(md5(text)), count(DISTINCT a), count(text) FROM ({records._SAID} SELECT CAST(split_part(pair_id, '-', 1) AS BIGINT) AS person_id, a FROM s WHERE CAST(split_part(pair_id, '-', 2) AS INT) % 5 <> 4) g LEFT JOIN p USING (person_id)""",
    # Of 100 tokens 4 are the template's and 4 the instruction's; what is left of these for the input besides the two of the answer is cut from the front.
    "retrieved_examples": rf"""{records._relevant(92)},
o AS (SELECT person_id, row_number() OVER (ORDER BY {shuffle_sql('person_id', seed=42)}, person_id) - 1 AS i, count(*) OVER () AS n FROM q),
m AS (SELECT person_id, instruction, kept[greatest(len(kept) - 90, 0) + 1:] AS kept FROM q JOIN o USING (person_id) JOIN k USING (person_id) WHERE i < floor(n * 0.8::DOUBLE)),
l AS (SELECT person_id, list_concat(regexp_extract_all('Do ' || instruction || ' with ' || array_to_string(kept, ' '), '[^ \t\n\x0B\f\r]+'), ['done', 'so']) AS w FROM m)
SELECT person_id, CAST(len(w) AS BIGINT) AS length, CAST(list_sum([CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % 32000 for t in w]) AS BIGINT) AS ids FROM l""",
    "training_rows_by_uid": f"""WITH p AS ({_DIGEST} SELECT * FROM p), r AS ({_RESPONSES} SELECT DISTINCT person_id, told FROM rp)
SELECT 'u' || person_id || '_gen_0.json' AS file, CASE WHEN told THEN md5(text) ELSE 'rejected' END AS input FROM r LEFT JOIN p USING (person_id)
UNION ALL SELECT 'u' || split_part(pair_id, '-', 1) || '_turn' || split_part(pair_id, '-', 2) || '_0.txt', 'rejected' FROM ({records._SAID} SELECT pair_id FROM s WHERE CAST(split_part(pair_id, '-', 2) AS INT) % 5 = 4)""",
    # 60 tokens less 3 for the template and 1 for the instruction are left for the record.
    "inference_rows": f"""WITH p AS ({_DIGEST} SELECT person_id, {_WORDS.format("text")} AS w FROM p), r AS ({_RESPONSES} SELECT * FROM rp WHERE told AND response IS NOT NULL AND instruction <> ''),
m AS (SELECT r.*, w[greatest(len(w) - 56, 0) + 1:] AS kept FROM r JOIN p USING (person_id))
SELECT instruction_id, person_id AS patient_id, instruction, md5(array_to_string(kept, ' ') || ' Q ' || instruction) AS prompt, len(kept) AS ehr_tokens, 316 AS context_length, 256 AS generation_length FROM m""",
    "guarded_selection": f"SELECT event_id, source_file FROM ({temporal._cover('relative_position >= 0.5 AND event_id % 5 <> 0', 20)})",
    "first_persons": f"SELECT 'u' || person_id AS uid, CAST(person_id AS VARCHAR) AS person_id, md5(text) AS text FROM ({_DIGEST} SELECT * FROM p) ORDER BY CAST(person_id AS VARCHAR) LIMIT 25",
    "json_record_files": """SELECT CAST(n_nationkey AS VARCHAR) AS person, n_name AS instruction, CAST(1 AS BIGINT) AS n FROM nation WHERE n_nationkey % 4 <> 0
UNION ALL SELECT 'rejected', NULL, count(*) FROM nation WHERE n_nationkey % 4 = 0""",
    "xml_by_person": f"{_DIGEST} SELECT person_id, md5(text) AS text FROM p",
    "whole_text_files": "SELECT 'q ' || n_name AS instruction, 'a' AS response FROM nation",
    "json_arrays": "SELECT CAST(doc_id AS VARCHAR) AS instruction, coalesce(lang, '') AS input, md5(coalesce(text, '')) AS output, CAST(13 AS BIGINT) AS length FROM documents",
    "quarantined_files": f"WITH {FACTS_SQL} SELECT DISTINCT person_id || '_gen_' || window_index || '.json' AS file, CASE WHEN person_id % 7 = 0 THEN 'quarantine' ELSE 'kept' END AS place FROM facts",
    "written_once": "SELECT n_nationkey FROM nation WHERE n_nationkey < 10",
    "csv_folder": "SELECT CAST(n_nationkey % 3 AS INTEGER) AS part, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation GROUP BY 1",
    "null_counts": """WITH e AS (SELECT CASE WHEN event_id % 3 > 0 THEN event_id END AS a, event_type AS b, CASE WHEN event_id % 7 = 0 THEN value END AS c FROM events)
SELECT 'a' AS name, count(a) AS present, count(*) - count(a) AS missing FROM e UNION ALL SELECT 'b', count(b), count(*) - count(b) FROM e UNION ALL SELECT 'c', count(c), count(*) - count(c) FROM e""",
    "means_with_interval": """SELECT l_returnflag, printf('%.4f', avg(l_linenumber)) AS line, printf('%.4f', avg(l_quantity)) AS quantity FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT 'interval', printf('%.4f - %.4f', CAST(min(l_linenumber) AS DOUBLE), CAST(max(l_linenumber) AS DOUBLE)), printf('%.4f - %.4f', min(l_quantity), max(l_quantity)) FROM lineitem""",
    "persons_over_folders": "SELECT DISTINCT user_id AS person_id FROM events WHERE user_id % 2 = 0 OR user_id % 3 = 0",
    "two_pass_truncation": r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents)
SELECT doc_id, md5(array_to_string(w[greatest(len(w) - 228, 0) + 1:], ' ')) AS kept FROM d""",
    "answers_by_either_name": f"WITH {QA_SQL} SELECT pair_id, md5(CASE WHEN length(pair_id) % 2 = 0 THEN coalesce(instruction, response) ELSE response END) AS answer FROM qa",
    "start_times": f"""{records._XML} SELECT person_id, visit, CASE visit % 3 WHEN 0 THEN strftime(day, '%Y-%m-%d') || ' 10:00' WHEN 1 THEN strftime(day, '%Y-%m-%d') || ' 15:05' ELSE '0001-01-01 00:00' END AS minute FROM t""",
    "small_scalars": """SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'context_' || n_nationkey * 100 ELSE 'last five/' || n_name END AS name,
CAST(greatest(300 - n_nationkey * 10 - 20, 100) AS BIGINT) AS room, CAST(n_nationkey * 1.5 AS DOUBLE) AS chrf FROM nation""",
    "attribute_operators": f"""{records._VISITS}, c AS (SELECT * FROM e WHERE NOT note)
SELECT '$eq' AS test, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM c WHERE v = 50 HAVING count(*) > 0 UNION ALL SELECT '$ne', count(*), CAST(sum(event_id) AS BIGINT) FROM c WHERE v <> 50
UNION ALL SELECT '$gt', count(*), CAST(sum(event_id) AS BIGINT) FROM c WHERE v > 50 UNION ALL SELECT '$lte', count(*), CAST(sum(event_id) AS BIGINT) FROM c WHERE v <= 50
UNION ALL SELECT '$in', count(*), CAST(sum(event_id) AS BIGINT) FROM e WHERE event_type IN ('view', 'error') HAVING count(*) > 0 UNION ALL SELECT 'exists', count(*), CAST(sum(event_id) AS BIGINT) FROM c""",
    "last_two_visits": f"{records._VISITS}, d AS (SELECT person_id, day, count(*) AS events FROM e WHERE NOT note GROUP BY ALL) SELECT person_id, CAST(day AS VARCHAR) AS day, events FROM d QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY day DESC) <= 2",
    "promoted_order": f"{records._XML} SELECT person_id, md5('<ehr>' || string_agg(replace(x, '/>', ' />'), '' ORDER BY day, event_id) || '</ehr>') AS text FROM x GROUP BY person_id",
    "bins_of_persons": f"WITH s AS ({temporal.ORACLES['temporal_balanced']}) SELECT person_id, array_to_string(list_sort(list(DISTINCT bin)), ',') AS bins FROM s GROUP BY person_id",
    "run_averages": """WITH e AS (SELECT avg(l_discount) AS loss, exp(avg(l_discount)) AS p FROM lineitem GROUP BY l_linenumber) SELECT round(avg(loss), 9) AS avg_loss, round(avg(p), 9) AS avg_perplexity, round(min(loss), 9) AS best_loss FROM e""",
    "split_rejects": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "bootstrap_by_group": """WITH v AS (SELECT n_regionkey AS region, CAST(n_nationkey AS DOUBLE) AS x, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation),
d AS (SELECT region, b.range AS b, CAST('0x' || substr(md5('0|' || b.range || '|' || v.i // 4), CAST(1 + 8 * (v.i % 4) AS INTEGER), 8) AS BIGINT) % n AS i FROM v, range(1000) b),
m AS (SELECT region, b, avg(x) AS m FROM d JOIN v USING (region, i) GROUP BY ALL)
SELECT region, (SELECT count(*) FROM v WHERE v.region = m.region) AS n, round((SELECT avg(x) FROM v WHERE v.region = m.region), 9) AS mean, round(quantile_cont(m, 0.025), 9) AS lower, round(quantile_cont(m, 0.975), 9) AS upper FROM m GROUP BY region""",
    # The wrapper is <, patient, > and <, /, patient, >.
    "wrapped_windows": packing._PACKED.replace("[^ \\t\\n\\x0B\\f\\r]+", r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]").replace("SELECT person_id, window_index, visits, visit_tokens, start_date, end_date, md5(text) AS text, ", "SELECT person_id, window_index, visit_tokens, visit_tokens + 7 AS tokens, round((visit_tokens + 7) * 100.0::DOUBLE / 120, 6) AS percent_full FROM g WHERE window_index < last OR last = 0 OR visit_tokens >= 60 --"),
    "windows_by_tokenizer": r"""WITH t AS (SELECT conv_id AS person_id, turn AS visit, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]{1,4}')) AS BIGINT) AS n FROM conversations),
s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY person_id ORDER BY visit DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS kept_tokens FROM t) SELECT * FROM s WHERE kept_tokens <= 400""",
}
