"""Whole steps of the workflow, each made of the other operators. One function per step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import text as tx
from chronoloom.operators import calls, dedup, judge, markup, retrieval, selection, training, trees, windows
from chronoloom.sources.scratch import written
from chronoloom.streaming.incremental import repeat_until_done
from chronoloom.streaming.manifest import Results, latest_failures

#: Tokens kept for an answer.
GENERATION = 256
#: Passes over what has failed, and the longest that one item may take.
PASSES, ITEM_SECONDS = 30, 300.0


def timeline_visits(timelines: DataFrame, filters: dict | None = None) -> DataFrame:
    """(person_id, visit, visit_date, text) of every visit in (person_id, text); visits are counted in document order.

    With ``filters`` (see ``trees.FILTERS``) a visit's text holds what passes them, and visits with nothing left go.
    """
    if filters is None:
        cut = timelines.select("person_id", F.posexplode(markup.visit_strings(F.col("text"))).alias("visit", "text"))
    else:
        cut = trees.filter_trees(timelines, filters)
    return cut.select("person_id", "visit", tx.visit_date(markup.start_attribute(F.col("text"))).alias("visit_date"), "text")


def generate_pairs(timelines: DataFrame, template: str, mode: str | int, make_model: Callable[[], calls.Model], limit: int | None = None, persona: DataFrame | None = None, tokenizer: str = "whitespace") -> DataFrame:
    """Windows of each timeline, filled into a template and sent to a model.

    (person_id, window_index, tokens, start_date, end_date, response, error). ``persona``
    (person_id, specialty) fills {specialty}. A limit takes the first persons by id.
    """
    people = timelines if limit is None else timelines.orderBy("person_id").limit(limit)
    mode = windows.checked_mode(mode)
    cut = windows.pack_windows(timeline_visits(people), mode, tokenizer=tokenizer) if isinstance(mode, int) else windows.record_window(people, 5 if mode == "last_five" else None, tokenizer)
    values = {"ehr": F.col("text")}
    if persona is not None:
        cut = cut.join(persona.select("person_id", "specialty"), "person_id", "left")
        values["specialty"] = F.coalesce("specialty", F.lit("Unknown"))
    key = F.concat_ws("/", F.col("person_id").cast("string"), F.col("window_index").cast("string"))
    asked = cut.withColumn("key", key).withColumn("prompt", tx.fill(template, **values))
    replies = calls.generate(asked, "key", make_model)
    return asked.select("key", "person_id", "window_index", "tokens", "start_date", "end_date").join(replies, "key").drop("key")


def evaluation_windows(timelines: DataFrame, budget: int, template: str, tokenizer: str = "whitespace") -> DataFrame:
    """(person_id, visits, tokens, start_date, end_date, text, percent_full, prompt) of each timeline's newest visits that fit."""
    return windows.newest_that_fit(timeline_visits(timelines), budget, tokenizer=tokenizer).withColumn("prompt", tx.fill(template, ehr=F.col("text")))


def evaluation_generation(timelines: DataFrame, budget: int, template: str, make_model: Callable[[], calls.Model], tokenizer: str = "whitespace") -> DataFrame:
    """(person_id, tokens, start_date, end_date, response) of each evaluation window that a model answers; failures are left out."""
    asked = evaluation_windows(timelines, budget, template, tokenizer)
    replies = calls.generate(asked, "person_id", make_model).where("response IS NOT NULL").select("person_id", "response")
    return asked.select("person_id", "tokens", "start_date", "end_date").join(replies, "person_id")


def positioned_from_responses(responses: DataFrame) -> DataFrame:
    """Positioned pairs from response files: (person_id, window_index, start_date, end_date, response_data, file)."""
    each = responses.select("person_id", "window_index", F.to_date("start_date").alias("start_date"), F.to_date("end_date").alias("end_date"), F.col("file").alias("source_file"), F.explode("response_data").alias("p"))
    pairs = each.select("person_id", "window_index", "start_date", "end_date", "source_file", "p.instruction", "p.response", tx.evidence_date(F.col("p.evidence")).alias("evidence"), "p.error")
    return selection.positioned(pairs)


def select_all(facts: DataFrame, n: int, key: str, bins: int = 10, cohort: DataFrame | None = None, strict: bool = True) -> dict[str, DataFrame]:
    """The selections by name: last_25, span_100, balanced_100, last_10."""
    return {
        "last_25": selection.recent(facts, n, key, 0.75, strict=strict),
        "span_100": selection.whole_span(facts, n, key),
        "balanced_100": selection.balanced_with_coverage(facts, n, key, bins=bins),
        "last_10": selection.recent(facts, n, key, 0.9, cohort=cohort, strict=strict),
    }


def training_rows_from_files(texts: DataFrame, responses: DataFrame, timelines: DataFrame, owner: str = "person_id") -> tuple[DataFrame, DataFrame]:
    """Training rows of generated text files (file, content) and response files, and the files without any pair.

    Both give (instruction, input, output, patient_id); the input is the windowed timeline with the
    file's person and window (the first, if several), and patient_id is known for response files.
    ``owner`` names the timelines' column that file names begin with: person_id, or uid.
    """
    from chronoloom.sources.readers import person_of, window_of

    parsed = texts.withColumn("pairs", tx.parse_pairs(F.col("content")))
    own = parsed.select("file", F.explode("pairs").alias("p"), F.lit(None).cast("string").alias("patient_id"))
    listed = responses.withColumn("pairs", dedup.valid_pairs(F.col("response_data")))
    other = listed.select("file", F.explode("pairs").alias("p"), F.col("file").alias("patient_id"))
    both = own.select("file", "p.instruction", F.col("p.response").alias("output"), "patient_id").unionByName(other.select("file", "p.instruction", F.col("p.response").alias("output"), "patient_id"))
    inputs = timelines.groupBy(F.col(owner).alias("person_id"), "window_index").agg(F.min_by("text", "position").alias("input"))
    placed = both.withColumn("person_id", person_of(F.col("file"))).withColumn("window_index", window_of(F.col("file")))
    rows = placed.join(inputs, ["person_id", "window_index"], "left").select("instruction", "input", "output", "patient_id")
    empty = parsed.where(F.size("pairs") == 0).select("file", "content").unionByName(listed.where(F.size("pairs") == 0).select("file", F.to_json("response_data").alias("content")))
    return rows, empty


def inference_prompts(responses: DataFrame, timelines: DataFrame, context: int, template: str, tokenizer: str = "whitespace") -> DataFrame:
    """One row per valid pair of a person with a timeline: (instruction_id, patient_id, instruction, ehr, prompt, context_length, generation_length).

    The timeline keeps its last tokens that fit beside template, instruction and answer. It is cut once for the
    instructions of a person that leave it equal room.
    """
    each = dedup.instruction_ids(responses.withColumn("response_data", dedup.valid_pairs(F.col("response_data"))))
    asked = each.where(F.length("item.instruction") > 0).select("instruction_id", "person_id", F.col("item.instruction").alias("instruction"))
    room = windows.room(F.lit(context), F.lit(GENERATION), template, F.col("instruction"), tokenizer)
    alike = asked.withColumn("_room", room).groupBy("person_id", "_room").agg(F.collect_list(F.struct("instruction_id", "instruction")).alias("_asked"))
    held = alike.join(timelines.select("person_id", "text"), "person_id").withColumn("kept", tx.last_tokens(F.col("text"), F.col("_room"), tokenizer))
    cut = held.select("person_id", "kept", F.explode("_asked").alias("_a")).select("person_id", "kept", "_a.*")
    prompt = tx.fill(template, ehr=F.col("kept"), question=F.col("instruction"))
    return cut.select("instruction_id", F.col("person_id").alias("patient_id"), "instruction", F.col("kept").alias("ehr"), prompt.alias("prompt"), F.lit(context).alias("context_length"), F.lit(GENERATION).alias("generation_length"))


def pack_prompts(
    instructions: DataFrame, timelines: DataFrame, template: str, context: int, retrieve: bool = False, with_record: bool = True, filters: dict | None = trees.FILTERS["all"], tokenizer: str = "whitespace", first: str | None = None
) -> DataFrame:
    """(instruction_id, prompt): each instruction with what of its person's record fits.

    The record is the person's visits with what passes ``filters`` (see ``trees.FILTERS``), one a
    line. Its budget is what template, instruction and answer leave of the context. With ``retrieve``
    the visits are ranked against the instruction, kept up to that budget (the one that crosses it
    included; those without a readable time are passed over), and put back in order of time; then, as
    without, the last tokens that fit are kept (``first`` names a cheaper tokenizer that cuts to twice
    the budget before). Nothing is retrieved for a budget of zero or less. Relevance goes by
    white-space terms, budgets by ``tokenizer``. An instruction whose person has no record is an error.
    """
    guarded = dedup.guarded_lookup(instructions.select("instruction_id", "person_id", "instruction"), timelines.select("person_id", F.lit("").alias("record")), "person_id", "record")
    # The empty text is joined on, so that the check is not pruned.
    guarded = guarded.withColumn("instruction", F.concat("instruction", "record")).drop("record")
    if not with_record:
        return guarded.select("instruction_id", tx.fill(template, ehr=F.lit(""), question=F.col("instruction")).alias("prompt"))
    visits = timeline_visits(timelines, filters)
    if retrieve:
        visits = written(visits, "visits")  # ranking reads them several times, and records are parsed once
        budget = windows.room(F.lit(context), F.lit(GENERATION), template, F.col("instruction"), tokenizer)
        asked = instructions.select("instruction_id", "person_id", F.col("instruction").alias("text"), budget.alias("_budget")).where("_budget > 0")
        texts = retrieval.relevant_texts(visits, asked, "person_id", "instruction_id", tokenizer)
        record = guarded.join(texts, "instruction_id", "left")
    else:
        lines = F.transform(F.array_sort(F.collect_list(F.struct("visit", "text"))), lambda v: v["text"])
        texts = visits.groupBy("person_id").agg(F.array_join(lines, "\n").alias("text"))
        record = guarded.join(texts, "person_id", "left")
    cut = windows.tail_truncate(record, context, GENERATION, template, tokenizer=tokenizer, first=first)
    return cut.select("instruction_id", tx.fill(template, ehr=F.col("kept"), question=F.col("instruction")).alias("prompt"))


def judge_all(references: DataFrame, responses: DataFrame, template: str, make_model: Callable[[], calls.Model], path: str, passes: int = PASSES, records: DataFrame | None = None, context: int = 16_384, seconds: float = ITEM_SECONDS, tokenizer: str = "whitespace", in_flight: int = 1, rate: float | None = None) -> DataFrame:
    """Judges every reference that has a response, resuming what is below ``path``: (instruction_id, scores, error).

    A call that fails or takes longer than ``seconds`` is tried again in the next pass; what still
    fails after the last one comes back with its last error and null scores.
    """
    inputs = judge.judge_inputs(references.where("annotator_num = 'Annotator_1'"), responses, template, records=records, context=context, tokenizer=tokenizer).select("instruction_id", "prompt")
    replies = _asked_until_done(inputs, "instruction_id", make_model, path, passes, seconds, in_flight, rate)
    return replies.withColumn("scores", judge.repaired_scores(F.col("response"))).select("instruction_id", "scores", "error")


def _asked_until_done(asked: DataFrame, key: str, make_model: Callable[[], calls.Model], path: str, passes: int, seconds: float, in_flight: int = 1, rate: float | None = None) -> DataFrame:
    """(key, response, error) of every prompt: its reply, or else its failure."""
    work = lambda rows: calls.generate(rows, key, make_model, seconds=seconds, in_flight=in_flight, rate=rate)
    repeat_until_done(asked, key, work, path, passes)
    results = Results(asked.sparkSession, path, work(asked.limit(0)))
    failed = latest_failures(results, key).select(key, F.lit(None).cast("string").alias("response"), "error")
    return results.done().unionByName(failed)


def compare_models(references: DataFrame, a: DataFrame, b: DataFrame, template: str, make_model: Callable[[], calls.Model], path: str, passes: int = PASSES, seconds: float = ITEM_SECONDS) -> DataFrame:
    """Win, loss and tie rates of model a against b over both orders, resuming what is below ``path``; failures count for nothing."""
    samples = judge.head_to_head_samples(references, a, b)
    asked = samples.withColumn("prompt", tx.fill(template, ans1=F.col("ans1"), ans2=F.col("ans2")))
    replies = _asked_until_done(asked.select("question_id", "prompt"), "question_id", make_model, path, passes, seconds)
    said = samples.select("question_id", "order").join(replies, "question_id")
    return judge.win_rates(said.select(F.col("response").alias("result"), "order"))


def tuning_examples(pairs: DataFrame, template: str, context: int, part: str, key: str, retrieve: bool = False, tokenizer: str = "whitespace") -> DataFrame:
    """The masked examples of one part of a dataset.

    With ``retrieve`` a pair's input is markup, of which the visits most relevant to its instruction
    are kept, in order of time, within what template and instruction leave of the context.
    """
    own = training.dataset_part(pairs, key, part)
    if retrieve:
        budget = F.lit(context) - tx.token_count(F.lit(template), tokenizer) - tx.token_count(F.col("instruction"), tokenizer)
        asked = own.select(key, F.col(key).alias("_pair"), F.col("instruction").alias("text"), budget.alias("_budget")).where("_budget > 0")
        visits = own.select(F.col(key).alias("_pair"), F.posexplode(markup.visit_strings(F.col("input"))).alias("visit", "text"))
        texts = retrieval.relevant_texts(visits, asked, "_pair", key, tokenizer)
        own = own.join(texts.withColumnRenamed("text", "_found"), key, "left").withColumn("input", F.coalesce("_found", F.lit(""))).drop("_found")
    return training.training_rows(own, template, context, tokenizer)
