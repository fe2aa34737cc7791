"""Judgements of model answers: score repair, averages, pairwise verdicts, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.text import available_tokens, fill, score, token_count, verdict
from chronoloom.operators.trees import trailing_record

#: What a judge's reply holds for each criterion.
CRITERION = "struct<score: string, explanation: string>"
CRITERIA = {"correctness": "correct", "completeness": "complete"}
#: Fixed value: what stands for a null response.
NO_RESPONSE = "[No response provided]"


def nested_get(json: Column, *keys: str) -> Column:
    """The value under these keys of a JSON text; null if any is missing or the text is no JSON."""
    return F.get_json_object(json, "$" + "".join(f".{k}" for k in keys))


def repaired_scores(reply: Column) -> Column:
    """A struct of the criteria's scores (double) from a judge's JSON reply.

    Where both are missing in their place, the last top-level key whose name contains 'correct' or
    'complete' is taken instead, as a number or as an object with a score.
    """
    own = {c: score(nested_get(reply, c, "score")) for c in CRITERIA}
    lacking = None
    for c in own.values():
        lacking = c.isNull() if lacking is None else lacking & c.isNull()
    entries = F.map_entries(F.from_json(reply, "map<string,string>"))

    def search(part: str) -> Column:
        like = F.filter(entries, lambda e: F.contains(F.lower(e["key"]), F.lit(part)))
        value = F.try_element_at(like, F.lit(-1))["value"]
        return F.coalesce(score(F.get_json_object(value, "$.score")), score(value))

    return F.struct(*[F.when(lacking, search(part)).otherwise(own[c]).alias(c) for c, part in CRITERIA.items()])


def average_scores(results: DataFrame, group: list[str] | None = None, scores: str = "scores") -> DataFrame:
    """The mean of each criterion over the rows that have it; 0 where none has."""
    means = [F.coalesce(F.avg(F.col(f"{scores}.{c}")), F.lit(0.0)).alias(c) for c in CRITERIA]
    return results.groupBy(*(group or [])).agg(*means)


def judge_inputs(references: DataFrame, responses: DataFrame, template: str, key: str = "instruction_id", records: DataFrame | None = None, record: str = "filename", context: int = 16_384, tokenizer: str = "whitespace") -> DataFrame:
    """References joined to responses (the last of several wins) with a ``prompt`` for the judge.

    References without any response row are left out; a null response is named as such. With
    ``records`` (``record``, text) the template's {ehr} is the reference's record: its root and the last of the root's
    children that fit what template, instruction, response and answer leave of ``context``, or of 100 tokens
    if they leave less. A reference without a record, or with a malformed one, has an empty one.
    """
    last = responses.groupBy(key).agg(F.max_by("model_response", "position").alias("model_response"))
    joined = references.join(last, key).withColumn("model_response", F.coalesce("model_response", F.lit(NO_RESPONSE)))
    values = {"instruction": F.col("instruction"), "reference": F.col("reference_answer"), "response": F.col("model_response")}
    if records is not None:
        joined = joined.join(records.select(record, F.col("text").alias("_record")), record, "left")
        room = available_tokens(F.lit(context), token_count(F.lit(fixed_part(template)), tokenizer), *[token_count(v, tokenizer) for v in values.values()])
        joined = trailing_record(joined.withColumn("_room", room), "_record", F.col("_room"), tokenizer)
        values = {"ehr": F.col("_record")} | values
    return joined.withColumn("prompt", fill(template, **values)).drop("_record", "_room")


def fixed_part(template: str) -> str:
    """A judge's template with nothing filled in."""
    for name in ("ehr", "instruction", "reference", "response"):
        template = template.replace("{" + name + "}", "")
    return template


def head_to_head_samples(references: DataFrame, a: DataFrame, b: DataFrame, key: str = "instruction_id") -> DataFrame:
    """Questions that both models answered (the first answer of each), once in each order: (question_id, ans1, ans2, order)."""
    first = lambda rows, name: rows.groupBy(key).agg(F.min_by("model_response", "position").alias(name))
    both = references.join(first(a, "_a"), key).join(first(b, "_b"), key)
    original = both.select(F.concat(F.col(key).cast("string"), F.lit("_original")).alias("question_id"), F.col("_a").alias("ans1"), F.col("_b").alias("ans2"), F.lit("original").alias("order"))
    swapped = both.select(F.concat(F.col(key).cast("string"), F.lit("_swapped")).alias("question_id"), F.col("_b").alias("ans1"), F.col("_a").alias("ans2"), F.lit("swapped").alias("order"))
    return original.unionByName(swapped)


def win_rates(results: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(win, loss, tie, total, win_rate, loss_rate, tie_rate) of replies (result, order); rates are 0 without any verdict."""
    said = results.withColumn("_v", verdict(F.col("result"), F.col("order") == "swapped"))
    count = lambda v: F.count_if(F.col("_v") == v)
    counts = said.groupBy(*(group or [])).agg(*[count(v).alias(v) for v in ("win", "loss", "tie")], F.count("_v").alias("total"))
    rate = lambda v: F.coalesce(F.try_divide(F.col(v), F.col("total")), F.lit(0.0)).alias(f"{v}_rate")
    return counts.select("*", *[rate(v) for v in ("win", "loss", "tie")])


def criterion_scores(results: DataFrame, criterion: str) -> DataFrame:
    """(instruction_id, value): one criterion's scores, one row per judged answer, for resampling."""
    if criterion not in CRITERIA:
        raise ValueError(f"criterion is one of {', '.join(CRITERIA)}, not {criterion!r}")
    return results.select("instruction_id", F.col(f"scores.{criterion}").alias("value")).where("value IS NOT NULL")
