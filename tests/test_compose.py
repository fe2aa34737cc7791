import glob
import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import calls, compose, judge


def timeline(n):
    return "<ehr>" + "".join(f'<visit start="{i + 1}/1/2020 10:00"><note>word{i} about topic{i % 3} today</note></visit>' for i in range(n)) + "</ehr>"


@pytest.fixture(scope="module")
def timelines(spark):
    return spark.createDataFrame([("p1", timeline(6)), ("p2", timeline(2)), ("p3", "<ehr/>")], "person_id string, text string").cache()


stub = calls.Registry().get("stub")


def test_generation_over_windows(spark, timelines):
    rows = compose.generate_pairs(timelines, "Read {ehr} as {specialty}", 12, stub, persona=spark.createDataFrame([("p1", "heart")], "person_id string, specialty string")).collect()
    assert {r.person_id for r in rows} == {"p1", "p2"} and all(r.error is None and r.response for r in rows)
    assert compose.generate_pairs(timelines, "{ehr}", "full", stub, limit=1).count() == 1


def test_evaluation_windows(timelines):
    rows = compose.evaluation_windows(timelines, 20, "<<{ehr}>>").collect()
    assert [r.person_id for r in rows] == ["p1"] and rows[0].tokens <= 20
    assert rows[0].prompt.count("<visit") == rows[0].visits


def test_responses_to_positions_and_selections(spark):
    pair = lambda d: {"instruction": "q" + d, "response": "a", "evidence": d, "error": None}
    kind = "person_id string, window_index int, start_date string, end_date string, file string, response_data array<struct<instruction: string, response: string, evidence: string, error: string>>"
    days = [f"{m:02d}/{d:02d}/2020" for m in range(1, 13) for d in (1, 11, 21)]
    rows = spark.createDataFrame([(f"p{k}", 0, "2020-01-01", "2020-12-31", f"p{k}_0.json", [pair(d) for d in days[k::2]] + [pair("01/05/2020 10:00 AM"), pair("01/01/2019")]) for k in range(2)], kind)
    facts = compose.positioned_from_responses(rows)
    assert facts.count() == 36
    keyed = facts.withColumn("k", F.concat("source_file", F.col("evidence").cast("string")))
    chosen = compose.select_all(keyed, 4, "k", bins=2, strict=False)
    assert {n: f.count() for n, f in chosen.items()} == {"last_25": 4, "span_100": 4, "balanced_100": 4, "last_10": 3}


def test_training_rows_from_files(spark):
    texts = spark.createDataFrame([("p1_gen_0.txt", "Instruction: q\nResponse: a"), ("p1_gen_1.txt", "nothing")], "file string, content string")
    responses = spark.createDataFrame([("p2_x_0.json", [("i", "o", None, None)]), ("p3_x_0.json", None)], "file string, response_data array<struct<instruction: string, response: string, evidence: string, error: string>>")
    windows = spark.createDataFrame([("p1", 0, "W1", 1), ("p1", 0, "later", 2), ("p2", 0, "W2", 3)], "person_id string, window_index int, text string, position int")
    rows, empty = compose.training_rows_from_files(texts, responses, windows)
    assert sorted(map(tuple, rows.collect()), key=str) == [("i", "W2", "o", "p2_x_0.json"), ("q", "W1", "a", None)]
    assert sorted(r.file for r in empty.collect()) == ["p1_gen_1.txt", "p3_x_0.json"]


def test_prompts(spark, timelines):
    responses = spark.createDataFrame([("p1", [("what now", "a", None, None), (None, "x", None, None)]), ("gone", [("q", "a", None, None)])], "person_id string, response_data array<struct<instruction: string, response: string, evidence: string, error: string>>")
    rows = compose.inference_prompts(responses, timelines, 256 + 12, "{ehr} Q {question}").collect()
    assert len(rows) == 1 and rows[0].prompt.endswith("Q what now") and len(rows[0].ehr.split()) == 7
    asked = spark.createDataFrame([(1, "p1", "topic2 word5"), (2, "p2", "topic1")], "instruction_id int, person_id string, instruction string")
    plain = {r.instruction_id: r.prompt for r in compose.pack_prompts(asked, timelines, "{ehr} | {question}", 256 + 20).collect()}
    assert plain[1].endswith("| topic2 word5") and len(plain[1].split()) <= 20
    found = {r.instruction_id: r.prompt for r in compose.pack_prompts(asked, timelines, "{ehr} | {question}", 600, retrieve=True).collect()}
    assert "word5" in found[1] and "topic1" in found[2]
    assert {r.prompt for r in compose.pack_prompts(asked, timelines, "{ehr}| {question}", 600, with_record=False).collect()} == {"| topic2 word5", "| topic1"}
    with pytest.raises(Exception, match="no record"):
        compose.pack_prompts(spark.createDataFrame([(3, "nobody", "q")], "instruction_id int, person_id string, instruction string"), timelines, "{ehr}", 600).collect()


def test_judging_and_comparison(spark, tmp_path):
    references = spark.createDataFrame([(i, f"q{i}", f"r{i}", "Annotator_1" if i else "Annotator_2") for i in range(5)], "instruction_id int, instruction string, reference_answer string, annotator_num string")
    answers = spark.createDataFrame([(i, f"a{i}", p) for i in range(4) for p in (0, 1)], "instruction_id int, model_response string, position int")
    scored = compose.judge_all(references, answers, "{instruction} {reference} {response}", stub, "file://" + str(tmp_path / "j"))
    assert sorted(r.instruction_id for r in scored.collect()) == [1, 2, 3]
    assert judge.average_scores(scored).count() == 1
    rates = compose.compare_models(references, answers, answers.withColumn("model_response", F.lit("other")), "{ans1} {ans2}", stub, "file://" + str(tmp_path / "h")).first()
    assert rates.total == 8 and json.loads(calls.stub_model("x"))["verdict"][:2] == "[["


def test_tuning_examples(spark):
    pairs = spark.range(10).select(F.col("id").alias("k"), F.lit("i").alias("instruction"), F.lit("a b c").alias("input"), F.lit("o").alias("output"))
    assert compose.tuning_examples(pairs, "{instruction} {input}", 100, "train", "k").count() == 8
    assert compose.tuning_examples(pairs, "{instruction} {input}", 100, "val", "k").count() == 2


def failing_twice(folder):
    """A model that fails the first two times it is asked something; what was asked is counted in files, as workers share nothing else."""

    def make():
        def model(prompt):
            name = f"{folder}/{hashlib.md5(prompt.encode()).hexdigest()}"
            tried = len(glob.glob(f"{name}-*"))
            open(f"{name}-{tried}", "w").close()
            if "never" in prompt:
                raise ValueError("refused")
            if tried < 2:
                raise calls.Transient("busy")
            return calls.stub_model(prompt)

        return model

    return make


def test_failures_are_tried_again(spark, tmp_path):
    references = spark.createDataFrame([(i, f"q{i}" if i else "never", f"r{i}", "Annotator_1") for i in range(4)], "instruction_id int, instruction string, reference_answer string, annotator_num string")
    answers = spark.createDataFrame([(i, None if i == 2 else f"a{i}", 0) for i in range(4)], "instruction_id int, model_response string, position int")
    (tmp_path / "asked").mkdir()
    path = "file://" + str(tmp_path / "j")
    ask = lambda passes: {r.instruction_id: r for r in compose.judge_all(references, answers, "{instruction} {response}", failing_twice(str(tmp_path / "asked")), path, passes).collect()}
    assert all(r.error and r.scores.correctness is None for r in ask(2).values())
    third = ask(1)
    assert [third[i].error for i in range(4)] == ["refused", None, None, None] and third[1].scores.correctness is not None
    assert len(list((tmp_path / "asked").iterdir())) == 4 * 3
    ask(2)
    assert len(list((tmp_path / "asked").iterdir())) == 4 * 3 + 2  # only what failed is asked again


def test_calls_have_a_time_limit():
    slow = calls.with_time_limit(lambda p: time.sleep(5) or p, 0.05)
    began = time.monotonic()
    with pytest.raises(calls.TimedOut):
        slow("x")
    assert time.monotonic() - began < 2
    assert calls.with_time_limit(lambda p: p + "!", 5)("x") == "x!"
    with pytest.raises(ValueError):
        calls.with_time_limit(lambda p: int(p), 5)("x")


def test_the_judge_sees_the_latest_visits_that_fit(spark, timelines):
    records = timelines.select(F.concat(F.col("person_id"), F.lit(".xml")).alias("filename"), "text")
    references = spark.createDataFrame([(1, "what now", "an answer", "p1.xml"), (2, "what now", "an answer", "gone.xml")], "instruction_id int, instruction string, reference_answer string, filename string")
    answers = spark.createDataFrame([(1, None, 0), (2, "a b", 0)], "instruction_id int, model_response string, position int")
    prompts = {r.instruction_id: r.prompt for r in judge.judge_inputs(references, answers, "Record {ehr} asked {instruction} said {response} right {reference}", records=records, context=125).collect()}
    assert prompts[2] == "Record  asked what now said a b right an answer"
    assert "said [No response provided] right" in prompts[1] and prompts[1].count("<visit") == 6
    long = spark.createDataFrame([("p1.xml", "<ehr id='7'>" + "".join(f'<visit start="{i}">' + "w " * 30 + "</visit>" for i in range(6)) + "</ehr>")], "filename string, text string")
    short = judge.judge_inputs(references.where("instruction_id = 1"), answers, "{ehr} {instruction}", records=long, context=10).first().prompt
    assert short.startswith("<ehr id=\"7\"><visit start=\"3\">") and short.endswith("</visit></ehr> what now")  # three of 32 tokens are within 100


def test_retrieval_gets_what_the_prompt_leaves(spark):
    """The budget is what template, instruction and answer leave; visits of unreadable times don't use it; none is retrieved for no budget."""
    visit = lambda day, words: f'<visit start="{day} 10:00"><note> {words} </note></visit>'
    text = "<ehr>" + visit("01/01/2020", "key one " * 3) + visit("01/02/2020", "fill " * 9) + visit("13/45/2020", "key key key " * 3) + visit("01/04/2020", "other " * 9) + visit("01/05/2020", "plain " * 9) + "</ehr>"
    timelines = spark.createDataFrame([(1, text)], "person_id long, text string")
    asked = spark.createDataFrame([(5, 1, "key one"), (6, 1, "key " * 50)], "instruction_id long, person_id long, instruction string")
    budget = 4
    got = {r.instruction_id: r.prompt for r in compose.pack_prompts(asked, timelines, "{ehr} Q {question}", compose.GENERATION + budget + 3 + 2, retrieve=True).collect()}
    # The best readable visit alone crosses the budget, and its last tokens stay.
    assert got[5] == "one key one </note></visit> Q key one"
    assert "other" not in got[5] and "13/45" not in got[5]
    assert got[6] == " Q " + "key " * 50


def test_retrieval_parses_records_once(spark):
    people = spark.createDataFrame([(1, '<ehr><visit start="01/01/2020 10:00"><code id="1"/></visit></ehr>')], "person_id int, text string")
    asked = spark.createDataFrame([(7, 1, "code")], "instruction_id int, person_id int, instruction string")
    made = compose.pack_prompts(asked, people, "{ehr} {question}", 400, retrieve=True)
    assert "MapInArrow" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.first().prompt == '<visit start="01/01/2020 10:00"><code id="1"/></visit> code'


def test_a_timeline_is_cut_once_for_instructions_that_leave_equal_room(spark, monkeypatch):
    from chronoloom.functions import text as tx

    cuts = spark.sparkContext.accumulator(0)

    class Counted(tx.Pieces):
        def last(self, text, n):
            def cut(x, k):
                cuts.add(1)
                return " ".join(x.split()[-k:]) if k > 0 else ""

            return F.udf(cut, "string")(text, n)

    monkeypatch.setitem(tx.TOKENIZERS, "counted", Counted(tx.tokens))
    told = ["ask a", "ask b", "ask a longer thing", "ask c", "ask more now"]
    responses = spark.createDataFrame([(1, told), (2, told[:1])], "person_id long, t array<string>").select("person_id", F.transform("t", lambda t: F.struct(t.alias("instruction"), F.lit("r").alias("response"))).alias("response_data"))
    timelines = spark.createDataFrame([(1, "a b c d e f g h"), (2, "x"), (3, "y")], "person_id long, text string")
    rows = compose.inference_prompts(responses, timelines, 256 + 7, "{ehr} {question}", tokenizer="counted").collect()
    assert sorted((r.patient_id, r.instruction, r.ehr) for r in rows) == [(1, "ask a", "f g h"), (1, "ask a longer thing", "h"), (1, "ask b", "f g h"), (1, "ask c", "f g h"), (1, "ask more now", "g h"), (2, "ask a", "x")]
    assert cuts.value == 4  # three rooms of the first person, one of the second
