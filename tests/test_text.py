import random

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import text as tx


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize("form", ["Instruction: {q}\nResponse: {a}\n", "**Instruction {n}:** {q}\n\n**Response {n}:** {a}\n", "Pair {n}: Question: {q}\nAnswer: {a}\n", "{n}. Instruction: {q}\nResponse: {a}\n", "**{n}. Instruction:** {q}\n**Response:** {a}\r\n"])
def test_pairs_round_trip(spark, form):
    rng = random.Random(form)
    pairs = [(" ".join(rng.choices(["alpha", "beta", "gamma?"], k=4)) + str(i), "line one\nline two " + str(i)) for i in range(4)]
    body = "\n".join(form.format(n=i + 1, q=q, a=a).rstrip("\n") for i, (q, a) in enumerate(pairs)).lstrip()
    got = one(spark, tx.parse_pairs(F.col("t")), t=body + "\n\nSAFETY_HAZARD is\nnone")
    clean = lambda s: s.replace("\r", "")
    assert {(p.instruction, p.response) for p in got} >= {(q, clean(a)) for q, a in pairs[-1:]}
    assert len({p for p in got}) == len(got)


def test_no_pairs(spark):
    assert one(spark, tx.parse_pairs(F.col("t")), t="nothing here") == []
    assert one(spark, tx.parse_pairs(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize("reply,swapped,want", [("[[B]] or [[A]]", False, "win"), ("[[A]]", True, "loss"), ("[[B]]", False, "loss"), ("[[B]]", True, "win"), ("[[C]]", True, "tie"), ("A", False, None)])
def test_verdicts(spark, reply, swapped, want):
    assert one(spark, tx.verdict(F.col("r"), swapped), r=reply) == want


@pytest.mark.parametrize("value,want", [("1", 1.0), ("0.5", 0.5), ("yes", None), ("", None)])
def test_scores(spark, value, want):
    assert one(spark, tx.score(F.col("v")), v=value) == want


@pytest.mark.parametrize("value,want", [("1/5/2020 10:00", "2020-01-05"), ("2020-01-05 22:30 PM", "2020-01-05"), ("13/40/2020 10:00", None), ("", None)])
def test_visit_dates(spark, value, want):
    assert one(spark, tx.visit_date(F.col("v")).cast("string"), v=value) == want


@pytest.mark.parametrize("value,want", [("02/15/2016", "2016-02-15"), ("2/5/2016", "2016-02-05"), ("02/15/2016 12:00 AM", None), ("02/30/2016", None), ("13/01/2016", None)])
def test_evidence_dates(spark, value, want):
    assert one(spark, tx.evidence_date(F.col("v")).cast("string"), v=value) == want


@pytest.mark.parametrize("a,b,want", [("2", "10", -1), ("b", "a", 1), ("1/5/2020 10:00", "12/1/2019 10:00", 1), ("x", "x", 0), ("10", "a", -1)])
def test_dynamic_comparison(spark, a, b, want):
    assert one(spark, tx.dynamic_compare(F.col("a"), F.col("b")), a=a, b=b) == want


def test_scalars(spark):
    assert one(spark, tx.fill("{a} 100% {b} {c}", a=F.lit("{b}"), b=F.lit("2"))) == "{b} 100% 2 {c}"
    assert one(spark, tx.strip(F.lit("\n\t x \n"))) == "x"
    assert one(spark, tx.unix_newlines(F.lit("a\r\nb\rc"))) == "a\nb\nc"
    assert one(spark, tx.without_safety_block(F.lit("a SAFETY_HAZARD b\nc\n\nd SAFETY_HAZARD e\n"))) == "a \n\nd "
    assert one(spark, tx.context_name(F.lit("4096"))) == "context_4096" and one(spark, tx.context_name(F.lit("last five"))) == "last five"
    assert one(spark, tx.available_tokens(F.lit(1000), F.lit(950))) == 100 and one(spark, tx.available_tokens(F.lit(1000), F.lit(1))) == 999
    assert one(spark, tx.token_count(F.lit(" a\tb\n\x0bc "))) == 3


def test_values_are_filled_once(spark):
    asked = tx.fill("{ehr} asks {question}, {other} {{ehr}} 100%", ehr=F.lit("see {question} {ehr}"), question=F.lit("{ehr}?"))
    assert one(spark, asked) == "see {question} {ehr} asks {ehr}?, {other} {see {question} {ehr}} 100%"
    assert one(spark, tx.fill("{a}{a}", a=F.lit(None).cast("string"))) == "" and one(spark, tx.fill("x {a}")) == "x {a}"


def test_last_tokens_are_cut_once(spark):
    rows = spark.createDataFrame([("a  b\tc\n", 2), (" ", 2), (None, 1), ("a b", 0), ("a b", -1), ("a b", 9)], "t string, n int")
    got = rows.select(tx.last_tokens(F.col("t"), F.col("n")).alias("k"))
    assert [r.k for r in got.collect()] == ["b c", "", "", "", "", "a b"]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
