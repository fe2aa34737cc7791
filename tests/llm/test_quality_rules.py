import duckdb
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import quality_rules as qr

def prose(n):
    return " ".join(f"The river{i} of town{i} was calm{i} and the boat{i} in it{i} moved{i} slowly{i}." for i in range(n))


TEXTS = {
    1: None,
    2: "",
    3: " \n\t ",
    4: "too short",
    5: prose(6),
    6: "spam spam " * 60,
    7: " ".join(w + "***" for w in prose(6).split()),
    8: " | ".join(f"menu{i}" for i in range(200)),
    9: prose(6).upper(),
    10: "\n".join([f"line {i} of the text is here" for i in range(10)] + ["the same line of words"] * 30),
    11: prose(900),
    12: "a b c a b c d",
    13: "a a a a",
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, v, "en", 1, "clash") for k, v in TEXTS.items()] + [(5, TEXTS[5], "en", 1, "clash"), (None, TEXTS[5], None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, kept string")


def plain_repeat(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(hit)


def test_counts_and_verdicts(docs):
    got = {r.doc_id: r for r in qr.judge(docs).where("doc_id is not null").collect()}
    assert set(got) == set(TEXTS)
    for k, text in TEXTS.items():
        words = (text or "").split()
        assert got[k]._verdict.counts.n_words == len(words)
        assert got[k]._verdict.counts.word_chars == sum(map(len, words))
        if len(words) < 1000:
            assert got[k]._verdict.counts.n_repeat_words == plain_repeat(words), k
    assert {k for k in got if got[k]._verdict.kept} == {5, 11}
    assert got[7]._verdict.broken == ["symbols_per_word", "stop_word_share"]
    assert got[9]._verdict.broken == ["upper_share"] or "upper_share" in got[9]._verdict.broken
    assert all(got[k]._verdict.base_failed for k in (1, 2, 3, 4, 6, 12, 13))


def test_rows_and_columns_stay(docs):
    kept = qr.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([5, 5, None, 11], key=str)
    assert qr.judge(docs).count() == docs.count()
    assert qr.judge(docs.limit(0)).count() == 0


def test_no_python_in_plan(docs):
    plan = qr.judge(docs.repartition(2))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_oracle_agrees(docs):
    con = duckdb.connect()
    documents = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text").toPandas()  # noqa: F841
    want = {r[0]: r[1:] for r in con.sql(qr.oracle("documents")).fetchall()}
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = qr.judge(docs.where("doc_id is not null")).select("doc_id", *[F.col(f"_verdict.counts.{n}") for n in names], "_verdict.base_failed", "_verdict.kept").collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == want
