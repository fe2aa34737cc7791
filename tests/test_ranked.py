"""Scores of a large corpus, made where its documents lie."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoloom.functions.text import tokens
from chronoloom.operators import ranked, retrieval

ODD = [None, "", " ", "a", " a  b ", "\t\n\x0b\f\r x\ty\nz\x0bw\fv\ru ", "no break wide\u0085next\x1cunit", "é ü日本 語\U0001f600 ", None, "", "x" * 5000, "end ", " start", "a\x00b c"]


def test_cut_as_the_tokenizer(spark):
    want = [r.t for r in spark.createDataFrame(list(enumerate(ODD)), "i int, text string").orderBy("i").select(tokens(F.col("text")).alias("t")).collect()]
    for start, end in ((0, len(ODD)), (3, 9), (7, 8), (8, 10), (0, 1)):
        for texts in (pa.array(ODD, pa.string()).slice(start, end - start), pa.array(ODD, pa.large_string()).slice(start, end - start)):
            found, n = ranked.cut(texts)
            found, ends = found.to_pylist(), np.cumsum(n)
            assert [found[e - k : e] for e, k in zip(ends, n, strict=True)] == want[start:end]


def test_counts_of_groups(spark):
    rows = [("a", "x x y"), ("a", "y\tz"), ("b", "x"), ("b", None), (None, "q q"), ("c", "")]
    got = ranked.counted(spark.createDataFrame(rows, "grp string, text string").repartition(3), "grp", "text").collect()
    assert {(r.grp, r.term): (r._docs, r._tokens) for r in got} == {
        ("a", "x"): (1, 0), ("a", "y"): (2, 0), ("a", "z"): (1, 0), ("a", None): (2, 5), ("b", "x"): (1, 0), ("b", None): (2, 1), (None, "q"): (1, 0), (None, None): (1, 2), ("c", None): (1, 0),
    }


def plain(docs, asked, weights, means, every):
    """All scores by loops over every pair."""
    out = {}
    for q, g in asked:
        for own, d, text in docs:
            words = (text or "").split()
            if own != g or not (every or any(weights.get((g, q, w)) for w in words)):
                continue
            norm = lambda tf, n=len(words): tf + 1.5 * (0.25 + 0.75 * n / means[g])
            score = sum(weights[g, q, w] * words.count(w) * 2.5 / norm(words.count(w)) for w in sorted(set(words)) if (g, q, w) in weights)
            if every or round(score, 9) > 0:
                out.setdefault(q, []).append((-round(score, 9), d, len(words)))
    return {q: sorted(rows) for q, rows in out.items()}


def fits(rows, limit, by_tokens):
    before, kept = 0, []
    for row in rows:
        if before > limit:
            break
        kept.append(row)
        before += row[2] if by_tokens else 1
    return kept


@pytest.mark.parametrize(("size", "hits", "rows"), [(8_000_000, 2_000_000, 500_000), (50, 7, 3), (1, 1, 0)])
@pytest.mark.parametrize("every", [False, True])
def test_portions_hand_on_all_that_can_be_best(monkeypatch, size, hits, rows, every):
    """However small the portions are; copies tie, and some weights are below 0."""
    monkeypatch.setattr(ranked, "BYTES", size)
    monkeypatch.setattr(ranked, "HITS", hits)
    monkeypatch.setattr(ranked, "ROWS", rows)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    docs = [(rng.choice("abc"), f"d{i:03}", rng.choice([None, "", " "] + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(20)])) for i in range(120)] + [("a", f"e{i}", "w1 w2 w3") for i in range(9)]
    asked = [(q, "abd"[q % 3]) for q in range(9)]
    weights = {(g, q, w): rng.choice([-1.0, 0.5, 2.0]) for q, g in asked if g != "d" for w in rng.sample(words, rng.randrange(0, 5))}
    means = {g: 4.0 + i for i, g in enumerate("ab")}
    known = ranked.Asked(
        pa.table({"query": [q for q, _ in asked], "grp": [g for _, g in asked]}),
        pa.table({"grp": [k[0] for k in weights], "query": [k[1] for k in weights], "term": [k[2] for k in weights], "_weight": list(weights.values())}),
        pa.table({"grp": list(means), "_mean": list(means.values())}), "grp", "query",
    )
    batch = pa.record_batch({"grp": [d[0] for d in docs], "doc": [d[1] for d in docs], "text": pa.array([d[2] for d in docs], pa.string())})
    want = plain(docs, asked, weights, means, every)
    for limit, by_tokens in ((0, False), (4, False), (0, True), (11, True), (10_000, True)):
        found = {}
        for part in ranked._nearest(iter([batch.slice(0, 50), batch.slice(50)]), known, ["grp", "query", "doc", "n_tokens", "score", "_place"], limit, by_tokens, every, 1.5, 0.75):
            for r in part.to_pylist():
                found.setdefault(r["query"], []).append((-r["_place"], r["doc"], r["n_tokens"]))
        assert set(found) == set(want)
        for q in want:
            kept = fits(sorted(found[q]), limit, by_tokens)
            near = fits(want[q], limit, by_tokens)
            assert [r[1:] for r in kept] == [r[1:] for r in near]
            assert [r[0] for r in kept] == pytest.approx([r[0] for r in near])


def most_moved(spark, made):
    """The most rows that a stage of ``made`` writes to a shuffle."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    known = {stages().apply(i).stageId() for i in range(stages().size())}
    made()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    after = stages()
    return max(after.apply(i).shuffleWriteRecords() for i in range(after.size()) if after.apply(i).stageId() not in known)


def test_a_task_hands_on_few_documents_a_query(spark):
    """A query's budget holds few documents, whatever its number of tokens: 8,000 pairs were moved here."""
    docs = spark.range(400).select(F.lit("g").alias("grp"), F.col("id").alias("doc"), F.concat(F.lit("a b"), F.repeat(F.lit(" c"), (F.col("id") % 50 + 100).cast("int"))).alias("text"))
    asked = spark.createDataFrame([(q, "g", "a b") for q in range(20)], "query long, grp string, text string")
    assert most_moved(spark, lambda: retrieval.fitting(docs, asked, "grp", "doc", "query", 300).collect()) < 1000
