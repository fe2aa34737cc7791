import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from chronoloom.functions.stems import stem
from chronoloom.operators import calls, dedup, judge, markup, metrics, retrieval, training


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above, row = row, [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
    return row[-1]


def test_rouge_both_forms(spark):
    rng = random.Random(0)
    pairs = [(" ".join(rng.choices("abcd", k=rng.randrange(9))), " ".join(rng.choices("abcd", k=rng.randrange(9)))) for _ in range(40)]
    rows = spark.createDataFrame(pairs, "reference string, candidate string")
    for r in metrics.evaluate(rows, ["rouge_l", "rouge_l_folded"]).collect():
        a, b = r.reference.split(), r.candidate.split()
        want = 2 * plain_lcs(a, b) / (len(a) + len(b)) if a or b else 0.0
        assert r.rouge_l == pytest.approx(want) and r.rouge_l_folded == pytest.approx(want)


def test_metric_values():
    same = "the cat sat on the mat"
    assert metrics.bleu_score(same.split(), same.split()) == 1 and metrics.bleu_score([], ["a"]) == 0
    assert metrics.bleu_score("a b".split(), "a c".split()) == pytest.approx(1 / 3)
    assert metrics.chrf_score(same, same) == pytest.approx(100) and metrics.chrf_score("abc", "xyz") == 0
    assert 0 < metrics.chrf_score("the cat", "the hat") < 100


def test_chrf_weighs_recall_twice():
    # One order of characters and of words each: all of the candidate is right, half of the reference is found.
    assert metrics.chrf_score("a b", "a") == pytest.approx(100 * (5 * 0.5 / (4 + 0.5) * 2) / 4)


def test_unknown_metrics_are_refused(spark):
    with pytest.raises(ValueError):
        metrics.evaluate(spark.range(1), ["bleurt"])


def test_nan_counts_as_missing(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", None), ("a", 2.0)], "g string, m double")
    got = metrics.group_means(rows, ["g"], ["m"]).first()
    assert (got.m_mean, got.m_median) == (1.5, 1.5)


def plain_meteor(reference, candidate):
    """Tries the words from the end, each with the last word alike that is left."""
    left, found = list(enumerate(reference)), []
    for i in reversed(range(len(candidate))):
        hit = next((x for x in reversed(left) if x[1] == candidate[i]), None)
        if hit:
            left.remove(hit)
            found.append((i, hit[0]))
    if not found:
        return 0.0
    found.sort()
    chunks = sum(k == 0 or found[k] != (found[k - 1][0] + 1, found[k - 1][1] + 1) for k in range(len(found)))
    p, r = len(found) / len(candidate), len(found) / len(reference)
    return (1 - 0.5 * (chunks / len(found)) ** 3) * p * r / (0.9 * p + 0.1 * r)


def test_meteor_aligns_and_counts_chunks(spark):
    rng = random.Random(2)
    pairs = [(" ".join(rng.choices("abcd", k=rng.randrange(9))), " ".join(rng.choices("abcde", k=rng.randrange(9)))) for _ in range(80)] + [("a b c d", "d c b a"), ("A b", "a B")]
    rows = metrics.evaluate(spark.createDataFrame(pairs, "reference string, candidate string"), ["meteor_exact"]).collect()
    for r in rows:
        assert r.meteor_exact == pytest.approx(plain_meteor(r.reference.lower().split(), r.candidate.lower().split()))
    assert rows[-2].meteor_exact == pytest.approx(0.5) and rows[-1].meteor_exact == pytest.approx(1 - 0.5 / 8)


def test_meteor_stems(spark):
    got = metrics.evaluate(spark.createDataFrame([("the cats were running", "the cat was run"), ("a", ""), (None, "b")], "reference string, candidate string"), ["meteor", "meteor_exact"]).collect()
    assert metrics.aligned_words("the cats were running".split(), "the cat was run".split()) == [(0, 0), (1, 1), (3, 3)]
    assert got[0].meteor > got[0].meteor_exact > 0 and (got[1].meteor, got[2].meteor) == (0, 0)


def test_porter_stems():
    known = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop falling fall hissing hiss failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit operator oper feudalism feudal decisiveness decis hopefulness hope triplicate triplic formative form electrical electr goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust replacement replac adoption adopt communism commun activate activ effective effect probate probat rate rate cease ceas controll control roll roll oscillators oscil generalizations gener".split()
    assert [(w, stem(w)) for w in known[::2]] == list(zip(known[::2], known[1::2]))


def test_overshoot(spark):
    rows = spark.createDataFrame([(1, 1, 60, 3.0), (1, 2, 50, 2.0), (1, 3, 10, 1.0)], "q int, d int, n_tokens long, score double")
    assert [r.d for r in retrieval.fit_by_rank(rows, "q", "d", 100).orderBy("rank").collect()] == [1, 2]


def test_context_in_time(spark):
    visits = [(1, 1, '<visit start="02/01/2020 10:00">b</visit>'), (1, 2, '<visit start="01/01/2020 10:00 AM">a</visit>'), (1, 3, "<visit>none</visit>"), (1, 4, '<visit start="13/40/2020 10:00">bad</visit>')]
    got = retrieval.in_time(retrieval.with_readable_time(spark.createDataFrame(visits, "q int, n int, v string"), "v"), "q", "v", "n").first().context
    assert [x.split(">")[1].split("<")[0] for x in got.split("\n")] == ["none", "a", "b"]


def test_missing_context_fails(spark):
    asked = spark.createDataFrame([(1, "x"), (2, "y")], "q int, instruction string")
    contexts = spark.createDataFrame([(1, "c")], "q int, context string")
    assert retrieval.prompts(asked.where("q = 1"), contexts, "q", "{context}/{question}").first().prompt == "c/x"
    with pytest.raises(Exception, match="no context for 2"):
        retrieval.prompts(asked, contexts, "q", "{context}/{question}").collect()


def test_judge_repair_and_averages(spark):
    replies = ['{"correctness": {"score": 1}, "completeness": {"score": "0.5"}}', '{"Correct?": "1", "how_complete": {"score": 0}}', "junk", '{"correctness": {"score": "yes"}}']
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string").withColumn("scores", judge.repaired_scores(F.col("r")))
    assert [tuple(r.scores) for r in rows.orderBy("i").collect()] == [(1.0, 0.5), (1.0, 0.0), (None, None), (None, None)]
    assert tuple(judge.average_scores(rows).first()) == (1.0, 0.25)
    assert tuple(judge.average_scores(rows.where("i = 2")).first()) == (0.0, 0.0)


def test_rates_without_verdicts(spark):
    got = judge.win_rates(spark.createDataFrame([("none", "original")], "result string, order string")).first()
    assert (got.total, got.win_rate, got.tie_rate) == (0, 0.0, 0.0)


def test_first_and_last(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, None), (None, 3, "x"), (None, 4, "y")], "k string, n int, v string")
    assert sorted((str(r.k), r.v) for r in dedup.keep_first(rows, "k", ["n"]).collect()) == [("None", "x"), ("k", "a")]
    assert sorted((str(r.k), str(r.v)) for r in dedup.keep_last(rows, "k", ["n"]).collect()) == [("None", "y"), ("k", "None")]


def test_guarded_lookup(spark):
    reference = spark.createDataFrame([(1, "v")], "k int, v string")
    assert dedup.guarded_lookup(spark.createDataFrame([(1,)], "k int"), reference, "k", "v").first().v == "v"
    with pytest.raises(Exception, match="no v for k 2"):
        dedup.guarded_lookup(spark.createDataFrame([(2,)], "k int"), reference, "k", "v").collect()


def test_reference_rows(spark):
    rows = spark.createDataFrame([(1, [("q", "a", "e", None), ("q2", None, None, None), ("", "a", None, None)]), (2, None)], "person_id long, response_data array<struct<instruction: string, response: string, evidence: string, error: string>>")
    got = dedup.reference_rows(rows).collect()
    assert [(r.filename, r.question, r.annotator_num) for r in got] == [("EHR_1.xml", "q", "Annotator_1")]


MARKUP = '<ehr><visit start="1/2/2020 10:00"><note id="1">hi &amp; ho</note><code id="2" value="7"/></visit><visit start="x"/></ehr>'


def test_markup(spark):
    rows = spark.createDataFrame([(1, MARKUP), (2, None), (3, "<visit>")], "person_id int, text string")
    visits = rows.select("person_id", F.posexplode(markup.visit_strings(F.col("text"))).alias("visit", "m")).withColumn("events", markup.events_of(F.col("m")))
    got = visits.orderBy("visit").collect()
    assert len(got) == 2 and [(e.tag, dict(e.attributes), e.text) for e in got[0].events] == [("note", {"id": "1"}, "hi & ho"), ("code", {"id": "2", "value": "7"}, "")]
    ids = lambda frame: [e.attributes["id"] for r in frame.collect() for e in r.events]
    assert ids(markup.filter_preset(visits, notes_only=True)) == ["1"] and ids(markup.filter_preset(visits, codes_only=True)) == ["2"]
    assert ids(markup.filter_visits(visits, conditions={"value": {"$gte": 7}})) == ["2"]
    assert ids(markup.filter_visits(visits, conditions={"value": {"$near": 7}})) == []
    assert ids(markup.filter_visits(visits, conditions={"value": {}, "missing": {"$eq": 1}})) == ["2"]
    assert ids(markup.filter_visits(visits, conditions={"id": {"$in": [1, 9]}})) == ["1"]
    with pytest.raises(ValueError):
        markup.filter_preset(visits, True, True)


def test_node_removal(spark):
    rows = spark.createDataFrame([("<a><b><c/></b><d/></a>",), ("<a>",), (None,)], "x string")
    assert [r[0] for r in rows.select(markup.remove_nodes(F.col("x"), "b")).collect()] == ["<a><d /></a>", None, None]
    assert [r[0] for r in rows.select(markup.remove_nodes(F.col("x"), "B", True)).collect()] == ["<a><d /><c /></a>", None, None]
    assert rows.select(markup.pretty_xml(F.col("x"))).first()[0] == "<a>\n  <b>\n    <c />\n  </b>\n  <d />\n</a>"


def test_retries():
    waits, left = [], [2]

    def model(_):
        if left[0]:
            left[0] -= 1
            raise calls.Transient("500")
        return "ok"

    assert calls.with_retries(model, 3, 1.0, sleep=waits.append)("p") == "ok" and waits == [1.0, 2.0]
    left[0] = 9
    with pytest.raises(calls.Transient):
        calls.with_retries(model, 3, sleep=waits.append)("p")
    with pytest.raises(KeyError):
        calls.with_retries(lambda p: {}[p], 3, sleep=waits.append)("p")


def test_generation_keeps_ids_and_failures(spark):
    def maker():
        def model(prompt):
            if prompt == "bad":
                raise RuntimeError("no")
            return prompt.upper()

        return model

    got = {r.k: (r.response, r.error) for r in calls.generate(spark.createDataFrame([(1, "a"), (2, "bad")], "k long, prompt string"), "k", maker).collect()}
    assert got == {1: ("A", None), 2: (None, "no")}
    with pytest.raises(ValueError):
        calls.Registry().get("nobody")


def test_plugin(tmp_path):
    path = tmp_path / "p.py"
    path.write_text("def twice(x):\n    return 2 * x\n")
    assert calls.load_plugin(f"{path}:twice")(4) == 8
    for bad in ("p.py", f"{path}:none"):
        with pytest.raises(ValueError):
            calls.load_plugin(bad)


def test_masks_and_batches(spark):
    row = spark.range(1).select(training.masked_example(F.lit("a b"), F.lit("c")).alias("e")).first().e
    assert row.labels[:2] == [-100, -100] and row.labels[2] == row.input_ids[2] and row.attention_mask == [1, 1, 1]


def plain_batches(sizes, size, replicas, drop):
    order = sorted(sizes, key=lambda k: (sizes[k], shuffled(k), k))
    batches = [order[i : i + size] for i in range(0, len(order), size)]
    if drop:
        batches = [b for b in batches if len(b) == size]
        batches = batches[: len(batches) // replicas * replicas]
    return {(b % replicas, b // replicas, b, place, k) for b, own in enumerate(batches) for place, k in enumerate(own)}


def shuffled(k):
    return hashlib.md5(f"{k}|0".encode()).hexdigest()


@pytest.mark.parametrize("n,size,replicas,drop", [(103, 8, 3, True), (103, 8, 3, False), (5, 8, 2, True), (5, 8, 2, False), (0, 4, 1, True), (64, 8, 2, True)])
def test_length_batches(spark, n, size, replicas, drop):
    sizes = {k: 3 if k % 2 else k * 37 % 700 for k in range(n)}
    rows = spark.createDataFrame(list(sizes.items()), "k long, n int")
    got = {tuple(r) for r in training.length_batches(rows, F.col("n"), "k", size, replicas, drop).collect()}
    assert got == plain_batches(sizes, size, replicas, drop)


def test_shuffled_batches_are_the_same_batches(spark):
    rows = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 7).alias("n"))
    plain, mixed = (training.length_batches(rows, F.col("n"), "k", 8, 2, shuffled=s) for s in (False, True))
    key = lambda df: {(r.batch, r.place, r.k) for r in df.collect()}
    steps = {(r.replica, r.step, r.batch) for r in mixed.collect()}
    assert key(plain) == key(mixed) and len(steps) == len({b for _, _, b in steps}) == 12 and {s for _, s, _ in steps} == set(range(6))
    assert sorted(steps) != sorted({(r.replica, r.step, r.batch) for r in plain.collect()})


def test_schedule(spark):
    steps = spark.range(101).withColumnRenamed("id", "step")
    rates = [r.rate for r in training.scheduled(steps, 10, 1.0, 0.1).orderBy("step").collect()]
    assert rates[0] == 0 and rates[10] == 1.0 and rates[100] == pytest.approx(0.1) and all(a >= b for a, b in itertools.pairwise(rates[10:]))


def test_best_and_fitting_equal_ranking_every_document(spark):
    """Hits alone serve most queries; those whose hits are too few take documents that score 0 too."""
    import random

    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(g, d, "" if d % 9 == 0 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))) for g in ("a", "b") for d in range(30)], "grp string, doc int, text string").cache()
    asked = spark.createDataFrame([(q, "ab"[q % 2], " ".join(rng.choice([*words, "none", "w1 w1"]) for _ in range(rng.randrange(0, 4)))) for q in range(30)] + [(99, "a", None), (98, "c", "w1")], "query int, grp string, text string").cache()
    every = retrieval.bm25(docs, asked, "grp", "doc", "query").cache()
    shown = lambda rows: sorted((r.query, r["rank"], r.doc, round(r.score, 9)) for r in rows.collect())
    for k in (1, 5, 40):
        assert shown(retrieval.best(docs, asked, "grp", "doc", "query", k)) == shown(retrieval.top_k(every, "query", "doc", k))
    for target in (0, 7, 60, 10_000):
        got = retrieval.fitting(docs, asked, "grp", "doc", "query", target).select("query", "rank", "doc", "score")
        order = {}
        for q, _, d, s in sorted(shown(retrieval.top_k(every, "query", "doc", 1000))):
            order.setdefault(q, []).append((d, s))
        tokens = {(r.grp, r.doc): len((r.text or "").split()) for r in docs.collect()}
        group = {r.query: r.grp for r in asked.collect()}
        want = []
        for q, ranked in order.items():
            before = 0
            for rank, (d, s) in enumerate(ranked, 1):
                if before > target:
                    break
                want.append((q, rank, d, s))
                before += tokens[group[q], d]
        assert shown(got) == sorted(want), target


def test_only_the_best_hits_are_written(spark, monkeypatch):
    rows = []
    own = retrieval.written
    monkeypatch.setattr(retrieval, "written", lambda df, name: rows.append((name, df.count())) or own(df, name))
    docs = spark.range(200).select(F.lit("g").alias("grp"), F.col("id").alias("doc"), F.concat(F.lit("a b c"), F.repeat(F.lit(" d"), (F.col("id") % 7).cast("int"))).alias("text"))
    asked = spark.createDataFrame([(q, "g", "d a") for q in range(10)], "query long, grp string, text string")
    every = retrieval.bm25(docs, asked, "grp", "doc", "query")
    for got, want in ((retrieval.best(docs, asked, "grp", "doc", "query", 3), retrieval.top_k(every, "query", "doc", 3)), (retrieval.fitting(docs, asked, "grp", "doc", "query", 20), retrieval.fit_by_rank(every, "query", "doc", 20))):
        shown = lambda df: sorted((r.query, r["rank"], r.doc, r.n_tokens, round(r.score, 9)) for r in df.collect())
        assert shown(got) == shown(want)
    assert max(n for name, n in rows if name not in ("tokens", "terms")) <= 10 * 21
