import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import rule_ensemble as re_


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(8)
    vocabulary = ["the", "of", "and", "in"] + [f"w{c}{d}" for c in "abcdefgh" for d in "ijklmnop"]
    docs, labels = [], []
    for i in range(1200):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([30, 80, 200]))]
        good = rng.random() < 0.7
        if not good:
            kind = rng.randrange(3)
            words = [w + "***" for w in words] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else [w for w in words[:5] for _ in range(20)]
        docs.append((i, " ".join(words), "en", 0.5))
        labels.append((i, int(good), 0))
    docs += [(5000, None, None, None), (5001, "", "", 0.0), (None, "the null of ids", "en", 0.0), (7, docs[7][1], "en", 0.5), (5002, "x " * 30000, "en", 0.1)]
    labels += [(None, 1, 0), (3, None, 0), (7, 1, 1), (99999, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((d, q) for d, q, _ in labels[:1200])


def test_held_out_accuracy_and_totality(case):
    docs, labels, truth = case
    model = re_.fit(docs, labels)
    rows = re_.score(docs, model).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(out) > 200 and np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.97
    assert 1 <= len(model.rules) <= 150
    assert model == re_.fit(docs.repartition(7), labels.repartition(5))


def test_held_out_labels_are_never_seen(case):
    docs, labels, _ = case
    flipped = labels.withColumn("quality", F.when(re_.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert re_.fit(docs, labels) == re_.fit(docs, flipped)


def test_compiled_score_equals_plain_evaluation(spark, case):
    docs, labels, _ = case
    model = re_.fit(docs, labels)
    rows = re_.with_statistics(docs).select("_stats", re_.compile_model(model).alias("s")).collect()
    for r in rows[::40]:
        total = model.intercept + sum(rule.weight for rule in model.rules if all((r._stats[n] > b) == above for n, above, b in rule.conditions))
        assert r.s == pytest.approx(1 / (1 + np.exp(-total)))


def test_lasso_finds_the_one_rule_that_matters():
    rng = np.random.default_rng(0)
    z = (rng.random((4000, 12)) < 0.5).astype(float)
    y = (rng.random(4000) < 1 / (1 + np.exp(2 - 4 * z[:, 3]))).astype(float)
    _, w = re_._lasso_logistic(z, y, 0.02)
    assert abs(w[3]) > 2 and np.abs(np.delete(w, 3)).max() < 0.1


def test_without_labels_or_rows(case):
    docs, labels, _ = case
    model = re_.fit(docs, labels.limit(0))
    assert {r.score for r in re_.score(docs, model).collect()} == {0.5}
    one = re_.fit(docs, labels.where("quality = 1"))
    assert re_.score(docs.limit(1), one).first().predicted == 1
    assert re_.score(docs.limit(0), model).count() == 0


def plain_statistics(text):
    import re

    from chronoloom.llm.quality_rules import STOP_WORDS

    text = text or ""
    words = re.findall("[^ \t\n\x0b\x0c\r]+", text)
    lines = [x for x in text.split("\n") if re.search("[^ \t\n\x0b\x0c\r]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    stop = {form for w in STOP_WORDS for form in (w, w.capitalize())}
    chars = sum(map(len, words))
    over = lambda a, b: a / max(b, 1)
    return {
        "words": len(words), "mean_word_length": over(chars, len(words)), "symbols_per_word": over(sum(c in "#*$%&|<>" for c in text), len(words)), "marks_per_word": over(sum(c in "!?" for c in text), len(words)),
        "upper_share": over(sum(c.isupper() and c != "ǅ" for c in text), chars), "stop_word_share": over(sum(w in stop for w in words), len(words)), "repeat_share": over(len(repeated), len(words)),
        "duplicate_line_share": over(len(lines) - len(set(lines)), len(lines)), "words_per_line": over(len(words), len(lines)), "distinct_word_share": over(len(set(words)), len(words)), "digit_share": over(sum(c in "0123456789" for c in text), chars),
    }


def test_every_statistic_equals_a_plain_count(spark):
    texts = [None, "", " \n\t ", "a", "The cat and the cat and the cat.\nThe cat and the cat and the cat.\n\n4 dogs, 17 #tags!", "ÄÖ 123 x\x0by\x0cz ?!", "word " * 50, "\n".join(["same line 1"] * 3 + ["Other line of THE text 22"]), " é " * 7]
    rows = re_.with_statistics(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    for r in rows:
        assert r._stats.asDict() == pytest.approx(plain_statistics(r.text)), r.text
