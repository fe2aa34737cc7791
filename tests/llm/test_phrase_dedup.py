import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import phrase_dedup as pd


def plain(texts):
    """n_words, n_removed and kept words of each text, window by window."""
    words = [(t or "").encode().split() for t in texts]
    windows = Counter(tuple(w[i : i + pd.WINDOW]) for w in words for i in range(len(w) - pd.WINDOW + 1))
    found = []
    for w in words:
        gone = {j for i in range(len(w) - pd.WINDOW + 1) if windows[tuple(w[i : i + pd.WINDOW])] > 1 for j in range(i, i + pd.WINDOW)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        found.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return found


def run(spark, texts, ids=None):
    rows = list(zip(ids or range(len(texts)), texts))
    docs = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], "doc_id long, text string, key string, n int, words int")
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in pd.remove_repeats(docs.repartition(3)).collect()]
    want = [(i, *w) for (i, _), w in zip(rows, plain(texts))]
    assert sorted(got, key=str) == sorted(want, key=str)
    return {r[0]: r for r in got}


def words_of(rng, n, size=4000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    passage, other, edge = words_of(rng, 90), words_of(rng, 35), words_of(rng, 34)
    join = " ".join
    found = [join(words_of(rng, 60) + passage + words_of(rng, 40)) for _ in range(6)]
    found += [join(words_of(rng, 50) + passage[20:70]), join(passage[:36]), join(passage[55:]) + "\n", join(other), "x " + join(other), join(edge + ["a"]), join(edge + ["b"])]
    found += ["", " \n\t", None, join(words_of(rng, 34)), join(words_of(rng, 35))]
    copy = join(words_of(rng, 200))
    found += [copy, copy, copy.replace(" ", "\n\v "), copy.upper()]
    found += [" ".join(["la"] * 36), " ".join(["lo"] * 35), " ".join(["li"] * 34), " ".join(["a", "b", "c"] * 20)]
    found += [join(words_of(rng, 30) + copy.split()[k : k + 60] + passage[k % 50 : k % 50 + 40]) for k in range(0, 140, 20)]
    found += ["é " * 50 + join(words_of(rng, 5)), join(words_of(rng, 9000) + passage), " ".join(words_of(rng, 50)), "_" * 100_000]
    return found


def test_equals_brute_force(spark, texts):
    run(spark, texts)


def test_null_equal_and_repeated_ids(spark, texts):
    run(spark, [texts[0], texts[0], texts[1], None, "short"], [None, None, 7, 7, 7])
    got = run(spark, [texts[0]] * 2, [1, 1])
    assert got[1][2] == got[1][1]


def test_empty_table(spark):
    assert pd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_kept_text_is_null_where_all_stays(spark, texts):
    docs = spark.createDataFrame([(1, "alone " * 3), (2, texts[18]), (3, texts[18])], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in pd.remove_repeats(docs).collect()} == {1: None, 2: "", 3: ""}


@pytest.mark.parametrize("seed", range(3))
def test_few_different_words_make_many_repeats(spark, seed):
    rng = random.Random(seed)
    run(spark, [" ".join(words_of(rng, rng.randrange(20, 160), 2)) for _ in range(12)] + [" ".join(["z"] * k) for k in (35, 36, 80, 200)])


def test_a_hot_line_in_all_texts(spark):
    rng = random.Random(1)
    line = words_of(rng, 20) + ["common"] + words_of(rng, 20)
    got = run(spark, [" ".join(words_of(rng, 30) + line + words_of(rng, 30)) for _ in range(300)])
    assert all(r[2] >= 41 for r in got.values())


def test_pieces_of_very_long_texts(spark, texts, monkeypatch):
    """A worker hashes long texts in pieces; the spans cover the same windows, each once."""
    rng = random.Random(2)
    words = pd.word_hashes(" ".join(words_of(rng, 3000, 50)).encode())
    first, length, anchor, place = pd.spans_of(words, np.array([len(words)]))
    assert ((place + pd.ANCHOR <= pd.WINDOW) & (place >= length - 1)).all()
    assert first[0] == 0 and (first[1:] == (first + length)[:-1]).all() and (first + length)[-1] == 3000 - pd.WINDOW + 1
    monkeypatch.setattr(pd, "PORTION_WINDOWS", 700)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()), "key": pa.array([b"k", b"l"]), "text": pa.array([" ".join(words_of(random.Random(2), 3000, 50)).encode(), b"a b"])})
    (got,) = pd._anchors(iter([batch]))
    shapes, anchors = (np.array(got.column(c)[0].as_py()) for c in ("shapes", "anchors"))
    firsts, lengths = shapes >> pd.PLACE_BITS + pd.LENGTH_BITS, shapes >> pd.PLACE_BITS & (1 << pd.LENGTH_BITS) - 1
    assert (firsts[1:] == (firsts + lengths)[:-1]).all() and (firsts + lengths)[-1] == 3000 - pd.WINDOW + 1
    assert set(anchors) == set(anchor.view(np.int64)) and got.column("anchors")[1].as_py() == []


def test_automaton_finds_words_at_edges():
    rng = random.Random(3)
    words = [w.encode() for w in words_of(rng, 60)]
    automaton = pd.PhraseAutomaton()
    assert automaton.covered(b" ".join(words), True) == []
    digests = pd._windows(words)
    automaton.add(b" ".join(words[22:34]).decode(), None)
    for k in (3, 4, 5, 20):
        automaton.add(None, pd._digest(*np.frombuffer(digests[k], "<i8").tolist()))
    assert automaton.covered(b" ".join(words), False) == [(3, 55)]
    assert automaton.covered(b" ".join(words[4:39]), False) == [(0, 35)]
    assert automaton.covered(b" ".join(words[5:45]), False) == [(0, 35)] and automaton.covered(b" ".join(words[5:45]), True) == [(0, 40)]
    assert automaton.covered(b" ".join(words[4:38]), False) == [] and automaton.covered(b"x" + b" ".join(words[4:39]), False) == []


def test_sql(spark, tmp_path, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = str(tmp_path / "d")
    docs.coalesce(1).write.parquet(path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    got = pd.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(db.execute(pd.oracle()).fetchall())
    assert pd.remove_repeats(docs).where(F.col("n_removed") > 0).count() > 20
