from itertools import permutations

import duckdb
import numpy as np
import pytest

from chronoloom.llm import filter_audit as fa

LONG = " ".join(f"word{i}" for i in range(250))
ROWS = [
    (1, LONG, "en"), (2, LONG, "en"), (3, LONG, None), (4, LONG, ""), (2, LONG, "en"), (None, LONG, "en"), (5, None, "de"), (6, "", "de"), (7, " \n\t", "de"), (8, "a " * 300, "en"), (9, "A B C", "fr"),
    (10, "price # 5", "fr"), (11, LONG.upper(), "en"), (12, LONG + " |", "en"), (13, "a " * 120 + LONG[:900], "es"), (14, "é" * 300, "es"), (15, LONG + " X" * 6, "en"), (16, "x\x0by\x0cz", "fr"), (17, "Word word", "fr"),
    (18, " ".join(f"w{i % 100}" for i in range(200)), "en"), (19, " ".join(f"w{i % 99}" for i in range(200)), "en"), (20, LONG * 40, "en"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (6, 1, None), (8, None, 1), (None, 1, 1), (99, 1, 1), (11, 1, 1), (10, 0, 1)]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, t, lang, "clash", 3) for i, t, lang in ROWS], "doc_id long, text string, lang string, part string, good int").repartition(3)
    return docs, spark.createDataFrame([(*r, "clash") for r in LABELS], "doc_id long, quality int, toxic int, text string")


def plain():
    docs = []
    for i, text, lang in ROWS:
        text = text or ""
        words = text.encode().split()
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), "D": any(c in "#$%&*|" for c in text)}
        fails["E"] = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in ROWS)
        mine = [r for r in LABELS if i is not None and r[0] == i]
        docs.append((lang or "", {f for f in fails if fails[f]}, any(r[1] == 1 for r in mine), any(r[2] == 1 for r in mine)))
    found = {}
    for part in {d[0] for d in docs}:
        own, total = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                earlier = sum(f in d[1] and bool(d[1] & set(order[:k])) for d in own)
                found[part, order, k + 1] = [len(left), len(gone), earlier, sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                total[f] += len(gone)
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                found[part, order, k + 1].append(total[f])
    return {k: tuple(v) for k, v in found.items()}


NAMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_equals_walking_every_order(tables):
    got = {(r.part, r.filter_order, r.step): tuple(r[n] for n in NAMES) for r in fa.audit(fa.flags(*tables)).collect()}
    assert got == plain() and len(got) == 600 * 5


def test_sql(spark, tables, tmp_path):
    db = duckdb.connect()
    for name, df in zip(("documents", "labels"), tables):
        df.coalesce(1).write.parquet(str(tmp_path / name))
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path / name}/*.parquet'")
    columns = ["part", "filter_order", "step", *NAMES]
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({fa.oracle()})").fetchall()
    assert sorted(want) == sorted(map(tuple, fa.audit(fa.flags(*tables)).select(columns).collect()))


def test_shards_hold_the_matrix(spark, tables, monkeypatch):
    """Ids mean the same word in every shard, and each word has one id."""
    docs = tables[0].selectExpr("struct(doc_id) AS row", "text")
    texts = {}
    for i, t, _ in ROWS:
        texts.setdefault(i, []).append(sorted((t or "").encode().split()))
    shards = fa.document_terms(docs).collect()
    assert len(shards) > 1
    seen = {}
    for s in shards:
        for k, row in enumerate(s.rows):
            ids, counts = s.ids[s.at[k] : s.at[k + 1]], s.counts[s.at[k] : s.at[k + 1]]
            assert len(set(ids)) == len(ids)
            options = [w for w in texts[row.doc_id] if len(set(w)) == len(ids) and len(w) == sum(counts)]
            assert options
            if len(options) == 1 and len(set(counts)) == len(counts):
                for word in set(options[0]):
                    n = options[0].count(word)
                    assert seen.setdefault(word, ids[counts.index(n)]) == ids[counts.index(n)]
    words = {w for many in texts.values() for one in many for w in one}
    assert len({i for s in shards for i in s.ids}) == len(words)


def test_empty_tables(spark, tables):
    docs, labels = tables
    assert fa.audit(fa.flags(docs.limit(0), labels)).count() == 0
    none = fa.audit(fa.flags(docs, labels.limit(0)))
    assert none.count() == 3000 and none.where("good_lost + toxic_lost > 0").count() == 0
    wordless = spark.createDataFrame([(1, None, None), (2, "  ", None)], "doc_id long, text string, lang string")
    assert {r.part for r in fa.audit(fa.flags(wordless, labels)).collect()} == {""}


def test_row_sums_of_facts():
    assert fa.text_facts("Äé A#b\U0001f642".encode())[:3] == (7, 1, 1)
    assert np.array_equal(fa._hashes([b"a", b"a"]), fa._hashes([b"a"] * 2))
