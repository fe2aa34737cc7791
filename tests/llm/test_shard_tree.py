import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronoloom.llm import shard_tree as st

ROWS = [(i, None if i % 50 == 0 else f"text é {i % 7}" * (i % 5), 3, "clash") for i in range(3000)] + [(7, "again", 1, "x"), (7, "again", 1, "x"), (None, "no id", 1, "x"), (None, None, None, None), (8, "", 0, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, size int, shard string")


def test_sizes_slots_and_growth(docs):
    rows = st.place_with_growth(docs).collect()
    assert len(rows) == len(ROWS)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in ROWS)
    for s in range(16):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots))) and 120 < len(slots) < 260
    moved = [r for r in rows if r.grown_shard != r.shard]
    assert {r.grown_shard for r in moved} == {16} and 110 < len(moved) < 260
    assert len({r.shard for r in rows if r.doc_id == 7}) == 1


def test_weights_decide_shares_and_only_grown_subtrees_gain(spark):
    ids = spark.range(20000).withColumnRenamed("id", "doc_id")
    before = st.Tree((((1.0, 3.0), (2.0,)), ((2.0, 2.0, 0.0),)))
    after = st.Tree((((1.0, 3.0), (2.0,)), ((2.0, 4.0, 0.0),)))
    rows = ids.select(st.shard_of(F.col("doc_id"), before).alias("a"), st.shard_of(F.col("doc_id"), after).alias("b")).collect()
    share = Counter(r.a for r in rows)
    for shard, weight in enumerate((1, 3, 2, 2, 2, 0)):
        assert abs(share[shard] / 20000 - weight / 10) < 0.02
    region = lambda s: 0 if s < 3 else 1
    assert all(r.a == r.b or region(r.b) == 1 for r in rows)  # nothing moves into, or within, region 0
    assert all(r.a == r.b or r.b == 4 for r in rows if region(r.a) == 1)


def test_chain_of_growth_moves_only_into_the_new_shard(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    tree, trees = st.SIXTEEN, []
    for _ in range(3):
        trees.append(tree)
        tree = tree.grown()
    rows = ids.select(*[st.shard_of(F.col("doc_id"), t).alias(f"t{i}") for i, t in enumerate(trees)]).collect()
    for i in range(2):
        assert {r[i + 1] for r in rows if r[i] != r[i + 1]} == {16 + i}


def test_empty(docs):
    assert st.place_with_growth(docs.limit(0)).count() == 0


def test_no_python_in_plan(docs):
    plan = st.place_with_growth(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("PythonRDD", "") and "Arrow" not in plan
