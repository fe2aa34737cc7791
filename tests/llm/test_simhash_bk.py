import random

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from chronoloom.llm import simhash_bk as sb
from chronoloom.llm.components import connected_components


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lowered) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs):
    prints = {d: f for d, f in pairs}
    ids = sorted(prints)
    label = {d: d for d in ids}

    def find(d):
        while label[d] != d:
            d = label[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "one TWO", "a b c", "É é x y z", "a b c d e f g a b c", "w " * 20000])
def test_fingerprint_equals_plain_version(text):
    assert sb.fingerprint((text or "").encode()) == plain_fingerprint(text)


def test_bk_forest_finds_every_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(12)]))
    groups = np.sort(rng.integers(0, 3, len(prints)))
    for frontier in (7, 1 << 20):
        got = {(int(a), int(b)) for x, y in sb.BKForest(groups, prints).within(3, frontier) for a, b in zip(x, y)}
        want = {(i, j) for i in range(len(prints)) for j in range(len(prints)) if i != j and groups[i] == groups[j] and bin(int(prints[i] ^ prints[j])).count("1") <= 3}
        assert got == want


def test_components_of_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 400)]
    rows = chain + star + [(500, 500), (7, 6), (900, 901)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(rows, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 400)} | {900: 900, 901: 900}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([4, 80, 300]))]
        rows.append((3 * i + 1, " ".join(words)))
        for k in range(rng.choice([0, 0, 2])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((1000 + 10 * i + k, " ".join(words)))
    return rows + [(700, None), (701, ""), (702, " \n "), (703, "x"), (704, "x")]


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "clash", 0) for d, t in rows], "doc_id long, text string, fp string, component_id int")
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in sb.near_duplicate_components(docs).collect()}
    prints = {d: plain_fingerprint(t) for d, t in rows}
    labels = plain_components(prints.items())
    assert got == {d: (prints[d], labels[d]) for d in prints}
    assert got[700][1] == got[702][1] == 700


def test_nulls_repeats_and_empty_table(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "only null ids here"), (9, "something else entirely")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in sb.near_duplicate_components(docs).collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (None, 5), (None, None), (9, 9)], key=str)
    kept = [r.doc_id for r in sb.keep_one_per_component(docs).collect()]
    assert sorted(kept, key=str) == sorted([5, None, None, 9], key=str)
    assert sb.near_duplicate_components(docs.limit(0)).count() == 0
    assert sb.keep_one_per_component(docs.limit(0)).count() == 0


def test_prints_within_the_radius_share_a_choice_of_blocks(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(1, 4)):
            b ^= 1 << bit
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    both = spark.createDataFrame(rows, "a long, b long")
    met = both.select(F.size(F.array_intersect(F.array(*sb.block_keys(F.col("a"))), F.array(*sb.block_keys(F.col("b"))))).alias("n"))
    assert met.where("n = 0").count() == 0
    keys = both.limit(50).select(F.array(*sb.block_keys(F.col("a"))).alias("k")).collect()
    assert all(len(set(r.k)) == 20 for r in keys)


def test_other_types_and_clashing_names(spark):
    rows = [(5, "a b c d", "x", 1), (5, "a b c d", "y", 2), (None, "a b c d", "z", 3), (9, "something else entirely", "w", 4)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _kept string, rank int")
    assert sorted((r.doc_id, r.component_id) for r in sb.near_duplicate_components(docs).collect() if r.doc_id) == [(5, 5), (5, 5), (9, 9)]
    kept = sb.keep_one_per_component(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[2], rows[3]], key=str)
