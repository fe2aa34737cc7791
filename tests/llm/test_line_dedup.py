import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoloom.llm import line_dedup as ld


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        above, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(above[j + 1] + 1, row[j] + 1, above[j] + (x != y)))
    return row[-1]


@settings(max_examples=500, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", max_size=14), st.integers(0, 5))
def test_banded_distance(a, b, limit):
    assert ld.edit_distance_within(a, b, limit) == min(plain_distance(a, b), limit + 1)


@settings(max_examples=300, deadline=None)
@given(st.text("abcdé", min_size=20, max_size=40), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 39), st.sampled_from("abxyé")), max_size=2))
def test_every_pair_within_the_threshold_meets(line, edits):
    other = line
    for kind, at, c in edits:
        at = min(at, len(other))
        other = other[:at] + c + other[at:] if kind == 0 else other[:at] + other[at + 1 :] if kind == 1 else other[:at] + c + other[at + 1 :]
    if other == line or len(other) < ld.MIN_CHARS:
        return
    rows = next(ld._filed(iter([ld.pa.RecordBatch.from_arrays([ld.pa.array([line + "\n" + other])], names=["text"])])))
    a, b = ld.candidate_pairs(*[rows.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1)], rows.column(2).to_numpy(zero_copy_only=False).view(np.uint32))
    assert sorted({*a.tolist(), *b.tolist()}) == sorted({ld.line_id(line), ld.line_id(other)}) and len(a) == 1


def mutate(rng, line, n):
    for _ in range(n):
        at = rng.randrange(len(line))
        line = rng.choice([line[:at] + line[at + 1 :], line[:at] + "~" + line[at:], line[:at] + "#" + line[at + 1 :]])
    return line


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([8, 19, 24, 60, 200]))) for _ in range(60)]
    docs = []
    for d in range(80):
        own = [mutate(rng, rng.choice(lines), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randrange(1, 7))]
        docs.append((d, "\n".join(["the very common line of all documents", *own, "", "  "])))
    return docs + [(500, None), (501, ""), (502, "\n\n"), (503, "x" * 30_000), (504, "x" * 29_999 + "y"), (None, "the very common line of all documents"), (7, docs[7][1])]


def plain_classes(rows):
    lines = [(d, i, x) for d, t in rows for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\r\x0b\x0c")]
    texts = sorted({x for _, _, x in lines})
    label = {x: x for x in texts}
    degree = dict.fromkeys(texts, 0)

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if min(len(a), len(b)) >= 20 and abs(len(a) - len(b)) <= 2 and ld.edit_distance_within(a, b, 2) <= 2:
                label[find(a)] = find(b)
                degree[a] += 1
                degree[b] += 1
    first = {}
    for d, i, x in lines:
        key = (d is None, d, i)
        root = find(x)
        first[root] = min(first.get(root, key), key, key=lambda k: (k[0], k[1] or 0, k[2]))
    return [(d, i, first[find(x)][1], first[find(x)][2], degree[x], (d, i) == first[find(x)][1:]) for d, i, x in lines]


def test_equals_brute_force(spark, rows):
    docs = spark.createDataFrame([(d, t, 1, "clash") for d, t in rows], "doc_id long, text string, line_no int, kept string")
    got = [tuple(r) for r in ld.line_classes(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_classes(rows)))
    assert sum(r[4] for r in got) > 50


def test_texts_without_repeated_lines(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dropped = {(d, i) for d, i, *_, kept in plain_classes(rows) if not kept}
    want = [(d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in dropped)) for d, t in rows]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in ld.drop_repeated_lines(docs).collect())


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ld.line_classes(empty).count() == 0 and ld.drop_repeated_lines(empty).count() == 0


def test_short_lines_of_the_query(spark, tmp_path):
    from chronoloom.llm import queries

    rng = random.Random(9)
    near = [mutate(rng, "".join(rng.choice("abc") for _ in range(rng.randrange(5, 24))), rng.choice([0, 1])) for _ in range(150)]
    near += [mutate(rng, x, k) for x in near for k in (1, 2)]
    texts = ["Der eingeä erer.", "Der, eingeä erer.", "Ly reonhe onble.", "Ly. Reonhe onble.", "cat", "cut", *near]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.n_links for r in queries.op1_line_edit_join(spark, str(tmp_path)).collect()}
    apart = lambda a, b: plain_distance(a, b) <= min(2, min(len(a), len(b)) // 8)
    different = sorted(set(texts))
    assert got == {i: sum(x != y and abs(len(x) - len(y)) <= 2 and apart(x, y) for y in different) for i, x in enumerate(texts) if x.strip()}
    assert got[0] == got[1] == got[2] == got[3] == 1 and got[4] == got[5] == 0


@pytest.mark.parametrize("bits", [64, 6, 3])
def test_wordless_lines_and_equal_ids(spark, bits):
    """With few bits most lines share an id with others, and near ones with each other; links stay the same."""
    rng = random.Random(3)
    lines = ["".join(rng.choice("abcdef") for _ in range(24)) for _ in range(20)]
    texts = [" " * 24, "ab" + " " * 22, " " * 22 + "cd", "\t" * 24, " " * 23 + "\x0b", *lines, *(mutate(rng, x, k) for x in lines for k in (1, 2, 2))]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    got = sorted(tuple(r) for r in ld.line_classes(docs, bits=bits).collect())
    assert got == sorted(plain_classes(list(enumerate(texts)))) and [r[0] for r in got][:2] == [1, 2]
    assert [r[4] for r in got][:2] == [0, 0]  # more than two edits apart; what both are near to is no line


def test_ids_are_those_of_the_column(spark):
    texts = ["a line", "é ü 漢", "x" * 5000, " z"]
    rows = spark.createDataFrame([(x,) for x in texts], "line string").select("line", ld.line_id_column(F.col("line")).alias("whole"), ld.line_id_column(F.col("line"), 5).alias("few"))
    assert all(r.whole % (1 << 64) == ld.line_id(r.line) and r.few == ld.line_id(r.line, 5) for r in rows.collect())


def test_hot_keys_lose_no_pair(monkeypatch):
    """Keys that many lines file are compared by blocks of the sketch: fewer comparisons, the same pairs."""
    rng = np.random.default_rng(4)
    n = 3000
    sketches = rng.integers(0, 1 << 32, n, dtype=np.uint64)
    for i in range(1, n, 3):  # near ones: one or two classes changed by one
        sketches[i] = sketches[i - 1] ^ np.uint64(1 << int(2 * rng.integers(16))) ^ np.uint64(1 << int(2 * rng.integers(16)))
    sketches = sketches.astype(np.uint32)
    keys = np.concatenate([np.full(n, 8, np.uint64), np.full(n, 9, np.uint64), rng.integers(0, 1 << 20, n).astype(np.uint64)])
    ids = np.concatenate([np.arange(n), np.arange(n), np.arange(n)]).astype(np.uint64)
    rows = keys, ids, np.concatenate([sketches] * 3)
    found = ld.candidate_pairs(*rows)
    monkeypatch.setattr(ld, "HOT", n)
    every = ld.candidate_pairs(*rows)
    assert len(every[0]) > 900 and all((a == b).all() for a, b in zip(found, every))


def plain_links(texts, rule):
    """n_links of each text, and the least text of its class."""
    different = sorted({x for x in texts if x.strip()})
    links, label = dict.fromkeys(different, 0), {x: x for x in different}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(different):
        for b in different[i + 1 :]:
            words = len(a.split()), len(b.split())
            if rule.words and min(words) >= ld.WORD_LINE:
                limit = rule.words(min(words))
                near = abs(words[0] - words[1]) <= limit and plain_distance(a.split(), b.split()) <= limit
            else:
                limit = rule.chars(min(len(a), len(b)))
                near = abs(len(a) - len(b)) <= limit and plain_distance(a, b) <= limit
            if near:
                links[a] += 1
                links[b] += 1
                label[max(find(a), find(b))] = min(find(a), find(b))
    return links, {x: find(x) for x in different}


def check_links(spark, texts, rule, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in ld.line_classes(docs, rule, **how).collect()}
    links, label = plain_links(texts, rule)
    first = {}
    for i, x in enumerate(texts):
        if x.strip():
            first.setdefault(label[x], i)
    assert {i: (r.n_links, r.class_doc_id) for i, r in got.items()} == {i: (links[x], first[label[x]]) for i, x in enumerate(texts) if x.strip()}
    return got


def templated(rng, n):
    found = [f"Page {rng.randrange(10**4):05d} of the yearly report" for _ in range(n)]
    found += [f"{rng.randrange(30):02d}.{rng.randrange(12):02d}.2020 | item {rng.randrange(99)} | {rng.choice(['yes', 'no'])}" for _ in range(n)]
    return found + [f"Seite {k} von 99" for k in range(n // 4)] + ["Page 123 of the yearly report", "xPage 00001 of the yearly report"]


@pytest.mark.parametrize("portion", [1 << 20, 900, 1])
def test_a_unit_gives_each_link_once(monkeypatch, portion):
    monkeypatch.setattr(ld, "PORTION", portion)
    lines = templated(random.Random(6), 40) + ["", "Page"]
    n, rule = len(lines), ld.Rule(ld.all_lines)
    near = {(i, j) for i in range(n) for j in range(i + 1, n) if lines[i] != lines[j] and rule.linked(lines[i], lines[j])}
    same = {(i, j) for i in range(n) for j in range(i + 1, n) if lines[i] == lines[j]}
    every, half = np.ones(n, bool), np.arange(n) < n // 2
    for first, second in ((every, every), (half, ~half)):
        found = [p for a, b, _ in ld._Unit(0, lines, first, second, [[0]] * n, rule).links() for p in zip(a.tolist(), b.tolist())]
        inside = {(i, j) for i, j in near if (first[i] and second[j]) and (first is second or half[i] != half[j])}
        assert len(found) == len(set(found)) and set(found) - same == inside


def test_templated_lines_meet_in_blocks(spark):
    """Crowded keys give the classes and numbers of links of a comparison of all lines."""
    texts = templated(random.Random(5), 100)
    for many, block in ((30, 16), (60, 200), (10_000, 10)):
        check_links(spark, texts, ld.Rule(ld.all_lines), many=many, block=block)


def changed_words(rng, line, n):
    words = line.split()
    for _ in range(n):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[at] = f"new{rng.randrange(99)}"
        elif kind == 1:
            words.insert(at, "more")
        else:
            del words[at]
    return " ".join(words)


def test_long_lines_link_by_words(spark):
    rng = random.Random(7)
    lines = [" ".join(f"w{rng.randrange(500)}" for _ in range(n)) for n in (22, 23, 24, 25, 26, 30, 60, 63, 64, 130, 300)]
    texts = lines + [changed_words(rng, x, k) for x in lines for k in (1, 2, 3, 4, 6)] + [mutate(rng, x, 2) for x in lines] + [x.replace(" ", "  ", 1) for x in lines] + [x.replace(" ", "", 1) for x in lines]
    got = check_links(spark, texts, ld.GROWING)
    assert got[6].n_links > 0 and sum(r.n_links for r in got.values()) > 100
    check_links(spark, texts, ld.GROWING, many=8, block=5)
    one = "word " * 59 + "old"
    assert [r.n_links for r in ld.line_classes(spark.createDataFrame([(1, one), (2, one.replace("old", "replacement"))], "doc_id long, text string"), ld.GROWING).collect()] == [1, 1]


def test_many_counter_lines_have_the_links_of_a_comparison_of_all(spark):
    """Two thousand lines of one template, against a table of distances of all pairs of their numbers."""
    n = 2000
    digits = np.array([[int(c) for c in f"{i:05d}"] for i in range(n)], np.int8)
    i, j = np.triu_indices(n, 1)
    a, b = digits[i], digits[j]
    table = np.zeros((6, 6, len(i)), np.int8)
    table[:, 0], table[0] = np.arange(6)[:, None], np.arange(6)[:, None]
    for x in range(1, 6):
        for y in range(1, 6):
            table[x, y] = np.minimum(np.minimum(table[x - 1, y], table[x, y - 1]) + 1, table[x - 1, y - 1] + (a[:, x - 1] != b[:, y - 1]))
    near = table[5, 5] <= 2
    links = np.bincount(i[near], minlength=n) + np.bincount(j[near], minlength=n)
    docs = spark.createDataFrame([(k, f"Page {k:05d} of the yearly report") for k in range(n)], "doc_id long, text string").repartition(3)
    for block in (ld.BLOCK, 300):
        got = ld.line_classes(docs, ld.GROWING, block=block).collect()
        assert {r.doc_id: r.n_links for r in got} == dict(enumerate(links.tolist())) and {r.class_doc_id for r in got} == {0}


def test_edits_grow_with_the_line():
    assert [ld.word_edits(n) for n in (24, 63, 127, 128, 255, 256, 1024, 10_000)] == [2, 2, 2, 3, 3, 4, 6, 9]


@pytest.mark.parametrize("limit", [1, 2, 3, 5])
def test_many_distances_at_once(limit):
    rng = random.Random(limit)
    pairs = []
    for _ in range(400):
        a = [rng.randrange(3) for _ in range(rng.randrange(9))]
        b = list(a) if rng.random() < 0.7 else [rng.randrange(3) for _ in range(rng.randrange(9))]
        for _ in range(rng.randrange(4)):
            if b and rng.random() < 0.5:
                del b[rng.randrange(len(b))]
            else:
                b.insert(rng.randrange(len(b) + 1), rng.randrange(3))
        pairs.append((a, b))
    sides = []
    for side in (0, 1):
        table = np.full((len(pairs), max(len(p[side]) for p in pairs) + 1), -1, np.int64)
        for k, p in enumerate(pairs):
            table[k, : len(p[side])] = p[side]
        sides.append((table, np.array([len(p[side]) for p in pairs])))
    got = ld._same_band(sides[0][0], sides[1][0], sides[0][1], sides[1][1], limit)
    assert got.tolist() == [plain_distance(a, b) <= limit for a, b in pairs]
