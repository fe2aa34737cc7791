import random
from collections import Counter
from fractions import Fraction

import pytest

from chronoloom.llm import decontam as dc


def plain(docs, items):
    """{(doc, item): best similarity} over every item-sized window."""
    found = {}
    for d, text in docs:
        words = (text or "").lower().split()
        for i, item in items:
            goal = (item or "").lower().split()
            if not goal or not words:
                continue
            w = min(5, len(goal))
            size = len(goal) - w + 1
            n = len(words) - w + 1
            bag = Counter(tuple(goal[k : k + w]) for k in range(size))
            best = Fraction(0)
            for s in range(max(0, n - size) + 1 if n > 0 else 0):
                own = Counter(tuple(words[k : k + w]) for k in range(s, min(s + size, n)))
                both = sum((own & bag).values())
                best = max(best, Fraction(both, sum((own | bag).values())))
            if best >= Fraction(4, 5):
                found[d, i] = float(best)
    return found


@pytest.fixture(scope="module")
def case():
    rng = random.Random(2)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrs")
    items = [(i, " ".join(word() for _ in range(rng.choice([15, 22, 22, 40, 60])))) for i in range(30)]
    items += [(100, "Only Three words"), (101, ""), (102, None), (103, items[0][1]), (104, "same same same same same same same same same same")]
    docs = []
    for d in range(120):
        body = [word() for _ in range(rng.choice([3, 40, 200]))]
        if d % 2:
            passage = rng.choice(items[:30])[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                k = rng.randrange(len(passage))
                passage[k : k + 1] = rng.choice([[], [word()], [word(), word()]])
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage
        docs.append((d, " ".join(body).upper() if d % 5 == 0 else " ".join(body)))
    docs += [(900, None), (901, ""), (902, "x only three words y"), (903, items[3][1]), (904, "same " * 5000), (905, items[4][1] + "\n" + items[5][1]), (905, items[4][1])]
    return docs, items


def run(spark, case, **more):
    docs, items = case
    d = spark.createDataFrame([(i, t, 1, "clash") for i, t in docs], "doc_id long, text string, item_id int, similarity string")
    b = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    return d, b, dc.find_contamination(d, b, **more)


def test_equals_brute_force(spark, case):
    docs, items = case
    rows = run(spark, case)[2].collect()
    got = {(r.doc_id, r.item_id): r.similarity for r in rows}
    want = plain(docs, items)
    assert got == pytest.approx(want) and len(rows) >= len(want)
    texts = dict(docs)
    for r in rows:
        if r.similarity == 1 and r.doc_id != 905:
            assert Counter(texts[r.doc_id].lower().split()[r.start_word : r.start_word + r.n_words]) == Counter(dict(items)[r.item_id].lower().split())


def test_blocks_of_items_give_the_same(spark, case):
    one = run(spark, case)[2].collect()
    many = run(spark, case, broadcast_bytes=4096)[2].collect()
    assert sorted(one) == sorted(many)


def test_drop_keeps_clean_rows(spark, case):
    docs, items = case
    d, b, _ = run(spark, case)
    dirty = {k for k, _ in plain(docs, items)}
    kept = dc.drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, _ in docs if k not in dirty)


def test_empty_tables(spark, case):
    d, b, _ = run(spark, case)
    assert dc.find_contamination(d.limit(0), b).count() == 0
    assert dc.find_contamination(d, b.limit(0)).count() == 0
    assert dc.drop_contaminated(d, b.limit(0)).count() == d.count()
