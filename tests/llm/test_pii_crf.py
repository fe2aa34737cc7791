import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoloom.llm import pii_crf as crf


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(map(int, str(2 * d)))
    return total % 10 == 0


def plain(text):
    spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    spans += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= sum(c.isdigit() for c in m[0]) <= 19 and plain_luhn(re.sub("[ -]", "", m[0]))]
    spans += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(spans, key=lambda s: (s[1], crf.KINDS.index(s[0])))


TEXT = "é mail a.b+c@mail8.example.com or x@y, call +1 (988) 555-2485 now. Card 4111 1111 1111 1111, not 4111 1111 1111 1112; ip 10.0.0.1 and 300.1.2.3 v4.0."


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.+- ()0123459\né_", max_size=60))
def test_patterns_equal_plain_versions(text):
    assert crf.base_spans(text) == plain(text)


def test_patterns_on_prose():
    assert crf.base_spans(TEXT) == plain(TEXT) and [k for k, *_ in plain(TEXT)] == ["email", "phone", "card", "ip"]


@pytest.mark.parametrize("text", ["a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000, "1 " * 100_000, "@" * 100_000])
def test_long_runs_take_linear_time(text):
    crf.all_spans(text, None)


@pytest.fixture(scope="module")
def weights():
    return crf.fit([TEXT + f" Or +44 20 7946 0{i:03d} and u{i}@h{i}.example.org from 192.168.{i}.7, page {i} of 4{i}." for i in range(60)])


def test_field_carries_labels_to_repeats_only(weights):
    text = "Ring +1 (736) 555-2678 today. Room 555-9999 is free. Later, 555-2678 again; year 1999, chapter 12, 4041894974608796."
    spans = crf.all_spans(text, weights)
    at = text.rindex("555-2678")
    assert spans == [("phone", 5, 22), ("phone", at, at + 8)]


def test_chain_of_repeats_and_far_distance(weights):
    middle = "word " * 5000
    text = f"+1 (736) 555-2678 {middle} 5552678 {middle} 555-2678"
    spans = crf.all_spans(text, weights)
    assert [text[s:e] for _, s, e in spans] == ["+1 (736) 555-2678", "5552678", "555-2678"]


def test_nothing_is_added_without_evidence(weights):
    for text in ("", "plain words", "room 555-2678 and 555-2678 again", "4041894974608796 twice 4041894974608796", "v1.2.3 in 2024"):
        assert crf.all_spans(text, weights) == []


def test_message_passing_is_exact_on_a_tree(weights):
    import itertools

    import numpy as np

    text = "+1 (736) 555-2678 77 x 555-2678 88"
    sites = crf.sites_of(text, crf.base_spans(text))
    edges, kinds = crf.graph(sites)
    total = np.zeros((len(sites), 5))
    for labels in itertools.product(range(5), repeat=len(sites)):
        if any(s.label is not None and s.label != lab for s, lab in zip(sites, labels)):
            continue
        score = sum(weights.unary[lab] @ crf.features(s.token) for s, lab in zip(sites, labels))
        score += sum(weights.pair[k][labels[i], labels[j]] for (i, j), k in zip(edges, kinds))
        for i, lab in enumerate(labels):
            total[i, lab] += np.exp(score)
    assert np.abs(crf.propagate(weights, sites) - total / total.sum(axis=1, keepdims=True)).max() < 0.02


def test_query_columns(spark):
    rows = [(1, TEXT, 5), (1, TEXT, 5), (2, None, 0), (3, "", 0), (None, "x@y.zz", 1), (4, "w " * 50_000 + "p@q.rr", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_email int")
    got = {r.doc_id: r for r in crf.digest(crf.find_personal_data(docs)).collect()}
    assert crf.find_personal_data(docs).count() == 6
    for d, text, _ in rows:
        want = plain(text or "")
        assert got[d].base_sha256 == hashlib.sha256(crf.joined(want).encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in crf.KINDS] == [sum(s[0] == k for s in want) for k in crf.KINDS]
        assert set(crf.joined(want).split(",")) <= set(got[d].spans.split(","))
    assert crf.find_personal_data(docs.limit(0)).count() == 0


SPACED = [("+33 6 12 34 56 78", "6 12 34 56 78"), ("+33 6 12 34 56 78", "06 12 34 56 78"), ("+33 6 12 34 56 78", "612345678"), ("+33 612345678", "6 12 34 56 78"), ("4111 1111 1111 1111", "1111 1111 1111"), ("5500 0055 5555 5559", "0055 5555 5559.")]


@pytest.fixture(scope="module")
def spaced_weights():
    cards = [n for n in map(str, range(4041894974608796, 4041894974620000, 7)) if plain_luhn(n)]
    return crf.fit([f"Call +1 ({300 + i}) 555-{2000 + 37 * i} now, card {cards[i]} or u{i}@h{i}.example.org, {i} of 17, from 10.0.{i}.7 in 1999." for i in range(60)])


@pytest.mark.parametrize("full,repeat", SPACED)
def test_spaced_numbers_are_found_again(spaced_weights, full, repeat):
    text = f"Ring {full} today. Later {repeat} once more; page 12 of 34, year 1999 and 7 18 29 30 41 52."
    (_, s, e), *more = crf.all_spans(text, spaced_weights)
    assert text[s:e] == full and [text[s:e] for _, s, e in more] == [repeat.rstrip(".")]


def test_groups_of_digits_link_however_they_are_spaced():
    sites = crf.sites_of("12 34 56 78 then 1234 5678 then 9234 5678, 12 34 then 12 34 56 79", [])
    edges, kinds = crf.graph(sites)
    skips = {tuple(e) for e, k in zip(edges.tolist(), kinds) if k}
    assert skips == {(0, 4), (1, 4), (2, 5), (3, 5), (4, 6), (5, 7)}
    assert crf.graph(crf.sites_of("1 " * 1000, []))[1].sum() <= 1000


def exact_marginals(weights, sites):
    import itertools

    import numpy as np

    edges, kinds = crf.graph(sites)
    total = np.zeros((len(sites), 5))
    for labels in itertools.product(*[range(5) if s.label is None else [s.label] for s in sites]):
        score = sum(weights.unary[lab] @ crf.features(s.token) for s, lab in zip(sites, labels))
        score += sum(weights.pair[k][labels[i], labels[j]] for (i, j), k in zip(edges, kinds))
        for i, lab in enumerate(labels):
            total[i, lab] += np.exp(score)
    return total / total.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("text", [
    "+1 (736) 555-2678 or 555-2678 12 555-2678 so 555-2678",
    "736-2678 555-2678 736-2678 555-2678 +1 (736) 555-2678",
    "u8@mail.example.org u8@mail.example.org 77 u8@mail.example.org 77 4041894974608796 4041894974608796",
])
def test_message_passing_on_graphs_with_loops(weights, text):
    import numpy as np

    sites = crf.sites_of(text, crf.base_spans(text)[:1])
    assert len(crf.graph(sites)[0]) >= len(sites)  # not a tree
    exact, found = exact_marginals(weights, sites), crf.propagate(weights, sites)
    assert (exact.argmax(axis=1) == found.argmax(axis=1)).all() and np.abs(exact - found).max() < 0.1


def test_messages_in_portions_are_the_same(weights, monkeypatch):
    import numpy as np

    sites = crf.sites_of("+1 (736) 555-2678 " + "555-2678 or 12 34 " * 30, [("phone", 0, 17)])
    whole = crf.propagate(weights, sites)
    monkeypatch.setattr(crf, "PORTION", 7)
    assert np.abs(whole - crf.propagate(weights, sites)).max() < 1e-9


@pytest.fixture(scope="module")
def trained():
    cards = [n for n in map(str, range(4041894974608796, 4041894974620000, 7)) if plain_luhn(n)]
    texts = [f"Call +1 ({300 + i}) 555-{2000 + 37 * i} now, card {cards[i]} or u{i}@h{i}.example.org, {i} of 17, from 10.{i}.0.{7 + i} in 1999, no {9041894974608796 + 10 * i}." for i in range(80)]
    return crf.fit(texts + [f"Order {4041894974608790 + 13 * i} of {1990 + i % 30}, twice {4041894974608790 + 13 * i}, v{i}.2.1" for i in range(80) if not plain_luhn(str(4041894974608790 + 13 * i))])


def test_numbers_that_the_patterns_miss_beside_others(trained):
    cards = [n for n in map(str, range(5041894974608796, 5041894974612000, 7)) if plain_luhn(n)]
    text = f"Ring +1 (826) 555-4081 190.137.223.204 or pay {cards[3]} {cards[9]} soon."
    assert [k for k, *_ in crf.base_spans(text)] == ["ip"]
    assert [(k, text[s:e]) for k, s, e in crf.all_spans(text, trained)] == [("phone", "+1 (826) 555-4081"), ("ip", "190.137.223.204"), ("card", cards[3]), ("card", cards[9])]
    other = f"Number 9041894974608791 {cards[5]} alone."
    assert crf.base_spans(other) == [] and [other[s:e] for _, s, e in crf.all_spans(other, trained)] == [cards[5]]


def test_precision_and_recall_of_added_spans(trained):
    import random

    rng = random.Random(8)
    digits = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))

    def card(valid):
        while True:
            found = "4" + digits(15)
            if plain_luhn(found) == valid:
                return found

    hit = added = planted = 0
    for _ in range(300):
        phone, pan, ip, decoy = f"+1 ({rng.randrange(200, 999)}) 555-{digits(4)}", card(True), ".".join(str(rng.randrange(256)) for _ in range(4)), card(False)
        kind = rng.randrange(5)
        told, wanted = [
            (f"Call {phone} now", [phone[9:]]),  # a shortened repeat
            (f"Card {pan} now", [pan[-8:]]),
            (f"At {phone} {ip} now", [phone]),  # a number beside another
            (f"At {decoy} {pan} now", [pan]),
            (f"At {decoy} and {decoy[:12]} now, in {ip}", []),
        ][kind]
        more = "" if kind > 1 else f" and later {wanted[0]} again"
        text = f"Page {rng.randrange(90)} of {rng.randrange(90)}: {told}{more}; room 555-{digits(4)}, no {card(False)}, v{digits(1)}.{digits(1)} in {rng.randrange(1900, 2030)}."
        base = set(crf.base_spans(text))
        found = [text[s:e] for k, s, e in crf.all_spans(text, trained) if (k, s, e) not in base]
        planted, added, hit = planted + len(wanted), added + len(found), hit + len(set(found) & set(wanted))
    assert planted > 200 and hit / added >= 0.95 and hit / planted >= 0.9, (hit, added, planted)
