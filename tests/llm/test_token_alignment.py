import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from chronoloom.llm import token_alignment as ta

FILES = ta.read_files()
TEXTS = [
    None, "", " ", "  ", "a", " a", "Hello world", "Hello  world \n\n  again\t tab  x", "été à la plage, c'était bien. Ça va?", "x▁y", "▁", "<s> a </s> <unk> <|endoftext|> <0x41>",
    "ｆｕｌｌ ① 中文字符 и ещё", "null\x00x \x1c \x1f y", "a​b   c 　d﻿ e", "don't we'll I'M", "𝔘𝔫𝔦 👩‍👩‍👧 ok", "http://a.b/c?d=e&f=1 2024-01-02 3.14", "a \n b\n \nc   d", "é é", "word " * 300, "0123456789" * 30,
    "\n", "\n\n a", "a\n", "tail   ", "  x \u0085 y", "�",
]


@pytest.fixture(scope="module")
def both():
    return ta.Vocabularies(*FILES)


def plain(vocabularies, texts):
    """Whole texts encoded at once, links by byte ranges, counts by sets of documents."""
    held, docs = defaultdict(set), []
    for d, text in enumerate(texts):
        if not text:
            docs.append(None)
            continue
        raw = (" " + text).encode()
        a = vocabularies.a.encode(" " + text, add_special_tokens=False).ids
        b = vocabularies.b.encode(text)
        parts = [[vocabularies.a_bytes[i] for i in a], [vocabularies.b_bytes[i] for i in b]]
        if any(b"".join(p) != raw for p in parts):
            docs.append(None)
            continue
        spans = []
        for p in parts:
            at, found = 0, []
            for x in p:
                found.append((at, at + len(x)))
                at += len(x)
            spans.append(found)
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for i, (s, t) in zip(ids, sp) if s >= low and t <= e) for ids, sp in zip((a, b), spans)))
            low = e
        links = Counter((x, y) for x, (s, t) in zip(a, spans[0]) for y, (u, v) in zip(b, spans[1]) if s < v and u < t)
        for pair in links:
            held[pair].add(d)
        docs.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (a, _), who in held.items():
        best[a] = max(best[a], len(who))
    found = []
    for doc in docs:
        if doc is None:
            found.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, digest = doc
        found.append((n_a, n_b, n_groups, sum(links.values()), sum(n for p, n in links.items() if len(held[p]) == best[p[0]]), sum(n * len(held[p]) for p, n in links.items()), digest))
    return found


def check(spark, both, texts, block_items=ta.BLOCK_ITEMS):
    docs = spark.createDataFrame([(i, t, "clash", 3) for i, t in enumerate(texts)], "doc_id long, text string, block string, pairs int").repartition(3)
    got = sorted(map(tuple, ta.align(docs, FILES, block_items).collect()))
    assert got == [(i, *w) for i, w in enumerate(plain(both, texts))]


def test_equals_brute_force(spark, both):
    check(spark, both, TEXTS)


def test_generated_texts_in_small_blocks(spark, both):
    rng = random.Random(4)
    letters = "aaeeiinnrstdl  \n.,'é ß▁中\t🙂-09AB"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 120))) for _ in range(150)]
    texts += [" ".join(rng.choice(TEXTS[6:20]) or "" for _ in range(3)).replace("▁", "") for _ in range(60)]
    check(spark, both, texts, block_items=200)


def test_chunks_give_the_tokens_of_whole_texts(both):
    rng = random.Random(8)
    chunks = ta.Chunks(both)
    assert both.cut and both.lean
    texts = ["".join(rng.choice("ab  \n\t.,'’é  \x1c\u0085sdmt09▁") for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    for text, numbers in zip(texts, chunks.numbers(texts)):
        of_a, of_b, (good,) = both.tokens([" " + text])
        assert (numbers is not None) == good
        if good:
            assert ";".join(chunks.groups[i] for i in numbers) == ta.aligned(both, of_a, of_b).groups[0]


def test_ranks_give_the_ids_of_the_file(both):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefghi ABCÄéß \n\t.,;'-0123456789'st'll…€“”") for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    assert both.encode_a(texts) == [e.ids for e in both.a.encode_batch(texts, add_special_tokens=False)]


def test_map_of_same_bytes(both):
    for a, b in enumerate(both.same):
        assert b < 0 or both.a_bytes[a] == both.b_bytes[b]
    assert (both.same >= 0).sum() > 10_000
    newline = both.a.encode("\n", add_special_tokens=False).ids[0]
    assert both.b.is_byte(int(both.same[newline]))


def test_memory_is_cleared_between_texts(spark, both, monkeypatch):
    monkeypatch.setattr(ta, "MEMORY_CHARS", 10)
    chunks = ta.Chunks(both)
    first = chunks.numbers(["some text here", None, ""])
    assert first[0] and first[1:] == [None, None] and chunks.full
    chunks.clear()
    assert not chunks.full and [chunks.groups[i] for i in chunks.numbers(["some text"])[0]]


def test_pair_counts(spark, both):
    docs = spark.createDataFrame([(1, "the cat"), (2, "the dog"), (3, "the the été"), (None, "the"), (None, "the"), (4, None)], "doc_id long, text string")
    counts = {(r.a_id, r.b_id): r.documents for r in ta.pair_counts(ta.encode_blocks(docs, FILES), both).collect()}
    the = both.a.encode(" the", add_special_tokens=False).ids[0]
    assert counts[the, int(both.same[the])] == 5


def test_null_equal_ids_long_and_empty(spark, both):
    long = " ".join(f"wörd{i}" for i in range(40_000))
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, "a b"), (7, long)], "doc_id long, text string")
    got = ta.align(docs, FILES).collect()
    assert sorted((r.doc_id or 0, r.n_groups > 9) for r in got) == [(0, False), (0, False), (7, False), (7, True)]
    assert ta.align(docs.limit(0), FILES).count() == 0
    assert ta.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), FILES).where("n_a = 0 and groups_sha256 = ''").count() == 2


def test_very_long_runs(both):
    """Runs that neither a space nor a word end cuts, of blanks and of letters."""
    chunks = ta.Chunks(both)
    for run in (" ", "\n", "\t \n", "a", ".", "é"):
        text = "x" + run * 1_200_000 + "y"
        (numbers,) = chunks.numbers([text])
        assert numbers and np.frombuffer(chunks.counts, np.int64).reshape(-1, 4)[numbers].sum(axis=0)[2] > 0
        chunks.clear()
