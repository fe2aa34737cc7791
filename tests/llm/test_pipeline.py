import hashlib
import random
from collections import Counter

import duckdb
import pytest
from test_curriculum import plain_targets
from test_decontam import plain as plain_contamination
from test_simhash_bk import plain_components, plain_fingerprint

import corpus_pipeline
from chronoloom.llm import quality_rules as qr
from chronoloom.llm import shard_tree as st


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    content = [a + b + c for a in "bcdfghklm" for b in "aeiou" for c in "nrst"]
    stop = ["the", "of", "and", "in", "was", "to"]
    sentence = lambda n: " ".join(rng.choice(stop) if i % 4 == 0 else rng.choice(content) for i in range(n))
    items = [(i, sentence(30)) for i in range(8)]
    docs = []
    for i in range(160):
        kind, text = i % 10, "\n".join(sentence(rng.choice([40, 70])) for _ in range(3))
        if kind == 0:
            text = items[rng.randrange(8)][1] + "\n" + text
        elif kind == 1:
            text = " ".join(w + "***" for w in text.split())
        elif kind in (2, 3) and i > 10:
            text = docs[-5][1] or text
            if kind == 3:
                words = text.split(" ")
                words[3] = "changed"
                text = " ".join(words)
        elif kind == 4:
            text = "too short"
        docs.append((i, text, "en", [f"s{i % 4}", "s0", None][i % 3], len(text)))
    docs += [(1000, None, None, None, None), (1001, "", "en", "s0", 0)]
    path = tmp_path_factory.mktemp("tables")
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, items


def plain_pipeline(docs, items):
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", docs)
    kept = {r[0] for r in con.sql(f"select doc_id from ({qr.oracle()}) where kept").fetchall()}
    stages = [[d for d in docs if d[0] in kept]]
    labels = plain_components([(d[0], plain_fingerprint(d[1])) for d in stages[-1]])
    stages.append([d for d in stages[-1] if labels[d[0]] == d[0]])
    dirty = {d for d, _ in plain_contamination([(d[0], d[1]) for d in stages[-1]], items)}
    stages.append([d for d in stages[-1] if d[0] not in dirty])
    sizes = Counter()
    for d in stages[-1]:
        sizes[d[3]] += len(d[1].split())
    targets, mixed = plain_targets(dict(sizes)), []
    for source in sizes:
        own = sorted((d for d in stages[-1] if d[3] == source), key=lambda d: int(hashlib.md5(str(d[0]).encode()).hexdigest()[:15], 16))
        for turn in range(2):
            at = turn * sizes[source]
            for d in own:
                if at < int(targets[source]) and d[1].split():
                    mixed.append(d)
                at += len(d[1].split())
    stages.append(mixed)
    return stages


def test_each_stage_and_the_whole(spark, tables):
    path, docs, items = tables
    stages = plain_pipeline(docs, items)
    assert [len(s) for s in stages] == sorted((len(s) for s in stages[:3]), reverse=True) + [len(stages[3])] and len(stages[2]) < len(docs) - 40
    frame = spark.read.parquet(f"{path}/documents.parquet")
    columns = frame.columns
    for (name, stage), want in zip(corpus_pipeline.STAGES[:4], stages):
        frame = stage(spark, frame, path)
        assert frame.columns == columns
        rows = frame.collect()
        assert Counter(map(tuple, rows)) == Counter(want), name
        frame = spark.createDataFrame(rows, frame.schema)
    got = corpus_pipeline.run(spark, path).collect()
    assert Counter(r.doc_id for r in got) == Counter(d[0] for d in stages[3])
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(d[0], d[1]) for d in set(stages[3])])
    placed = {r[0]: r[1:] for r in con.sql(f"select doc_id, size, text_crc32, shard, grown_shard from ({st.oracle()})").fetchall()}
    assert all((r.size, r.text_crc32, r.shard, r.grown_shard) == placed[r.doc_id] for r in got)
    for shard in range(16):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_empty_documents(spark, tables, tmp_path):
    path, _, _ = tables
    frame = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, path)
        assert out.count() == 0
