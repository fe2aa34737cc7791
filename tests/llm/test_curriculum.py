import duckdb
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import curriculum as cu


def plain_targets(sizes):
    """Shares by weight; a source above its cap stops there and the excess is shared again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "w " * (i % 23), ["big", "big", "big", None, "a", "é", "empty"][i % 7] if i % 7 != 6 else "b", i, 1.0) for i in range(900)]
    rows += [(5000 + i, None if i % 2 else " ", "empty", 0, 0.0) for i in range(5)] + [(None, "x y z", "big", 0, 0.0), (1, "w ", "big", 1, 1.0), (1, "w ", "big", 1, 1.0), (9000, "long " * 30000, "a", 1, 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target double")


def test_targets_and_taken(docs):
    sources = {r.source: r.n for r in docs.groupBy("source").agg(F.sum(F.when(F.col("text").isNull(), 0).otherwise(F.size(F.array_remove(F.split("text", " "), "")))).alias("n")).collect()}
    want = plain_targets(sources)
    rows = cu.mix_plan(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    expected = sorted((n, want[s]) for s, n in sources.items())
    assert [n for n, _ in sorted(by)] == [n for n, _ in expected]
    assert [x for _, x in sorted(by)] == pytest.approx([x for _, x in expected])
    for (_, target), taken in by.items():
        assert sum(taken) == int(target)
    assert sorted(map(str, rows)) == sorted(map(str, cu.mix_plan(docs.repartition(5)).collect()))


def test_positions_follow_the_schedule(docs):
    rows = [r for r in cu.mix_plan(docs).collect() if r.position is not None]
    assert [r.position for r in rows] == sorted(r.position for r in rows) and all(0 <= r.position <= 1 for r in rows)
    ramp = docs.sparkSession.range(11).select((F.col("id") / 10).alias("f")).select("f", cu.due(F.col("f"), F.lit(0.5)).alias("t"))
    for r in ramp.collect():
        assert 1.5 * r.t - 0.5 * r.t**2 == pytest.approx(r.f)


def test_mix_repeats_rows(docs):
    plan = {(r.doc_id, r.size): (r.position is not None) + (r.again is not None) for r in cu.mix_plan(docs).where("doc_id <> 1").collect()}
    mixed = cu.mix(docs)
    assert mixed.columns == docs.columns
    got = {r.doc_id: r["count"] for r in mixed.where("doc_id <> 1").groupBy("doc_id").count().collect()}
    assert got == {d: n for (d, _), n in plan.items() if n and d is not None}


def test_oracle_agrees(docs):
    documents = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = cu.mix_plan(documents).withColumns({c: F.round(c, 9) for c in ("position", "again")}).collect()
    assert sum(r.position is not None for r in rows) > 300 and sum(r.again is not None for r in rows) > 50
    con = duckdb.connect()
    con.register("documents", documents.toPandas())
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, con.sql(f"select doc_id, size, source_size, target, taken, position, again from ({cu.oracle()})").fetchall()))


def test_empty_and_wordless(docs):
    assert cu.mix_plan(docs.limit(0)).count() == 0
    rows = cu.mix_plan(docs.where("source = 'empty'")).collect()
    assert len(rows) == 5 and all(r.taken == 0 and r.target == 0 for r in rows)
    assert cu.mix(docs.where("source = 'empty'")).count() == 0


def test_positions_equal_a_schedule_walked_in_small_steps(docs):
    """The demand of each source, summed up step by step, reaches each document at its position."""
    rows = [r for r in cu.mix_plan(docs).collect() if r.target]
    ramps = {}
    for r in rows:
        ramps.setdefault((r.source_size, r.target), []).append(r)
    steps = 20_000
    for own in ramps.values():
        starts = sorted((p, r) for r in own for p in (r.position, r.again) if p is not None)
        for ramp in cu.RAMPS:  # the source's own schedule is the one that fits
            demand = lambda t: sum((1 + ramp * (1 - 2 * (i + 0.5) / steps)) / steps for i in range(int(t * steps)))  # noqa: B023, E731
            taken, fits = 0.0, True
            for p, r in starts[:: max(1, len(starts) // 5)]:
                taken = sum(min(q.size, r.target) for s, q in starts if s < p)
                fits = fits and abs(demand(p) * r.target - taken) <= 2 * max(q.size for _, q in starts) + r.target / 100
            if fits:
                break
        assert fits
