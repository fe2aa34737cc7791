import datetime
import random

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import binning
from chronoloom.operators import sampling, selection


def test_bin_edges(spark):
    values = [0.0, 0.1, 0.3, 0.30000000000000004, 0.6, 0.7, 0.95, 1.0]
    rows = spark.createDataFrame([(v,) for v in [*values, -0.1, 1.1]], "x double").select("x", binning.half_open_bin(F.col("x")).alias("h"), binning.right_closed_bin(F.col("x")).alias("r")).collect()
    got = {r.x: (r.h, r.r) for r in rows}
    assert [got[v][0] for v in values] == [0, 1, 2, 3, 5, 6, 9, 9]
    assert [got[v][1] for v in values] == [0, 0, 2, 2, 5, 6, 9, 9]
    assert got[-0.1][1] is None and got[1.1][1] is None


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(n)


@pytest.fixture(scope="module")
def facts(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        rows.append((i, rng.randrange(40), 0, day(0), day(100), f"q{i % 50}", "r", day(rng.randrange(101)), None, f"file{rng.randrange(60)}"))
    rows += [(900, 1, 0, day(3), day(3), "zero", "r", day(3), None, "f"), (901, 1, 0, day(0), day(9), "outside", "r", day(20), None, "f"), (902, 1, 0, day(0), day(9), "bad", "r", day(2), "error", "f"), (903, 1, 0, day(0), day(9), "none", "r", None, None, "f")]
    rows += [(904, 7, 0, day(0), day(100), "twin", "r", day(99), None, "twins"), (905, 7, 0, day(0), day(100), "twin", "r", day(99), None, "twins")]
    raw = spark.createDataFrame(rows, "id long, person_id long, window_index int, start_date date, end_date date, instruction string, response string, evidence date, error string, source_file string")
    return selection.positioned(raw, keep=["id"]).cache()


def test_positions(facts):
    assert facts.count() == 602
    assert facts.where("relative_position <> datediff(evidence, start_date) / 100.0").count() == 0


def test_recent_covers_every_source_and_fills(facts):
    late = facts.where("relative_position >= 0.75")
    rows = selection.recent(facts, 100, "id").collect()
    assert len(rows) == 100 and len({r.id for r in rows}) == 100
    assert {r.source_file for r in rows} == {r.source_file for r in late.select("source_file").collect()}
    assert sum(r.instruction == "twin" for r in rows) == 1  # the twin of a chosen row is no filling
    assert sorted(rows) == sorted(selection.recent(facts.repartition(7), 100, "id").collect())


def test_coverage_may_exceed_n(facts):
    sources = facts.select("source_file").distinct().count()
    assert selection.whole_span(facts, 5, "id").count() == sources


def test_too_few_rows_raise(facts):
    with pytest.raises(ValueError):
        selection.recent(facts, 10_000, "id")


def test_cohort(facts, spark):
    cohort = spark.createDataFrame([(1,), (2,)], "person_id long")
    assert {r.person_id for r in selection.recent(facts, 5, "id", 0.5, cohort=cohort).collect()} <= {1, 2}
    everyone = selection.recent(facts, 50, "id", 0.9, cohort=cohort.limit(0), strict=False)
    assert everyone.select("person_id").distinct().count() > 2


def plain_balanced(rows, n, bins=10):
    """The fold, source by source in the given order: (source, bin) choices."""
    quota, fill, chosen = n // bins, [0] * bins, []
    for source, held in rows:
        open_bins = [b for b in held if fill[b] < quota]
        if open_bins:
            b = min(open_bins, key=lambda x: (fill[x], held.index(x)))
            fill[b] += 1
            chosen.append((source, b))
    return chosen


def test_balanced_with_coverage(facts):
    import hashlib

    digest = lambda s: hashlib.md5(f"{s}|0".encode()).hexdigest()
    rows = selection.balanced_with_coverage(facts, 200, "id").collect()
    by_bin = {}
    for r in rows:
        by_bin[r.bin] = by_bin.get(r.bin, 0) + 1
    available = {r.b: r.n for r in facts.groupBy(binning.half_open_bin(F.col("relative_position")).alias("b")).agg(F.count("*").alias("n")).collect()}
    assert by_bin == {b: min(20, n) for b, n in available.items()}
    held = {}
    for r in sorted(facts.withColumn("b", binning.half_open_bin(F.col("relative_position"))).collect(), key=lambda r: digest(r.id)):
        held.setdefault(r.source_file, [])
        if r.b not in held[r.source_file]:
            held[r.source_file].append(r.b)
    choices = plain_balanced(sorted(held.items(), key=lambda x: digest(x[0])), 200)
    assert {(r.source_file, r.bin) for r in rows} >= set(choices)


def test_uniform_bins(facts):
    rows = selection.uniform_bins(facts, 20, "id").collect()
    for b in range(10):
        own = [r for r in rows if r.bin == b]
        persons = facts.where(binning.right_closed_bin(F.col("relative_position")) == b).select("person_id").distinct().count()
        assert len(own) == 20 and len({r.person_id for r in own}) == min(20, persons)
    with pytest.raises(ValueError):
        selection.uniform_bins(facts.where("relative_position < 0.5"), None, "id")


def test_uniformity_of_nothing(facts):
    assert selection.uniformity(selection.bin_histogram(facts.limit(0))).first().cv == float("inf")


def test_bootstrap_of_a_constant(spark):
    rows = spark.createDataFrame([("m", 1.0)] * 9 + [("m", None), ("n", 0.0), ("n", 1.0)], "model string, v double")
    got = {r.model: r for r in sampling.bootstrap(rows, "v", ["model"], 100).collect()}
    assert (got["m"].n, got["m"].lower, got["m"].upper, got["m"].half_width) == (9, 1.0, 1.0, 0.0)
    assert got["n"].lower == 0.0 and got["n"].upper == 1.0 and got["n"].mean == 0.5


def test_split_sizes_and_determinism(spark):
    rows = spark.range(1003).withColumnRenamed("id", "k")
    got = sampling.split(rows, "k").groupBy("partition").count().collect()
    assert {r.partition: r["count"] for r in got} == {"train": 802, "test": 200, None: 1}
    assert sorted(sampling.split(rows, "k").collect()) == sorted(sampling.split(rows.repartition(9), "k").collect())


def test_exact_per_person(facts):
    rows = sampling.exact_per_person(facts, 23, 5, "id").collect()
    assert len(rows) == 20 and all(sum(r.person_id == q.person_id for q in rows) == 5 for r in rows)
    with pytest.raises(ValueError):
        sampling.exact_per_person(facts, 1000, 5, "id")


def test_latest_valid_label(spark):
    people = spark.createDataFrame([(1,), (2,), (3,)], "person_id long")
    visits = spark.createDataFrame([(1, "a", 1, day(1)), (1, "b", 2, day(9)), (2, "c", 2, day(1)), (1, "d", 3, day(5))], "person_id long, visit_id string, provider_id long, visit_date date")
    providers = spark.createDataFrame([(1, "heart"), (2, "UNKNOWN"), (3, " ")], "provider_id long, specialty string")
    got = {r.person_id: (r.visit_id, r.specialty) for r in sampling.latest_valid_label(people, visits, providers).collect()}
    assert got == {1: ("a", "heart"), 2: ("Unknown", "Unknown"), 3: ("Unknown", "Unknown")}


def test_replicates_draw_from_counted_values(monkeypatch):
    from hashlib import md5

    import numpy as np

    from chronoloom.operators import sampling

    values, counts = [0.5, 1.0, 2.25], [9, 1, 13]
    own = [v for v, c in zip(values, counts) for _ in range(c)]
    number = lambda b, i: int(md5(f"7|{b}|{i // 4}".encode()).hexdigest()[8 * (i % 4) :][:8], 16)
    want = [sum(own[number(b, i) % len(own)] for i in range(len(own))) / len(own) for b in range(3, 11)]
    for most in (1, 2, 1 << 16):
        monkeypatch.setattr(sampling, "HASHES", most)
        assert np.allclose(sampling._drawn_means(7, np.array(values), np.array(counts), 3, 11), want, rtol=0, atol=1e-12)
