"""Columns of the input whose names are those that the operators use inside."""

import __spark_entry__ as entry
from chronoloom.llm import curriculum, decontam, line_dedup, quality_rules, simhash_bk

OWN = ["_verdict", "_size", "_key", "_order", "_before", "_print", "_hit", "_rank", "_kept", "_text", "_position", "_starts", "_dropped", "_id", "row", "id", "rank"]


def test_rows_come_back_whole(spark):
    words = "the quick brown fox jumps over the lazy dog and runs to all of its many friends in a wood that is not far from here "
    texts = [" ".join(f"{w}{i}" if k % 3 else w for k, w in enumerate((words * 4).split())) for i in range(4)]
    rows = [(i, t, "s", *[f"{name}-{i}" for name in OWN]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in OWN))
    benchmark = spark.createDataFrame([(1, texts[2])], "item_id long, text string")
    found = {
        "good": (quality_rules.keep_good(docs), range(4)),
        "mix": (curriculum.mix(docs).distinct(), range(4)),
        "clean": (decontam.drop_contaminated(docs, benchmark), (0, 1, 3)),
        "lines": (line_dedup.drop_repeated_lines(docs), range(4)),
        "copies": (simhash_bk.keep_one_per_component(docs), range(4)),
    }
    for name, (df, ids) in found.items():
        assert df.columns == docs.columns, name
        assert sorted(map(tuple, df.collect())) == [rows[i] for i in ids], name


def test_all_operators_are_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)} and "pipeline" in names
