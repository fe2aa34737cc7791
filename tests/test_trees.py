import random
import xml.etree.ElementTree as ET

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import trees

RECORD = """<ehr id="1"><visit start="01/01/2020 10:00"><enc kind="a"><code value="7"/>tail<grp><code value="30"/></grp></enc><note who="x">hi &amp; ho<code value="50"/></note></visit><visit start="02/01/2020 10:00">only text</visit><visit start="03/01/2020 10:00"><code value="3"/></visit></ehr>"""


def records(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "person_id int, text string")


def filtered(spark, filters, *texts):
    return [(r.person_id, r.visit, r.text) for r in trees.filter_trees(records(spark, *(texts or (RECORD,))), filters).orderBy("person_id", "visit").collect()]


def plain(source, filters):
    """The filter as a walk over a tree that it changes as it goes."""
    exclude = tuple(filters.get("@exclude_children", ()))
    include = tuple(filters.get("@include_children", ()))
    found = []
    for visit in ET.fromstring(source).iter(filters["@parent"]):
        above = {c: p for p in visit.iter() for c in p}
        for node in list(visit.iter())[1:]:
            tag = node.tag.lower()
            stays = tag.startswith(include) if include else not (exclude and tag.startswith(exclude))
            if stays and "value" in filters.get(node.tag, {}):
                stays = int(node.get("value", -1)) >= filters[node.tag]["value"]["$gte"]
            if not stays:
                parent = above[node]
                for child in list(node):
                    parent.append(child)
                    above[child] = parent
                parent.remove(node)
        if len(visit):
            visit.tail = None
            found.append(ET.tostring(visit, encoding="unicode").replace(" />", "/>"))
    return found


def test_intervals(spark):
    rows = trees.node_rows(records(spark, RECORD))
    got = {r.node: r for r in rows.collect()}
    assert [got[k].tag for k in range(len(got))] == [e.tag for e in ET.fromstring(RECORD).iter()]
    assert (got[0].last, got[0].parent, got[0].depth) == (len(got) - 1, -1, 0) and got[1].attributes == {"start": "01/01/2020 10:00"}
    assert [(got[k].last, got[k].depth) for k in (2, 4)] == [(5, 2), (5, 3)] and got[3].tail == "tail"
    below = trees.below(rows, "person_id", F.col("tag") == "visit", F.col("tag") == "code")
    assert sorted((r.above, r.node) for r in below.collect()) == [(1, 3), (1, 5), (1, 7), (9, 10)]


def test_nested_elements_stay_with_what_holds_them(spark):
    assert [t for _, _, t in filtered(spark, trees.FILTERS["all"])] == plain(RECORD, trees.FILTERS["all"])
    assert filtered(spark, trees.FILTERS["codes"])[0][2] == '<visit start="01/01/2020 10:00"><enc kind="a"><code value="7"/>tail<grp><code value="30"/></grp></enc><code value="50"/></visit>'
    assert filtered(spark, trees.FILTERS["notes"]) == [(1, 0, '<visit start="01/01/2020 10:00"><note who="x">hi &amp; ho</note></visit>')]


def test_conditions_hold_for_their_tag_alone(spark):
    got = filtered(spark, {"@parent": "visit", "code": {"value": {"$gte": 20}}})
    assert got == [(1, 0, '<visit start="01/01/2020 10:00"><enc kind="a"><grp><code value="30"/></grp></enc><note who="x">hi &amp; ho<code value="50"/></note></visit>')]
    assert filtered(spark, {"@parent": "visit", "code": {"none": {}}})[0][2].count("<code") == 0
    assert [v for _, v, _ in filtered(spark, {"@parent": "visit", "visit": {"start": {"$gte": "02/15/2020 00:00"}}})] == [2]


def test_first_and_last(spark):
    assert [v for _, v, _ in filtered(spark, {"@parent": "visit", "@first": 1})] == [0]
    assert [v for _, v, _ in filtered(spark, {"@parent": "visit", "@last": 1})] == [2]


def test_malformed_records_are_set_aside(spark):
    bad = '<ehr><visit><code a="1" a="2"/></visit></ehr>'
    rows = records(spark, bad, "<ehr>", None, "", RECORD)
    assert {r.person_id for r in trees.filter_trees(rows, trees.FILTERS["all"]).collect()} == {5}
    assert {r.person_id for r in trees.malformed(rows).collect()} == {1, 2, 3, 4}
    assert trees.filter_trees(rows.limit(0), trees.FILTERS["all"]).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_equals_a_walk_over_the_tree(spark, seed):
    rng = random.Random(seed)

    def grown(depth):
        out = []
        for _ in range(rng.randrange(4)):
            tag = rng.choice(["enc", "grp", "code", "note"])
            inside = grown(depth + 1) if depth < 4 else ""
            out.append(f'<{tag} value="{rng.randrange(40)}">{rng.choice(["", "t"])}{inside}</{tag}>')
        return "".join(out)

    texts = ["<ehr>" + "".join(f"<visit>{grown(0)}</visit>" for _ in range(3)) + "</ehr>" for _ in range(25)]
    for filters in ({"@parent": "visit", "@exclude_children": ["enc", "grp"]}, {"@parent": "visit", "@include_children": ["co", "grp"]}, {"@parent": "visit", "@exclude_children": ["note"], "code": {"value": {"$gte": 20}}, "enc": {"value": {"$gte": 10}}}):
        got = [(p, t) for p, _, t in filtered(spark, filters, *texts)]
        assert got == [(k, t) for k, x in enumerate(texts, 1) for t in plain(x, filters)]


def test_trailing_record_keeps_any_child(spark):
    record = "<?xml version='1.0'?>\n<ehr id='7'>text<who>a b</who><visit>c d e</visit><end/></ehr>"
    rows = records(spark, record, "<ehr", None, "<ehr/>").withColumn("room", F.lit(5))
    got = {r.person_id: r.text for r in trees.trailing_record(rows, "text", F.col("room")).collect()}
    assert got == {1: '<ehr id="7"><visit>c d e</visit><end /></ehr>', 2: "", 3: "", 4: "<ehr />"}
    none = trees.trailing_record(rows.where("person_id = 1"), "text", F.lit(1)).first().text
    assert none == '<ehr id="7" />'
    assert trees.trailing_record(rows.where("person_id = 1"), "text", F.lit(500), "bpe").first().text.startswith('<ehr id="7"><who>')


def test_a_visit_carries_its_own_nodes_alone(spark):
    """Neither buffered nor multiplied: no visit is beside the nodes of its whole record."""
    found = trees.filter_trees(records(spark, RECORD), {"@parent": "visit"})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "Generate" not in plan and found.count() > 0


def test_nodes_are_held_for_a_portion_of_records(spark):
    long = "<ehr>" + "<visit/>" * (trees.PORTION_CHARS // 20) + "</ehr>"
    batch = pa.RecordBatch.from_pydict({"person_id": list(range(9)), "text": [long] * 4 + ["<ehr>", None] + [long] * 3})
    portions = [(keys.to_pylist(), [len(own) for own in found]) for keys, found in trees._parsed_portions(iter([batch]))]
    assert [k for keys, _ in portions for k in keys] == [0, 1, 2, 3, 6, 7, 8] and max(len(found) for _, found in portions) <= 3
    nodes = trees.node_rows(records(spark, RECORD, "<ehr>", RECORD)).groupBy("person_id").count().collect()
    assert {r.person_id for r in nodes} == {1, 3} and len({r["count"] for r in nodes}) == 1
