import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoloom.operators import windows


def events(spark, sizes, person=1):
    """Sizes newest first."""
    day = datetime.date(2020, 1, 1)
    rows = [(person, len(sizes) - i, day + datetime.timedelta(len(sizes) - i), "w " * n) for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "person_id long, visit int, visit_date date, text string")


def plain_pack(sizes, budget):
    out, total, w = [], None, -1
    for n in sizes:
        if total is None or total + n > budget:
            w, total = w + 1, n
        else:
            total += n
        out.append(w)
    return out


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 12), max_size=12), min_size=1, max_size=20), st.integers(1, 20))
def test_pack(spark, lists, budget):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<int>").select("i", windows.pack(F.col("x"), budget).alias("w")).collect()
    assert {r.i: r.w for r in rows} == {i: plain_pack(x, budget) for i, x in enumerate(lists)}


def test_reset_and_oversize(spark):
    got = windows.pack_windows(events(spark, [3, 4, 5, 9, 1]), 8, 0.0).orderBy("window_index").collect()
    assert [(r.window_index, r.visits, r.visit_tokens) for r in got] == [(0, 2, 7), (1, 1, 5), (2, 1, 9), (3, 1, 1)]


def test_small_last_window_goes_unless_alone(spark):
    assert windows.pack_windows(events(spark, [8, 3]), 8).count() == 1
    assert windows.pack_windows(events(spark, [8, 4]), 8).count() == 2
    assert windows.pack_windows(events(spark, [1]), 8).count() == 1
    assert windows.pack_windows(events(spark, []), 8).count() == 0


def test_newest_that_fit(spark):
    assert windows.newest_that_fit(events(spark, [1, 1]), 9).count() == 0
    assert windows.newest_that_fit(events(spark, [5, 5, 1]), 9).count() == 0
    got = windows.newest_that_fit(events(spark, [2, 2, 2, 9, 1]), 9).first()
    assert (got.visits, got.tokens) == (3, 6)


def test_trailing_children_in_order(spark):
    got = windows.trailing_children(events(spark, [2, 3, 9]), 6).orderBy("visit").collect()
    assert [(r.visit, r.n) for r in got] == [(2, 3), (3, 2)]


def test_modes(spark):
    rows = events(spark, [1] * 7)
    assert windows.context_windows(rows, "last_five").first().visits == 5
    assert windows.context_windows(rows, "full").first().percent_full == 100
    assert windows.context_windows(rows, "4").count() == 2
    for bad in ("0", "-3", "some", True):
        with pytest.raises(ValueError):
            windows.context_windows(rows, bad)


def test_tail_truncation(spark):
    rows = spark.createDataFrame([("a b c d e", "i j"), ("a", "i"), ("", "i"), (None, "i")], "text string, instruction string")
    assert [r.kept for r in windows.tail_truncate(rows, 10, 3, "t t").collect()] == ["c d e", "a", "", ""]
    assert [r.kept for r in windows.tail_truncate(rows, 5, 3, "t t").collect()] == [""] * 4


def test_windows_of_repeated_visits_and_of_other_tokenizers(spark):
    rows = [("p", 1, "a b c"), ("p", 1, "a b c"), ("p", 2, "d-e f"), ("q", 0, "abcdefgh i")]
    events = spark.createDataFrame(rows, "person_id string, visit int, text string").withColumn("visit_date", F.lit("2020-01-01").cast("date"))
    got = sorted((r.person_id, r.window_index, r.visits, r.visit_tokens) for r in windows.pack_windows(events, 5, 0.0).collect())
    assert got == [("p", 0, 2, 5), ("p", 1, 1, 3), ("q", 0, 1, 2)]
    assert [r.visit_tokens for r in windows.pack_windows(events.where("person_id = 'q'"), 5, tokenizer="quarters").collect()] == [3]
    assert [r.visit_tokens for r in windows.pack_windows(events.where("visit = 2"), 5, tokenizer="words").collect()] == [4]
    with pytest.raises(ValueError, match="whitespace"):
        windows.pack_windows(events, 5, tokenizer="gpt").collect()


def test_windows_are_records_newest_first(spark):
    rows = events(spark, [1, 2, 9]).withColumn("text", F.concat(F.lit("v"), F.col("visit").cast("string"), F.lit(" "), F.col("text")))
    got = windows.pack_windows(rows, 20).orderBy("window_index").first()
    assert got.text == "<patient>\nv3 w \nv2 w w \nv1 w w w w w w w w w \n</patient>"
    assert (got.visit_tokens, got.tokens, got.percent_full) == (15, 17, 85.0)
    assert windows.newest_that_fit(rows, 20).first().text == got.text
    whole = windows.context_windows(rows, "full").first()
    assert whole.text.index("v1") < whole.text.index("v3") and (whole.tokens, whole.percent_full) == (17, 100.0)
    assert windows.context_windows(rows, "last_five").first().percent_full == 100


def test_record_windows_keep_the_rest_of_the_record(spark):
    visits = [f'<visit start="0{i}/02/2020 10:00"><code v="{i}"/></visit>' for i in range(1, 8)]
    record = "<?xml version='1.0'?><ehr id='7'><who>x</who>" + " tail\n".join(visits) + "<end/></ehr>"
    rows = spark.createDataFrame([(1, record), (2, "<ehr><a/></ehr>"), (3, None)], "person_id int, text string")
    got = {r.person_id: r for r in windows.record_window(rows, 5).collect()}
    assert got[1].text == "<?xml version='1.0'?><ehr id='7'><who>x</who>" + " tail\n".join(visits[2:]) + "<end/></ehr>"
    assert (got[1].visits, str(got[1].start_date), str(got[1].end_date), got[1].percent_full) == (5, "2020-03-02", "2020-07-02", 100.0)
    assert (got[2].text, got[2].visits, got[2].start_date, got[3].text) == ("<ehr><a/></ehr>", 0, None, "")
    whole = {r.person_id: r for r in windows.record_window(rows).collect()}
    assert whole[1].text == record and whole[1].visits == 7
