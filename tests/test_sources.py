import json
import os

import pytest
from pyspark.sql import functions as F

from chronoloom.sources import readers, writers
from chronoloom.streaming import incremental


def test_json_lines_skip_bad_ones(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"uid": "u", "person_id": "1", "text": "t"}\nnot json\n{"person_id": "2"}\n')
    rows = readers.read_jsonl(spark, str(tmp_path))
    assert sorted(r.person_id for r in rows.collect()) == ["1", "2"] and rows.first().file == "a.jsonl"
    assert [r.person_id for r in readers.read_jsonl(spark, str(tmp_path), limit=1).collect()] == ["1"]


def test_json_files_and_rejects(spark, tmp_path):
    (tmp_path / "7_x_0.json").write_text(json.dumps({"person_id": "7", "window_index": 0, "response_data": [{"instruction": "q", "response": "a"}]}))
    (tmp_path / "8_x_1.json").write_text(json.dumps({"person_id": "8", "response_data": {"error": "e"}}))
    (tmp_path / "9_x_2.json").write_text("{ broken")
    good, bad = readers.read_json_files(spark, str(tmp_path))
    got = {r.file: r for r in good.collect()}
    assert set(got) == {"7_x_0.json", "8_x_1.json"} and [r.file for r in bad.collect()] == ["9_x_2.json"]
    assert got["7_x_0.json"].response_data[0].instruction == "q" and got["8_x_1.json"].response_data[0].error == "e"
    names = good.select(readers.person_of(F.col("file")).alias("p"), readers.window_of(F.col("file")).alias("w")).collect()
    assert sorted((r.p, r.w) for r in names) == [("7", 0), ("8", 1)]


def test_numbered_xml_texts_and_arrays(spark, tmp_path):
    (tmp_path / "EHR_12.xml").write_text("<a/>\n")
    (tmp_path / "other.xml").write_text("<b/>")
    assert [(r.patient_id, r.text) for r in readers.read_numbered_xml(spark, str(tmp_path)).collect()] == [(12, "<a/>\n")]
    assert readers.read_texts(spark, str(tmp_path)).count() == 2
    (tmp_path / "rows.json").write_text('[{"instruction": "i"}, {"instruction": "j"}]')
    assert readers.read_json_array(spark, str(tmp_path / "rows.json")).count() == 2
    assert readers.read_template(str(tmp_path / "other.xml")) == "<b/>" and readers.read_template("/nowhere") == ""


def test_csv(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b",\nc')], "instruction_id long, question string")
    writers.write_csv(rows, str(tmp_path / "c"))
    back = readers.read_csv(spark, str(tmp_path / "c"), ["question"])
    assert back.first().question == 'a "b",\nc'
    with pytest.raises(ValueError, match="person_id"):
        readers.read_csv(spark, str(tmp_path / "c"), ["person_id"])


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("u", "1", 0, "<a><b/></a>")], "uid string, person_id string, window_index int, text string")
    path = str(tmp_path / "w")
    writers.append_windows(rows, path)
    writers.append_windows(rows, path)
    assert spark.read.json(path).count() == 2
    writers.append_windows(rows, path, fresh=True)
    assert spark.read.json(path).count() == 1
    writers.write_once(rows.limit(0), path)
    assert spark.read.json(path).count() == 1
    writers.write_xml(rows, str(tmp_path / "x"))
    assert "\n  <b />" in spark.read.text(str(tmp_path / "x"), wholetext=True).first().value
    pairs = spark.createDataFrame([("f", [1]), ("g", []), ("h", None)], "file string, pairs array<int>")
    assert writers.quarantine(pairs, "pairs", str(tmp_path / "q")).count() == 1 and spark.read.json(str(tmp_path / "q")).count() == 2


def test_resume_and_stream(spark, tmp_path):
    rows = spark.range(20).withColumnRenamed("id", "k")
    work = lambda r: r.select("k", (F.col("k") * 2).alias("v"))
    path = str(tmp_path / "r")
    assert incremental.resume(rows.where("k < 5"), "k", work, path) == 5
    assert incremental.repeat_until_done(rows, "k", work, path) == 0
    assert incremental.done_so_far(spark, path, work(rows)).count() == 20
    folder = str(tmp_path / "in")
    rows.write.parquet(folder)
    for _ in range(2):
        source = spark.readStream.schema(rows.schema).parquet(folder)
        incremental.stream_results(source, "k", work, str(tmp_path / "s"), str(tmp_path / "cp")).awaitTermination()
    assert incremental.done_so_far(spark, str(tmp_path / "s"), work(rows)).count() == 20


def test_persons_share_a_bounded_number_of_folders(spark, tmp_path):
    people = [None, "a/b\n\x1e\"c", *(str(k) for k in range(300))]
    rows = spark.createDataFrame([(p, f"<a n='{k}'>é\n<b/></a>") for k, p in enumerate(people)] + [("broken", "<a")], "person_id string, text string").repartition(7)
    writers.write_xml(rows, str(tmp_path / "x"))
    assert len([d for d in os.listdir(tmp_path / "x") if d.startswith("folder=")]) <= writers.FOLDERS
    found = {r.person_id: r.text for r in readers.read_xml(spark, str(tmp_path / "x")).collect()}
    assert found.keys() == set(people) and all(found[p] == f'<a n="{k}">é\n<b />\n</a>' for k, p in enumerate(people))
    pairs = rows.select("person_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("window_index"))
    writers.write_responses(pairs, str(tmp_path / "r"))
    folders = [d for d in os.listdir(tmp_path / "r") if d.startswith("folder=")]
    assert len(folders) <= writers.FOLDERS and all(len([f for f in os.listdir(tmp_path / "r" / d) if f.endswith(".json")]) == 1 for d in folders)
    back = spark.read.schema("person_id string, window_index int").json(str(tmp_path / "r")).select(*pairs.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, pairs.collect()))
