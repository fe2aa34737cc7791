import pyarrow as pa
from pyspark.sql import functions as F

from chronoloom.functions import portions
from chronoloom.functions.subwords import Subwords
from chronoloom.operators import markup


def test_parts_are_small_and_lose_no_row():
    texts = pa.array(["x" * 300_000, None, "", "é" * 900_000, *["y" * 1_000] * 5_000])
    parts = list(portions.portions(texts))
    assert pa.concat_arrays(parts).equals(texts) and all(len(p) > 0 for p in parts)
    assert all(len(p) == 1 or sum(len((x or "").encode()) for x in p.to_pylist()) <= portions.BYTES + 1_800_000 for p in parts) and len(parts) > 5
    ids = pa.array([[1] * 50_000, None, [], [2] * 90_000, [3]], pa.list_(pa.int32()))
    assert pa.concat_arrays(portions.portions(ids)).equals(ids) and len(list(portions.portions(ids))) > 1
    assert list(portions.portions(pa.array([], pa.string()))) in ([], [pa.array([], pa.string())])


def test_few_rows_are_python_objects_at_a_time(spark):
    def begun():
        held = []
        return lambda x: held.append(x) or len(held)

    rows = spark.range(3_000, numPartitions=1).select("id", F.repeat(F.lit("z"), 2_000).alias("t"))
    assert rows.select(portions.each_row("int", begun)(F.col("t")).alias("n")).agg(F.max("n")).first()[0] == 3_000


def test_pretty_and_subwords_over_many_parts(spark):
    rows = spark.range(2_000, numPartitions=1).select("id", F.concat(F.lit("<a><b>"), F.repeat(F.lit("word "), 300), F.col("id").cast("string"), F.lit("</b></a>")).alias("t"))
    bpe = Subwords()
    got = rows.select("id", bpe.text(bpe.ids(F.col("t"))).alias("back"), (F.size(bpe.ids(F.col("t"))) == bpe.count(F.col("t"))).alias("same"), markup.pretty_xml(F.col("t")).alias("p"), bpe.last(F.col("t"), F.lit(10_000)).alias("last"), "t")
    assert got.where("back <> t OR NOT same OR last <> t OR replace(replace(p, '\n  ', ''), '\n', '') <> t OR p IS NULL").count() == 0
