"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage reads what its predecessor wrote and works on all of it. All but the last return the
columns of ``documents``, whatever these are named. An empty table stays empty, and a null id,
language or source is a value like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm.common import write_table
from chronoloom.llm.curriculum import mix
from chronoloom.llm.decontam import drop_contaminated
from chronoloom.llm.quality_rules import keep_good
from chronoloom.llm.shard_tree import place_with_growth
from chronoloom.llm.simhash_bk import keep_one_per_component


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or a rule rejects go, so null, empty and wordless texts do.

    Each row is judged alone: repeated rows stay or go together, however long their text is.
    """
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id.

    Of rows with that id one stays, the least by its columns; rows without an id all stay. Null and
    wordless texts are copies of each other.
    """
    return keep_one_per_component(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null texts hold none, and null or empty items are held by none. Rows are told apart by id and text,
    so rows with equal or null ids go only if their own text holds an item. Texts are searched whole.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, sorted by range of training position.

    A source takes its documents in a repeatable random order, ties by id; a null source weighs last.
    Null and wordless texts have no size and are not taken; a document at a source's end is taken whole.
    """
    return mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and its place there: id and shard count decide, so rows with equal or null ids share a shard."""
    return place_with_growth(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SimHash and windows of shingles have no SQL form; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each one's result written and read again; the last one's is returned."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
