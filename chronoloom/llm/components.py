"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import remove_table, scratch_path


def _min_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges``; label is the least node of its component.

    Alternates large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce
    and Beyond", 2014), which needs about log^2 rounds whatever the diameter. The least neighbour
    comes from an aggregate with partial sums and is joined back, so a node with very many
    neighbours is a skewed join that adaptive execution splits, never one large group in a task.
    Every round is written to the shared folder, in place of the one before. Nodes may be of any ordered type; loops and rows
    with a null end are ignored; an empty table gives an empty result.
    """
    u, v = F.col(left), F.col(right)
    current = edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    spark, path = edges.sparkSession, None

    def written(rows: DataFrame) -> DataFrame:
        nonlocal path
        before, path = path, scratch_path(spark, "components")
        rows.write.parquet(path)
        if before:
            remove_table(spark, before)
        return spark.read.schema(rows.schema).parquet(path)

    current, known = written(current), None
    for _ in range(max_rounds):
        stats = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if stats.n == 0 or (stats.n, stats.h) == known:
            break
        known = (stats.n, stats.h)
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _min_neighbour(both).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _min_neighbour(large).select(F.col("u").alias("c"), "m")
        star = large.join(least, F.col("u") == F.col("c"))
        small = star.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        current = written(small)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
