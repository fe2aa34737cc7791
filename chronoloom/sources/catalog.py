"""Visits and providers as tables of the catalog, laid out by key, and the cohort as SQL over them.

Both tables have the same number of buckets by provider, sorted, so their join moves neither. Each
query is SQL text with named parameters; values never become part of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lay_out(visits: DataFrame, providers: DataFrame, prefix: str, buckets: int = 64) -> None:
    """Writes the tables <prefix>_visits and <prefix>_providers, in place of what was there."""
    for rows, name in ((visits, f"{prefix}_visits"), (providers.dropDuplicates(["provider_id"]), f"{prefix}_providers")):
        # By bucket first, so a bucket is one file.
        dealt = rows.repartition(buckets, "provider_id")
        dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, "provider_id").sortBy("provider_id").saveAsTable(name)


#: The specialty of each visit; unknown ones are left out.
KNOWN = """SELECT v.visit_id, v.person_id, v.visit_date, p.specialty
FROM IDENTIFIER(:visits) v JOIN IDENTIFIER(:providers) p ON v.provider_id = p.provider_id
WHERE p.specialty IS NOT NULL AND lower(trim(p.specialty)) NOT IN ('', 'unknown')"""

#: How many visits each of the most frequent specialties has.
LARGEST = f"""WITH known AS ({KNOWN})
SELECT specialty, count(*) AS n FROM known GROUP BY specialty ORDER BY n DESC, specialty LIMIT :strata"""

#: So many visits of each of the most frequent specialties, by a repeatable random order.
STRATIFIED = f"""WITH known AS ({KNOWN}), largest AS (SELECT specialty FROM known GROUP BY specialty ORDER BY count(*) DESC, specialty LIMIT :strata),
ranked AS (SELECT k.*, row_number() OVER (PARTITION BY k.specialty ORDER BY md5(concat(k.visit_id, '|', :seed)), k.visit_id) AS r FROM known k LEFT SEMI JOIN largest l ON k.specialty = l.specialty)
SELECT visit_id, person_id, specialty FROM ranked WHERE r <= :quota"""

#: The known specialty of each person's last visit at or before a day.
LATEST = f"""WITH known AS ({KNOWN})
SELECT person_id, max_by(specialty, struct(visit_date, visit_id)) AS specialty FROM known WHERE visit_date <= :day GROUP BY person_id"""


def cohort(spark: SparkSession, query: str, prefix: str, **values) -> DataFrame:
    """One of the queries above over the tables of ``prefix``."""
    return spark.sql(query, args={"visits": f"{prefix}_visits", "providers": f"{prefix}_providers", **values})


def drop(spark: SparkSession, prefix: str) -> None:
    for kind in ("visits", "providers"):
        spark.sql(f"DROP TABLE IF EXISTS {prefix}_{kind}")


def moved(df: DataFrame) -> int:
    """How many shuffles the plan of ``df`` has."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def buckets_of(spark: SparkSession, table: str) -> int:
    rows = spark.sql(f"DESCRIBE EXTENDED {table}").where(F.lower("col_name") == "num buckets").collect()
    return int(rows[0].data_type) if rows else 0
