"""Keyed deduplication, lookups whose duplicates have an order, and resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _kept(rows: DataFrame, key: str, order: list[str], aggregate) -> DataFrame:
    """One row per key by an aggregate with partial sums: a hot key is reduced before it moves."""
    others = [c for c in rows.columns if c != key and c not in order]
    place, whole = F.struct(*order), F.struct(*order, *others)
    picked = rows.groupBy(key).agg(aggregate(whole, place).alias("_row"))
    return picked.select(key, "_row.*").select(*rows.columns)


def keep_first(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; rows without a key share one."""
    return _kept(rows, key, order, F.min_by)


def keep_last(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    return _kept(rows, key, order, F.max_by)


def lookup_last(rows: DataFrame, reference: DataFrame, key: str, value: str, order: list[str], how: str = "left") -> DataFrame:
    """``rows`` with ``value`` from the last reference row of their key; null (or no row, if inner) where there is none."""
    return rows.join(keep_last(reference.select(key, value, *order), key, order).select(key, value), key, how)


def guarded_lookup(rows: DataFrame, reference: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with ``value``; the job fails at a key that the reference lacks."""
    known = reference.select(key, value, F.lit(True).alias("_known")).dropDuplicates([key])
    joined = rows.join(known, key, "left")
    missing = F.raise_error(F.concat(F.lit(f"no {value} for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return joined.withColumn(value, F.when(F.col("_known"), F.col(value)).otherwise(missing)).drop("_known")


def unprocessed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no result yet."""
    return rows.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def rejects(rows: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Rows that an inner join on the key would lose."""
    return rows.join(reference.select(key).distinct(), key, "left_anti")


def instruction_ids(responses: DataFrame, person: str = "person_id", items: str = "response_data") -> DataFrame:
    """(person, position, instruction_id, item): an id for each item from a base per person and its place."""
    base = F.conv(F.substring(F.md5(F.col(person).cast("string")), 1, 8), 16, 10).cast("long") % 8_000_000 + 1_000_000
    return responses.select(person, base.alias("_base"), F.posexplode(items).alias("position", "item")).select(person, "position", (F.col("_base") + F.col("position")).alias("instruction_id"), "item")


def valid_pairs(items: Column) -> Column:
    """The items that have both an instruction and a response; none from a null array."""
    return F.coalesce(F.filter(items, lambda x: x["instruction"].isNotNull() & x["response"].isNotNull()), F.array())


def answer_of(item: Column, *names: str) -> Column:
    """The first of the named fields that an item has a value for: ``output``, else ``response``."""
    return F.coalesce(*[item[n] for n in names or ("output", "response")])


def persons_over(*tables: DataFrame, key: str = "person_id") -> DataFrame:
    """The different keys of several tables; null is none."""
    found = tables[0].select(key)
    for t in tables[1:]:
        found = found.unionByName(t.select(key))
    return found.where(F.col(key).isNotNull()).distinct()


def reference_rows(responses: DataFrame) -> DataFrame:
    """Sampled pairs as reference answers: (instruction_id, filename, question, clinician_response, evidence, flags)."""
    each = instruction_ids(responses.withColumn("response_data", valid_pairs(F.col("response_data"))))
    told = each.where((F.length("item.instruction") > 0) & (F.length("item.response") > 0))
    yes = [F.lit("Yes").alias(c) for c in ("is_applicable", "is_sufficient")]
    return told.select(
        "instruction_id", F.concat(F.lit("EHR_"), F.col("person_id").cast("string"), F.lit(".xml")).alias("filename"), F.col("item.instruction").alias("question"), *yes,
        F.lit("").alias("required_characteristics"), F.col("item.response").alias("clinician_response"), F.col("item.evidence").alias("evidence"), F.lit("Annotator_1").alias("annotator_num"),
    )
