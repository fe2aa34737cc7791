"""Repeatable random order: the md5 of a stable key and a seed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shuffle_key(*keys: Column | str, seed: int | str = 0) -> Column:
    """A hexadecimal digest that orders rows as if at random, alike on every engine."""
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def shuffle_sql(*keys: str, seed: int | str = 0) -> str:
    return "md5(" + " || '|' || ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys) + f" || '|{seed}')"
