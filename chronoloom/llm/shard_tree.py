"""Sharding by a hierarchical weighted hash tree.

A document descends from the root to a region, a rack and a shard. At each level every child draws
``-ln(u) / weight`` with u hashed from the document and the child, and the least draw wins, so a
child is chosen in proportion to its weight, and changing one weight moves documents only into the
child that grew (or out of the child that shrank). Shards added later race once, against the regions,
with draws of their own: a document goes to a late shard if that draw is the least of all, else down
the tree as before. So one more shard takes documents only into itself, and no others move.

Everything is a projection of hashes, then a numbering by bucket; no task sees a whole shard.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import bucket_starts, bucket_sums, let, running_totals, spread


class Tree(NamedTuple):
    """``shards[r][k]`` holds the weights of the shards of rack k in region r; ``late`` those of later shards."""

    shards: tuple[tuple[tuple[float, ...], ...], ...]
    late: tuple[float, ...] = ()

    def grown(self, weight: float = 1.0) -> Tree:
        """The tree with one more shard."""
        return Tree(self.shards, (*self.late, weight))

    @property
    def first_late(self) -> int:
        return sum(len(rack) for region in self.shards for rack in region)


#: Sixteen shards of equal weight: two regions of two racks of four.
SIXTEEN = Tree((((1.0,) * 4,) * 2,) * 2)

_UNIT = float(1 << 52)


def _draw(key: Column, path: Column, weight: Column) -> Column:
    """An exponential draw with rate ``weight`` from the document's key and the node's path."""
    digits = F.substring(F.md5(F.concat(key, F.lit("/"), path)), 1, 13)
    unit = (F.conv(digits, 16, 10).cast("double") + 0.5) / _UNIT
    return F.when(weight > 0, -F.log(unit) / weight)


def _winner(key: Column, path: Column, weights: Column) -> Column:
    """The (draw, index) of the child with the least draw; a child of weight 0 never wins."""
    race = F.transform(weights, lambda w, i: F.struct(_draw(key, F.concat(path, F.lit("."), i.cast("string")), w).alias("draw"), i.alias("at")))
    return F.array_min(F.filter(race, lambda x: x["draw"].isNotNull()))


def _literal(values) -> Column:
    return F.array(*[_literal(v) if isinstance(v, tuple) else F.lit(v) for v in values])


def shard_of(doc_id: Column, tree: Tree) -> Column:
    """The shard number of a document, from its id and the tree alone."""
    key = F.coalesce(doc_id.cast("string"), F.lit("null"))
    racks = tuple(tuple(float(sum(rack)) for rack in region) for region in tree.shards)
    regions = tuple(float(sum(region)) for region in racks)
    sizes = tuple(tuple(len(rack) for rack in region) for region in tree.shards)
    firsts, n = [], 0
    for region in sizes:
        firsts.append([])
        for size in region:
            firsts[-1].append(n)
            n += size
    first = _literal(tuple(map(tuple, firsts)))

    def below(r: Column) -> Column:
        path = F.concat(F.lit("r"), r.cast("string"))

        def shard(k: Column) -> Column:
            leaf = _winner(key, F.concat(path, F.lit("k"), k.cast("string")), F.get(F.get(_literal(tree.shards), r), k))
            return F.get(F.get(first, r), k) + leaf["at"]

        return let(_winner(key, path, F.get(_literal(racks), r))["at"], shard)

    def top(region: Column) -> Column:
        base = let(region["at"], below)
        if not tree.late:
            return base
        late = let(_winner(key, F.lit("late"), _literal(tree.late)), lambda x: F.struct(x["draw"].alias("draw"), (x["at"] + n).alias("at")))
        return let(late, lambda x: F.when(x["draw"] < region["draw"], x["at"]).otherwise(base))

    return let(_winner(key, F.lit("root"), _literal(regions)), top).cast("int")


def place(docs: DataFrame, tree: Tree = SIXTEEN) -> DataFrame:
    """Every row of ``docs`` as doc_id, size, text_crc32, shard and slot.

    size is the text's UTF-8 length plus 1 (null: 1) and text_crc32 its checksum (null: of nothing).
    slot numbers the rows of a shard from 0 without gaps, ordered by a hash of the id, the id, the
    checksum and the size; rows equal in all of these are alike, and which of them comes first is
    open. A null id is a value like any other. The first count reads ids only. An empty table gives
    an empty result; other columns are not looked at.
    """
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"), shard_of(F.col("doc_id"), tree).alias("_key"), spread(F.col("doc_id")).alias("_order"))
    starts = bucket_starts(bucket_sums(rows, F.lit(1).cast("long")))
    placed = running_totals(rows, starts, F.lit(1).cast("long"), [F.col(c) for c in ("doc_id", "text_crc32", "size")], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.col("_key").alias("shard"), "slot")


def place_with_growth(docs: DataFrame, tree: Tree = SIXTEEN) -> DataFrame:
    """``place``, the name of the law that holds, and each row's shard once there is one more."""
    placed = place(docs, tree)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", shard_of(F.col("doc_id"), tree.grown()).alias("grown_shard"))


def _crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes in DuckDB, which has no such function: half a byte at a time."""
    table = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    half = lambda crc, bits: f"xor({table}[(xor({crc}, {bits}) & 15) + 1], ({crc}) >> 4)"
    byte = "CAST('0x' || b AS BIGINT)"
    return f"xor(list_reduce(regexp_extract_all(hex(encode({text})), '..'), lambda acc, b: CAST({half(half('CAST(acc AS BIGINT)', f'{byte} & 15'), f'({byte} >> 4)')} AS VARCHAR), '4294967295')::BIGINT, 4294967295)"


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for the registered query (sixteen shards, one more)."""
    draw = lambda path: f"-ln((CAST('0x' || substr(md5(key || '/' || {path}), 1, 13) AS BIGINT) + 0.5) / {_UNIT!r})"
    pick = lambda path, n, weight: "list_min([" + ", ".join(f"{{'draw': {draw(path + f' || {chr(39)}.{i}{chr(39)}')} / {weight}, 'at': {i}}}" for i in range(n)) + "])"
    return f"""
WITH k AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key FROM {table}),
a AS (SELECT *, {pick("'root'", 2, "8.0")} AS r, {draw("'late.0'")} / 1.0 AS late FROM k),
b AS (SELECT *, {pick("'r' || r.at", 2, "4.0")} AS k FROM a),
c AS (SELECT *, {pick("'r' || r.at || 'k' || k.at", 4, "1.0")} AS s FROM b),
d AS (SELECT *, CAST(8 * r.at + 4 * k.at + s.at AS INTEGER) AS shard FROM c)
SELECT doc_id, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS size, {_crc32_sql("text")} AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5(key), 1, 15) AS BIGINT), doc_id) - 1 AS slot,
       CAST(CASE WHEN late < r.draw THEN 16 ELSE shard END AS INTEGER) AS grown_shard
FROM d"""
