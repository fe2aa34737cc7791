"""Records as tables of nodes, and filters on them.

A record is parsed once, in one pass, into nodes in document order. ``node`` numbers them from 0 and
``last`` is the greatest number in a node's subtree, so "below" is a range: d is below a if
a.node < d.node <= a.last. ``depth`` and ``parent`` (-1 for the root) say where a node hangs. Filters
are predicates over nodes, compiled into column expressions; what they keep is written out again.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import reduce
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from chronoloom.operators.markup import attribute_test, tag_test

_INT, _STRING = T.IntegerType(), T.StringType()
NODE = T.StructType([T.StructField(n, k) for n, k in [("node", _INT), ("last", _INT), ("depth", _INT), ("parent", _INT), ("tag", _STRING), ("attributes", T.MapType(_STRING, _STRING)), ("text", _STRING), ("tail", _STRING)]])

#: Filters by name. Keys that begin with @ name the parent elements, tag prefixes to keep or to drop below them, and how many parents to return; any other key is a tag with conditions on its attributes.
FILTERS = {"all": {"@parent": "visit"}, "codes": {"@parent": "visit", "@exclude_children": ["note"]}, "notes": {"@parent": "visit", "@include_children": ["note"]}}


def _parsed(source: str | None) -> list[dict] | None:
    try:
        root = ET.fromstring(source or "")
    except ET.ParseError:
        return None
    found: list[dict] = []
    stack: list[tuple[ET.Element | None, int, int]] = [(root, 0, -1)]
    while stack:
        element, depth, parent = stack.pop()
        if element is None:
            found[parent]["last"] = len(found) - 1
            continue
        node = len(found)
        found.append({"node": node, "last": node, "depth": depth, "parent": parent, "tag": element.tag, "attributes": list(element.attrib.items()), "text": element.text or "", "tail": element.tail or ""})
        stack.append((None, depth, node))
        stack.extend((child, depth + 1, node) for child in reversed(element))
    return found


#: The same as NODE, for Arrow.
_ARROW_NODE = pa.struct([("node", pa.int32()), ("last", pa.int32()), ("depth", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("tail", pa.string())])
#: Characters of records that are held as nodes at once; nodes are many times as large as their record.
PORTION_CHARS = 1 << 20


def _parsed_portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[list[dict]]]]:
    """(keys, nodes of each record) of the well-formed records of (key, text), some at a time."""
    for batch in batches:
        at, found, size = [], [], 0
        for i, text in enumerate(batch.column(1)):
            source = text.as_py()
            own = _parsed(source)
            if own is not None:
                at.append(i)
                found.append(own)
                size += len(source)
            if size >= PORTION_CHARS:
                yield batch.column(0).take(pa.array(at, pa.int64())), found
                at, found, size = [], [], 0
        if found:
            yield batch.column(0).take(pa.array(at, pa.int64())), found


def node_rows(records: DataFrame, key: str = "person_id", text: str = "text") -> DataFrame:
    """(key, node, last, depth, parent, tag, attributes, text, tail) of every node; malformed records have none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, found in _parsed_portions(batches):
            made = pa.array([n for own in found for n in own], _ARROW_NODE)
            at = pa.array([i for i, own in enumerate(found) for _ in own], pa.int64())
            yield pa.RecordBatch.from_arrays([keys.take(at), *made.flatten()], names=[key, *NODE.names])

    return records.select(key, F.col(text).cast("string")).mapInArrow(rows, T.StructType([records.schema[key], *NODE.fields]))


def _parents(records: DataFrame, tag: str, key: str, text: str) -> DataFrame:
    """(key, visit, _own): each element of a tag, counted from 0 in its record, as its nodes and no others of the record."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, found in _parsed_portions(batches):
            roots = [(i, visit, n) for i, own in enumerate(found) for visit, n in enumerate(n for n in own if n["tag"] == tag)]
            owned = pa.array([found[i][n["node"] : n["last"] + 1] for i, _, n in roots], pa.list_(_ARROW_NODE))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array([i for i, _, _ in roots], pa.int64())), pa.array([v for _, v, _ in roots], pa.int32()), owned], names=[key, "visit", "_own"])

    kind = T.StructType([records.schema[key], T.StructField("visit", _INT), T.StructField("_own", T.ArrayType(NODE))])
    return records.select(key, F.col(text).cast("string")).mapInArrow(cut, kind)


def below(rows: DataFrame, key: str, outer: Column, inner: Column) -> DataFrame:
    """(key, above, node): nodes for which ``inner`` holds, with every node above them for which ``outer`` does, at any depth."""
    a = rows.where(outer).select(F.col(key).alias("_key"), F.col("node").alias("above"), F.col("last").alias("_last"))
    d = rows.where(inner).select(key, "node")
    return d.join(a, d[key].eqNullSafe(a["_key"]) & (d["node"] > a["above"]) & (d["node"] <= a["_last"])).select(key, "above", "node")


def _tested(node: Column, filters: dict) -> Column:
    """Whether a node below a parent stays."""
    kept = tag_test(node["tag"], filters.get("@include_children"), filters.get("@exclude_children"))
    tests = [(node["tag"] != tag) | attribute_test(node["attributes"], conditions) for tag, conditions in filters.items() if not tag.startswith("@")]
    return reduce(lambda a, b: a & b, tests, F.coalesce(kept, F.lit(False)))


def _written(own: list, keep: list) -> str:
    """The first of ``own`` with the nodes below it that stay. Nodes below one that goes move to the end of what is left above it."""
    base = own[0]["node"]
    owners, below_of = {}, {0: []}
    for k, n in enumerate(own[1:], 1):
        parent = n["parent"] - base
        owner = parent if parent == 0 or keep[parent] else owners[parent]
        owners[k] = owner
        if keep[k]:
            below_of[k] = []
            # As the filter goes through the nodes in order, children move when their parent is taken out.
            below_of[owner].append((-1 if owner == parent else parent, k))
    out, stack = [], [(0, False)]
    while stack:
        k, closing = stack.pop()
        n = own[k]
        tail = escape(n["tail"]) if k else ""
        if closing:
            out.append(f"</{n['tag']}>{tail}")
            continue
        attributes = "".join(f" {name}={quoteattr(value)}" for name, value in dict(n["attributes"]).items())
        if not below_of[k] and not n["text"]:
            out.append(f"<{n['tag']}{attributes}/>{tail}")
            continue
        out.append(f"<{n['tag']}{attributes}>{escape(n['text'])}")
        stack.append((k, True))
        stack.extend((c, False) for _, c in sorted(below_of[k], reverse=True))
    return "".join(out)


#: Parents that are written out at once.
PORTION_ROWS = 256


def _markup(cut: DataFrame, key: str) -> DataFrame:
    """(key, visit, text) of parents (key, visit, _own, _keep); those below which nothing is left go."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PORTION_ROWS):
                part = batch.slice(start, PORTION_ROWS)
                texts = [_written(own, keep) if any(keep[1:]) else None for own, keep in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=[key, "visit", "text"])

    kind = T.StructType([cut.schema[key], T.StructField("visit", _INT), T.StructField("text", _STRING)])
    return cut.select(key, "visit", "_own", "_keep").mapInArrow(write, kind).where("text IS NOT NULL")


def filter_trees(records: DataFrame, filters: dict, key: str = "person_id", text: str = "text") -> DataFrame:
    """(key, visit, text): the parent elements of each record as markup of their own, with the nodes that pass the filters.

    ``filters``: see FILTERS. A parent that fails its tag's conditions goes; so does one below which
    nothing is left. A node that goes loses its own text; what is below it stays if it passes and
    moves to the end of its parent. @first or @last keeps so many parents of a record, after that;
    ``visit`` counts the parents of a record from 0 before any goes. Parents are taken to hold no
    parents. Malformed records have no parent (see ``malformed``).
    """
    tag = filters["@parent"]
    cut = _parents(records, tag, key, text)
    passed = cut.where(attribute_test(F.col("_own")[0]["attributes"], filters[tag])) if filters.get(tag) else cut
    found = _markup(passed.withColumn("_keep", F.transform("_own", lambda n: _tested(n, filters))), key)
    n, order = (filters.get("@first"), F.asc("visit")) if filters.get("@first") else (filters.get("@last"), F.desc("visit"))
    if not n:
        return found
    return found.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_rank") <= n).drop("_rank")


@F.pandas_udf(T.BooleanType())
def _well_formed(texts: pd.Series) -> pd.Series:
    return pd.Series([_parsed(x) is not None for x in texts], dtype=bool)


def malformed(records: DataFrame, text: str = "text") -> DataFrame:
    """The records that are no well-formed XML (a repeated attribute is none)."""
    return records.where(~_well_formed(F.col(text)))


_PARTS = T.StructType([T.StructField(n, _STRING) for n in ("empty", "head", "foot")] + [T.StructField("children", T.ArrayType(_STRING))])


def _in_parts(source: str | None) -> dict | None:
    try:
        root = ET.fromstring(source or "")
    except ET.ParseError:
        return None
    children = [ET.tostring(child, encoding="unicode") for child in root]
    empty = ET.tostring(ET.Element(root.tag, root.attrib), encoding="unicode")
    return {"empty": empty, "head": empty.removesuffix(" />") + ">", "foot": f"</{root.tag}>", "children": children}


@F.pandas_udf(_PARTS)
def parts(texts: pd.Series) -> pd.DataFrame:
    """A record's root without anything in it, its start and end tags, and its children, whatever they are; nulls if malformed."""
    found = [_in_parts(x) or dict.fromkeys(("empty", "head", "foot", "children")) for x in texts]
    return pd.DataFrame(found, columns=["empty", "head", "foot", "children"])


def trailing_record(records: DataFrame, text: str, budget: Column, tokenizer: str = "whitespace") -> DataFrame:
    """``records`` with the column ``text`` cut to the root and the last of its children whose tokens together are within the budget.

    Stops at the first that doesn't fit. A declaration and the root's own text go; null and malformed
    records become ''.
    """
    from chronoloom.functions.text import tokenizer_named

    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(acc: Column, size: Column) -> Column:
        fits = acc["open"] & (acc["sum"] + size <= budget)
        return F.struct(F.when(fits, acc["sum"] + size).otherwise(acc["sum"]).alias("sum"), F.when(fits, acc["n"] + 1).otherwise(acc["n"]).alias("n"), fits.alias("open"))

    held = records.withColumn("_parts", parts(F.col(text)))
    held = held.withColumn("_sizes", tokenizer_named(tokenizer).counts(F.col("_parts.children")))
    held = held.withColumn("_n", F.aggregate(F.reverse("_sizes"), start, step, lambda acc: acc["n"]))
    children = F.col("_parts.children")
    kept = F.array_join(F.slice(children, F.size(children) - F.col("_n") + 1, F.col("_n")), "")
    cut = F.when(F.col("_n") == 0, F.col("_parts.empty")).otherwise(F.concat("_parts.head", kept, "_parts.foot"))
    return held.withColumn(text, F.coalesce(cut, F.lit(""))).drop("_parts", "_sizes", "_n")
